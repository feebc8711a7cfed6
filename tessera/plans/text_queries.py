"""Queries over texts, pages and streams: normalisation, extraction, scoring, similarity, learning, windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.functions import links, normalize, quality, repair
from tessera.functions.cells import any_of, share
from tessera.functions.constants import BLOCKED_LINKS, DETAIL_PARTS, LINK_WORDS, PAGE_WORDS
from tessera.operators import ml, reports, search, similar
from tessera.plans.views import table
from tessera.sources import pages as page_source
from tessera.streaming import monitors, ordered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def sql_any(text: str, parts) -> str:
    return "(" + " or ".join(f"contains({text}, '{p}')" for p in parts) + ")"


NORM = """lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)) || rtrim(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/') ||
    coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&'), lambda p: p <> '' and lower(split_part(p, '=', 1)) not in ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid', '_ga', 'ref', 'source')), '&'), ''), '')"""
TITLE = "trim(regexp_extract(html, '<title>([^<]*)</title>', 1))"
PLAIN = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


@query(f"select page_id, {NORM} as normal, rtrim(split_part(split_part(rtrim(url, '/'), '#', 1), '?', 1)) as plain from pages")
def normalize_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", links.normalize_url(F.col("url")).alias("normal"), links.plain_url(F.col("url")).alias("plain"))


@query(f"select page_id, md5(lower({TITLE} || '|' || url)) as by_url, md5(trim(lower({TITLE}) || '|' || lower({NORM}) || '|', '|')) as canonical, sha256(lower({TITLE}) || '|' || url) as dedupe from pages where {TITLE} <> ''")
def canonical_hash(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("title", links.meta_title(F.col("html")))
    p = p.where("title <> ''")
    none = F.lit(None).cast("string")
    t, u = F.col("title"), F.col("url")
    return p.select("page_id", links.title_url_hash(t, u).alias("by_url"), links.canonical_hash(t, u).alias("canonical"), links.dedupe_hash(none, t, none, u).alias("dedupe"))


@query(f"""with a as (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) as href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) as t from pages),
    s as (select page_id, trim(t) as t, href, lower(trim(t)) as l, lower(href) as h from a),
    x as (select page_id, t as text, href, case when t = '' or href = '' or h like 'mailto:%' or href like '#%' or {" or ".join(f"starts_with(l, '{b}')" for b in BLOCKED_LINKS)} then 0 else greatest(0,
        case when {sql_any('h', LINK_WORDS)} then 2.0 else 0 end + case when {sql_any('l', LINK_WORDS)} then 1.5 else 0 end + case when length(t) >= 4 then 0.5 else 0 end + case when length(t) >= 15 then 1.0 else 0 end
        - case when not contains(t, ' ') and t = upper(t) and t <> lower(t) and length(t) < 10 then 2.0 else 0 end - case when contains(t, '@') or t like '%.org' or t like '%.com' then 1.0 else 0 end + case when {sql_any('h', DETAIL_PARTS)} then 1.5 else 0 end) end as score from s)
    select page_id, text, href, cast(score as double) as score, count(*) as n from x where score > 0 group by all""")
def link_scoring(spark, sf_dir):
    """Scored links of every page, without the limit of a page."""
    rows = page_source.link_rows(table(spark, sf_dir, "pages").select("page_id", "html"), most=None)
    return rows.groupBy("page_id", "text", "href", "score").agg(F.count("*").alias("n"))


@query(f"""with t as (select page_id, lower({PLAIN}) as x, lower(url) as u, html from pages)
    select page_id, round(least(1, greatest(0, least(0.4, 0.1 * ({" + ".join(f"cast(contains(x, '{w}') as integer)" for w in PAGE_WORDS)})) + case when {sql_any('u', ['/job', '/career', '/position', '/vacancy', '/opportunity'])} then 0.3 else 0 end
        - case when {sql_any("substr(x, 1, 500)", ['login', 'sign in', 'register', 'homepage', 'about us'])} then 0.2 else 0 end)), 4)::double as score from t""")
def page_classifier(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.round(links.page_score(F.col("html"), F.col("url")), 4).alias("score"))


@query(f"select page_id, {TITLE} as title, substr({PLAIN}, 1, 500) as snippet from pages")
def html_text_snippet(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", links.meta_title(F.col("html")).alias("title"), links.snippet(F.col("html")).alias("snippet"))


@query("""select doc_id, array_to_string(list_sort(list_distinct((regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z|]{2,}'))[:10])), ',') as emails from documents where regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z|]{2,}')""")
def contact_extract(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("emails", links.emails(F.col("text")))
    return d.where(F.size("emails") > 0).select("doc_id", F.array_join(F.array_sort("emails"), ",").alias("emails"))


@query("""with f as (select doc_id, regexp_extract_all(text, '[+]?[0-9 \\t\\n\\r\\f\\-()]{10,}')[:10] as f from documents), t as (select doc_id, list_sort(list_distinct(list_filter(list_transform(f, lambda p: trim(regexp_replace(p, '[ \\t\\n\\r\\f]+', ' ', 'g'))), lambda p: length(p) >= 10))) as phones from f)
    select doc_id, array_to_string(phones, ',') as phones from t where len(phones) > 0""")
def phone_extract(spark, sf_dir):
    """Distinct phone numbers among the first ten found."""
    d = table(spark, sf_dir, "documents").withColumn("phones", links.phones(F.col("text")))
    return d.where(F.size("phones") > 0).select("doc_id", F.array_join(F.array_sort("phones"), ",").alias("phones"))


@query("""with s as (select doc_id, substr(regexp_extract(lower(text), '([0-9]+)', 1), 1, 6) as d, doc_id % 6 as k from documents where regexp_matches(text, '[0-9]')),
    t as (select doc_id, k, case k when 0 then d || ' months' when 1 then d || ' yr' when 2 then '3-' || d || ' month' when 3 then 'Yes' when 4 then '$' || d || ' - $99 per hour' else d || ' EUR monthly' end as x, d from s)
    select doc_id, x, cast(case k when 0 then try_cast(d as integer) when 1 then try_cast(d as integer) * 12 when 2 then try_cast(d as integer) end as integer) as months,
        case when k = 3 then true when try_cast(x as double) is not null then try_cast(x as double) <> 0 end as flag,
        case k when 4 then 'USD' when 5 then 'EUR' else 'USD' end as currency, case k when 3 then null when 4 then 'hourly' when 5 then 'monthly' when 0 then 'salary' when 1 then 'salary' when 2 then 'monthly' end as kind,
        round(case k when 3 then null when 2 then least(3.0, cast(d as double)) when 4 then least(cast(d as double), 99.0) when 5 then cast(d as double) * 1.1 else cast(d as double) end, 4) as low from t""")
def scalar_parsers(spark, sf_dir):
    """Durations, booleans and pay read from strings."""
    d = F.substring(F.regexp_extract(F.lower("text"), "([0-9]+)", 1), 1, 6)
    k = F.col("doc_id") % 6
    x = F.when(k == 0, F.concat(d, F.lit(" months"))).when(k == 1, F.concat(d, F.lit(" yr"))).when(k == 2, F.concat(F.lit("3-"), d, F.lit(" month"))).when(k == 3, "Yes").when(k == 4, F.concat(F.lit("$"), d, F.lit(" - $99 per hour"))).otherwise(F.concat(d, F.lit(" EUR monthly")))
    rows = table(spark, sf_dir, "documents").where(F.col("text").rlike("[0-9]")).select("doc_id", x.alias("x"))
    pay = normalize.compensation(F.col("x"))
    return rows.select("doc_id", "x", normalize.contract_months(F.col("x")).alias("months"), normalize.boolean(F.col("x")).alias("flag"), pay["currency"].alias("currency"), F.when(pay["type"] == "monthly", "monthly").otherwise(pay["type"]).alias("kind"), F.round(pay["min_usd"], 4).alias("low"))


RECORD = """rec as (select d.doc_id, trim(split_part(text, chr(10), 1)) as title, case when d.doc_id % 5 = 0 then '' when d.doc_id % 5 = 1 then 'ftp://x' else 'https://a.org/' || d.doc_id end as url,
    case when d.doc_id % 3 = 0 then null else lang end as place, case when d.doc_id % 4 = 0 then null when d.doc_id % 4 = 1 then '2024-01-01' when d.doc_id % 4 = 2 then 'soon' else '2024-12-31' end as deadline, text as descr, source,
    case when d.doc_id % 2 = 0 then 'KE' end as country, d.doc_id % 7 = 0 as remote from documents d)"""


def _records(spark, sf_dir) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.trim(F.substring_index("text", "\n", 1)).alias("title"), F.when(k % 5 == 0, "").when(k % 5 == 1, "ftp://x").otherwise(F.concat(F.lit("https://a.org/"), k.cast("string"))).alias("url"),
        F.when(k % 3 != 0, F.col("lang")).alias("place"), F.when(k % 4 == 0, None).when(k % 4 == 1, "2024-01-01").when(k % 4 == 2, "soon").otherwise("2024-12-31").alias("deadline"), F.col("text").alias("descr"), "source",
        F.when(k % 2 == 0, "KE").alias("country"), (k % 7 == 0).alias("remote"),
    )


SCORE_SQL = f"""with {RECORD}, f as (select *, case when title = '' then 0 when length(title) >= 5 then 1 else 0.5 end as ft, case when url = '' then 0 when url like 'http%' then 1 else 0.5 end as fu,
    case when place is null then 0 when remote then 1 else 0.7 end as fl, case when deadline is null then 0 when deadline = 'soon' then 0.5 else 1 end as fd, case when trim(descr) = '' then 0 when length(trim(descr)) >= 50 then 1 else 0.5 end as fe,
    case when place is not null and remote then 1 else 0 end as fg, case when country is null then 0 else 1 end as fc from rec),
    s as (select *, cast(0.20 * ft + 0.20 * fu + 0.15 * fl + 0.15 * fd + 0.10 * fe + 0.10 + 0.05 * fg + 0.05 * fc as double) as total from f),
    g as (select doc_id, round(total, 3) as score, case when round(total, 9) >= 0.85 then 'high' when round(total, 9) >= 0.70 then 'medium' when round(total, 9) >= 0.50 then 'low' else 'very_low' end as grade,
    cast(case when ft = 0.5 then 1 else 0 end + case when fu = 0.5 then 1 else 0 end + case when fd = 0.5 then 1 else 0 end + case when place is not null and country is null and not remote then 1 else 0 end + case when deadline = '2024-01-01' then 1 else 0 end as integer) as n_issues from s) """


def _scored(spark, sf_dir) -> DataFrame:
    from datetime import date

    none = F.lit(None).cast("double")
    job = {"title": F.col("title"), "apply_url": F.col("url"), "location_raw": F.col("place"), "latitude": none, "longitude": none, "is_remote": F.col("remote"), "deadline": F.col("deadline"), "description": F.col("descr"), "org_name": F.col("source"), "country": F.col("country")}
    return _records(spark, sf_dir).select("doc_id", quality.quality(job, date(2024, 6, 15)).alias("q"))


@query(SCORE_SQL + "select * from g")
def quality_score_grade(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", F.round("q.score", 3).alias("score"), "q.grade", F.size("q.issues").alias("n_issues"))


@query(SCORE_SQL + "select grade, count(*) as n, round(avg(score), 6) as mean, count(case when n_issues > 0 or grade in ('low', 'very_low') then 1 end) as n_review from g group by 1")
def quality_batch(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.groupBy("q.grade").agg(F.count("*").alias("n"), F.round(F.avg("q.score"), 6).alias("mean"), F.count_if("q.needs_review").alias("n_review"))


@query(SCORE_SQL + "select grade, count(*) as n, min(score) as least, max(score) as most from g group by 1")
def quality_grades(spark, sf_dir):
    """Least and greatest score of each grade."""
    return _scored(spark, sf_dir).groupBy("q.grade").agg(F.count("*").alias("n"), F.round(F.min("q.score"), 3).alias("least"), F.round(F.max("q.score"), 3).alias("most"))


@query(f"""with {RECORD} select doc_id, case when title = '' then 'Missing required field: title' when url = '' then 'Missing required field: apply_url' when length(title) < 5 then 'Title too short (minimum 5 characters): ' || title when url like 'ftp%' then 'Invalid URL scheme' end as error from rec""")
def validation_errors(spark, sf_dir):
    return _records(spark, sf_dir).select("doc_id", quality.upsert_error(F.col("title"), F.col("url")).alias("error"))


@query("""with d as (select doc_id, doc_id % 100 / 100.0 as a, doc_id % 37 / 37.0 as b, doc_id % 3 as k from documents)
    select doc_id, case when k = 0 then '' else array_to_string(list_transform(list_filter(list_sort([{'c': -a, 's': 3}, {'c': -b, 's': 5}, {'c': -0.61, 's': 6}]), lambda x: x.c <= -0.6)[:2], lambda x: x.s), ',') end as goals, cast(k = 0 or a < 0.65 or b < 0.70 as boolean) as low from d""")
def enrichment_rules(spark, sf_dir):
    """Confidence rules over enrichments of which every third is of an operational role."""
    k, a, b = F.col("doc_id") % 3, F.col("doc_id") % 100 / 100.0, F.col("doc_id") % 37 / 37.0
    e = {
        "functional_role": F.when(k == 0, F.array(F.lit("HR, Admin & Ops"))).otherwise(F.array(F.lit("Legal"))), "sdgs": F.array(F.lit(3), F.lit(5), F.lit(6)),
        "sdg_confidences": F.create_map(F.lit("3"), a, F.lit("5"), b, F.lit("6"), F.lit(0.61)), "impact_domain": F.array().cast("array<string>"), "impact_confidences": F.create_map().cast("map<string,double>"),
        "experience_level": F.lit("Officer / Associate"), "experience_confidence": b, "confidence_overall": a,
    }
    r = repair.enrichment_rules(e)
    ranked = F.array_sort(F.transform(r["sdgs"], lambda s: F.struct((-F.element_at(r["sdg_confidences"], s.cast("string"))).alias("c"), s.alias("s"))))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(ranked, lambda x: x["s"].cast("string")), ",").alias("goals"), r["low_confidence"].alias("low"))


@query("""with t as (select l.doc_id, list_filter([case when quality = 1 then 'good' end, case when toxic = 1 then 'toxic' end], lambda x: x is not null) as truth,
    list_filter([case when length(text) > 500 then 'good' end, case when contains(lower(text), 'stupid') then 'toxic' end, case when lang = 'en' then 'english' end], lambda x: x is not null) as guess from labels l join documents d on d.doc_id = l.doc_id),
    m as (select doc_id, len(list_intersect(truth, guess)) as b, len(truth) as t, len(guess) as g from t),
    r as (select doc_id, case when g > 0 then b / g else 0 end as p, case when t > 0 then b / t else 0 end as r from m)
    select doc_id, round(p, 6)::double as p, round(r, 6)::double as r, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6)::double as f1 from r""")
def precision_recall(spark, sf_dir):
    """Precision, recall and F1 of guessed against true labels as sets."""
    l = table(spark, sf_dir, "labels").select("doc_id", F.array_compact(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"))).alias("tags"))
    g = table(spark, sf_dir, "documents").select("doc_id", F.array_compact(F.array(F.when(F.length("text") > 500, "good"), F.when(F.lower("text").contains("stupid"), "toxic"), F.when(F.col("lang") == "en", "english"))).alias("tags"))
    out = reports.accuracy(l, g, "doc_id", ["tags"], [])
    return out.select("doc_id", F.round("tags_metrics.precision", 6).alias("p"), F.round("tags_metrics.recall", 6).alias("r"), F.round("tags_metrics.f1", 6).alias("f1"))


@query(f"select page_id, {TITLE} as title, 'meta' as stage, 0.7::double as confidence from pages where {TITLE} <> ''")
def best_field_by_confidence(spark, sf_dir):
    """The title of highest confidence of every page."""
    p = table(spark, sf_dir, "pages").withColumn("page_id", F.col("page_id").cast("string"))
    best = page_source.best_fields(page_source.field_rows(p)).where("field = 'title'")
    return best.select(F.col("page_id").cast("long").alias("page_id"), F.col("value").alias("title"), "stage", "confidence")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _first_two(table_: dict) -> str:
    found = "list_filter([" + ", ".join(f"case when contains(x, {_quoted(k)}) then {_quoted(v)} end" for k, v in table_.items()) + "], lambda v: v is not null)"
    return f"concat_ws(',', {found}[1], list_filter({found}, lambda v: v <> {found}[1])[1])"


def _first_of(pairs: list) -> str:
    return "case " + " ".join(f"when {' or '.join(f'contains(x, {_quoted(w)})' for w in words)} then {_quoted(v)}" for words, v in pairs) + " else '' end"


@query(f"""with c as (select conv_id, turn, lower(text) as x from conversations where role = 'user')
    select conv_id, turn, coalesce({sql_any('x', C.REMOTE_WORDS)}, false) as is_remote, {_first_of(C.QUERY_LEVELS)} as level, {_first_two(C.QUERY_DOMAINS)} as domains, {_first_two(C.QUERY_ROLES)} as roles, {_first_of([([c], c.title()) for c in C.QUERY_COUNTRIES])} as location from c""")
def plain_queries(spark, sf_dir):
    """Filters guessed from the users' turns. Substrings match inside words, as 'it' does."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    out = search.parse_queries(c.select("conv_id", "turn", "text"), "text")
    return out.select("conv_id", "turn", "is_remote", F.col("experience_level").alias("level"), F.array_join("impact_domain", ",").alias("domains"), F.array_join("functional_role", ",").alias("roles"), "location")


@query()
def similar_docs(spark, sf_dir):
    """The ten documents of the newest 500 that are most like each document, by whole first lines and beginnings.

    A test compares with a loop over all of them; SQL has no such ratio.
    """
    d = table(spark, sf_dir, "documents")
    pairs = similar.similar_to_newest(d, "doc_id", F.substring_index("text", "\n", 1), F.col("text"), [F.desc("doc_id")])
    return similar.top_similar(pairs).select(F.col("a").cast("long").alias("doc_id"), F.col("b").cast("long").alias("like_id"), "similarity", "rank")


@query()
def text_classifier(spark, sf_dir):
    """Trains the text classifier for quality and reports its scores on held-out rows."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("quality").alias("label"))
    training, test = ml.split(rows, "doc_id", "label")
    model = ml.train(training, "text", "label")
    return ml.scores(model.transform(test.withColumn("label", F.col("label").cast("double"))), "label")


WINDOWS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


@query("select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_tumbling(spark, sf_dir):
    """Daily counts as a stream; equal to the batch result."""
    s = monitors.events(spark, f"{sf_dir}/events.parquet")
    out = monitors.windowed(s, "ts", "1 day", keys=("event_type",), n=F.count("*"), total=F.sum("value"))
    return monitors.run_once(out, "complete").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""with w as (select unnest([0, 1, 2, 3]) as k), x as (select time_bucket(interval '15 minutes', ts) - k * interval '15 minutes' as start, event_type from events, w)
    select strftime(start, '%Y-%m-%d %H:%M:%S') as window_start, count(*) as n, count(case when event_type = 'error' then 1 end) as n_failed, count(*) >= 10 and count(case when event_type = 'error' then 1 end) >= 0.1 * count(*) as opens from x group by start""")
def stream_sliding(spark, sf_dir):
    """Failure rate of sliding hours as a stream; equal to the batch result."""
    s = monitors.events(spark, f"{sf_dir}/events.parquet")
    out = monitors.error_windows(s, "ts", F.col("event_type") == "error", "60 minutes", "15 minutes")
    got = monitors.run_once(out, "complete")
    return got.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n", "n_failed", "opens")


@query("select distinct user_id from events")
def stream_dedupe(spark, sf_dir):
    """Keys seen, once each, behind a watermark that spans the data."""
    s = monitors.events(spark, f"{sf_dir}/events.parquet", watermark="60 days")
    return monitors.run_once(monitors.first_seen(s, ["user_id"]).select("user_id"))


@query()
def stateful_breaker(spark, sf_dir):
    """When each user's breaker opens, day by day. A test compares with a loop over the events."""
    s = monitors.events(spark, f"{sf_dir}/events.parquet")
    s = s.withColumn("k", F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")))
    return monitors.run_breaker(s, "k", "ts", F.col("event_type") == "error", window_s=86400, least_calls=2)


@query()
def stateful_buckets(spark, sf_dir):
    """How many calls of each event type and hour a token bucket lets pass (T4). A test compares with a loop."""
    s = monitors.events(spark, f"{sf_dir}/events.parquet")
    s = s.withColumn("k", F.concat_ws("/", "event_type", F.date_format("ts", "yyyy-MM-dd HH")))
    out = monitors.run_once(monitors.token_bucket(s, "k", "ts", 1.0, 1 / 1800), rocksdb=True)
    return out.groupBy("key").agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"))


def calls(spark, sf_dir):
    """The events as calls to eight services, 500 times as fast as they came, so that minutes hold many."""
    s = monitors.events(spark, f"{sf_dir}/events.parquet", watermark=None)
    at = F.lit(1.7e9) + (F.col("ts").cast("double") - 1.7e9) / 500
    return s.select((F.col("user_id") % 8).alias("service"), "event_type", at.cast("timestamp").alias("ts")).withWatermark("ts", "30 seconds")


@query()
def breaker_changes(spark, sf_dir):
    """When each service's breaker opens, is tried and closes: 300 seconds, 10 calls, a tenth, 60 seconds.

    Minutes that the watermark has not passed at the end stay open. A test compares with a loop over the events.
    """
    out = ordered.timed_breaker(calls(spark, sf_dir), "service", "ts", F.col("event_type") == "error")
    return monitors.run_once(out, rocksdb=True)


@query()
def bucket_passes(spark, sf_dir):
    """Which calls of each service a token bucket lets pass, in order of event time (T4). A test compares with a loop."""
    out = monitors.run_once(ordered.timed_bucket(calls(spark, sf_dir), "service", "ts", 3.0, 0.02), rocksdb=True)
    return out.groupBy("key").agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"))


@query("select user_id, count(*) as n, cast(sum(case when event_type = 'error' then 1 else 0 end) as bigint) as n_failed from events group by 1")
def stream_upserts(spark, sf_dir):
    """Counters per source kept by upserts of micro-batches; equal to the batch result (T5)."""
    s = monitors.events(spark, f"{sf_dir}/events.parquet")
    return monitors.run_upserts(s, "user_id", {"n": F.count("*"), "n_failed": F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0))})
