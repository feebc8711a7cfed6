"""Queries of the administration: listings, dashboards, maintenance, inserts and deletions, sources and feeds."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.functions import normalize, quality
from tessera.operators import admin, reports, search, state
from tessera.plans.views import AS_OF, JOBS_AS_OF, JOBS_SQL, LOGS_SQL, jobs, logs, table
from tessera.session import shared_dir
from tessera.sources import feeds, nodes, plugins
from tessera.sources import pages as page_source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DAY = date.fromisoformat(JOBS_AS_OF)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Orders as enriched records.
ENRICHED_SQL = """enriched as (
    select cast(k as varchar) as id, o_custkey as source_id, o_orderpriority as title, case when k % 6 <> 0 then o_orderdate end as enriched_at, case when k % 6 <> 0 then k % 100 / 100.0 end as confidence_overall,
        case k % 4 when 0 then 'Early / Junior' when 1 then 'Officer / Associate' when 2 then 'Specialist / Advisor' end as experience_level, k % 37 / 37.0 as experience_confidence,
        case k % 5 when 0 then ['Health', 'WASH'] when 1 then ['Education'] when 2 then cast([] as varchar[]) when 3 then ['WASH'] end as impact_domain, k % 9 = 0 as low_confidence, o_totalprice as amount, k
    from (select *, o_orderkey as k from orders)
)"""
#: Events as reviews of the records.
REVIEWS_SQL = """reviews as (
    select event_id as review_id, cast(user_id as varchar) as job_id, case event_type when 'error' then 'pending' when 'click' then 'approved' else 'needs_review' end as status, ts as created_at, cast(event_id % 97 as varchar) as reviewer from events
)"""
#: Events as extraction logs and as failed inserts.
EXTRACTIONS_SQL = """extractions as (
    select event_id as id, user_id as source_id, 'https://a.org/' || (event_id % 50) as url, case event_id % 4 when 0 then 'OK' when 1 then 'PARTIAL' when 2 then 'EMPTY' else 'DB_FAIL' end as status, event_type as reason, ts as created_at,
        cast(floor(value) as bigint) as found, cast(floor(value * 0.9) as bigint) as stored from events
)"""
FAILURES_SQL = """failures as (
    select event_id as id, user_id as source_id, 'https://a.org/' || (event_id % 50) as source_url, event_type as operation, props as error, ts as attempt_at, case when event_id % 3 = 0 then ts end as resolved_at from events where event_type <> 'view'
)"""


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, o = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    done = k % 6 != 0
    domains = F.when(k % 5 == 0, F.array(F.lit("Health"), F.lit("WASH"))).when(k % 5 == 1, F.array(F.lit("Education"))).when(k % 5 == 2, F.array().cast("array<string>")).when(k % 5 == 3, F.array(F.lit("WASH")))
    return o.select(
        k.cast("string").alias("id"), F.col("o_custkey").alias("source_id"), F.col("o_orderpriority").alias("title"), F.when(done, F.col("o_orderdate")).alias("enriched_at"), F.when(done, k % 100 / 100.0).alias("confidence_overall"),
        F.when(k % 4 == 0, "Early / Junior").when(k % 4 == 1, "Officer / Associate").when(k % 4 == 2, "Specialist / Advisor").alias("experience_level"), (k % 37 / 37.0).alias("experience_confidence"),
        domains.alias("impact_domain"), (k % 9 == 0).alias("low_confidence"), F.col("o_totalprice").alias("amount"), k.alias("k"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "pending").when(F.col("event_type") == "click", "approved").otherwise("needs_review")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("review_id"), F.col("user_id").cast("string").alias("job_id"), status.alias("status"), F.col("ts").alias("created_at"), (F.col("event_id") % 97).cast("string").alias("reviewer"))


def _url() -> Column:
    return F.concat(F.lit("https://a.org/"), (F.col("event_id") % 50).cast("string"))


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v = F.col("event_id") % 4, F.col("value")
    status = F.when(k == 0, "OK").when(k == 1, "PARTIAL").when(k == 2, "EMPTY").otherwise("DB_FAIL")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("source_id"), _url().alias("url"), status.alias("status"), F.col("event_type").alias("reason"), F.col("ts").alias("created_at"), F.floor(v).alias("found"), F.floor(v * 0.9).alias("stored"))


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type <> 'view'")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("source_id"), _url().alias("source_url"), F.col("event_type").alias("operation"), F.col("props").alias("error"), F.col("ts").alias("attempt_at"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("resolved_at"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def day(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


# Listings and details.


@query("select o_orderkey, o_totalprice from orders where o_totalprice >= 100000 and o_totalprice <= 200000 and o_orderdate >= timestamp '1996-01-01'")
def range_filters(spark, sf_dir):
    """Ranges with either end open."""
    return admin.in_ranges(table(spark, sf_dir, "orders"), {"o_totalprice": (100_000.0, 200_000.0), "o_orderdate": ("1996-01-01", None)}).select("o_orderkey", "o_totalprice")


@query(f"with {REVIEWS_SQL} select job_id, review_id, status, rank from (select *, cast(row_number() over (partition by job_id order by created_at desc, review_id desc) as integer) as rank from reviews) where rank <= 2")
def history_newest_first(spark, sf_dir):
    """The two newest entries of every record's history at once."""
    return admin.history(reviews(spark, sf_dir), "job_id", "created_at", "review_id", 2).select("job_id", "review_id", "status", "rank")


@query(f"with {FAILURES_SQL} select id, source_id, operation, error from failures where resolved_at is null and operation = 'error' order by attempt_at desc, id limit 100")
def unresolved_failures(spark, sf_dir):
    """Unresolved failures of one operation, newest first (P25)."""
    return admin.failed_inserts(failures(spark, sf_dir), "attempt_at", "id", operation="error", source_id=None).select("id", "source_id", "operation", "error")


@query("select c_name as id, case when c_name = 'Customer#000000012' then 'exact' when lower(c_name) = 'customer#000000012' then 'case' when starts_with(c_name, 'Customer') then 'prefix' else 'part' end as found_by from customer where starts_with(c_name, 'Customer') or contains(lower(c_name), 'customer#000000012')")
def id_diagnostics(spark, sf_dir):
    """How an id is found: exactly, in another case, by prefix or as a part."""
    return admin.diagnose(table(spark, sf_dir, "customer"), "c_name", "Customer#000000012")


@query(f"with {JOBS_SQL} select id, coalesce(apply_url, '') as url, title as title_value, org_name as employer_value, strftime(deadline, '%Y-%m-%d') as deadline_value, 'database' as source, strftime(created_at, '%Y-%m-%dT%H:%M:%S') as extracted_at, md5(id) as dedupe_hash from jobs where deleted_at is null")
def canonical_payload(spark, sf_dir):
    """Stored rows as nested extraction results, flattened for comparison."""
    fields = {"title": F.col("title"), "employer": F.col("org_name"), "deadline": day("deadline")}
    j = jobs(spark, sf_dir).where("deleted_at is null").select("id", admin.payload(fields, F.col("apply_url"), F.md5("id"), F.col("created_at").cast("timestamp")).alias("p"))
    return j.select("id", "p.url", F.col("p.fields.title.value").alias("title_value"), F.col("p.fields.employer.value").alias("employer_value"), F.col("p.fields.deadline.value").alias("deadline_value"), F.col("p.fields.title.source").alias("source"), "p.extracted_at", "p.dedupe_hash")


@query(f"with {JOBS_SQL} select id, title as raw_level, case when title like '1%' then 'senior' end as level, work_modality as modality, case when title not like '1%' then 'level' else '' end as dropped from jobs")
def normalize_preview(spark, sf_dir):
    """Raw values beside normalised ones and the fields that were dropped."""
    j = jobs(spark, sf_dir)
    raw = {"level": F.regexp_replace("title", "^1-.*", "Sr."), "modality": F.upper("work_modality")}
    done = {"level": normalize.level(raw["level"]), "modality": normalize.modality(raw["modality"])}
    p = j.select("id", F.col("title").alias("raw_level"), admin.preview(raw, done).alias("p"))
    return p.select("id", "raw_level", F.col("p.normalized.level").alias("level"), F.col("p.normalized.modality").alias("modality"), F.array_join("p.dropped", ",").alias("dropped"))


@query(f"with {JOBS_SQL} select id from jobs where status = 'active' and deleted_at is null and (deadline is null or deadline >= date '{JOBS_AS_OF}') and work_modality = 'remote' and level_norm = 'senior'")
def collection_preset(spark, sf_dir):
    """A named filter set with the user's own filters, of which those of the set hold."""
    request = search.with_collection("remote", {"level_norm": "sr.", "work_modality": "onsite"})
    return search.matches(jobs(spark, sf_dir).withColumn("description_snippet", F.lit("")), request, DAY).select("id")


@query(f"with {JOBS_SQL} select 'active' as mode, count(*) as n from jobs where deleted_at is null union all select 'deleted', count(*) from jobs where deleted_at is not null union all select 'all', count(*) from jobs")
def status_modes(spark, sf_dir):
    """Active, deleted or all records (P10)."""
    j = jobs(spark, sf_dir)
    return reports.union([search.by_status(j, m).agg(F.count("*").alias("n")).select(F.lit(m).alias("mode"), "n") for m in ("active", "deleted", "all")])


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls first, o_orderkey limit 25")
def sort_by_known_column(spark, sf_dir):
    """Order by a column that the caller names, if it is known."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return search.ordered(o, {"price": "o_totalprice", "date": "o_orderdate"}, "price", True, "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("select cast(ceil(count(*) / 20.0) as bigint) as pages from orders")
def page_total(spark, sf_dir):
    """Number of pages."""
    return table(spark, sf_dir, "orders").agg(F.ceil(F.count("*") / 20).alias("pages"))


@query("select doc_id, coalesce(length(text), 0) as n from documents order by n desc, doc_id limit 20")
def order_by_expression(spark, sf_dir):
    """Order by a computed expression."""
    n = F.coalesce(F.length("text"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n")).orderBy(F.desc("n"), "doc_id").limit(20)


@query("with h as (select page_id, url, lower(regexp_extract(url, '://([^/?#:]*)', 1)) as host from pages) select page_id, host, case when host like '%.example.org' then 5 else 1 end as delay from h")
def host_policies(spark, sf_dir):
    """Each url with its host's policy, defaults for hosts without one."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    known = p.select(F.lower(F.regexp_extract("url", r"://([^/?#:]*)", 1)).alias("host")).distinct().where("host like '%.example.org'").withColumn("delay", F.lit(5))
    return search.policies(p, known, {"delay": 1}).select("page_id", "host", "delay")


@query("select page_id, (('0x' || substr(md5(url), 17, 16))::ubigint::hugeint + ('0x' || substr(md5(url), 1, 16))::ubigint::hugeint % 100 * 16) % 100 < 30 or regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www[.]', '') = 'blog.example.org' as on_ from pages")
def percentage_rollout(spark, sf_dir):
    """A repeatable share of urls, and listed hosts (P21, P22). 2**64 is 16 modulo 100."""
    return table(spark, sf_dir, "pages").select("page_id", search.rolled_out(F.col("url"), 30, ["blog.example.org"]).alias("on_"))


# Joins.


@query(f"with {JOBS_SQL}, {REVIEWS_SQL} select review_id, job_id, title, org_name from reviews join jobs on id = job_id where reviews.status = 'pending' order by reviews.created_at, review_id limit 50")
def review_queue(spark, sf_dir):
    """Pending reviews with their records, oldest first."""
    r = reviews(spark, sf_dir).where("status = 'pending'").select("review_id", "job_id", F.col("created_at").alias("asked_at"))
    joined = r.join(jobs(spark, sf_dir).select("id", "title", "org_name"), F.col("job_id") == F.col("id"))
    return joined.orderBy("asked_at", "review_id").limit(50).select("review_id", "job_id", "title", "org_name")


@query(f"with {EXTRACTIONS_SQL} select id, status, c_name as source_name from extractions left join customer on c_custkey = source_id and c_acctbal > 5000 where status <> 'OK'")
def failures_with_sources(spark, sf_dir):
    """Failed extractions with their sources, kept where the source is gone."""
    c = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select("c_custkey", F.col("c_name").alias("source_name"))
    return extractions(spark, sf_dir).where("status <> 'OK'").join(c, F.col("source_id") == F.col("c_custkey"), "left").select("id", "status", "source_name")


@query("select s_suppkey, (select n_nationkey from nation where n_name = 'NATION_' || (s_suppkey % 30)) as nation_key from supplier")
def scalar_subselect(spark, sf_dir):
    """A foreign key looked up by name for each inserted row, null where the name is unknown."""
    n = table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").alias("nation_key"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("NATION_"), (F.col("s_suppkey") % 30).cast("string")).alias("name"))
    return s.join(n, F.col("name") == F.col("n_name"), "left").select("s_suppkey", "nation_key")


@query("select event_type as value, count(*) as n from events where event_type not in (select * from (values ('click'), (null)) t(k)) group by 1")
def not_in_with_null(spark, sf_dir):
    """NOT IN against keys of which one is null finds nothing."""
    known = spark.createDataFrame([("click",), (None,)], "key string")
    return reports.unknown_tags(table(spark, sf_dir, "events").select(F.array("event_type").alias("tags")), "tags", known, "key", null_aware=True)


# Dashboards and reports.


@query(f"with {ENRICHED_SQL} select count(*) as total, count(enriched_at) as enriched, round(avg(confidence_overall), 6) as mean, count(case when low_confidence then 1 end) as low, round(100.0 * count(enriched_at) / count(*), 6) as percent from enriched")
def enrichment_overall(spark, sf_dir):
    """The dashboard's totals."""
    return rounded(admin.enrichment_overall(enriched(spark, sf_dir)), "mean", "percent")


@query(f"with {ENRICHED_SQL} select experience_level as value, count(*) as n, round(avg(experience_confidence), 6) as mean from enriched where experience_level is not null group by 1")
def experience_distribution(spark, sf_dir):
    """Levels with their mean confidence."""
    return rounded(admin.distribution_with_mean(enriched(spark, sf_dir), "experience_level", "experience_confidence"), "mean")


@query(f"with {ENRICHED_SQL} select value, count(*) as n, round(avg(confidence_overall), 6) as mean from (select unnest(impact_domain) as value, confidence_overall from enriched) group by 1 order by n desc, value limit 20")
def domain_distribution(spark, sf_dir):
    """The 20 most frequent domains."""
    return rounded(admin.distribution_with_mean(enriched(spark, sf_dir), "impact_domain", "confidence_overall", explode=True, top=20), "mean")


@query(f"with {REVIEWS_SQL} select status, count(*) as n from reviews group by 1")
def review_counts(spark, sf_dir):
    """Reviews by status."""
    return reviews(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query(f"with {LOGS_SQL} select strftime(ran_at, '%Y-%m-%d') as day, count(*) as n, round(avg(value), 6) as mean from logs where ran_at >= timestamp '{AS_OF}' - interval 7 day group by 1")
def recent_activity(spark, sf_dir):
    """Rows and mean a day of the last week."""
    out = admin.daily_mean(logs(spark, sf_dir), "ran_at", "value", AS_OF, 7)
    return rounded(out.withColumn("day", day("day")), "mean")


FEEDBACK_SQL = "feedback as (select event_type as field, 'v' || (event_id % 3) as original, 'v' || (event_id % 4) as corrected, ts as made from events where event_id % 3 <> event_id % 4)"


@query(f"with {FEEDBACK_SQL} select field, original, corrected, count(*) as n, strftime(max(made), '%Y-%m-%d %H:%M:%S') as last_at from feedback group by all order by n desc, max(made) desc, field, original, corrected limit 20")
def feedback_patterns(spark, sf_dir):
    """The most frequent corrections."""
    k = F.col("event_id")
    f = table(spark, sf_dir, "events").where(k % 3 != k % 4).select(F.col("event_type").alias("field"), F.concat(F.lit("v"), (k % 3).cast("string")).alias("original"), F.concat(F.lit("v"), (k % 4).cast("string")).alias("corrected"), F.col("ts").alias("at"))
    return admin.feedback_patterns(f).withColumn("last_at", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss"))


@query(f"with {REVIEWS_SQL} select count(*) as n, count(distinct reviewer) as labelers, strftime(min(created_at), '%Y-%m-%d') as first_at, strftime(max(created_at), '%Y-%m-%d') as last_at from reviews")
def ground_truth_stats(spark, sf_dir):
    """Labels, labelers, first and last day."""
    out = admin.ground_truth_stats(reviews(spark, sf_dir), "reviewer", "created_at")
    return out.withColumns({c: day(c) for c in ("first_at", "last_at")})


@query(f"with {ENRICHED_SQL} select source_id, count(*) as n, (select count(distinct v) from (select unnest(impact_domain) as v, source_id as s from enriched) where s = source_id) as n_values from enriched group by 1")
def distinct_domains(spark, sf_dir):
    """Records and distinct domains of each source; records do not multiply by their domains."""
    return admin.distinct_values(enriched(spark, sf_dir), "source_id", "impact_domain")


@query(f"""with {ENRICHED_SQL}, p as (select a.id as a, b.id as b from enriched a join enriched b on b.k = a.k + 1 or b.k = a.k + 2), sides as (select a, b from p union all select b, a from p)
    select x.id, count(*) as n, round(avg(cast(coalesce(list_has_any(x.impact_domain, y.impact_domain), false) as integer)), 6)::double as overlap, round(avg(cast(x.experience_level is not distinct from y.experience_level as integer)), 6)::double as same_level,
    round((avg(cast(coalesce(list_has_any(x.impact_domain, y.impact_domain), false) as integer)) + avg(cast(x.experience_level is not distinct from y.experience_level as integer))) / 2, 6)::double as score
    from sides join enriched x on x.id = a join enriched y on y.id = b group by 1""")
def label_consistency(spark, sf_dir):
    """How far records agree with the similar ones, here those of the next two keys."""
    e = enriched(spark, sf_dir)
    right = e.select(F.col("id").alias("b"), F.explode(F.array(F.col("k") - 1, F.col("k") - 2)).alias("k_a"))
    pairs = e.select(F.col("id").alias("a"), "k").join(right, F.col("k") == F.col("k_a")).select("a", "b")
    return rounded(admin.consistency(pairs, e, "id", "impact_domain", "experience_level"), "overlap", "same_level", "score")


@query("select 'nation' as name, count(*) as n from nation union all select 'region', count(*) from region union all select 'supplier', count(*) from supplier")
def lookup_counts(spark, sf_dir):
    """Rows of the lookup tables."""
    return admin.row_counts({n: table(spark, sf_dir, n) for n in ("nation", "region", "supplier")})


@query("select event_type as field, user_id % 3 as source, case when value > 50 then 'ok' else 'empty' end as status, count(*) as n from events group by all")
def field_counters(spark, sf_dir):
    """Extractions by field, source and status."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("field"), (F.col("user_id") % 3).alias("source"), F.when(F.col("value") > 50, "ok").otherwise("empty").alias("status")).agg(F.count("*").alias("n"))


@query("select c_custkey, count(o_orderkey) as n, strftime(max(o_orderdate), '%Y-%m-%d') as latest from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'F' group by 1")
def counts_with_latest(spark, sf_dir):
    """Records of each source and the latest day."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return admin.counts_with_latest(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", o, "o_custkey", "o_orderdate").withColumn("latest", day("latest"))


@query(f"with {ENRICHED_SQL} select id from enriched where enriched_at is null order by k desc limit 100")
def unenriched(spark, sf_dir):
    """The newest records without enrichment."""
    return enriched(spark, sf_dir).where("enriched_at is null").orderBy(F.desc("k")).limit(100).select("id")


@query(f"with {EXTRACTIONS_SQL}, s as (select source_id, cast(sum(found) as bigint) as found, cast(sum(stored) as bigint) as stored from extractions group by 1) select *, round(100.0 * (found - stored) / found, 6) as mismatch from s where found > 0 and 100.0 * (found - stored) / found > 10.2")
def flagged_sources(spark, sf_dir):
    """Sources that store too few of the records found."""
    s = extractions(spark, sf_dir).groupBy("source_id").agg(F.sum("found").alias("found"), F.sum("stored").alias("stored"))
    return rounded(admin.flagged(s, "found", "stored", 10.2), "mismatch")


@query(f"with {EXTRACTIONS_SQL} select count(*) as n, count(case when status in ('OK', 'PARTIAL') then 1 end) as n_good, round(100.0 * count(case when status in ('OK', 'PARTIAL') then 1 end) / count(*), 6) as rate, 100.0 * count(case when status in ('OK', 'PARTIAL') then 1 end) / count(*) >= 45 as passed from extractions where created_at >= timestamp '{AS_OF}' - interval 7 day")
def extraction_accuracy(spark, sf_dir):
    """Share of good extractions of the last week."""
    return rounded(admin.accuracy_rate(extractions(spark, sf_dir), "created_at", F.col("status").isin("OK", "PARTIAL"), AS_OF, 7, 45.0), "rate")


@query(f"with {EXTRACTIONS_SQL} select status, count(*) as n, round(100.0 * count(*) / (select count(*) from extractions), 6) as percent from extractions group by 1")
def extraction_statuses(spark, sf_dir):
    """Histogram of extraction statuses."""
    return rounded(reports.distribution(extractions(spark, sf_dir), "status"), "percent")


@query(f"with {JOBS_SQL} select count(*) as total_jobs, count(distinct apply_url) as unique_urls, count(case when apply_url is null then 1 end) as null_urls, count(case when contains(apply_url, '/jobs') then 1 end) as listing_urls from jobs where deleted_at is null")
def quality_report_global(spark, sf_dir):
    """The same report over everything."""
    return reports.url_report(jobs(spark, sf_dir).where("deleted_at is null"), None, C.LISTING_GLOBAL).select("total_jobs", "unique_urls", "null_urls", "listing_urls")


@query("""with t as (select event_id, ts, value * 10 as latency_ms, case when event_type = 'error' then 'db' else 'index' end as source from events order by ts desc, event_id desc limit 100)
    select count(*) as n, round(avg(latency_ms), 4) as mean_latency_ms, count(case when source = 'index' then 1 end) as n_index, count(case when source = 'db' then 1 end) as n_db, round(100.0 * count(case when source = 'index' then 1 end) / count(*), 6)::double as hit_rate, round(100.0 * count(case when source = 'db' then 1 end) / count(*), 6)::double as fallback_rate from t""")
def query_analytics(spark, sf_dir):
    """Latency, hit rate and fallback rate of the last 100 queries."""
    t = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("timestamp"), (F.col("value") * 10).alias("latency_ms"), F.when(F.col("event_type") == "error", "db").otherwise("index").alias("source"))
    out = reports.query_metrics(t, tie="event_id")
    return rounded(out, "hit_rate", "fallback_rate").withColumn("mean_latency_ms", F.round("mean_latency_ms", 4))


@query("""with m as (select ts, case when event_type = 'error' then 'failed' else 'inserted' end as kind, event_id % 4 as c from events where ts >= timestamp '2024-01-30' - interval 60 minute),
    s as (select coalesce(cast(sum(case when kind = 'failed' then c end) as bigint), 0) as failed, coalesce(cast(sum(case when kind = 'inserted' then c end) as bigint), 0) as inserted from m)
    select failed, inserted, round(coalesce(100.0 * failed / nullif(failed + inserted, 0), 0), 6)::double as rate, coalesce(100.0 * failed / nullif(failed + inserted, 0), 0) > 5 as alert from s""")
def failure_rate_hour(spark, sf_dir):
    """Failures among the attempts of an hour, with the alert."""
    m = table(spark, sf_dir, "events").select(F.col("ts").alias("timestamp"), F.when(F.col("event_type") == "error", "failed").otherwise("inserted").alias("type"), (F.col("event_id") % 4).alias("count"))
    return rounded(reports.failure_rate(m, "2024-01-30", 60, 5.0), "rate")


@query("select count(*) as n, count(case when c_custkey % 5 = 0 or c_custkey % 3 = 0 then 1 end) as n_due, count(case when c_custkey % 7 = 0 then 1 end) as n_locked from customer")
def due_counts(spark, sf_dir):
    """Sources, due ones and locked ones."""
    k = F.col("c_custkey")
    s = table(spark, sf_dir, "customer").select(F.when(k % 5 == 0, None).when(k % 3 == 0, F.lit("2024-01-01")).otherwise(F.lit("2024-03-01")).cast("timestamp").alias("next_run_at"), (k % 7 == 0).alias("locked"))
    return s.agg(F.count("*").alias("n"), F.count_if(search.due(AS_OF)).alias("n_due"), F.count_if("locked").alias("n_locked"))


# Inserts, deletions and maintenance.


@query("select c_custkey, c_name from customer where c_custkey % 3 <> 0 union all select c_custkey, upper(c_name) from customer where c_custkey % 3 = 0 and c_custkey % 2 = 0")
def insert_if_absent(spark, sf_dir):
    """Rows whose key is stored already change nothing (K3 to K5, K7)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return state.insert_new(c.where("c_custkey % 3 <> 0"), c.where("c_custkey % 2 = 0").withColumn("c_name", F.upper("c_name")), ["c_custkey"])


@query("select 'stays' as what, count(*) as n from orders where not (o_orderstatus = 'P' and o_totalprice > 100000) union all select 'goes: too dear', count(*) from orders where o_orderstatus = 'P' and o_totalprice > 100000")
def hard_deletion(spark, sf_dir):
    """Rows that stay and rows that go, with the reason."""
    stay, go = state.hard_delete(table(spark, sf_dir, "orders"), (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 100_000), "too dear")
    counted = go.groupBy("deletion_reason").agg(F.count("*").alias("n")).select(F.concat(F.lit("goes: "), "deletion_reason").alias("what"), "n")
    return stay.agg(F.count("*").alias("n")).select(F.lit("stays").alias("what"), "n").unionByName(counted)


@query(f"with {JOBS_SQL} select id from jobs where deadline is null or deadline >= date '{JOBS_AS_OF}'")
def expired_cleanup(spark, sf_dir):
    """Records that are not past their deadline."""
    return state.without_expired(jobs(spark, sf_dir), JOBS_AS_OF).select("id")


@query(f"with {JOBS_SQL} select id from jobs where org_name ilike '%build%' or source_id in (select cast(c_custkey as varchar) from customer where c_name ilike '%build%' or c_custkey % 10 = 0)")
def organisation_deletion(spark, sf_dir):
    """Records that name an organisation or come from one of its sources."""
    k = F.col("c_custkey")
    sources = table(spark, sf_dir, "customer").select(k.cast("string").alias("id"), F.when(k % 10 == 0, "Rebuild").otherwise(F.col("c_name")).alias("org_name"))
    return state.of_organisation(jobs(spark, sf_dir), sources, "build").select("id")


@query("select l_orderkey, l_linenumber from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus <> 'F')")
def source_cascade(spark, sf_dir):
    """Children without those whose parent went."""
    left = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    return state.cascade(left, table(spark, sf_dir, "lineitem"), "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")


@query(f"""with {REVIEWS_SQL} select review_id as id, case when review_id % 4 = 0 then 'approved' when review_id % 4 = 1 then 'later' else status end as status, case when review_id % 4 = 0 then 'fine' end as review_notes,
    case when review_id % 4 = 0 then '2024-01-01' end as reviewed_on from reviews""")
def review_decisions(spark, sf_dir):
    """Reviews after decisions on half of them."""
    r = reviews(spark, sf_dir).select(F.col("review_id").alias("id"), "status", F.lit(None).cast("string").alias("review_notes"), F.lit(None).cast("timestamp").alias("reviewed_at"))
    k = F.col("id") % 4
    decisions = r.where(k < 2).select("id", F.when(k == 0, "approved").otherwise("later").alias("new_status"), F.when(k == 0, "fine").alias("new_notes"), F.lit("2024-01-01").cast("timestamp").alias("at"))
    return state.review_update(r, decisions).select("id", "status", "review_notes", day("reviewed_at").alias("reviewed_on"))


@query("select url from (select distinct 'https://a.org/' || (event_id % 700) as url, event_id % 700 as k from events) where k % 5 <> 0 and k % 7 <> 0")
def new_submissions(spark, sf_dir):
    """Submitted urls that no source and no earlier submission has."""
    k = F.col("event_id") % 700
    all_urls = table(spark, sf_dir, "events").select(k.alias("k"), F.concat(F.lit("https://a.org/"), k.cast("string")).alias("url"))
    known, earlier = all_urls.where("k % 5 = 0").select(F.col("url").alias("careers_url")), all_urls.where("k % 7 = 0").select("url")
    return state.submissions(all_urls.select("url"), known, earlier)


@query(f"""with {EXTRACTIONS_SQL}, {FAILURES_SQL} select kind, count(*) as n, count(distinct url) as urls from (select 'extraction' as kind, url from extractions where status <> 'OK' and created_at >= timestamp '{AS_OF}' - interval 10 day
    union all select 'insert', source_url from failures where attempt_at >= timestamp '{AS_OF}' - interval 10 day) group by 1""")
def failure_report(spark, sf_dir):
    """Failed extractions and inserts of ten days under common columns, counted."""
    rows = state.failure_rows(extractions(spark, sf_dir), failures(spark, sf_dir), AS_OF, 10)
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("url").alias("urls"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders order by o_orderdate desc nulls last, o_orderkey limit 10000")
def export_newest(spark, sf_dir):
    """The rows of an export: the newest 10 000, its own limit."""
    return state.newest(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey").select("o_orderkey", day("o_orderdate").alias("day"))


@query("select doc_id, case when length(text) > 80 then substr(text, 1, 80) || '...' else text end as message, length(text) > 80 as truncated from documents")
def log_truncation(spark, sf_dir):
    """Messages of a log, cut where they are too long."""
    return admin.log_rows(table(spark, sf_dir, "documents"), "text", 80, ("doc_id",))


@query("""with d as (select doc_id as id, case when doc_id % 3 = 0 then doc_id / 10.0 end as quality_score, length(text) as n from documents), t as (select id from d where quality_score is null order by id desc limit 200)
    select id, round(case when id in (select id from t) then n / 1000.0 else quality_score end, 6)::double as quality_score, id in (select id from t) as filled from d""")
def quality_backfill(spark, sf_dir):
    """Scores for the newest 200 records that have none, the batch of the operator."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") / 10.0).alias("quality_score"), F.length("text").alias("n"))
    return rounded(admin.backfill(d, F.col("n") / 1000.0, [F.desc("id")], 200), "quality_score").select("id", "quality_score", "filled")


@query(f"with {JOBS_SQL} select id, case when cast(id as bigint) % 2 = 0 then coalesce(level_norm, null) else case when level_norm = 'senior' then 'senior' else level_norm end end as level_norm, case when cast(id as bigint) % 2 = 0 and level_norm = 'senior' then 'level_norm' else '' end as changed from jobs")
def renormalize_all(spark, sf_dir):
    """Every record normalised anew, with the names of changed fields."""
    j = jobs(spark, sf_dir).withColumn("level_norm", F.when((F.col("id").cast("long") % 2 == 0) & (F.col("level_norm") == "senior"), "Sr.").otherwise(F.col("level_norm")))
    return admin.renormalized(j, {"level_norm": normalize.level(F.col("level_norm"))}).select("id", "level_norm", F.array_join("changed", ",").alias("changed"))


@query("""with d as (select doc_id as id, trim(regexp_replace('  Doc   ' || doc_id, '\\s+', ' ', 'g')) as title, case when doc_id % 3 = 0 then null else 'https://a.org/' || doc_id end as url from documents)
    select id, title, round(0.30 + case when url is null then 0 else 0.20 end, 6)::double as score, url is not null as restored from d""")
def repair_rejected(spark, sf_dir):
    """Rejected records repaired, scored anew and restored where they reach the bound, in one pass."""
    from tessera.functions import repair

    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(k.alias("id"), F.concat(F.lit("  Doc   "), k.cast("string")).alias("title"), F.when(k % 3 != 0, F.concat(F.lit("https://a.org/"), k.cast("string"))).alias("url"))
    none, nowhere = F.lit(None).cast("string"), F.lit(None).cast("double")

    def score(row: dict[str, Column]) -> Column:
        job = {"title": row["title"], "apply_url": row["url"], "location_raw": none, "latitude": nowhere, "longitude": nowhere, "is_remote": F.lit(False), "deadline": none, "description": none, "org_name": F.lit("o"), "country": none}
        return quality.quality(job, DAY)["score"]

    out = admin.repaired(d, {"title": repair.clean_title(F.col("title"))}, score, 0.45)
    return rounded(out, "score").select("id", "title", "score", "restored")


# Sources.


@query("""select c_custkey as id, case when c_custkey % 2 = 0 then 'new' else c_mktsegment end as segment, case when c_custkey % 2 = 0 and c_custkey % 3 = 0 then 1 else c_nationkey end as nation from customer""")
def source_import(spark, sf_dir):
    """Source settings written as JSON and read back over the stored ones; what is left out stays."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    k = F.col("id")
    changed = c.where(k % 2 == 0).select("id", F.lit("new").alias("segment"), F.when(k % 3 == 0, 1).alias("nation"))
    return admin.imported(c, admin.source_configs(changed, ["segment", "nation"]), "segment string, nation int")


@query("select c_custkey as id, case c_custkey % 3 when 0 then 'un' when 1 then c_mktsegment end as org_type, case c_custkey % 3 when 0 then 1 else 9 end as crawl_frequency_days from customer")
def source_presets(spark, sf_dir):
    """Settings that a source lacks come from its preset."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 3 == 0, "un").otherwise("other").alias("preset"), F.when(k % 3 == 1, F.col("c_mktsegment")).alias("org_type"), F.lit(None).cast("string").alias("parser_hint"), F.when(k % 3 != 0, 9).alias("crawl_frequency_days"))
    return admin.with_preset(c, "preset").select("id", "org_type", "crawl_frequency_days")


@query(f"""with {JOBS_SQL} select id, cast(1.0 * cast(regexp_matches(lower(title), '(^|[^a-z0-9])urgent([^a-z0-9]|$)') as integer) + 0.4 * cast(lower(org_name) = 'furniture' as integer)
    + 0.1 * cast(coalesce(list_contains(mission_tags, 'wash'), false) as integer) as double) as rank from jobs""")
def weighted_search(spark, sf_dir):
    """Rank of records for three words over weighted texts."""
    parts = {"title": F.col("title"), "org": F.col("org_name"), "tags": F.array_join("mission_tags", " ")}
    return jobs(spark, sf_dir).select("id", admin.weighted_words(parts, ["Urgent", "furniture", "wash"], {"title": 1.0, "org": 0.4, "tags": 0.1}).alias("rank"))


@query("""with l as (select page_id, case page_id % 6 when 0 then 'https://a.org/job/12345' when 1 then 'https://a.org/jobs' when 2 then 'https://a.org/base' when 3 then '/vacancy/a-very-long-name-of-it' when 4 then 'https://a.org/id=7' else url end as href,
        case page_id % 3 when 0 then 'View the nurse post' when 1 then 'x' else 'nurse' end as t, page_id % 2 = 0 as c from pages)
    select page_id, cast(case when c then 100 else 50 end + case when regexp_matches(href, '/[0-9]{4,}') then 50 when regexp_matches(href, '/[a-z0-9-]{15,}') then 40 when regexp_matches(href, '(?i)/id[=:]([0-9]+|[a-z0-9-]+)') then 45 else 0 end
        + case when contains(href, '/job/') or contains(href, '/vacancy/') then 30 else 0 end + case when t like 'View%' then 20 else 0 end - case when contains(href, '/jobs') then 100 else 0 end
        - case when href = 'https://a.org/base' then 50 else 0 end + case when contains(t, 'nurse') then 15 else 0 end as double) as score from l""")
def site_link_scores(spark, sf_dir):
    """A site's own link score."""
    k = F.col("page_id")
    href = F.when(k % 6 == 0, "https://a.org/job/12345").when(k % 6 == 1, "https://a.org/jobs").when(k % 6 == 2, "https://a.org/base").when(k % 6 == 3, "/vacancy/a-very-long-name-of-it").when(k % 6 == 4, "https://a.org/id=7").otherwise(F.col("url"))
    text = F.when(k % 3 == 0, "View the nurse post").when(k % 3 == 1, "x").otherwise("nurse")
    return table(spark, sf_dir, "pages").select("page_id", admin.site_link_score(href, text, F.lit("Nurse"), F.lit("https://a.org/base/"), k % 2 == 0).cast("double").alias("score"))


# Feeds and stored pages.


@query("""select doc_id, 'T' || doc_id as title, case when doc_id % 2 = 0 then 'https://u/' || doc_id else 'https://api/' || doc_id end as apply_url, case when doc_id % 4 < 2 then lang end as location_raw from documents where doc_id % 5 <> 0""")
def json_feed(spark, sf_dir):
    """Items of JSON interfaces in several shapes."""
    k = F.col("doc_id")
    item = F.concat(
        F.lit('{"id": '), k.cast("string"), F.when(k % 5 == 0, F.lit("")).when(k % 3 == 0, F.concat(F.lit(', "name": "T'), k.cast("string"), F.lit('"'))).otherwise(F.concat(F.lit(', "title": "T'), k.cast("string"), F.lit('"'))),
        F.when(k % 2 == 0, F.concat(F.lit(', "link": "https://u/'), k.cast("string"), F.lit('"'))).otherwise(""), F.when(k % 4 < 2, F.concat(F.lit(', "duty_station": "'), F.col("lang"), F.lit('"'))).otherwise(""), F.lit("}"),
    )
    body = F.when(k % 2 == 0, F.concat(F.lit("["), item, F.lit("]"))).otherwise(F.concat(F.lit('{"results": ['), item, F.lit("]}")))
    docs = table(spark, sf_dir, "documents").select("doc_id", body.alias("body"))
    return feeds.json_items(docs, "body", F.lit("https://api/")).select("doc_id", "title", "apply_url", "location_raw")


@query("select c_custkey as host, case c_custkey % 3 when 0 then '/a,/b' when 1 then '/x' else '' end as disallow, cast(case when c_custkey % 3 = 0 then 1500 end as integer) as delay from customer")
def robots_rules(spark, sf_dir):
    """Robots files read by lines and a running section."""
    k = F.col("c_custkey")
    body = F.when(k % 3 == 0, "User-agent: *\nDisallow: /a\nDisallow: /b\nCrawl-delay: 1.5\nUser-agent: other\nDisallow: /z").when(k % 3 == 1, "# none\nUser-agent: else\nDisallow: /y\nUser-agent: *\nDisallow: /x").otherwise("")
    out = feeds.robots(table(spark, sf_dir, "customer").select(k.alias("host"), body.alias("body")))
    return out.select("host", F.array_join("disallow", ",").alias("disallow"), F.col("crawl_delay_ms").alias("delay"))


@query("select page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) || '/src/20240131/' || substr(md5(url), 1, 12) || '.html' as path, sha256(url) as snapshot, html is not null as held from pages")
def snapshot_names(spark, sf_dir):
    """Where pages and snapshots are kept."""
    p = table(spark, sf_dir, "pages")
    s = feeds.snapshots(p.select("url", "html", "page_id"))
    named = s.select("snapshot", F.get_json_object("meta", "$.page_id").cast("long").alias("m_id"), F.col("html").isNotNull().alias("held"))
    return p.select("page_id", feeds.storage_path(F.col("url"), F.lit("src"), F.lit(AS_OF).cast("date")).alias("path")).join(named, F.col("page_id") == F.col("m_id")).select("page_id", "path", "snapshot", "held")


@query("select 'level' as type, count(*) as n, count(case when canonical_key = 'own' then 1 end) as n_own from (values ('sr', 'own'), ('boss', 'own')) s(raw_value, canonical_key) full join (values " + ", ".join(f"('{k}')" for k in C.LEVEL_SYNONYMS) + ") b(k) on k = raw_value")
def stored_synonyms(spark, sf_dir):
    """Stored synonyms, gaps filled by the built-in ones (S3)."""
    stored = spark.createDataFrame([("level", "SR", "own"), ("level", "boss", "own")], "type string, raw_value string, canonical_key string")
    return feeds.synonyms(stored).where("type = 'level'").groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("canonical_key") == "own").alias("n_own"))


@query("select doc_id, 'https://a.org/' || doc_id as url, quality as label from labels where doc_id in (select doc_id from documents where doc_id % 2 = 0)")
def training_labels(spark, sf_dir):
    """Labels with the snippets of their urls."""
    url = F.concat(F.lit("https://a.org/"), F.col("doc_id").cast("string")).alias("url")
    l = table(spark, sf_dir, "labels").select(url, F.col("quality").alias("label"))
    d = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(url, F.col("text").alias("raw_html_snippet"))
    return feeds.training_rows(l, d).select(F.regexp_extract("url", "([0-9]+)$", 1).cast("long").alias("doc_id"), "url", "label")


# Extraction from pages made of the driver's rows.

LD = """'<script type="application/ld+json">' || case c_custkey % 3 when 0 then '{"@type": "JobPosting", "title": "' || c_name || '", "hiringOrganization": {"name": "' || c_mktsegment || '"}, "jobLocation": {"address": {"addressLocality": "Rome", "addressCountry": "IT"}}, "validThrough": "2024-02-01"}'
    when 1 then '{"@graph": [{"@type": "WebPage"}, {"@type": "JobPosting", "title": "' || c_name || '"}]}' else '{"@type": "WebPage"}' end || '</script>'"""


def _pages(spark, sf_dir) -> DataFrame:
    k, name = F.col("c_custkey"), F.col("c_name")
    one = F.concat(F.lit('{"@type": "JobPosting", "title": "'), name, F.lit('", "hiringOrganization": {"name": "'), F.col("c_mktsegment"), F.lit('"}, "jobLocation": {"address": {"addressLocality": "Rome", "addressCountry": "IT"}}, "validThrough": "2024-02-01"}'))
    graph = F.concat(F.lit('{"@graph": [{"@type": "WebPage"}, {"@type": "JobPosting", "title": "'), name, F.lit('"}]}'))
    ld = F.concat(F.lit('<script type="application/ld+json">'), F.when(k % 3 == 0, one).when(k % 3 == 1, graph).otherwise('{"@type": "WebPage"}'), F.lit("</script>"))
    labels = F.concat(F.lit("<dl><dt>Duty station:</dt><dd>"), F.col("c_mktsegment"), F.lit("</dd><dt>Closing date</dt><dd>2024-03-0"), (k % 9 + 1).cast("string"), F.lit("</dd></dl>"))
    rows = F.concat(F.lit("<table><tr><th>Job title</th><th>Location</th><th>Deadline</th></tr><tr><td><a href='/job/"), k.cast("string"), F.lit("'>"), name, F.lit("</a></td><td>Oslo</td><td>1 May 2024</td></tr></table>"))
    html = F.concat(F.lit("<html><head><title>Page</title>"), ld, F.lit("</head><body><p>Apply by 2024-04-01 please</p>"), F.when(k % 2 == 0, labels).otherwise(""), F.when(k % 4 == 0, rows).otherwise(""), F.lit("</body></html>"))
    return table(spark, sf_dir, "customer").select(k.alias("page_id"), F.concat(F.lit("https://"), F.when(k % 5 == 0, "jobs.un.org").otherwise("a.org"), F.lit("/x")).alias("url"), html.alias("html"))


@query("select c_custkey as page_id, c_name as title, case when c_custkey % 3 = 0 then c_mktsegment end as employer, case when c_custkey % 3 = 0 then 'Rome, IT' end as location, case when c_custkey % 3 = 0 then '2024-02-01' end as deadline from customer where c_custkey % 3 < 2")
def page_json_ld(spark, sf_dir):
    """Postings in JSON-LD, alone and in a graph."""
    return page_source.json_ld(_pages(spark, sf_dir)).select("page_id", "title", "employer", "location", "deadline")


@query("select cast(c_custkey as varchar) as page_id, 'location' as field, c_mktsegment as value from customer where c_custkey % 2 = 0 union all select cast(c_custkey as varchar), 'deadline', '2024-03-0' || (c_custkey % 9 + 1) from customer where c_custkey % 2 = 0")
def page_labels(spark, sf_dir):
    """Labelled values of pages."""
    return page_source.label_fields(_pages(spark, sf_dir))


@query("select cast(c_custkey as varchar) as page_id, 0 as n, c_name as title, 'Oslo' as location, '1 May 2024' as deadline, '/job/' || c_custkey as apply_url from customer where c_custkey % 4 = 0")
def page_tables(spark, sf_dir):
    """Postings in tables."""
    return page_source.table_rows(_pages(spark, sf_dir))


@query("""select cast(c_custkey as varchar) as page_id, case when c_custkey % 3 = 0 then '2024-02-01' when c_custkey % 2 = 0 then '2024-03-0' || (c_custkey % 9 + 1) else '2024-04-01' end as deadline,
    case when c_custkey % 3 = 0 then 'jsonld' when c_custkey % 2 = 0 then 'heuristic' else 'regex' end as stage, case when c_custkey % 3 < 2 then c_name else 'Page' end as title from customer""")
def page_best_fields(spark, sf_dir):
    """The deadline and title of highest confidence of every page."""
    best = page_source.best_fields(page_source.field_rows(_pages(spark, sf_dir)).where("field in ('deadline', 'title')"))
    of = lambda field, c: F.max(F.when(F.col("field") == field, F.col(c)))
    both = best.groupBy("page_id").agg(of("deadline", "value").alias("deadline"), of("deadline", "stage").alias("stage"), of("title", "value").alias("title"))
    return both.where("deadline is not null and title is not null")


@query("select c_custkey as page_id, 'json_ld' as strategy, 0.95::double as confidence, case when c_custkey % 5 = 0 then 'un' else 'generic' end as plugin from customer")
def page_strategy(spark, sf_dir):
    """The way of extraction that a page suggests, and its plugin."""
    s = page_source.strategy(F.col("html"))
    return _pages(spark, sf_dir).select("page_id", s["strategy"].alias("strategy"), s["confidence"].alias("confidence"), page_source.plugin(F.col("url"), [("un", 10, "un.org"), ("b", 5, "b.org")]).alias("plugin"))


@query("select c_custkey as id, case when c_custkey % 2 = 0 then '2024-09-09' when c_custkey % 3 = 0 then '2024-05-01' end as deadline, case when c_custkey % 3 = 0 then 'P-4' end as grade from customer")
def detail_enrichment(spark, sf_dir):
    """Missing fields of records from their detail pages."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    url = F.concat(F.lit("https://a.org/"), k.cast("string"))
    records = c.select(k.alias("id"), url.alias("apply_url"), F.when(k % 2 == 0, "2024-09-09").alias("deadline"), F.lit(None).cast("string").alias("grade"))
    details = c.where(k % 3 == 0).select(url.alias("apply_url"), F.lit("<p>Deadline: 2024-05-01</p><p>Grade: P-4</p>").alias("html"))
    return page_source.enrich_from_details(records, details).select("id", "deadline", "grade")


# Keys and urls.


@query(f"with {JOBS_SQL} select l_orderkey, l_linenumber from lineitem where cast(l_orderkey as varchar) in (select id from jobs where deleted_at is null)")
def verified_hits(spark, sf_dir):
    """Hits of an index whose records are stored and not deleted."""
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"), "l_orderkey", "l_linenumber")
    return state.verified(hits, jobs(spark, sf_dir).select("id", "deleted_at"), "id").select("l_orderkey", "l_linenumber")


@query(f"with {REVIEWS_SQL} select job_id, arg_max(review_id, (created_at, review_id)) as review_id, arg_max(status, (created_at, review_id)) as status from reviews group by 1")
def latest_rows(spark, sf_dir):
    """The newest whole row of each key."""
    return state.latest(reviews(spark, sf_dir), ["job_id"], [F.desc("created_at"), F.desc("review_id")]).select("job_id", "review_id", "status")


@query(f"with {EXTRACTIONS_SQL} select url, min(id) as id, count(*) as n from (select rtrim(split_part(url, '?', 1), '/') as url, id from extractions) group by 1")
def first_per_url(spark, sf_dir):
    """The first row of each normalised url, and how many there are."""
    from tessera.functions import links

    return extractions(spark, sf_dir).groupBy(links.normalize_url(F.col("url")).alias("url")).agg(F.min("id").alias("id"), F.count("*").alias("n"))


@query(f"with {LOGS_SQL} select event_id, source_id, c_name, l.status from logs l left join customer on c_custkey = source_id and c_mktsegment = 'BUILDING' where found > 90")
def logs_left_sources(spark, sf_dir):
    """Logs with their sources, kept where there is none."""
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    return logs(spark, sf_dir).where("found > 90").join(c, F.col("source_id") == F.col("c_custkey"), "left").select("event_id", "source_id", "c_name", "status")


@query(f"with {ENRICHED_SQL}, p as (select id, cast(k % 2 = 0 as integer) as predicted, cast(confidence_overall > 0.5 as integer) as truth from enriched where enriched_at is not null) select count(*) as n, round(avg(cast(predicted = truth as integer)), 6)::double as accuracy from p")
def scalar_accuracy(spark, sf_dir):
    """Agreement of a scalar field with the ground truth."""
    e = enriched(spark, sf_dir).where("enriched_at is not null")
    truth = e.select("id", (F.col("confidence_overall") > 0.5).cast("int").alias("flag"))
    guess = e.select("id", (F.col("k") % 2 == 0).cast("int").alias("flag"))
    out = reports.accuracy(truth, guess, "id", [], ["flag"])
    return rounded(out.agg(F.count("*").alias("n"), F.avg(F.col("flag_metrics").cast("double")).alias("accuracy")), "accuracy")


# More reports.


@query(f"""with {LOGS_SQL}, w as (select '7d' as period, * from logs where ran_at >= timestamp '{AS_OF}' - interval 7 day and ran_at < timestamp '{AS_OF}' union all select '30d', * from logs where ran_at >= timestamp '{AS_OF}' - interval 30 day and ran_at < timestamp '{AS_OF}')
    select period, count(*) as n, count(distinct source_id) as sources, count(case when status = 'ok' then 1 end) as n_ok, count(case when status = 'fail' then 1 end) as n_failed from w group by 1""")
def overview_of_sources(spark, sf_dir):
    """Runs, distinct sources and statuses of two windows."""
    out = admin.overview(logs(spark, sf_dir), "ran_at", "source_id", "status", AS_OF, {"7d": 7, "30d": 30})
    return out.select("period", "n", "sources", F.col("by_status")["ok"].alias("n_ok"), F.col("by_status")["fail"].alias("n_failed"))


@query(f"""with {LOGS_SQL}, x as (select *, row_number() over (partition by source_id order by ran_at desc, event_id) as k from logs)
    select source_id, count(*) as n, min(found) as least, max(found) as most, round(avg(found), 6) as mean, count(case when k <= 20 then 1 end) as n_last, round(100.0 * count(case when k <= 20 and status = 'ok' then 1 end) / count(case when k <= 20 then 1 end), 6)::double as rate from x group by 1""")
def source_analytics(spark, sf_dir):
    """The last 20 runs of every source and its lifetime figures."""
    return rounded(admin.source_analytics(logs(spark, sf_dir), "source_id", [F.desc("ran_at"), F.asc("event_id")], F.col("status") == "ok", "found"), "mean", "rate")


@query(f"""with {EXTRACTIONS_SQL}, w as (select * from extractions where created_at >= timestamp '{AS_OF}' - interval 200 hour),
    s as (select count(case when status = 'OK' then 1 end) as ok, count(case when status = 'PARTIAL' then 1 end) as partial, count(case when status = 'EMPTY' then 1 end) as empty, count(case when status = 'DB_FAIL' then 1 end) as db_fail,
        cast(coalesce(sum(found), 0) as bigint) as extracted, cast(coalesce(sum(stored), 0) as bigint) as inserted from w)
    select *, round(coalesce(100.0 * (extracted - inserted) / nullif(extracted, 0), 0), 6)::double as mismatch, case when coalesce(100.0 * (extracted - inserted) / nullif(extracted, 0), 0) > 10 then 'critical' when coalesce(100.0 * (extracted - inserted) / nullif(extracted, 0), 0) > 5 then 'warning' else 'healthy' end as health from s""")
def coverage_status(spark, sf_dir):
    """Statuses and stored numbers of a window, read from JSON, with a health label."""
    e = extractions(spark, sf_dir).withColumn("extracted_fields", F.to_json(F.struct(F.col("found").alias("job_count"), F.col("stored").alias("inserted_count"))))
    return rounded(reports.coverage_status(e, AS_OF, 200), "mismatch")


@query(f"""with {EXTRACTIONS_SQL} select source_id, count(*) as n, cast(sum(found) as bigint) as found, cast(sum(stored) as bigint) as stored, count(distinct url) as urls, count(distinct status) as statuses,
    round(100.0 * (sum(found) - sum(stored)) / nullif(sum(found), 0), 6)::double as mismatch from extractions group by 1 having count(*) >= 50""")
def coverage_per_source(spark, sf_dir):
    """Coverage of the sources with enough rows."""
    return rounded(admin.source_coverage(extractions(spark, sf_dir), "source_id", "url", "status", "found", "stored", 50), "mismatch")


@query("""with w as (select list_distinct(list_transform(string_split(case doc_id % 3 when 0 then 'WASH,gold' when 1 then 'health,tin,Gold' else 'youth' end, ','), lambda x: lower(trim(x)))) as v from documents), u as (select unnest(v) as value from w)
    select 'tags' as field, '(normalized)' as value, count(*) as n from u where value in ('wash', 'health', 'youth') union all select 'tags', '(unknown)', count(*) from u where value not in ('wash', 'health', 'youth')
    union all select 'tags', value, count(*) from u where value not in ('wash', 'health', 'youth') group by value""")
def normalization_report(spark, sf_dir):
    """What the normalisation of tags keeps and loses, with the most frequent lost values."""
    k = F.col("doc_id") % 3
    d = table(spark, sf_dir, "documents").select(F.split(F.when(k == 0, "WASH,gold").when(k == 1, "health,tin,Gold").otherwise("youth"), ",").alias("raw"))
    return admin.normalization_report(d, "tags", F.col("raw"), normalize.tags(F.col("raw")))


@query(f"""with {ENRICHED_SQL} select id, cast(30 * cast(coalesce(list_has_any(impact_domain, ['Health']), false) as integer) + 20 * cast(experience_level is not null and experience_level like 'Officer%' as integer) + 10 * cast(source_id % 2 = 0 as integer) as double) as score,
    array_to_string(list_filter([case when list_has_any(impact_domain, ['Health']) then 'Matches Impact: Health' end, case when experience_level like 'Officer%' then 'Experience: ' || experience_level end, case when source_id % 2 = 0 then 'Location: Rome' end], lambda x: x is not null), '; ') as reasons from enriched""")
def match_score_reasons(spark, sf_dir):
    """Score and reasons of every record for one wish."""
    cells = {"impact_domain": F.col("impact_domain"), "functional_role": F.array().cast("array<string>"), "experience_level": F.col("experience_level"), "location_raw": F.when(F.col("source_id") % 2 == 0, "Rome"), "country": F.lit(None).cast("string"), "work_modality": F.lit(None).cast("string")}
    m = search.match_score(cells, {"impact_domain": ["Health"], "experience_level": "officer / associate", "location": "rome", "is_remote": True})
    return enriched(spark, sf_dir).select("id", m["score"].alias("score"), F.array_join(m["reasons"], "; ").alias("reasons"))


# Files, written to the shared folder first.


def _written(df: DataFrame, kind: str, **options) -> str:
    path = f"{shared_dir(df.sparkSession)}/tessera-{uuid.uuid4().hex}"
    df.write.format(kind).options(**options).save(path)
    return path


@query("select cast(doc_id as varchar) as doc_id, cast(quality as varchar) as label from labels")
def label_file(spark, sf_dir):
    """Labels of a CSV file with a header."""
    l = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return feeds.label_file(spark, _written(l, "csv", header=True))


# Pages as tables of nodes.


@query("""with li as (select page_id, url, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 1)) as href, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 2)) as title, unnest(range(cast(len(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>')) as bigint))) as n from pages)
    select page_id, n, title, regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || href as apply_url from li where len(title) >= 5""")
def page_div_records(spark, sf_dir):
    """Records in divs and lists of the crawled pages, here lists of links that are told by their shape alone."""
    found = nodes.div_records(nodes.page_trees(table(spark, sf_dir, "pages")))
    return found.select(F.col("page_id").cast("long").alias("page_id"), F.col("n").cast("long").alias("n"), "title", "apply_url")


@query("""select page_id, len(regexp_extract_all(html, '<li>')) as n_items, len(regexp_extract_all(html, '<a ')) as n_links, len(regexp_extract_all(regexp_replace(html, '(?s)<script.*?</script>', '', 'g'), '<p>')) as n_paragraphs,
    case when len(regexp_extract_all(html, '<li>')) > 0 then 1 else 0 end as n_item_shapes, case when contains(html, '<li>') then 3 end as item_level from pages""")
def page_node_counts(spark, sf_dir):
    """Items, links and paragraphs of each crawled page, how many shapes its items have and how deep they stand."""
    rows = nodes.node_rows(nodes.page_trees(table(spark, sf_dir, "pages")))
    out = rows.groupBy(F.col("page_id").cast("long").alias("page_id")).agg(
        F.count_if(F.col("tag") == "li").alias("n_items"), F.count_if(F.col("tag") == "a").alias("n_links"), F.count_if(F.col("tag") == "p").alias("n_paragraphs"),
        F.count_distinct(F.when(F.col("tag") == "li", F.col("shape"))).alias("n_item_shapes"), F.max(F.when(F.col("tag") == "li", F.col("level") - 1)).alias("item_level"),
    )
    return out


@query("""with kinds as (
    select page_id, 'crawled' as kind, html from pages union all select page_id, 'linked', '<a href="x">' || coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '') || '</a>' from pages union all
    select page_id, 'tabled', '<table><tr><td>1</td></tr><tr><td>2</td></tr><tr><td>' || page_id || '</td></tr></table>' || html from pages union all
    select page_id, 'marked', '<script type="application/ld+json">{}</script>' || html from pages union all select page_id, 'plain', regexp_replace(html, '<[^>]*>', ' ', 'g') from pages
),
n as (select page_id, kind, lower(html) as h from kinds),
c as (select page_id, kind, contains(h, 'application/ld+json') as ld, len(regexp_extract_all(h, '<table')) as tables, len(regexp_extract_all(h, '<tr')) as trs, len(regexp_extract_all(h, '<li')) as lis, len(regexp_extract_all(h, '<a ')) as links from n),
s as (select page_id, kind, case when ld then 0.95 else 0 end as j, case when tables > 0 and trs >= 3 then least(0.9, 0.5 + trs * 0.02) else 0 end as t, case when lis >= 3 then least(0.7, 0.3 + lis * 0.01) else 0 end as l, case when links > 0 then least(0.5, 0.2 + links * 0.01) else 0 end as a from c)
select page_id, kind, case greatest(j, t, l, a, 0.1) when j then 'json_ld' when t then 'table' when l then 'list' when a then 'links' else 'generic' end as strategy, round(cast(greatest(j, t, l, a, 0.1) as double), 4) as confidence from s""")
def page_strategies(spark, sf_dir):
    """The way of extraction that each crawled page suggests: as it is, as a link, with a table, with JSON-LD, as plain text."""
    p, html = table(spark, sf_dir, "pages"), F.col("html")
    kinds = {
        "crawled": html, "linked": F.concat(F.lit('<a href="x">'), F.coalesce(F.regexp_extract(html, "<title>([^<]*)</title>", 1), F.lit("")), F.lit("</a>")),
        "tabled": F.concat(F.lit("<table><tr><td>1</td></tr><tr><td>2</td></tr><tr><td>"), F.col("page_id").cast("string"), F.lit("</td></tr></table>"), html),
        "marked": F.concat(F.lit('<script type="application/ld+json">{}</script>'), html), "plain": F.regexp_replace(html, "<[^>]*>", " "),
    }
    rows = p.select("page_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), h.alias("html")) for k, h in kinds.items()])).alias("x")).select("page_id", "x.*")
    s = page_source.strategy(F.col("html"))
    return rows.select("page_id", "kind", s["strategy"].alias("strategy"), F.round(s["confidence"], 4).alias("confidence"))


@query("""with p as (select page_id, regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) as host, case page_id % 6 when 0 then 'undp' when 1 then 'unesco' when 2 then 'unicef' when 3 then 'amnesty' when 4 then 'save_the_children' else 'generic' end as plugin, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) as t,
        regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 2) as words from pages)
    select page_id, plugin, 0 as n, 'Senior Officer ' || page_id as title, host || case when page_id % 6 = 0 then '/view/' || (10000 + page_id) else '/job/' || page_id end as apply_url, 'Rome' as location, '2024-05-01' as deadline from p""")
def site_plugin_records(spark, sf_dir):
    """Crawled pages with a posting in the form of each site, read by that site's plugin through a lateral join."""
    k, n = F.col("page_id") % 6, F.col("page_id").cast("string")
    officer = F.concat(F.lit("Senior Officer "), n)
    rows = F.concat(F.lit("<table><tr><td>Job Title "), officer, F.lit("\n</td><td><a href='/jobs'>list</a><a href='/view/"), (F.col("page_id") + 10000).cast("string"), F.lit("'>open</a></td><td>Location: Rome\nApply by: 2024-05-01\n</td></tr></table>"))
    table_ = F.concat(F.lit("<table><thead><tr><th>Title</th><th>Duty station</th><th>Deadline</th></tr></thead><tr><td><a href='/job/"), n, F.lit("'>"), officer, F.lit("</a></td><td>Rome</td><td>2024-05-01</td></tr></table>"))
    card = F.concat(F.lit("<div class='job-card'><h3>"), officer, F.lit("</h3><a href='/job/"), n, F.lit("'>Read</a>\nLocation: Rome\nDeadline: 2024-05-01\n</div>"))
    two = F.concat(card, F.lit("<div class='job-card'><h3>Follow us and search</h3><a href='/x'>x</a></div>"))
    # The site whose articles are containers gets no article, so that its next way is tried.
    html = F.when(k == 0, F.concat(rows, F.col("html"))).when(k == 1, F.concat(table_, F.col("html"))).when(k == 2, F.concat(card, F.regexp_replace("html", "</?article>", ""))).when(k.isin(3, 4), F.concat(two, F.col("html"))).otherwise(F.concat(table_, F.col("html")))
    names = F.element_at(F.array(*[F.lit(x) for x in ("undp", "unesco", "unicef", "amnesty", "save_the_children", "generic")]), (k + 1).cast("int"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", html.alias("html"), names.alias("wanted"))
    return plugins.site_records(spark, pages, preferred="wanted").select("page_id", "plugin", "n", "title", "apply_url", "location", "deadline")
