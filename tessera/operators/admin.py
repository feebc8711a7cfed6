"""Listings, dashboards, maintenance and presets over stored state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.cells import has_any, share

#: Named source configurations (fixed values of the service's setup): what a new source starts from.
PRESETS = {
    "un": {"org_type": "un", "parser_hint": "html", "crawl_frequency_days": 1},
    "ingo": {"org_type": "ingo", "parser_hint": "html", "crawl_frequency_days": 2},
    "feed": {"org_type": "ngo", "parser_hint": "rss", "crawl_frequency_days": 3},
    "api": {"org_type": "ngo", "parser_hint": "api", "crawl_frequency_days": 3},
}


def since(ts: Column, as_of: str, days: int) -> Column:
    return ts >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {int(days)} days")


def in_ranges(df: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    """Rows whose columns lie within (low, high), both ends included, either of which may be None (P9). Nulls fail a bound."""
    for name, (low, high) in ranges.items():
        if low is not None:
            df = df.where(F.col(name) >= F.lit(low))
        if high is not None:
            df = df.where(F.col(name) <= F.lit(high))
    return df


def history(df: DataFrame, key: str, ts: str, tie: str, most: int = 50, of: list | None = None) -> DataFrame:
    """The newest ``most`` entries of each key, or of the keys ``of`` (P27), with their rank."""
    rows = df if of is None else df.where(F.col(key).isin(of))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(tie).desc()))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most)


def failed_inserts(df: DataFrame, ts: str, tie: str, most: int = 100, unresolved_only: bool = True, **equal) -> DataFrame:
    """Failures, newest first, by optional equalities such as source_id and operation (P25)."""
    if unresolved_only:
        df = df.where(F.col("resolved_at").isNull())
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df.orderBy(F.col(ts).desc(), F.col(tie)).limit(most)


def diagnose(df: DataFrame, column: str, wanted: str) -> DataFrame:
    """How an id is found: rows that equal it, equal it in any case, begin with its first 8 letters, or hold it."""
    c = F.col(column)
    low = F.lit(wanted.lower())
    kind = F.when(c == wanted, "exact").when(F.lower(c) == low, "case").when(c.startswith(wanted[:8]), "prefix").when(F.lower(c).contains(low), "part")
    return df.select(c.alias("id"), kind.alias("found_by")).where("found_by is not null")


def payload(fields: dict[str, Column], url: Column, digest: Column, at: Column) -> Column:
    """A stored row as the result of an extraction (P18): url, id, time, and each field as (value, source, confidence, raw_snippet)."""

    def cell(value: Column) -> Column:
        return F.struct(value.cast("string").alias("value"), F.lit("database").alias("source"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("raw_snippet"))

    return F.struct(
        F.coalesce(url, F.lit("")).alias("url"), F.coalesce(digest, F.lit("")).alias("canonical_id"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("extracted_at"),
        F.struct(*[cell(v).alias(k) for k, v in fields.items()]).alias("fields"), F.lit(True).alias("is_job"), F.lit(1.0).alias("classifier_score"), F.coalesce(digest, F.lit("")).alias("dedupe_hash"),
    )


def preview(raw: dict[str, Column], done: dict[str, Column]) -> Column:
    """Raw beside normalised values, and the names of the fields that normalisation dropped."""
    dropped = F.array_compact(F.array(*[F.when(raw[k].isNotNull() & done[k].isNull(), F.lit(k)) for k in done]))
    return F.struct(F.struct(*[raw[k].alias(k) for k in done]).alias("raw"), F.struct(*[done[k].alias(k) for k in done]).alias("normalized"), dropped.alias("dropped"))


def batch_summary(records: DataFrame, errors: Column) -> DataFrame:
    """One row: records, valid ones, invalid ones, and errors in all (A41). An empty batch has zeros."""
    n = F.size(errors)
    return records.select(n.alias("n_errors")).agg(F.count("*").alias("n"), F.count_if(F.col("n_errors") == 0).alias("valid"), F.count_if(F.col("n_errors") > 0).alias("invalid"), F.coalesce(F.sum("n_errors"), F.lit(0)).alias("n_errors"))


def enrichment_overall(df: DataFrame) -> DataFrame:
    """Records, enriched ones, their share, mean confidence and how many are marked low."""
    out = df.agg(F.count("*").alias("total"), F.count("enriched_at").alias("enriched"), F.avg("confidence_overall").alias("mean"), F.count_if("low_confidence").alias("low"))
    return out.withColumn("percent", share(F.col("enriched") * 100, F.col("total")))


def distribution_with_mean(df: DataFrame, value: str, of: str, explode: bool = False, top: int | None = None) -> DataFrame:
    """Counts and mean of ``of`` for each value of a column or, exploded, of an array; most frequent first."""
    rows = df.select(F.explode(value).alias("value"), F.col(of)) if explode else df.select(F.col(value).alias("value"), F.col(of))
    out = rows.where("value is not null").groupBy("value").agg(F.count("*").alias("n"), F.avg(of).alias("mean")).orderBy(F.desc("n"), F.asc("value"))
    return out if top is None else out.limit(top)


def daily_mean(df: DataFrame, ts: str, of: str, as_of: str, days: int) -> DataFrame:
    """Rows and mean of ``of`` a day, over the trailing days."""
    return df.where(since(F.col(ts), as_of, days)).groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"), F.avg(of).alias("mean"))


def feedback_patterns(df: DataFrame, top: int = 20, field: str | None = None) -> DataFrame:
    """How often a value of a field was corrected to another, with the latest time; most frequent first, then latest."""
    rows = df if field is None else df.where(F.col("field") == field)
    out = rows.groupBy("field", "original", "corrected").agg(F.count("*").alias("n"), F.max("at").alias("last_at"))
    return out.orderBy(F.desc("n"), F.desc("last_at"), "field", "original", "corrected").limit(top)


def ground_truth_stats(df: DataFrame, who: str, at: str) -> DataFrame:
    """Labels, labelers, first and last time."""
    return df.agg(F.count("*").alias("n"), F.count_distinct(who).alias("labelers"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def distinct_values(df: DataFrame, key: str, array: str) -> DataFrame:
    """Records and distinct elements of an array for each key (A34). Elements are counted apart, so records do not multiply."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    kinds = df.select(F.col(key).alias("_k"), F.explode(array).alias("v")).distinct().groupBy("_k").agg(F.count("v").alias("n_values"))
    return n.join(kinds, F.col(key).eqNullSafe(F.col("_k")), "left").select(key, "n", F.coalesce("n_values", F.lit(0)).alias("n_values"))


def consistency(pairs: DataFrame, labels: DataFrame, key: str, array: str, level: str) -> DataFrame:
    """Of each record's similar ones: how many, the share whose array overlaps its own, the share with its level, and
    their mean as the score (A33). ``pairs(a, b)`` holds each pair once."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    own = labels.select(F.col(key).alias("a"), F.col(array).alias("x_array"), F.col(level).alias("x_level"))
    other = labels.select(F.col(key).alias("b"), F.col(array).alias("y_array"), F.col(level).alias("y_level"))
    joined = both.join(own, "a").join(other, "b")
    overlap = F.coalesce(F.arrays_overlap("x_array", "y_array"), F.lit(False))
    out = joined.groupBy("a").agg(F.count("*").alias("n"), F.avg(overlap.cast("double")).alias("overlap"), F.avg(F.col("x_level").eqNullSafe(F.col("y_level")).cast("double")).alias("same_level"))
    return out.withColumnRenamed("a", key).withColumn("score", (F.col("overlap") + F.col("same_level")) / 2)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def counts_with_latest(parents: DataFrame, key: str, children: DataFrame, child_key: str, ts: str) -> DataFrame:
    """Children of each parent and their latest time, zeros kept."""
    n = children.groupBy(F.col(child_key).alias("_k")).agg(F.count("*").alias("n"), F.max(ts).alias("latest"))
    return parents.join(n, F.col(key) == F.col("_k"), "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), "latest")


def flagged(coverage: DataFrame, found: str, stored: str, percent: float) -> DataFrame:
    """Sources whose stored records fall short of those found by more than ``percent``."""
    lost = share((F.col(found) - F.col(stored)) * 100, F.col(found))
    return coverage.withColumn("mismatch", lost).where(F.col("mismatch") > percent)


def accuracy_rate(logs: DataFrame, ts: str, good: Column, as_of: str, days: int, least: float) -> DataFrame:
    """Extractions of the trailing days, good ones, their share, and whether it reaches ``least`` percent."""
    out = logs.where(since(F.col(ts), as_of, days)).agg(F.count("*").alias("n"), F.count_if(good).alias("n_good"))
    return out.withColumn("rate", share(F.col("n_good") * 100, F.col("n"))).withColumn("passed", F.col("rate") >= least)


def duplicate_urls(jobs: DataFrame, url: str, title: str, most: int | None = None) -> DataFrame:
    """(url, n, titles): the urls, without query, fragment and last slash, that several records have, and their titles.

    Titles are cut to 100 letters, Unknown where there is none, and sorted; a title that repeats is listed as often.
    ``most`` keeps that many titles of each url, the first in order, which are found before any list is made.
    """
    plain = F.substring_index(F.substring_index(F.rtrim(F.trim(url), F.lit("/")), "#", 1), "?", 1)
    rows = jobs.select(plain.alias("url"), F.substring(F.coalesce(F.col(title), F.lit("Unknown")), 1, 100).alias("title")).where("url <> ''")
    # Equal titles are counted first, so that a url with very many records is as many rows as it has titles.
    counted = rows.groupBy("url", "title").agg(F.count("*").alias("k"))
    n = counted.groupBy(F.col("url").alias("n_url")).agg(F.sum("k").alias("n")).where("n > 1")
    if most is not None:
        counted = counted.withColumn("_r", F.row_number().over(Window.partitionBy("url").orderBy("title"))).where(F.col("_r") <= most)
    listed = counted.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("title", "k"))).alias("t"))
    titles = F.flatten(F.transform("t", lambda x: F.array_repeat(x["title"], x["k"].cast("int"))))
    out = listed.join(n, F.col("url") == F.col("n_url"))
    return out.select("url", "n", (titles if most is None else F.slice(titles, 1, most)).alias("titles"))


def log_rows(events: DataFrame, message: str, most: int = 500, keep: tuple[str, ...] = ()) -> DataFrame:
    """Log entries to append: the message cut to ``most`` letters, with a mark where it was longer."""
    cut = F.when(F.length(message) > most, F.concat(F.substring(message, 1, most), F.lit("..."))).otherwise(F.col(message))
    return events.select(*keep, cut.alias("message"), (F.length(message) > most).alias("truncated"))


def backfill(df: DataFrame, score: Column, order: list[Column], most: int, column: str = "quality_score") -> DataFrame:
    """Scores for the first ``most`` rows by ``order`` that have none; other rows stay (K26). Adds ``filled``."""
    todo = df.where(F.col(column).isNull()).orderBy(*order).limit(most).select(F.col("id").alias("_id"))
    hit = F.col("_id").isNotNull()
    joined = df.join(todo, F.col("id") == F.col("_id"), "left")
    return joined.withColumn(column, F.when(hit, score).otherwise(F.col(column))).withColumn("filled", hit).drop("_id")


def renormalized(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Every record with its columns normalised anew, and the names of those that changed."""
    changed = F.array_compact(F.array(*[F.when(~rule.eqNullSafe(F.col(c)), F.lit(c)) for c, rule in rules.items()]))
    return df.withColumns({"changed": changed} | rules)


def repaired(df: DataFrame, fixes: dict[str, Column], score: Callable[[dict[str, Column]], Column], least: float) -> DataFrame:
    """Rejected records after repair and scoring anew; those that reach ``least`` are restored (K28), all in one pass."""
    fixed = df.withColumns(fixes)
    return fixed.withColumn("score", score({c: F.col(c) for c in fixed.columns})).withColumn("restored", F.coalesce(F.col("score") >= least, F.lit(False)))


def source_configs(sources: DataFrame, columns: list[str]) -> DataFrame:
    """Sources as JSON documents, nulls left out (S15, export)."""
    return sources.select("id", F.to_json(F.struct(*columns)).alias("config"))


def imported(sources: DataFrame, configs: DataFrame, schema: str) -> DataFrame:
    """Sources after their configs were read back: what a config names replaces, what it leaves out stays (S15, import)."""
    new = configs.select(F.col("id").alias("_id"), F.from_json("config", schema).alias("c"))
    joined = sources.join(new, F.col("id") == F.col("_id"), "left")
    names = [f.split()[0] for f in schema.split(", ")]
    return joined.select(*[F.coalesce(F.col(f"c.{c}"), F.col(c)).alias(c) if c in names else F.col(c) for c in sources.columns])


def with_preset(sources: DataFrame, preset: str) -> DataFrame:
    """Sources whose missing settings come from the preset that a column names (S18). An unknown preset changes nothing."""
    settings = {c: F.coalesce(*[F.when(F.col(preset) == n, F.lit(p[c])) for n, p in PRESETS.items()]) for c in next(iter(PRESETS.values()))}
    return sources.withColumns({c: F.coalesce(F.col(c), v) for c, v in settings.items()})


def weighted_words(parts: dict[str, Column], words: list[str], weights: dict[str, float]) -> Column:
    """Rank of a record for a query over weighted texts (X65): for each part, its weight times the query words it holds."""
    total = F.lit(0.0)
    for name, c in parts.items():
        held = F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+")
        total = total + weights[name] * F.size(F.array_intersect(held, F.array(*[F.lit(w.lower()) for w in words])))
    return total


# Parts of urls and words of links that a site's own score looks for.
SITE_DETAIL = ["/job/", "/position/", "/vacancy/", "/detail", "/view/", "/apply", "/post/", "/consultant/", "/opportunity/", "/consultancy/"]
SITE_WORDS = ["view", "details", "read more", "apply", "see more", "full", "more info"]
SITE_LISTING = ["/jobs", "/careers", "/vacancies", "/opportunities", "/list", "/search", "/cj_view_consultancies", "/all", "/index"]


def site_link_score(href: Column, text: Column, title: Column, base_url: Column, in_title_cell: Column) -> Column:
    """A site's own link score (X47): links in the title's cell, with an id or to a detail page go up, listings and the page itself down."""

    def path(url: Column) -> Column:
        return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)

    low, words = F.lower(href), F.lower(F.trim(text))
    score = F.when(in_title_cell, 100.0).otherwise(50.0)
    score += F.when(href.rlike(r"/\d{4,}"), 50).when(href.rlike("/[a-z0-9-]{15,}"), 40).when(href.rlike(r"(?i)/id[=:](\d+|[a-z0-9-]+)"), 45).otherwise(0)
    score += F.when(has_any(low, SITE_DETAIL), 30).otherwise(0) + F.when(has_any(words, SITE_WORDS), 20).otherwise(0) - F.when(has_any(low, SITE_LISTING), 100).otherwise(0)
    same = (path(href) == path(base_url)) | (path(href) == F.rtrim(path(base_url), F.lit("/")))
    return score - F.when(same, 50).otherwise(0) + F.when(words.contains(F.substring(F.lower(title), 1, 20)), 15).otherwise(0)


def overview(logs: DataFrame, ts: str, source: str, status: str, as_of: str, windows: dict[str, int]) -> DataFrame:
    """For each trailing window of days: runs, distinct sources, and runs by status as a map."""
    t, at = F.col(ts), F.lit(as_of).cast("timestamp")
    inside = F.explode(F.array_compact(F.array(*[F.when(since(t, as_of, d) & (t < at), F.lit(n)) for n, d in windows.items()])))
    rows = logs.withColumn("period", inside)
    by_status = rows.groupBy("period", status).agg(F.count("*").alias("k")).groupBy("period").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(status, "k")))).alias("by_status"), F.sum("k").alias("n"))
    sources = rows.groupBy("period", source).agg(F.lit(1)).groupBy("period").agg(F.count("*").alias("sources"))
    return by_status.join(sources, "period")


def source_analytics(logs: DataFrame, key: str, order: list[Column], good: Column, amount: str, last: int = 20) -> DataFrame:
    """Success rate of each source's last runs and its lifetime number, least, greatest and mean of an amount."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    rows = logs.withColumn("_n", rank).withColumn("_good", good)
    recent = F.col("_n") <= last
    out = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(amount).alias("least"), F.max(amount).alias("most"), F.avg(amount).alias("mean"), F.count_if(recent & F.col("_good")).alias("ok"), F.count_if(recent).alias("n_last"))
    return out.withColumn("rate", share(F.col("ok") * 100, F.col("n_last"))).drop("ok")


def source_coverage(logs: DataFrame, key: str, url: str, status: str, found: str, stored: str, least: int) -> DataFrame:
    """Distinct urls, statuses and extractions of each source with at least ``least`` rows, and its mismatch, null where
    nothing was found (A20). Distinct numbers are counted apart, so that nothing fans out."""
    base = logs.groupBy(key).agg(F.count("*").alias("n"), F.sum(found).alias("found"), F.sum(stored).alias("stored")).where(F.col("n") >= least)
    for name, c in (("urls", url), ("statuses", status)):
        kinds = logs.groupBy(key, c).agg(F.lit(1)).groupBy(F.col(key).alias("_k")).agg(F.count("*").alias(name))
        base = base.join(kinds, F.col(key) == F.col("_k")).drop("_k")
    return base.withColumn("mismatch", F.try_divide((F.col("found") - F.col("stored")) * 100.0, F.col("found"))).orderBy(F.col("mismatch").desc_nulls_last(), key)


def normalization_report(rows: DataFrame, field: str, raw: Column, done: Column, top: int = 10) -> DataFrame:
    """(field, value, n): how many raw values a normalisation keeps and loses, then the most frequent lost ones."""
    lost = F.array_except(F.transform(raw, lambda x: F.lower(F.trim(x))), done)
    values = rows.select(F.explode(lost).alias("value"))
    counts = rows.agg(F.coalesce(F.sum(F.size(done)), F.lit(0)).alias("normalized"), F.coalesce(F.sum(F.coalesce(F.size(lost), F.lit(0))), F.lit(0)).alias("unknown"))
    totals = counts.select(F.explode(F.array(F.struct(F.lit("(normalized)").alias("value"), F.col("normalized").alias("n")), F.struct(F.lit("(unknown)").alias("value"), F.col("unknown").alias("n")))).alias("t")).select("t.*")
    most = values.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(top)
    return totals.unionByName(most).select(F.lit(field).alias("field"), "value", "n")
