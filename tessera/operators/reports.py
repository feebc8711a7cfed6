"""Reports over logs, records and enrichments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.functions.cells import share
from tessera.functions.quality import is_listing, report_score


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def counts_by(df: DataFrame, key: str, cases: dict[str, Column]) -> DataFrame:
    return df.groupBy(key).agg(*[F.count_if(c).alias(n) for n, c in cases.items()])


def with_zero(parents: DataFrame, children: DataFrame, key: str, child_key: str, name: str = "n") -> DataFrame:
    """Parents with the number of their (already filtered) children, 0 where there is none. Children are counted first."""
    n = children.groupBy(F.col(child_key).alias("_k")).agg(F.count("*").alias(name))
    return parents.join(n, F.col(key) == F.col("_k"), "left").drop("_k").withColumn(name, F.coalesce(name, F.lit(0)))


def coverage(parents: DataFrame, key: str, sides: list[DataFrame]) -> DataFrame:
    """Joins aggregates that each have one row per key (first column), zeros for missing numbers; nothing fans out."""
    out = parents
    for s in sides:
        k, *rest = s.columns
        out = out.join(s.withColumnRenamed(k, "_k"), F.col(key) == F.col("_k"), "left").drop("_k")
        out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in rest})
    return out


def url_report(jobs: DataFrame, by: str | None = None, parts=C.LISTING_SOURCE) -> DataFrame:
    """Totals of records, distinct, missing and listing urls, missing and short titles, extra copies, and the score."""
    keys = [by] if by else []
    title, url = F.col("title"), F.col("apply_url")
    total = jobs.groupBy(*keys).agg(
        F.count("*").alias("total_jobs"), F.count_distinct(url).alias("unique_urls"), F.count_if(url.isNull()).alias("null_urls"), F.count_if(is_listing(url, parts)).alias("listing_urls"),
        F.count_if(title.isNull() | (title == "")).alias("missing_titles"), F.count_if(F.length(title) < 5).alias("short_titles"),
    )
    extra = F.col("total_jobs") - F.col("null_urls") - F.col("unique_urls")
    return total.withColumn("duplicate_urls", extra).withColumn("quality_score", report_score(F.col("total_jobs"), F.col("null_urls"), F.col("listing_urls"), F.col("missing_titles"), F.col("short_titles"), F.col("duplicate_urls")))


def duplicate_groups(df: DataFrame, url: Column, title: str, newest: str, top: int | None = 10, titles: int = 3) -> DataFrame:
    """Urls held more than once, with how often and their newest titles. Groups are counted first, and of each only the
    newest titles are gathered."""
    rows = df.select(url.alias("url"), F.col(newest).alias("at"), F.col(title).alias("title")).where("url is not null")
    groups = rows.groupBy("url").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), F.asc("url"))
    groups = groups if top is None else groups.limit(top)
    rank = F.row_number().over(Window.partitionBy("g_url").orderBy(F.col("at").desc(), F.col("title").desc()))
    newest_rows = rows.join(groups.select(F.col("url").alias("g_url")), F.col("url") == F.col("g_url")).withColumn("rank", rank).where(F.col("rank") <= titles)
    gathered = newest_rows.groupBy("g_url").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda r: r["title"]).alias("titles"))
    return groups.join(gathered, F.col("url") == F.col("g_url")).select("url", "n", "titles").orderBy(F.desc("n"), F.asc("url"))


def issue_counts(selections: list[DataFrame], key: str, top: int = 10) -> DataFrame:
    """Rows of several selections counted together by key."""
    out = selections[0].select(key)
    for s in selections[1:]:
        out = out.unionByName(s.select(key))
    return out.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(top)


def run_overview(logs: DataFrame, ts: str, status: str, amount: str, as_of: str, windows: dict[str, str], ok: str, failed: str) -> DataFrame:
    """One row per trailing window: runs, successes, failures, mean and sum of an amount."""
    t = F.col(ts)
    at = F.lit(as_of).cast("timestamp")
    inside = F.explode(F.array_compact(F.array(*[F.when((t >= at - F.expr(f"interval {w}")) & (t < at), F.lit(n)) for n, w in windows.items()])))
    rows = logs.withColumn("period", inside)
    return rows.groupBy("period").agg(F.count("*").alias("n"), F.count_if(F.col(status) == ok).alias("n_ok"), F.count_if(F.col(status) == failed).alias("n_failed"), F.avg(amount).alias("mean"), F.sum(amount).alias("total"))


def daily(logs: DataFrame, ts: str, good: Column) -> DataFrame:
    day = F.to_date(ts).alias("day")
    return logs.groupBy(day).agg(F.count("*").alias("n"), F.count_if(good).alias("n_good")).withColumn("rate", share(F.col("n_good") * 100, F.col("n")))


def distribution(df: DataFrame, key: str) -> DataFrame:
    """Counts with their percentage of the whole, which is one row joined to each group."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    total = F.broadcast(df.agg(F.count("*").alias("_total")))
    return n.join(total).withColumn("percent", F.col("n") * 100.0 / F.col("_total")).drop("_total")


def last_n(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def coverage_status(logs: DataFrame, as_of: str, hours: int) -> DataFrame:
    """Extraction statuses, stored numbers and the mismatch of a trailing window, with a health label."""
    rows = logs.where(F.col("created_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {int(hours)} hours"))
    n = F.get_json_object("extracted_fields", "$.job_count").try_cast("int")
    ins = F.get_json_object("extracted_fields", "$.inserted_count").try_cast("int")
    out = rows.agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("OK", "PARTIAL", "EMPTY", "DB_FAIL")], F.coalesce(F.sum(n), F.lit(0)).alias("extracted"), F.coalesce(F.sum(ins), F.lit(0)).alias("inserted"))
    miss = share((F.col("extracted") - F.col("inserted")) * 100, F.col("extracted"))
    return out.withColumn("mismatch", miss).withColumn("health", F.when(F.col("mismatch") > 10, "critical").when(F.col("mismatch") > 5, "warning").otherwise("healthy"))


def set_metrics(truth: Column, predicted: Column) -> Column:
    """struct(precision, recall, f1) of two arrays as sets."""
    both, t, p = F.size(F.array_intersect(truth, predicted)), F.size(F.array_distinct(truth)), F.size(F.array_distinct(predicted))
    precision, recall = share(both, p), share(both, t)
    return F.struct(precision.alias("precision"), recall.alias("recall"), share(2 * precision * recall, precision + recall).alias("f1"))


def accuracy(truth: DataFrame, predicted: DataFrame, key: str, arrays: list[str], scalars: list[str]) -> DataFrame:
    """Per record: metrics of each array field, agreement of each scalar, and the mean of F1s and agreements."""
    t = truth.select(F.col(key), *[F.col(c).alias(f"t_{c}") for c in [*arrays, *scalars]])
    joined = t.join(predicted, key)
    cells = {c: set_metrics(F.col(f"t_{c}"), F.col(c)) for c in arrays} | {c: F.col(f"t_{c}").eqNullSafe(F.col(c)) for c in scalars}
    parts = [cells[c]["f1"] for c in arrays] + [cells[c].cast("double") for c in scalars]
    return joined.select(key, *[v.alias(f"{k}_metrics") for k, v in cells.items()], (sum(parts, F.lit(0.0)) / len(parts)).alias("overall"))


def mode_of(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value per key (the smallest among equals) and its share."""
    n = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    return n.groupBy(key).agg(F.max_by(value, F.struct("_n", F.lit(0))).alias("_any"), F.max("_n").alias("n_mode"), F.sum("_n").alias("n")).drop("_any").join(
        n.withColumnRenamed(key, "_k"), (F.col(key) == F.col("_k")) & (F.col("_n") == F.col("n_mode"))
    ).groupBy(key, "n_mode", "n").agg(F.min(value).alias("mode")).withColumn("share", share(F.col("n_mode"), F.col("n")))


def unknown_tags(rows: DataFrame, array: str, known: DataFrame, key: str, top: int = 10, null_aware: bool = False) -> DataFrame:
    """Values of an array that a lookup lacks. ``null_aware``, as NOT IN is, nothing is unknown to one with a null key."""
    values = rows.select(F.explode(array).alias("value")).where("value is not null")
    if null_aware:
        nulls = known.where(F.col(key).isNull()).limit(1).select(F.lit(True).alias("any_null"))
        # One row at most.
        values = values.join(F.broadcast(nulls), F.lit(True), "left_anti")
    return values.join(known.select(F.col(key).alias("value")), "value", "left_anti").groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("value")).limit(top)


def link_stats(jobs: DataFrame, validations: DataFrame, as_of: str) -> DataFrame:
    """Valid, invalid, unchecked and freshly checked urls of records, with the share of valid ones among the checked."""
    v = validations.select("url", "is_valid", "validated_at")
    joined = jobs.join(v, F.col("apply_url") == F.col("url"), "left")
    fresh = F.col("validated_at") >= F.lit(as_of).cast("timestamp") - F.expr("interval 24 hours")
    out = joined.agg(F.count("*").alias("total"), F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid"), F.count_if(F.col("is_valid").isNull()).alias("unvalidated"), F.count_if(fresh).alias("recent"))
    return out.withColumn("percent", share(F.col("valid") * 100, F.col("valid") + F.col("invalid")))


def deletion_impact(jobs: DataFrame, children: dict[str, tuple[DataFrame, str]], key: str = "id") -> DataFrame:
    """How many records and dependent rows a deletion hits, and its risk (high over 1000 records or 100 saves, medium over 100)."""
    ids = jobs.select(F.col(key).alias("_id"))
    out = jobs.agg(F.count("*").alias("jobs"))
    for name, (df, child_key) in children.items():
        hit = df.join(ids, F.col(child_key) == F.col("_id"), "left_semi").agg(F.count("*").alias(name))
        # Both sides are one row.
        out = out.join(F.broadcast(hit))
    saves = F.col("shortlists") if "shortlists" in children else F.lit(0)
    return out.withColumn("risk", F.when((F.col("jobs") > 1000) | (saves > 100), "high").when(F.col("jobs") > 100, "medium").otherwise("low"))


def query_metrics(tracks: DataFrame, as_of_last: int = 100, tie: str | None = None) -> DataFrame:
    """Latency, hit rate and fallback rate of the last tracked queries; of equal times those of the greater ``tie``."""
    last = tracks.orderBy(F.desc("timestamp"), *([F.desc(tie)] if tie else [])).limit(as_of_last)
    out = last.agg(F.count("*").alias("n"), F.avg("latency_ms").alias("mean_latency_ms"), F.count_if(F.col("source") == "index").alias("n_index"), F.count_if(F.col("source") == "db").alias("n_db"))
    return out.withColumns({"hit_rate": share(F.col("n_index") * 100, F.col("n")), "fallback_rate": share(F.col("n_db") * 100, F.col("n"))})


def failure_rate(metrics: DataFrame, as_of: str, minutes: int, threshold: float) -> DataFrame:
    """Failures among attempts of the trailing minutes; one row, zeros without history."""
    rows = metrics.where((F.col("timestamp") >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {int(minutes)} minutes")) & (F.col("count") > 0))
    out = rows.agg(F.coalesce(F.sum(F.when(F.col("type") == "failed", F.col("count"))), F.lit(0)).alias("failed"), F.coalesce(F.sum(F.when(F.col("type") == "inserted", F.col("count"))), F.lit(0)).alias("inserted"))
    rate = share(F.col("failed") * 100, F.col("failed") + F.col("inserted"))
    return out.withColumn("rate", rate).withColumn("alert", F.col("rate") > threshold)
