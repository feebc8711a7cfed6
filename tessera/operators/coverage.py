"""Coverage of sources over several trailing windows from one pass: exact distinct counts, and mergeable daily sketches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The windows of the reports, in hours.
WINDOWS = {"24h": 24, "7d": 24 * 7, "30d": 24 * 30}
#: Size of a sketch as a power of two; its relative standard error is about 0.83 / sqrt(2 ** LG_K), 1.3 % here.
LG_K = 12


def _starts(as_of: str, windows: dict[str, int]) -> dict[str, Column]:
    return {w: F.lit(as_of).cast("timestamp") - F.expr(f"interval {h} hours") for w, h in windows.items()}


def windowed_counts(rows: DataFrame, key: str, ts: str, as_of: str, sums: dict[str, Column], distinct: dict[str, Column], windows: dict[str, int] = WINDOWS) -> DataFrame:
    """For each key and trailing window up to ``as_of``: rows ``n``, ``sums``, exact ``distinct`` values and the last time.

    Returns (key, n_w, sum_w, distinct_w, last) with a column for each window w. A value counts in a window if it was
    last seen in it, so the latest time of each value, one row for each key and value, answers all windows at once:
    nothing is copied per window, and a key with very many rows meets in one task only as its distinct values do, and
    these as partial counts. Rows after ``as_of`` are left out; a key without rows in the longest window has no row.
    """
    starts = _starts(as_of, windows)
    t = F.col(ts)
    rows = rows.where((t <= F.lit(as_of).cast("timestamp")) & (t >= F.least(*starts.values()) if len(starts) > 1 else t >= next(iter(starts.values()))))
    aggregates = [F.count_if(t >= s).alias(f"n_{w}") for w, s in starts.items()]
    aggregates += [F.coalesce(F.sum(F.when(t >= s, c)), F.lit(0)).alias(f"{name}_{w}") for name, c in sums.items() for w, s in starts.items()]
    out = rows.groupBy(F.col(key).alias("key")).agg(*aggregates, F.max(t).alias("last"))
    for name, value in distinct.items():
        seen = rows.where(value.isNotNull()).groupBy(F.col(key).alias("v_key"), value.alias("v")).agg(F.max(t).alias("seen"))
        kinds = seen.groupBy("v_key").agg(*[F.count_if(F.col("seen") >= s).alias(f"{name}_{w}") for w, s in starts.items()])
        out = out.join(kinds, F.col("key") == F.col("v_key"), "left").drop("v_key").fillna(0, [f"{name}_{w}" for w in starts])
    return out


def coverage(sources: DataFrame, children: dict[str, DataFrame], key: str) -> DataFrame:
    """Sources with what :func:`windowed_counts` gave for each kind of children, 0 where there are none.

    Children are counted before they are joined, so rows of one kind do not multiply those of another.
    """

    def joined(left: DataFrame, item: tuple[str, DataFrame]) -> DataFrame:
        name, counts = item
        named = counts.select(F.col("key").alias(f"{name}_key"), *[F.col(c).alias(f"{name}_{c}") for c in counts.columns if c != "key"])
        out = left.join(named, F.col(key) == F.col(f"{name}_key"), "left").drop(f"{name}_key")
        return out.fillna(0, [f"{name}_{c}" for c in counts.columns if c not in ("key", "last")])

    return reduce(joined, children.items(), sources)


def daily_sketches(rows: DataFrame, keys: list[str], ts: str, value: Column, lg_k: int = LG_K) -> DataFrame:
    """(keys, day, sketch, n): a sketch of the distinct values of each day, of some kB, to be kept and merged."""
    return rows.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.hll_sketch_agg(value, F.lit(lg_k)).alias("sketch"), F.count("*").alias("n"))


def merged(sketches: DataFrame, keys: list[str], as_of: str, days: dict[str, int]) -> DataFrame:
    """(keys, window, estimate, n) for trailing windows of whole days before ``as_of``, from daily sketches alone."""
    inside = F.array_compact(F.array(*[F.when((F.col("day") < F.lit(as_of).cast("date")) & (F.col("day") >= F.date_sub(F.lit(as_of).cast("date"), d)), F.lit(w)) for w, d in days.items()]))
    rows = sketches.withColumn("window", F.explode(inside))
    return rows.groupBy(*keys, "window").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"), F.sum("n").alias("n"))
