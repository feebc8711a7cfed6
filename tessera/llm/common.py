"""Shared pieces: durable intermediate tables, connected components and bounded blocks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tessera.session import shared_dir


#: Rows of an Arrow batch that is sent to a Python worker. Whole texts stand in them, so the usual 10 000 are too many.
BATCH_ROWS = 512


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's rows per Arrow batch to BATCH_ROWS, so that batches of long texts stay small in both processes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


#: Files of a compact table for each core of the cluster.
FILES_PER_CORE = 3


def materialize(df: DataFrame, compact: bool = False) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back, which cuts its lineage.

    The table outlives lost executors. Files stay until the owner of the folder clears it. ``compact`` is for what
    comes from a shuffle and is small beside its input: partitions are written together, a few files for each core.
    """
    spark = df.sparkSession
    if compact:
        df = df.coalesce(FILES_PER_CORE * spark.sparkContext.defaultParallelism)
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def least_by_hash(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the least hash of ``key``, ties by key: a sample that is the same however the rows are dealt.

    Of a large table only the rows below a hash that about 2 n of them have are sorted.
    """
    total, h = df.count(), F.xxhash64(key)
    if total > 4 * n:
        df = df.where(h < F.lit(int(-(2**63) + 2**64 * 2 * n / total)))
    return df.orderBy(h, key).limit(n)


#: Bits of the filters that keep rows out of a shuffle.
FILTER_BITS = 1 << 22


def member_filter(ids: DataFrame, column: str) -> Callable[[Column], Column]:
    """Whether an id may be among ``ids``: false only where it is not.

    A bitmap of FILTER_BITS hashed ids, a fixed size, passes the driver and is broadcast. It spares a shuffle most rows
    while it is not full, and nothing when it is; what it lets pass has to be joined.
    """

    def place(of: Column) -> Column:
        return F.pmod(F.xxhash64(of.cast("long")), F.lit(FILTER_BITS)).cast("int")

    bitmap = np.zeros(FILTER_BITS, bool)
    bitmap[ids.select(place(F.col(column)).alias("place")).distinct().toPandas()["place"]] = True
    bits = ids.sparkSession.sparkContext.broadcast(np.packbits(bitmap))

    @F.pandas_udf(BooleanType())
    def listed(at: pd.Series) -> pd.Series:
        at = at.to_numpy()
        return pd.Series((bits.value[at >> 3] >> (7 - (at & 7))) & 1 == 1)

    return lambda of: listed(place(of))


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`materialize` of which nothing that is still to be computed reads."""
    for df in tables:
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows (node, component), the component being its smallest node.

    Alternates the large-star and small-star steps, O(log n) rounds in practice. Nodes without an edge to another
    node do not appear. The minimum of each node is aggregated before it is shuffled and written out before it is
    joined, so that a node with very many neighbours stays a splittable join side instead of one group.
    """

    def step(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(pairs.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("low")), compact=True)
        joined = pairs.join(least, F.col("a") == F.col("node"))
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            out = joined.select(F.explode(F.array(F.struct(F.col("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.a", "e.b")
        return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def stars(pairs: DataFrame) -> bool:
        """Whether every larger end has one smaller end, which is itself no larger end: nothing is left to do then."""
        ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e"))
        open_ends = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.count("*").alias("n")).where("up > 1 or (up = 1 and n > 1)")
        return open_ends.agg(F.count("*")).first()[0] == 0

    ends = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    pairs = materialize(ends.distinct(), compact=True)
    while not stars(pairs):
        half = materialize(step(pairs, True), compact=True)
        discard(pairs)
        pairs = materialize(step(half, False), compact=True)
        discard(half)
    low = pairs.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(low)


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 joined by the pairs (left, right), the smallest node of each one's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def in_blocks(df: DataFrame, keys: list[str], by: str, size: int) -> DataFrame:
    """Deals the rows of each group of ``keys`` so that any two rows meet in exactly one bounded block.

    A group of n rows gets c = ceil(n / size) chunks; each row goes, by a hash of ``by``, to a chunk and is sent to
    that chunk's c blocks. Adds ``block_a`` <= ``block_b`` (the two chunks that meet) and ``chunk``; group by keys and
    both blocks. Groups of one row, which have no pairs, are left out. The group sizes are written out first, so that
    the join with them can be split where a group is hot.
    """
    sizes = materialize(df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1"), compact=True)
    side = sizes.select(*[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)], F.ceil(F.col("n_rows") / size).cast("int").alias("n_chunks"))
    match = [F.col(k) == F.col(f"key_{i}") for i, k in enumerate(keys)]
    rows = df.join(side, match).drop(*[f"key_{i}" for i in range(len(keys))])
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(F.col(by), F.lit("chunk")), F.col("n_chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    return rows.withColumn("block_a", F.least("chunk", "other")).withColumn("block_b", F.greatest("chunk", "other")).drop("other", "n_chunks")


def by_groups(df: DataFrame, keys: list[str], work: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray] | None], schema: str) -> DataFrame:
    """Calls ``work`` with the columns of each group of ``keys`` and joins what it returns.

    Meant for very many small groups, which are taken from sorted Arrow batches instead of one call of Spark's each.
    Keys must not be null; groups must fit in memory.
    """

    def grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for batch in batches:
            part = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            ends = _ends(part, keys)
            rest = part.iloc[ends[-1] if len(ends) else 0 :]
            yield from _each(part, ends, work)
        if rest is not None and len(rest):
            yield from _each(rest, np.array([0, len(rest)]), work)

    # A fixed number of partitions, since little data may be much work.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys).sortWithinPartitions(*keys).mapInPandas(grouped, schema)


def slices(batches: Iterator[pd.DataFrame], rows: int = 256) -> Iterator[pd.DataFrame]:
    """The same rows in pieces of at most ``rows``, so that what a task makes of its texts stays small."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.iloc[start : start + rows].reset_index(drop=True)


def _ends(part: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where groups begin, up to the begin of the last one, which may go on in the next batch."""
    new = np.zeros(len(part), bool)
    if len(part):
        new[0] = True
    for k in keys:
        x = part[k].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _each(part: pd.DataFrame, ends: np.ndarray, work: Callable) -> Iterator[pd.DataFrame]:
    columns = {c: part[c].to_numpy() for c in part.columns}
    out = [r for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True) if (r := work({c: x[s:e] for c, x in columns.items()})) is not None]
    if out:
        yield pd.DataFrame({c: np.concatenate([r[c] for r in out]) for c in out[0]})
