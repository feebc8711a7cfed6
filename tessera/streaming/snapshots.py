"""Versioned snapshots by key bucket: a batch rewrites the buckets it touches, and a restart goes on from storage (T5, K1)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.streaming.monitors import each_batch


@dataclass(frozen=True)
class Snapshot:
    """A table at ``path``, by a hash of ``keys`` in ``buckets`` parts.

    ``data/version=v/bucket=b`` holds a bucket as batch v left it, ``versions/v`` which version of each bucket is the
    one after v. A version counts once its list is there, written last and in one file, so a batch that stopped midway
    left nothing that counts and is run again under the same number. The state is in storage alone: whoever opens the
    path goes on.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    schema: str
    buckets: int = 64

    def _names(self, folder: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def versions(self) -> list[int]:
        """The versions that count, ascending."""
        done = [int(n) for n in self._names("versions") if n.isdigit()]
        return sorted(v for v in done if "_SUCCESS" in self._names(f"versions/{v}"))

    def places(self, before: int | None = None) -> dict[int, int]:
        """The version that each bucket has, after the last batch or the last one before ``before``: a row for each bucket."""
        found = [v for v in self.versions() if before is None or v < before]
        if not found:
            return {}
        return {r.bucket: r.version for r in self.spark.read.schema("bucket int, version long").parquet(f"{self.path}/versions/{found[-1]}").collect()}

    def read(self, only: list[int] | None = None, before: int | None = None) -> DataFrame:
        """The rows of the last version, or of some buckets of it; other buckets' files are not opened."""
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(self.places(before).items()) if only is None or b in only]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def apply(self, new: DataFrame, version: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Merges the rows of a batch and writes the buckets of their keys; returns these. A version that counts is left alone.

        ``merge`` gets the touched buckets' rows and the new ones, and must keep rows of one key in their bucket.
        """
        if version in self.versions():
            return []
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        # At most ``buckets`` numbers reach the driver.
        touched = sorted(r[0] for r in new.select(bucket.alias("b")).distinct().collect())
        places = self.places(version)
        if touched:
            merged = merge(self.read(touched, version), new).withColumn("bucket", bucket)
            merged.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={version}")
            written = {int(n.partition("=")[2]) for n in self._names(f"data/version={version}") if n.startswith("bucket=")}
            # A bucket whose rows all went has no folder.
            places = {b: v for b, v in places.items() if b not in touched} | {b: version for b in written}
        rows = [(b, v) for b, v in sorted(places.items())]
        self.spark.createDataFrame(rows, "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/{version}")
        return touched

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes what none of the last ``keep`` versions reads; returns the folders."""
        versions = self.versions()
        old, kept = versions[:-keep], versions[-keep:]
        used = {(v, b) for k in kept for b, v in self.places(k + 1).items()}
        gone = [f"versions/{v}" for v in old]
        for name in self._names("data"):
            v = int(name.partition("=")[2])
            if kept and v <= kept[-1]:
                gone += [f"data/{name}/{b}" for b in self._names(f"data/{name}") if b.startswith("bucket=") and (v, int(b.partition("=")[2])) not in used]
        for g in gone:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{g}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return gone


def adding(keys: tuple[str, ...], sums: list[str], latest: list[str] = ()) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge that adds up ``sums`` and keeps the greatest of ``latest``."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        rows = old.unionByName(new)
        return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in latest])

    return merge


def run(stream: DataFrame, snapshot: Snapshot, shape: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame, DataFrame], DataFrame], every: str | None = None) -> StreamingQuery:
    """Merges a stream into a snapshot batch by batch: ``shape`` sums a micro-batch up to a row for each key.

    The stream's own checkpoint stands beside the snapshot; batches are the versions.
    """
    return each_batch(stream, lambda rows, batch: snapshot.apply(shape(rows), batch, merge) and None, f"{snapshot.path}/checkpoint", every)
