"""Merkle fixity audit of WARC replicas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: Page ids of one volume; bytes of the lowest range; ranges that one of the next level holds; levels below the root.
VOLUME_PAGES, RANGE_BYTES, FAN_OUT, LEVELS = 1024, 65_536, 16, 3


def _bytes(text: Column) -> Column:
    return F.octet_length(text)


def warc_records(pages: DataFrame, volume_pages: int = VOLUME_PAGES) -> DataFrame:
    """The WARC response record of each page and its volume: volume, page_id, record.

    Volumes hold ``volume_pages`` consecutive page ids each. Null urls and htmls count as empty. Repeated rows are
    records each. Rows without a page_id have no place of their own: equal ones make one record that names their
    number, and their volumes, which are negative, are dealt by a hash of the record, as many as hold ``volume_pages``
    of them each on average. An empty table has no records; other columns are ignored.
    """
    url, html = F.coalesce(F.col("url").cast("string"), F.lit("")), F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), html.alias("html"))
    ends = F.lit("\r\n")

    def record(name: Column) -> Column:
        head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\n"), name, ends, F.lit("WARC-Target-URI: "), F.col("url"), F.lit("\r\nContent-Length: "), _bytes(F.col("html")).cast("string"), ends, ends)
        return F.concat(head, F.col("html"), ends, ends)

    named = rows.where("page_id is not null").select(
        F.floor(F.col("page_id") / F.lit(volume_pages)).cast("long").alias("volume"), "page_id",
        record(F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.col("page_id").cast("string"), F.lit(">"))).alias("record"),
    )
    nameless = rows.where("page_id is null").groupBy("url", "html").agg(F.count("*").alias("copies"))
    n_volumes = F.broadcast(nameless.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(volume_pages))).alias("n_volumes")))
    # One row: the join with it neither shuffles nor multiplies rows.
    nameless = nameless.join(n_volumes).select(
        (-1 - F.pmod(F.xxhash64("url", "html"), F.col("n_volumes"))).cast("long").alias("volume"), F.lit(None).cast("long").alias("page_id"),
        record(F.concat(F.lit("X-Copies: "), F.col("copies").cast("string"))).alias("record"),
    )
    return named.unionByName(nameless)


def manifest(records: DataFrame) -> DataFrame:
    """Place and digest of each record: volume, page_id, offset, length, digest. Only digests are shuffled."""
    hashed = records.select("volume", "page_id", _bytes(F.col("record")).cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    before = Window.partitionBy("volume").orderBy(F.col("page_id").asc_nulls_first(), "digest").rowsBetween(Window.unboundedPreceding, -1)
    return hashed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def tree(places: DataFrame, range_bytes: int = RANGE_BYTES, fan_out: int = FAN_OUT, levels: int = LEVELS, by: tuple[str, ...] = ("volume",)) -> list[DataFrame]:
    """Nodes of each volume's hash tree, lowest level first: (volume, node, digest); the last level is the root.

    ``by`` names what makes a tree; with the replica's column before the volume, several are built at once.

    A lowest node hashes offset, length and digest of the records that begin in its range of offsets, in order; a node
    above hashes number and digest of the nodes below it, in order. A record's bytes bound what a range holds. Each
    level is written out before the next is made of it.
    """

    def joined(of: Column) -> Column:
        return F.sha2(F.array_join(of, ","), 256)

    leaf = F.transform(F.array_sort(F.collect_list(F.struct("offset", "length", "digest"))), lambda r: F.concat_ws(":", r["offset"], r["length"], r["digest"]))
    nodes = [materialize(places.groupBy(*by, F.floor(F.col("offset") / range_bytes).cast("long").alias("node")).agg(joined(leaf).alias("digest")), compact=True)]
    for level in range(1, levels + 1):
        up = F.lit(0).cast("long") if level == levels else F.floor(F.col("node") / fan_out).cast("long")
        below = F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda r: F.concat_ws(":", r["node"], r["digest"]))
        nodes.append(materialize(nodes[-1].groupBy(*by, up.alias("up")).agg(joined(below).alias("digest")).withColumnRenamed("up", "node"), compact=True))
    return nodes


def audit(replica_a: DataFrame, replica_b: DataFrame, range_bytes: int = RANGE_BYTES, fan_out: int = FAN_OUT, levels: int = LEVELS) -> DataFrame:
    """Compares two replicas, given as manifests (volume, page_id, offset, length, digest), one row per volume.

    Returns volume, n_records and n_bytes of the first replica (0 where it lacks the volume), root_a and root_b (null
    where one lacks it), intact, n_compared (nodes looked at below the roots), bad_pages (sorted ids of the records
    that differ, are missing, or are extra), n_nameless (such records without an id) and n_shifted (records of the
    first replica that the second holds unchanged at another offset, as behind one that is missing).

    The trees are written out once. Roots are compared first; below, each level reads of both trees only the children
    of nodes that differ, down to the records, so an intact volume adds nothing below its root. Replicas may hold a
    record more than once: as many are matched as both hold. Two empty replicas give no rows.
    """
    columns = ["volume", "page_id", "offset", "length", "digest"]
    places = replica_a.select(*columns, F.lit("a").alias("replica")).unionByName(replica_b.select(*columns, F.lit("b").alias("replica")))
    places = materialize(places, compact=True)
    trees = tree(places, range_bytes, fan_out, levels, ("replica", "volume"))

    def both(level: int, wrong: DataFrame | None, parent: Column | None) -> DataFrame:
        nodes = trees[level].select("replica", "volume", "node", "digest")
        if wrong is not None:
            nodes = nodes.join(wrong, (F.col("volume") == F.col("w_volume")) & (parent == F.col("w_node")), "left_semi")
        sides = [F.max(F.when(F.col("replica") == k, F.col("digest"))).alias(f"digest_{k}") for k in "ab"]
        return materialize(nodes.groupBy("volume", "node").agg(*sides).withColumn("same", F.col("digest_a").eqNullSafe(F.col("digest_b"))), compact=True)

    roots = both(levels, None, None)
    seen, looked = roots, None
    for level in range(levels - 1, -1, -1):
        wrong = seen.where("not same").select(F.col("volume").alias("w_volume"), F.col("node").alias("w_node"))
        seen = both(level, wrong, F.lit(0).cast("long") if level == levels - 1 else F.floor(F.col("node") / fan_out).cast("long"))
        here = seen.select("volume")
        looked = here if looked is None else looked.unionByName(here)
    wrong = seen.where("not same").select(F.col("volume").alias("w_volume"), F.col("node").alias("w_node"))

    here = F.floor(F.col("offset") / range_bytes).cast("long")
    suspects = places.join(wrong, (F.col("volume") == F.col("w_volume")) & (here == F.col("w_node")), "left_semi")
    keys = ["volume", "page_id", "length", "digest"]
    held = suspects.withColumn("side", F.when(F.col("replica") == "a", 1).otherwise(-1))
    # As many copies of a record as both replicas hold at one offset cancel out first, then those at any offset.
    at = held.groupBy(*keys, "offset").agg(F.sum("side").alias("more")).where("more <> 0")
    of = at.groupBy(*keys).agg(F.sum("more").alias("more"), F.sum(F.greatest("more", F.lit(0))).alias("only_a"))
    found = of.groupBy("volume").agg(
        F.array_sort(F.collect_set(F.when(F.col("more") != 0, F.col("page_id")))).alias("bad_pages"), F.count_if((F.col("more") != 0) & F.col("page_id").isNull()).alias("n_nameless"),
        F.sum(F.col("only_a") - F.greatest("more", F.lit(0))).alias("n_shifted"),
    )
    compared = looked.groupBy("volume").agg(F.count("*").alias("n_compared"))
    sizes = places.where("replica = 'a'").groupBy("volume").agg(F.count("*").alias("n_records"), F.sum("length").alias("n_bytes"))
    out = roots.select("volume", F.col("digest_a").alias("root_a"), F.col("digest_b").alias("root_b"), F.col("same").alias("intact"))
    out = out.join(sizes, "volume", "left").join(compared, "volume", "left").join(found, "volume", "left")
    return out.select(
        "volume", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_records", "n_bytes")], "root_a", "root_b", "intact",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_compared", "n_nameless", "n_shifted")], F.coalesce("bad_pages", F.array().cast("array<bigint>")).alias("bad_pages"),
    )
