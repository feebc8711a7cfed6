"""Merkle manifest of a table: a tree over the rows of each source, one over the sources, and a proof for every row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize

#: Nodes that one node of the next level holds; levels after which proofs are written out.
FAN_OUT, WRITTEN = 3, 4


def sealed(of: Column) -> Column:
    """A value as the hash takes it: ``-`` for null, else its length in UTF-8 bytes, a colon, itself."""
    text = of.cast("string")
    return F.when(of.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[sealed(v) for v in values]), 256)


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def proof_digest(proof: Column) -> Column:
    """Hash of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(_hex(s["before"]), _hex(s["after"]))), ""), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf, as hex text, and its siblings lead to."""
    return F.aggregate(proof, leaf, lambda acc, s: F.sha2(F.concat(_hex(s["before"]), acc, _hex(s["after"])), 256))


def _numbered(leaves: DataFrame) -> DataFrame:
    """Level 0: (tree, place, width, digest, doc_id, carried), trees numbered by source, places by doc_id.

    Rows are dealt by ranges of source and doc_id, numbered within each range and source, and raised by what the ranges
    before hold of the source; a large source is many ranges. Only a row for each range and source meets elsewhere, and
    only a row for each source is ordered in one task.
    """
    spark = leaves.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("digest")]
    # Equal rows are told apart by any number, so that they need not share a range.
    dealt = materialize(leaves.repartitionByRange(parts, *order, F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()))
    counts = materialize(dealt.groupBy("part", "source").agg(F.count("*").alias("n")), compact=True)
    of_source = Window.partitionBy("source").orderBy("part")
    whole = Window.partitionBy("source")
    ahead = counts.withColumn("first", F.coalesce(F.sum("n").over(of_source.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("width", F.sum("n").over(whole))
    trees = counts.select("source").distinct().withColumn("tree", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_first())).cast("long") - 1)
    ahead = ahead.alias("a").join(trees.alias("t"), F.col("a.source").eqNullSafe(F.col("t.source"))).select(F.col("a.part").alias("a_part"), F.col("a.source").alias("a_source"), "first", "width", "tree")
    inside = dealt.withColumn("inside", F.row_number().over(Window.partitionBy("part", "source").orderBy(*order[1:])) - 1)
    placed = inside.join(ahead, (F.col("part") == F.col("a_part")) & F.col("source").eqNullSafe(F.col("a_source")))
    out = materialize(placed.select("tree", (F.col("first") + F.col("inside")).alias("place"), "width", "digest", "doc_id", "carried"))
    discard(dealt, counts)
    return out


def build(leaves: DataFrame) -> list[DataFrame]:
    """The levels of every tree, lowest first: (tree, place, width, digest, children), each written out.

    ``leaves`` is the written level 0: (tree, place, width, digest), ``width`` nodes of the tree at this level. Every
    FAN_OUT consecutive nodes become one, the last ones fewer; a tree of one node is done and goes no higher.
    """
    levels = [leaves]
    width = leaves.agg(F.max("width")).first()[0] or 0
    while width > 1:
        below = levels[-1].where("width > 1").groupBy("tree", "width", F.floor(F.col("place") / FAN_OUT).alias("up")).agg(F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("nodes"))
        children = below.select("tree", F.col("up").cast("long").alias("place"), F.ceil(F.col("width") / FAN_OUT).cast("long").alias("width"), F.transform("nodes", lambda x: x["digest"]).alias("children"))
        joined = F.sha2(F.array_join(F.transform("children", _hex), ""), 256)
        levels.append(materialize(children.withColumn("digest", F.unhex(joined)), compact=True))
        width = -(-width // FAN_OUT)
    return levels


def push(levels: list[DataFrame], inherited: DataFrame, keep: list[str]) -> DataFrame:
    """Proofs of the lowest level: (tree, place, subroot, proof) and the columns ``keep`` of that level.

    ``inherited`` (tree, subroot, proof) is what each tree's root starts with. From the top down, children join their
    parents and put their own siblings before the proof of the parent, so that nothing but a node's ancestors is read.
    Every WRITTEN levels the proofs so far, of ever fewer nodes than rows, are written out, which keeps plans short.
    """

    def at_root(level: DataFrame) -> DataFrame:
        roots = level.where("width = 1")
        return roots.join(inherited.select(F.col("tree").alias("of"), "subroot", "proof"), F.col("tree") == F.col("of")).drop("of")

    down = at_root(levels[-1])
    for k in range(len(levels) - 2, -1, -1):
        level = levels[k]
        if (len(levels) - 2 - k) % WRITTEN == WRITTEN - 1:
            down = materialize(down, compact=True)
        parents = down.select(F.col("tree").alias("of"), F.col("place").alias("up"), F.col("children").alias("nodes"), "subroot", F.col("proof").alias("rest"))
        joined = level.where("width > 1").join(parents, (F.col("tree") == F.col("of")) & (F.floor(F.col("place") / FAN_OUT).cast("long") == F.col("up")))
        mine = F.pmod(F.col("place"), F.lit(FAN_OUT)).cast("int")
        join = lambda nodes: F.aggregate(nodes, F.unhex(F.lit("")), lambda acc, x: F.concat(acc, x))
        siblings = F.struct(join(F.slice("nodes", F.lit(1), mine)).alias("before"), join(F.slice("nodes", mine + 2, F.lit(FAN_OUT))).alias("after"))
        down = joined.withColumn("proof", F.concat(F.array(siblings), F.col("rest"))).select(*level.columns, "subroot", "proof").unionByName(at_root(level).select(*level.columns, "subroot", "proof"))
    return down.select("tree", "place", "subroot", "proof", *keep)


def manifest(docs: DataFrame, carry: Callable[[], Column] | None = None) -> DataFrame:
    """Leaf, roots and proof of every row: doc_id, leaf, subroot, root, proof, carried.

    A leaf hashes doc_id, source, lang, n_chars and text, each ``-`` if null, else its bytes' number, a colon and
    itself. The leaves of a source, in order of doc_id, nulls first, make a tree in which each node hashes up to three
    below it; their roots, in order of source, null first, make the tree of the whole table. ``proof`` holds for each
    level, from the leaf to the root, the digests ``before`` and ``after`` the node among the children of its parent:
    :func:`folded` leads back to the root from it. ``carry`` gives a column of the rows of ``docs`` to be handed on.

    Null and empty values differ, a null source is a source. Rows that repeat a doc_id are leaves each, in order of
    their digests; equal rows have neighbouring places. An empty table gives no rows; other columns are ignored. Texts
    of any length are read once, where they are; only digests are shuffled.
    """
    carried = carry() if carry else F.lit(None).cast("string")
    digest = F.unhex(leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]))
    leaves = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), digest.alias("digest"), carried.alias("carried")))
    lowest = _numbered(leaves)
    discard(leaves)
    levels = build(lowest)
    subroots = levels[0].where("width = 1").select("tree", "digest")
    for level in levels[1:]:
        subroots = subroots.unionByName(level.where("width = 1").select("tree", "digest"))
    subroots = materialize(subroots, compact=True)
    n_trees = subroots.count()
    top = build(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(n_trees).cast("long").alias("width"), "digest"))
    root = top[-1].first()
    nothing = F.array().cast("array<struct<before:binary,after:binary>>")
    start = top[-1].select("tree", F.col("digest").alias("subroot"), nothing.alias("proof"))
    over = push([level if "children" in level.columns else level.withColumn("children", F.array().cast("array<binary>")) for level in top], start, ["digest"])
    over = materialize(over.select(F.col("place").alias("tree"), F.col("digest").alias("subroot"), "proof"), compact=True)
    levels[0] = levels[0].withColumn("children", F.array().cast("array<binary>"))
    out = push(levels, over, ["doc_id", "digest", "carried"])
    whole = F.lit(bytes(root["digest"]) if root else None).cast("binary")
    return out.select("doc_id", _hex(F.col("digest")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(whole).alias("root"), "proof", "carried")
