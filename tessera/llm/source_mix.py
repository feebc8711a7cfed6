"""Mixing sources to target weights: blocks of words, counts drawn for each shard, and blocks joined by index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

WORD = "[^\\x20\\x09-\\x0D]+"
#: Words of a block, slots of an output shard, groups of rows of a chunk of a source, steps of a permutation.
BLOCK_WORDS, SHARD_SLOTS, CHUNK_ROWS, ROUNDS = 128, 1024, 2048, 24
#: Weights of the sources in order, repeating; size of the mix against the input's; most that is taken of a source.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Below this prime the bit that decides a step of a permutation is computed.
PRIME = 2_147_483_647
#: Parts into which the range of draws is cut to look up the source of one.
CELLS = 1024
SEED = "mix"


@dataclass
class Mix:
    """rows: every row's place in its source's words, and its text's digest; sources; slots: shard, slot, source_no, block."""

    rows: DataFrame
    empty: DataFrame
    sources: DataFrame
    slots: DataFrame
    block_words: int


def number(*parts: Column | str) -> Column:
    """60 bits that depend on all parts and on SEED."""
    text = F.concat_ws(":", F.lit(SEED), *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _before(value: str, window) -> Column:
    return F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def running(df: DataFrame, group: str, order: str, value: str, width: int = CHUNK_ROWS) -> DataFrame:
    """Adds ``before``, the sum of ``value`` over the rows of the group with a smaller ``order``, numbered from 0.

    Sums of ``width`` consecutive rows are added up first, so that no window holds more than those or than one row for
    each of them. ``order`` must be unique in its group.
    """
    span = F.floor(F.col(order) / width).cast("long")
    sums = df.groupBy(F.col(group).alias("of_group"), span.alias("of_span")).agg(F.sum(value).alias("of_sum"))
    sums = sums.withColumn("of_before", _before("of_sum", Window.partitionBy("of_group").orderBy("of_span"))).drop("of_sum")
    rows = df.withColumn("span", span).join(sums, (F.col(group) == F.col("of_group")) & (F.col("span") == F.col("of_span")))
    inside = _before(value, Window.partitionBy(group, "span").orderBy(order))
    return rows.withColumn("before", F.col("of_before") + inside).drop("span", "of_group", "of_span", "of_before")


def targets(sizes: DataFrame, block_words: int) -> DataFrame:
    """The sources in order with weight, target, n_blocks and quota, the blocks that the mix takes of each.

    ``sizes``: source, source_size. Sources ascend by code point, null last. Their targets are the weights' shares of
    SHARE times all words; a target above MOST times its source's size stops there and the excess goes to the others by
    weight, until none is above. In order of size by weight the sources that stop come first, so that one pass finds
    them. One row for each source meets in a task here, whatever the number of documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    out = sizes.withColumn("source_no", F.row_number().over(order).cast("long") - 1)
    out = out.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("source_no") % len(WEIGHTS) + 1).cast("int")))
    out = out.withColumn("most", F.lit(float(MOST)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "source_no")
    everything = Window.partitionBy()
    left = F.lit(SHARE) * F.sum("source_size").over(everything) - _before("most", by_ratio)
    level = left / (F.sum("weight").over(everything) - _before("weight", by_ratio))
    out = out.withColumn("level", level)
    share = F.min(F.when(F.col("most") >= F.col("level") * F.col("weight"), F.struct(F.col("most") / F.col("weight"), "source_no", "level"))).over(everything)
    out = out.withColumn("share", share["level"])
    out = out.withColumn("target", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least("most", F.col("share") * F.col("weight"))))
    out = out.withColumn("n_blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    quota = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.round(F.col("target") * F.col("n_blocks") / F.col("source_size"))).cast("long")
    out = out.withColumn("quota", quota).withColumn("ahead", _before("quota", order).cast("long"))
    return out.select("source", "source_no", "source_size", "n_groups", "weight", "target", "n_blocks", "quota", "ahead")


def permuted(index: Column, n: Column, keys: Column) -> Column:
    """Where a pseudorandom permutation of 0..n-1 puts ``index``: the swap-or-not shuffle, exact for any n.

    Each step pairs x with (k - x) mod n and moves to the larger or the smaller of both by one bit of the larger, so it
    is its own inverse; ``keys`` holds (k, a, b) of each step.
    """

    def step(x: Column, key: Column) -> Column:
        partner = (key["k"] + n - x) % n
        high = F.greatest(x, partner)
        return F.when((high % PRIME * key["a"] + key["b"]) % PRIME % 2 == 1, partner).otherwise(x)

    return F.aggregate(keys, index, step)


def _keys(n: Column, *of: Column | str) -> Column:
    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.transform(rounds, lambda r: F.struct((number("k", *of, r) % n).alias("k"), (number("a", *of, r) % PRIME).alias("a"), (number("b", *of, r) % PRIME).alias("b")))


def _draws(spark, sources: DataFrame, total: int, shard_slots: int) -> DataFrame:
    """Multinomial counts of each shard: shard, source_no, n. Each slot draws a number below the sum of quotas.

    The source of a number is looked up by the cell it falls into, of which CELLS cover the range: a cell lists the
    sources that reach into it, so there are no more rows than cells and sources together, and no loop over sources.
    """
    cell = lambda at: F.floor(at * F.lit(float(CELLS)) / F.lit(float(total))).cast("long")
    ends = sources.where("quota > 0").select("source_no", "ahead", (F.col("ahead") + F.col("quota")).alias("until"))
    cells = ends.select("source_no", "ahead", "until", F.explode(F.sequence(cell(F.col("ahead")), cell(F.col("until") - 1))).alias("of_cell"))
    slots = spark.range(total).select(F.floor(F.col("id") / shard_slots).cast("long").alias("shard"), (number("draw", F.col("id")) % total).alias("drawn")).withColumn("cell", cell(F.col("drawn")))
    found = slots.join(cells, (F.col("cell") == F.col("of_cell")) & (F.col("drawn") >= F.col("ahead")) & (F.col("drawn") < F.col("until")))
    return found.groupBy("shard", "source_no").agg(F.count("*").alias("n"))


def _slots(spark, sources: DataFrame, shard_slots: int) -> DataFrame:
    """The slots of all shards: shard, slot, source_no, index, the index within the blocks that the mix takes of the source.

    A source's slots are numbered through all shards. Draws sum to the quotas only nearly: what a source has drawn
    above its quota is handed, number by number, to sources below theirs.
    """
    total = sources.agg(F.sum("quota")).first()[0] or 0
    counts = materialize(_draws(spark, sources, max(total, 1), shard_slots).where(F.lit(total > 0)), compact=True)
    drawn = sources.select("source_no", "quota").join(counts.groupBy(F.col("source_no").alias("of")).agg(F.sum("n").alias("n")), F.col("source_no") == F.col("of"), "left").select("source_no", "quota", F.coalesce("n", F.lit(0)).alias("drawn"))
    order = Window.orderBy("source_no")
    settled = drawn.withColumn("over", F.greatest(F.col("drawn") - F.col("quota"), F.lit(0))).withColumn("under", F.greatest(F.col("quota") - F.col("drawn"), F.lit(0)))
    settled = materialize(settled.withColumn("over_ahead", _before("over", order)).withColumn("under_ahead", _before("under", order)), compact=True)

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    gives = settled.where("over > 0").select("source_no", "quota", "over_ahead", each("over").alias("i")).select(F.col("source_no").alias("from_no"), (F.col("quota") + F.col("i")).alias("from_index"), (F.col("over_ahead") + F.col("i")).alias("x"))
    takes = settled.where("under > 0").select("source_no", "drawn", "under_ahead", each("under").alias("i")).select(F.col("source_no").alias("to_no"), (F.col("drawn") + F.col("i")).alias("to_index"), (F.col("under_ahead") + F.col("i")).alias("x"))
    moves = gives.join(takes, "x").drop("x")
    numbered = running(counts, "source_no", "shard", "n").withColumn("offset", _before("n", Window.partitionBy("shard").orderBy("source_no")))
    length = F.least(F.lit(shard_slots).cast("long"), F.lit(total) - F.col("shard") * shard_slots)
    slots = numbered.withColumn("length", length).withColumn("keys", _keys(F.col("length"), "shard", F.col("shard"))).select("shard", "source_no", "before", "offset", "length", "keys", each("n").alias("i"))
    slots = slots.select("shard", permuted(F.col("offset") + F.col("i"), F.col("length"), F.col("keys")).alias("slot"), "source_no", (F.col("before") + F.col("i")).alias("index"))
    quotas = sources.select(F.col("source_no").alias("q_no"), F.col("quota"))
    slots = slots.join(quotas, F.col("source_no") == F.col("q_no")).drop("q_no")
    moved = slots.where("index >= quota").join(moves, (F.col("source_no") == F.col("from_no")) & (F.col("index") == F.col("from_index")))
    return slots.where("index < quota").select("shard", "slot", "source_no", "index").unionByName(moved.select("shard", "slot", F.col("to_no").alias("source_no"), F.col("to_index").alias("index")))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> Mix:
    """Plans a mix of all sources of ``docs``: which blocks of words stand in which slots of which output shards.

    The words of a source, document after document in an order that a hash of the doc_id gives, are packed into blocks
    of ``block_words``, the last one shorter. :func:`targets` gives the blocks that the mix takes of each source, each
    shard of ``shard_slots`` slots draws multinomial counts of them, and the slots of a source, numbered through all
    shards, run through permutations of its blocks, a new one each time round: no block comes a third time, so no
    document exceeds MOST times its size.

    Null texts count as empty; texts without words take part with nothing. A null source is one, after the others. Rows
    without a doc_id are dealt by their text. Equal rows are counted once and numbered; of rows that repeat a doc_id
    the smaller come first. Texts of any length are cut between words wherever a block ends. An empty table mixes
    nothing; other columns are ignored. Reruns agree: nothing depends on how rows are dealt.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), text))
    rows = docs.select(
        F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long").alias("spread"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.md5(text).alias("digest"),
    )
    groups = materialize(rows.groupBy("source", "doc_id", "spread", "size", "digest").agg(F.count("*").alias("copies")))
    sizes = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("n_groups"))
    sources = materialize(targets(sizes, block_words), compact=True)

    of = sources.select(F.col("source").alias("of_source"), "source_no", F.ceil(F.col("n_groups") / CHUNK_ROWS).alias("n_chunks"))
    named = groups.join(of, F.col("source").eqNullSafe(F.col("of_source")))
    empty = named.where("size = 0").select("source_no", "doc_id", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")
    named = named.where("size > 0").select("source_no", "doc_id", "spread", "size", "digest", "copies", F.floor(F.col("spread") * F.col("n_chunks") / F.lit(float(1 << 32))).cast("long").alias("chunk"), (F.col("size") * F.col("copies")).alias("words"))
    starts = running(named.groupBy("source_no", "chunk").agg(F.sum("words").alias("words")), "source_no", "chunk", "words")
    starts = starts.select(F.col("source_no").alias("s_no"), F.col("chunk").alias("s_chunk"), F.col("before").alias("chunk_start"))
    inside = _before("words", Window.partitionBy("source_no", "chunk").orderBy("spread", F.col("doc_id").asc_nulls_first(), "size", "digest"))
    placed = named.withColumn("inside", inside).join(starts, (F.col("source_no") == F.col("s_no")) & (F.col("chunk") == F.col("s_chunk")))
    placed = placed.select("source_no", "doc_id", "size", "digest", (F.col("chunk_start") + F.col("inside")).alias("first"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    placed = placed.withColumn("first", F.col("first") + F.col("copy") * F.col("size")).drop("copy")

    rounds = sources.where("n_blocks > 0").select(F.col("source_no").alias("r_no"), "n_blocks", F.explode(F.array(*[F.lit(i).cast("long") for i in range(MOST)])).alias("r_epoch"))
    rounds = materialize(rounds.withColumn("keys", _keys(F.col("n_blocks"), "source", F.col("r_no"), F.col("r_epoch"))), compact=True)
    counts = rounds.where("r_epoch = 0").select(F.col("r_no").alias("c_no"), F.col("n_blocks").alias("n"))
    slots = _slots(spark, sources, shard_slots).join(counts, F.col("source_no") == F.col("c_no")).withColumn("epoch", F.floor(F.col("index") / F.col("n")).cast("long"))
    slots = slots.join(rounds, (F.col("source_no") == F.col("r_no")) & (F.col("epoch") == F.col("r_epoch")))
    slots = slots.select("shard", "slot", "source_no", permuted(F.col("index") % F.col("n"), F.col("n"), F.col("keys")).alias("block"))
    return Mix(placed, empty, sources, slots, block_words)


def pieces(of: Mix) -> DataFrame:
    """The part of each row that stands in each block of its source: source_no, block, at (word of the block), skip (words of the row before it), words, and the row."""
    b = of.block_words
    out = of.rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / b), F.floor((F.col("first") + F.col("size") - 1) / b))))
    begin = F.greatest(F.col("first"), F.col("block") * b)
    out = out.withColumn("at", begin - F.col("block") * b).withColumn("skip", begin - F.col("first"))
    return out.withColumn("words", F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * b) - begin)


def taken(of: Mix) -> DataFrame:
    """What the mix takes of each row: doc_id, size, source_size, target, taken; a row for each row of the documents."""
    picks = of.slots.groupBy(F.col("source_no").alias("p_no"), F.col("block").alias("p_block")).agg(F.count("*").alias("times"))
    found = pieces(of).join(picks, (F.col("source_no") == F.col("p_no")) & (F.col("block") == F.col("p_block")), "left")
    rows = found.groupBy("source_no", "doc_id", "size", "first").agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken")).drop("first")
    rows = rows.unionByName(of.empty.withColumn("taken", F.lit(0).cast("long")))
    sources = of.sources.select(F.col("source_no").alias("of"), "source_size", "target")
    return rows.join(sources, F.col("source_no") == F.col("of")).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def texts(of: Mix, docs: DataFrame) -> DataFrame:
    """The mix itself: shard, slot, source, text, the words of each slot's block joined by one space.

    Blocks join the slots by their index, and the texts by doc_id, source and digest, so each text is cut where it is.
    A block has no more pieces than words.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = docs.select(F.col("doc_id").cast("long").alias("t_id"), F.col("source").cast("string").alias("t_source"), F.md5(text).alias("t_digest"), text.alias("text")).dropDuplicates(["t_id", "t_source", "t_digest"])
    names = of.sources.select(F.col("source_no").alias("n_no"), "source")
    parts = pieces(of).join(names, F.col("source_no") == F.col("n_no"))
    parts = parts.join(whole, F.col("doc_id").eqNullSafe(F.col("t_id")) & F.col("source").eqNullSafe(F.col("t_source")) & (F.col("digest") == F.col("t_digest")))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    parts = parts.select("source", "source_no", "block", "at", F.array_join(F.slice(words, (F.col("skip") + 1).cast("int"), F.col("words").cast("int")), " ").alias("part"))
    blocks = parts.groupBy("source", "source_no", "block").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"))
    blocks = blocks.select("source", F.col("source_no").alias("b_no"), F.col("block").alias("b_block"), F.array_join(F.transform("parts", lambda p: p["part"]), " ").alias("text"))
    return of.slots.join(blocks, (F.col("source_no") == F.col("b_no")) & (F.col("block") == F.col("b_block"))).select("shard", "slot", "source", "text")
