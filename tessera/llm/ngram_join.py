"""Similarity join on word n-grams: a blocked product of the document by n-gram incidence with size-derived bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, by_groups, components, discard, in_blocks, materialize, member_filter, slices

#: Counters of the frequency sketch that orders n-grams from rare to common (its size is the bound of what is broadcast).
COUNTERS = 1 << 18
#: Entries of the incidence matrix that one chunk of a block of the product holds; documents from which a column counts
#: as long; rows that are multiplied at once.
BLOCK, LONG_COLUMN, ROWS = 16_384, 64, 256
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams.

    A-Z are lower-cased and words are runs of other than space, tab, newline, vertical tab, form feed and carriage
    return. With fewer than n words the whole sequence is one n-gram; without words there is none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < n:
        return np.array([xxhash.xxh64_intdigest(b"\0".join([b"short", *words]))], dtype=np.uint64) if words else np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w) for w in words], dtype=np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out += (h[k : len(h) - n + 1 + k] ^ np.uint64(k)) * MULTIPLIERS[k % 5]
    out ^= out >> np.uint64(29)
    return np.unique(out)


def prefix_length(n: int, percent: int) -> int:
    """Sets of which one has n members and whose Jaccard reaches ``percent`` share one of its first this many members."""
    return n - -(-percent * n // 100) + 1 if n else 0


def linked(size_a: int, size_b: int, overlap: int, percent: int) -> bool:
    return 100 * overlap >= percent * (size_a + size_b - overlap)


def ngram_jaccard_join(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """Links documents whose n-gram sets have a Jaccard similarity of ``percent`` or more: doc_id, n_shingles, component_id.

    The product of the document by n-gram incidence matrix with its transpose holds the overlap of each pair. Its rows
    and columns are bounded first: documents with equal sets count as one row; n-grams are ordered from rare to common
    by a frequency sketch over all documents, and a document enters only the columns of its first members, as many as
    its size requires to meet every partner. The product is formed in blocks of some columns and a bounded number of
    their entries; overlap counts are accumulated per pair, in the block and then over the blocks, and a pair is
    discarded where sizes and count leave too few members to reach the similarity. Of what is left the overlap of the
    whole sets decides. Each document is first compared with one partner, the one with which it shares most
    columns among the documents whose columns are shared most, and the product is then formed between different
    components only, so components are those of all links.

    component_id is the smallest doc_id reachable by links, itself included. Null, empty and blank texts have 0
    n-grams and are linked with nothing. Repeated rows are returned each and link as copies do; several texts with one
    doc_id are one node, which links where any of them does; a null doc_id is returned but represents nothing; other
    columns are ignored; an empty table gives no rows. n-grams are 64-bit hashes: that two differing ones of one
    document of m n-grams share one has probability m * m / 2**65, and sets are told apart by 128 bits.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros(COUNTERS, np.int64)
        for batch in slices(batches):
            sets = [shingles(t, n) for t in batch["text"]]
            found += np.bincount((np.concatenate(sets) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS) if sets else 0
        at = np.flatnonzero(found)
        yield pd.DataFrame({"at": at.astype(np.int32), "n": found[at]})

    sketch = rows.mapInPandas(counted, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    common = np.zeros(COUNTERS, np.uint8)
    common[sketch["at"]] = np.floor(4 * np.log2(sketch["n"])).astype(np.uint8)
    order = spark.sparkContext.broadcast(common)

    def first_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        how_common = order.value
        for batch in slices(batches):
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                s = shingles(text, n)
                ranked = s[np.lexsort((s, how_common[(s % np.uint64(COUNTERS)).astype(np.int64)]))]
                out.append((doc_id, len(s), set_digest(s), ranked[: prefix_length(len(s), percent)].view(np.int64)))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "digest", "members"])

    sets = materialize(rows.mapInPandas(first_members, "doc_id long, n_shingles long, digest binary, members array<long>"))
    groups = sets.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"), F.first("members").alias("members"))
    groups = materialize(groups, compact=True)
    exploded = groups.select("rep", "size", F.explode("members").alias("member"))
    shared = materialize(exploded.groupBy("member").agg(F.count("*").alias("n_docs")).where("n_docs > 1").select(F.col("member").alias("shared_member")), compact=True)
    columns = materialize(exploded.join(shared, F.col("member") == F.col("shared_member")).drop("shared_member"), compact=True)

    homes, first = _first_partners(columns, percent)
    found = _verified(first, rows, n, percent)
    member_of = materialize(components(found).select(F.col("node").alias("c_node"), F.col("component")), compact=True)

    # What is left of each column: pairs of different components. Columns with one smallest hub, as those of a group of
    # near copies have, are multiplied together, so that their pairs are counted and discarded in the block.
    left = columns.join(member_of, F.col("rep") == F.col("c_node"), "left").join(homes, F.col("rep") == F.col("h_rep"), "left")
    left = materialize(left.select("member", "rep", "size", F.coalesce("component", "rep").alias("component"), F.coalesce("home", "rep").alias("home")), compact=True)
    mixed = left.groupBy("member").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("home").alias("anchor")).where("low <> high")
    mixed = materialize(mixed.select(F.col("member").alias("m_member"), "anchor"), compact=True)
    open_columns = materialize(left.join(mixed, F.col("member") == F.col("m_member")).drop("m_member", "home"), compact=True)
    totals = open_columns.groupBy("rep", "size").agg(F.count("*").alias("total")).select(F.col("rep").alias("t_rep"), F.col("size").alias("t_size"), "total")
    counted_columns = open_columns.join(totals, (F.col("rep") == F.col("t_rep")) & (F.col("size") == F.col("t_size"))).drop("t_rep", "t_size")
    counted_columns = materialize(counted_columns, compact=True)
    blocks = in_blocks(counted_columns, ["anchor"], "rep", BLOCK)
    met = by_groups(blocks, ["anchor", "block_a", "block_b"], lambda group: block_product(group, percent), "a long, b long, size_a long, size_b long, met long")
    met = met.groupBy("a", "b", "size_a", "size_b").agg(F.sum("met").alias("met")).where(_enough(F.col("size_a"), F.col("size_b"), F.col("met"), percent))
    pairs = materialize(met.select("a", "b").distinct().join(first, ["a", "b"], "left_anti"), compact=True)
    discard(columns, homes, left, mixed, open_columns, counted_columns, shared)
    more = _verified(pairs, rows, n, percent)
    known = member_of.select(F.col("c_node").alias("a"), F.col("component").alias("b"))
    member_of_all = components(known.unionByName(more))
    by_digest = groups.select(F.col("digest").alias("g_digest"), "rep").join(member_of_all, F.col("rep") == F.col("node"), "left")
    by_digest = materialize(by_digest.select("g_digest", F.coalesce("component", "rep").alias("component")), compact=True)
    # Of the sets only what the result needs stays.
    ids = materialize(sets.select("doc_id", "n_shingles", "digest"))
    discard(sets, groups, first, found, member_of, pairs, more)
    out = ids.join(by_digest, F.col("digest") == F.col("g_digest"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def set_digest(members: np.ndarray) -> bytes | None:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest() if len(members) else None


def _first_partners(columns: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(h_rep, home) and pairs a < b for the documents of ``columns(rep, size, member)``.

    In each column the document with the greatest share of shared columns is the hub; a document's home is the hub it
    meets most often. The pairs are those of documents and homes that are likely linked; what is not found here is
    found by the product.
    """
    weight = columns.groupBy("rep").agg(F.count("*").alias("n_shared"), F.first("size").alias("size"))
    weight = weight.select(F.col("rep").alias("w_rep"), (F.col("n_shared") / F.col("size")).alias("weight"))
    weighed = materialize(columns.join(weight, F.col("rep") == F.col("w_rep")).select("rep", "size", "member", "weight"), compact=True)
    hub = F.max(F.struct("weight", (-F.col("rep")).alias("minus"), F.col("size").alias("hub_size"))).alias("hub")
    hubs = materialize(weighed.groupBy("member").agg(hub).select(F.col("member").alias("h_member"), "hub"), compact=True)
    met = weighed.join(hubs, F.col("member") == F.col("h_member")).groupBy("rep", "size", F.col("hub.minus").alias("minus"), F.col("hub.hub_size").alias("hub_size")).agg(F.count("*").alias("met"))
    other = F.col("rep") != -F.col("minus")
    likely = other & _sizes_fit(F.col("size"), F.col("hub_size"), percent) & _enough(F.col("size"), F.col("hub_size"), F.col("met"), percent)
    best = met.groupBy("rep").agg(F.max(F.struct("met", "minus")).alias("best"), F.max(F.when(likely, F.struct("met", "minus"))).alias("pair"))
    best = materialize(best.select(F.col("rep").alias("h_rep"), (-F.col("best.minus")).alias("home"), (-F.col("pair.minus")).alias("partner")), compact=True)
    pairs = best.where("partner is not null").select(F.least("h_rep", "partner").alias("a"), F.greatest("h_rep", "partner").alias("b")).distinct()
    pairs = materialize(pairs, compact=True)
    discard(weighed, hubs)
    return best.select("h_rep", "home"), pairs


def _sizes_fit(size_a: Column, size_b: Column, percent: int) -> Column:
    return 100 * F.least(size_a, size_b) >= percent * F.greatest(size_a, size_b)


def _enough(size_a: Column, size_b: Column, met: Column, percent: int) -> Column:
    """Whether two sets that share ``met`` of their first members can reach the similarity.

    All common members up to the last of the first members of one of the two are among those met; so beyond them
    there are at most those that come after its first members, which are one less than ``percent`` of its size.
    """
    beyond = F.ceil(F.greatest(size_a, size_b) * percent / 100) - 1
    return (100 + percent) * (met + beyond) >= percent * (size_a + size_b)


def block_product(group: dict[str, np.ndarray], percent: int) -> dict[str, np.ndarray] | None:
    """Overlap counts of a block: of each pair of one chunk and the other, of different components and sizes that fit.

    ``group`` has the entries of the block: member, rep, size, component, total (columns of the document in all blocks)
    and chunk. A pair is discarded where its count and what the columns elsewhere can add are too few. Columns with
    many documents are multiplied densely, some rows at a time; of the others the pairs are listed.
    """
    members, column = np.unique(group["member"], return_inverse=True)
    keys = np.stack([group["rep"], group["size"]], axis=1)
    docs, first, row = np.unique(keys, axis=0, return_index=True, return_inverse=True)
    row = row.ravel()
    component, chunk = group["component"][first], group["chunk"][first]
    elsewhere = group["total"][first] - np.bincount(row, minlength=len(docs))
    a, b = group["block_a"][0], group["block_b"][0]
    left, right = np.flatnonzero(chunk == a), np.flatnonzero(chunk == b)
    if not len(left) or not len(right):
        return None
    held = np.bincount(column)
    long = np.flatnonzero(held > LONG_COLUMN)
    dense = np.zeros((len(docs), len(long)), np.float32)
    place = np.full(len(members), -1)
    place[long] = np.arange(len(long))
    at = place[column]
    dense[row[at >= 0], at[at >= 0]] = 1
    short_i, short_j = _pairs_of(column[at < 0], row[at < 0])
    begin = np.searchsorted(short_i, np.arange(0, len(docs) + ROWS, ROWS))
    out = []
    for k, start in enumerate(range(0, len(docs), ROWS)):
        end = min(start + ROWS, len(docs))
        count = dense[start:end] @ dense.T
        np.add.at(count, (short_i[begin[k] : begin[k + 1]] - start, short_j[begin[k] : begin[k + 1]]), 1)
        size, least, most = docs[start:end, 1, None], np.minimum(docs[start:end, 1, None], docs[:, 1]), np.maximum(docs[start:end, 1, None], docs[:, 1])
        reach = count + np.minimum(elsewhere[start:end, None], elsewhere) - (-percent * most // 100) - 1
        fit = (100 * least >= percent * most) & ((100 + percent) * reach >= percent * (size + docs[:, 1]))
        sides = (chunk[start:end, None] == a) & (chunk == b)
        if a == b:
            sides &= docs[start:end, 0, None] < docs[:, 0]
        i, j = np.nonzero((count > 0) & fit & sides & (component[start:end, None] != component))
        out.append((i + start, j, count[i, j]))
    i, j, n = (np.concatenate(x) for x in zip(*out, strict=True))
    if not len(i):
        return None
    i, j = np.where(docs[i, 0] < docs[j, 0], i, j), np.where(docs[i, 0] < docs[j, 0], j, i)
    return {"a": docs[i, 0], "b": docs[j, 0], "size_a": docs[i, 1], "size_b": docs[j, 1], "met": n.astype(np.int64)}


def _pairs_of(column: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), both ways and by i, of the rows that share a column, once for each column they share."""
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    ends = np.flatnonzero(np.diff(column, append=-1)) + 1
    sizes = np.diff(ends, prepend=0)
    of = np.repeat(sizes, sizes)
    i = np.repeat(row, of)
    start = np.repeat(np.repeat(ends - sizes, sizes), of)
    j = row[start + np.arange(len(i)) - np.repeat(np.cumsum(of) - of, of)]
    by = np.argsort(i, kind="stable")
    return i[by], j[by]


def _sets(rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """Whole sets (id, members) of at least the ids ``wanted(id)``, one row for each of an id's different sets.

    A bitmap of hashed ids spares most other texts the work.
    """
    listed = member_filter(wanted, "id")

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            found = [shingles(t, n) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["doc_id"], "digest": [set_digest(s) for s in found], "members": [s.view(np.int64) for s in found]})

    some = rows.where("doc_id is not null").where(listed(F.col("doc_id")))
    once = some.mapInPandas(whole, "id long, digest binary, members array<long>").where("digest is not null")
    return materialize(once.groupBy("id", "digest").agg(F.first("members").alias("members")).select("id", "members"), compact=True)


def _verified(pairs: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of which some sets are linked."""
    sets = _sets(rows, pairs.select(F.explode(F.array("a", "b")).alias("id")), n)
    left = sets.select(F.col("id").alias("id_a"), F.col("members").alias("set_a"))
    right = sets.select(F.col("id").alias("id_b"), F.col("members").alias("set_b"))
    full = pairs.select("a", "b").join(right, F.col("b") == F.col("id_b")).join(left, F.col("a") == F.col("id_a"))
    size_a, size_b, both = F.size("set_a"), F.size("set_b"), F.size(F.array_intersect("set_a", "set_b"))
    linked_pairs = full.select("a", "b", size_a.alias("size_a"), size_b.alias("size_b"), both.alias("both")).where((100 + percent) * F.col("both") >= percent * (F.col("size_a") + F.col("size_b")))
    out = materialize(linked_pairs.select("a", "b").distinct(), compact=True)
    discard(sets)
    return out
