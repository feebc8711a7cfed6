"""Near-duplicate embeddings: random-hyperplane signs in several tables, exact cosine, connected components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import FILES_PER_CORE, bounded_batches, by_groups, components, in_blocks, local_roots, materialize

#: Least signs per table, vectors of one label that a bucket has on average beyond that, and the probability with which
#: two vectors at the least cosine meet in no table. At cosine 0.98 they agree in one sign with probability 0.936, in
#: all 12 signs of a table with 0.453, and so meet in none of 24 tables with 5e-7.
BITS, BUCKET, MISS, SEED = 12, 16, 6e-7, 20
#: Vectors of one bucket that a block holds.
BLOCK = 1024


def planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def signs_and_tables(n: int, least: float) -> tuple[int, int]:
    """Signs per table for ``n`` vectors of one label, so that pairs in buckets grow in proportion to them, and the tables that miss no more than MISS."""
    bits = min(31, max(BITS, math.ceil(math.log2(max(1, n) / BUCKET))))
    meet = (1 - math.acos(min(1.0, least)) / math.pi) ** bits
    return bits, 1 if meet >= 1 else math.ceil(math.log(MISS) / math.log(1 - meet))


def compact(v: np.ndarray) -> bytes:
    """The bytes of a vector, as 32-bit floats where these are equal."""
    with np.errstate(over="ignore"):
        small = v.astype("<f4")
    return (small if (small == v).all() else v.astype("<f8")).tobytes()


def expanded(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, "<f4" if len(raw) == 4 * dim else "<f8").astype(np.float64)


def near_duplicates(
    vectors: DataFrame, least: float = 0.98, bits: int | None = None, tables: int | None = None, block: int = BLOCK, seed: int = SEED
) -> DataFrame:
    """Links vectors of one label whose cosine (in double precision) is ``least`` or more.

    Returns vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable, itself
    included), kept (vec_id = component_id), one row per input row. Vectors that are null, zero, or hold null or
    non-finite components, and those without a label, link with nothing. Equal vectors are one class, counted by its
    size. Only ids and codes go through the buckets, of which those of one class end there; buckets of any size are
    compared whole, in blocks of bounded size, to which each vector is sent once, as 32-bit floats where that loses
    nothing. A pair that meets in several tables is counted in the first only. Within a block a matrix product finds
    the links, and only counts and one edge to the smallest member of each local component leave it. Two vectors of
    cosine c agree in one sign with probability p = 1 - acos(c) / pi, so a link is missed with (1 - p^bits)^tables;
    without ``bits`` and ``tables`` both come from the number of vectors (:func:`signs_and_tables`).

    Rows that repeat a vec_id are vectors each, with links of their own, and one node: what one of them reaches, the
    others reach. A row with a repeated vec_id that has no valid vector or label links with nothing. A null vec_id
    links with nothing; other columns are ignored; an empty table gives no rows.
    """
    bounded_batches(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw, keys = [], []
            for e in batch["embedding"]:
                v = np.asarray([np.nan if x is None else x for x in e] if e is not None and getattr(e, "dtype", None) == object else ([] if e is None else e), dtype=np.float64)
                good = len(v) and np.isfinite(v).all() and v.any()
                raw.append(compact(v + 0.0) if good else None)
                keys.append(hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).digest() if good else None)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "label": batch["label"], "key": keys, "vec": raw, "dim": [0 if e is None else len(e) for e in batch["embedding"]]})

    packed_rows = rows.mapInPandas(packed, "vec_id long, label long, key binary, vec binary, dim int")
    classes = packed_rows.where("key is not null and label is not null and vec_id is not null").groupBy("label", "key")
    classes = classes.agg(F.min("vec_id").alias("low"), F.count("*").alias("size"), F.first("vec").alias("vec"), F.first("dim").alias("dim"))
    # Numbers of the classes: any that differ, fixed by being written.
    classes = materialize(classes.coalesce(FILES_PER_CORE * vectors.sparkSession.sparkContext.defaultParallelism).withColumn("rep", F.monotonically_increasing_id()))
    if bits is None or tables is None:
        most = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        bits, tables = signs_and_tables(most, least)

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            out, dims = [], []
            for raw, dim in zip(batch["vec"], batch["dim"].tolist(), strict=True):
                v = expanded(raw, dim)
                if dim not in known:
                    known[dim] = planes(dim, bits, tables, seed)
                # A scale that keeps the sums finite; it changes no sign and no cosine.
                out.append(((v / np.abs(v).max() @ known[dim]) >= 0).reshape(tables, bits) @ (1 << np.arange(bits)))
                dims.append(dim)
            yield pd.DataFrame({"label": batch["label"], "dim": dims, "rep": batch["rep"], "each": out, "codes": [c.astype("<u4").tobytes() for c in out]})

    signs = materialize(classes.select("label", "rep", "dim", "vec").mapInPandas(signed, "label long, dim int, rep long, each array<int>, codes binary"))
    in_tables = signs.select("label", "dim", "rep", F.posexplode("each").alias("t", "code"))
    blocks = in_blocks(in_tables, ["label", "dim", "t", "code"], "rep", block)
    whole = classes.select(F.col("rep").alias("w_rep"), "size", "vec").join(signs.select("rep", "codes"), F.col("w_rep") == F.col("rep")).drop("rep")
    blocks = blocks.join(materialize(whole, compact=True), F.col("rep") == F.col("w_rep")).drop("w_rep")

    def compared(group: dict[str, np.ndarray]) -> dict[str, np.ndarray] | None:
        rep, dim = group["rep"], int(group["dim"][0])
        small = np.array([len(raw) == 4 * dim for raw in group["vec"]])
        vec = np.empty((len(rep), dim))
        for kind, which in (("<f4", small), ("<f8", ~small)):
            vec[which] = np.frombuffer(b"".join(group["vec"][which]), kind).reshape(-1, dim)
        vec = vec / np.abs(vec).max(axis=1, keepdims=True)
        vec /= np.sqrt((vec * vec).sum(axis=1, keepdims=True))
        t, chunk, a, b = int(group["t"][0]), group["chunk"], group["block_a"][0], group["block_b"][0]
        left, right = np.flatnonzero(chunk == a), np.flatnonzero(chunk == b)
        i, j = np.nonzero(vec[left] @ vec[right].T >= least)
        i, j = left[i], right[j]
        if a == b:
            i, j = i[rep[i] < rep[j]], j[rep[i] < rep[j]]
        if t and len(i):
            codes = np.frombuffer(b"".join(group["codes"]), "<u4").reshape(len(rep), -1)
            new = np.ones(len(i), bool)
            for earlier in range(t):
                new &= codes[i, earlier] != codes[j, earlier]
            i, j = i[new], j[new]
        if not len(i):
            return None
        links = np.bincount(i, group["size"][j], len(rep)) + np.bincount(j, group["size"][i], len(rep))
        order = np.argsort(rep)
        place = np.empty_like(order)
        place[order] = np.arange(len(rep))
        root = rep[order][local_roots(len(rep), place[i], place[j])][place]
        hit = links > 0
        return {"rep": rep[hit], "links": links[hit].astype(np.int64), "root": root[hit]}

    keys = ["label", "dim", "t", "code", "block_a", "block_b"]
    found = materialize(by_groups(blocks, keys, compared, "rep long, links long, root long"), compact=True)
    counts = found.groupBy("rep").agg(F.sum("links").alias("links")).withColumnRenamed("rep", "l_rep")
    of = classes.select(F.col("label").alias("c_label"), F.col("key").alias("c_key"), F.col("rep").alias("c_rep"))
    members = packed_rows.select("vec_id", "label", "key").join(of, (F.col("label") == F.col("c_label")) & (F.col("key") == F.col("c_key")), "left").select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("c_rep")).alias("rep"))
    members = materialize(members, compact=True)
    # Classes that share a vec_id are joined as well.
    shared = members.where("rep is not null").groupBy("vec_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b")
    shared = members.select(F.col("vec_id").alias("m_id"), F.col("rep").alias("m_rep")).join(shared, F.col("m_id") == F.col("vec_id")).where("m_rep <> a").select("a", F.col("m_rep").alias("b"))
    nodes = materialize(components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(shared)), compact=True)
    lows = classes.select("rep", "low").join(nodes, F.col("rep") == F.col("node")).groupBy(F.col("component").alias("of_component")).agg(F.min("low").alias("component_low"))
    # Written, its size is known before the join: small, it is sent to the classes; large, the join can be split where a component is.
    lows = materialize(lows, compact=True)
    known = classes.select("rep", "low", "size").join(counts, F.col("rep") == F.col("l_rep"), "left").join(nodes, F.col("rep") == F.col("node"), "left").join(lows, F.col("component") == F.col("of_component"), "left")
    known = materialize(known.select(F.col("rep").alias("k_rep"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_low", "low").alias("component")), compact=True)
    out = members.join(known, F.col("rep") == F.col("k_rep"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
