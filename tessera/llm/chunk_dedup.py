"""Substring deduplication by content-defined chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.llm.common import bounded_batches, discard, materialize, member_filter, slices

#: Bytes that the rolling hash sees; bits of it that are 0 at a cut (32 bytes between cuts on average); longest chunk.
SEEN, CUT_BITS, LONGEST = 16, 5, 256
#: A run of repeated chunks counts from this many words.
LEAST_WORDS = 15
#: Bytes of a digest; greatest number that tells texts of one doc_id apart.
DIGEST_BYTES, TAGS = 12, (1 << 14) - 1
GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a text in UTF-8: where the gear hash of the last SEEN bytes has its top bits 0.

    The gear hash h = (h << 1) + gear[byte] of 16 bits forgets a byte after SEEN steps, so cuts depend on the text
    around them only and reappear right after an insertion. A chunk never ends inside a character, and a stretch of
    LONGEST bytes without a cut is cut.
    """
    n = len(data)
    gear = GEAR[data].astype(np.uint16)
    h = gear.copy()
    for k in range(1, min(SEEN, n)):
        h[k:] += gear[:-k] << np.uint16(k)
    whole = np.ones(n, bool)
    whole[:-1] = (data[1:] & 0xC0) != 0x80
    ends = np.flatnonzero(((h >> np.uint16(16 - CUT_BITS)) == 0) & whole) + 1
    ends = np.append(ends, n) if not len(ends) or ends[-1] != n else ends
    gaps = np.diff(ends, prepend=0)
    if gaps.max() > LONGEST:
        out: list[int] = []
        last = 0
        for e in ends.tolist():
            while e - last > LONGEST:
                last += LONGEST
                while last < n and data[last] & 0xC0 == 0x80:
                    last += 1
                if last < e:
                    out.append(last)
            if e > last:
                out.append(e)
            last = max(e, last)
        ends = np.unique(np.array(out))
    return ends


BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def chunks(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, end, words) of the chunks of a text; ends are byte offsets, words are those that begin in the chunk.

    Digests are DIGEST_BYTES bytes each, one row of bytes for each chunk.
    """
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    ends = cuts(data)
    blank = BLANK[data]
    begins = ~blank
    begins[1:] &= blank[:-1]
    words = np.diff(np.cumsum(begins)[ends - 1], prepend=0)
    starts = [0, *ends[:-1].tolist()]
    blake = hashlib.blake2b
    digests = b"".join([blake(raw[s:e], digest_size=DIGEST_BYTES).digest() for s, e in zip(starts, ends.tolist(), strict=True)])
    return np.frombuffer(digests, np.uint8).reshape(-1, DIGEST_BYTES), ends, words


def text_tag(text: str) -> int:
    """A number that tells apart texts that share a doc_id."""
    return xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass")) & TAGS


def packed(tag: int, ends: np.ndarray, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Tag, start, length, words and whether the chunk is the first of its digest in the text, as one number each."""
    starts = np.concatenate([[0], ends[:-1]])
    return (np.int64(tag) << 49) | (starts.astype(np.int64) << 18) | ((ends - starts).astype(np.int64) << 9) | (words.astype(np.int64) << 1) | first


def first_in_text(digests: np.ndarray) -> np.ndarray:
    first = np.zeros(len(digests), np.int64)
    first[np.unique(np.ascontiguousarray(digests).view(f"V{DIGEST_BYTES}").ravel(), return_index=True)[1]] = 1
    return first


def repeated_spans(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Stretches of text that stand elsewhere before: doc_id, tag, span_start, span_end, n_words, first_docs.

    Each text is cut by content into variable chunks; the first occurrence of a chunk's digest, by doc_id and offset,
    is its original and all later ones (in other documents or further on in the same one) are repeats. Neighbouring
    repeats join to spans, of which those of ``least_words`` words or more are returned, with byte offsets into the
    UTF-8 text and the sorted ids of the documents where the originals stand. Digests have 96 bits: among 3e12 chunks
    (100 TB) any two differing ones share one with probability 6e-5. Chunks are combined per digest before they are
    shuffled; the table of repeated digests is written out first, so that the join with it can be split where one
    digest is in very many documents; only repeats are then gathered by document, and read there in order, a batch at
    a time.

    Cuts depend on content, so a passage counts only from its first whole chunk to its last: of passages of 51 words
    about 0.7 % have fewer than ``least_words`` words in whole chunks and are not found, of longer ones fewer.

    Null and empty texts have no chunks. Rows that share a doc_id and the text are one original and not repeats of
    each other; of several texts with one doc_id each is its own, told apart by ``tag`` (a hash of the text), and they
    are no repeats of each other. A null doc_id is left out. Other columns are ignored; an empty table gives no rows.
    """
    return _runs(_repeats(docs), least_words)


def _repeats(docs: DataFrame) -> DataFrame:
    """The chunks that stand elsewhere before: doc_id, place, first_doc; a written table."""
    rows = docs.where("doc_id is not null and text is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bounded_batches(docs.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches, 128):
            found = [(*chunks(t), text_tag(t)) for t in batch["text"]]
            if not found:
                continue
            digests = np.concatenate([f[0] for f in found])
            place = np.concatenate([packed(tag, ends, words, first_in_text(digest)) for digest, ends, words, tag in found])
            yield pd.DataFrame({"d1": digests[:, :8].copy().view("<i8").ravel(), "d2": digests[:, 8:].copy().view("<i4").ravel(), "doc_id": np.repeat(batch["doc_id"].to_numpy(), [len(f[0]) for f in found]), "place": place})

    pieces = rows.mapInPandas(cut, "d1 long, d2 int, doc_id long, place long")
    first = pieces.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")
    first = materialize(first.select(F.col("d1").alias("f1"), F.col("d2").alias("f2"), "first_doc"), compact=True)
    repeats = pieces.join(first, (F.col("d1") == F.col("f1")) & (F.col("d2") == F.col("f2"))).where("doc_id <> first_doc or place % 2 = 0")
    repeats = materialize(repeats.select("doc_id", "place", "first_doc"), compact=True)
    discard(first)
    return repeats


def _runs(repeats: DataFrame, least_words: int) -> DataFrame:
    """Neighbouring repeats joined to spans."""

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: np.ndarray | None = None
        for batch in batches:
            part = batch[["doc_id", "place", "first_doc"]].to_numpy(np.int64)
            part = part if rest is None else np.concatenate([rest, part])
            new = _run_starts(part)
            rest = part[new[-1] :]
            yield _spans(part[: new[-1]], new[:-1], least_words)
        if rest is not None:
            yield _spans(rest, _run_starts(rest), least_words)

    in_order = repeats.repartition("doc_id").sortWithinPartitions("doc_id", "place", "first_doc")
    return in_order.mapInPandas(joined, "doc_id long, tag int, span_start int, span_end int, n_words int, first_docs array<long>")


def _run_starts(part: np.ndarray) -> np.ndarray:
    """Where runs of neighbouring chunks begin among rows (doc_id, place, first_doc) in order; equal rows belong together."""
    doc, tag = part[:, 0], part[:, 1] >> 49
    start, length = (part[:, 1] >> 18) & 0x7FFFFFFF, (part[:, 1] >> 9) & 0x1FF
    new = np.ones(len(part), bool)
    same = (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1])
    new[1:] = ~(same & ((start[1:] == (start + length)[:-1]) | (part[1:, 1] == part[:-1, 1])))
    return np.flatnonzero(new)


def _spans(part: np.ndarray, new: np.ndarray, least_words: int) -> pd.DataFrame:
    once = np.ones(len(part), np.int64)
    once[1:] = part[1:, 1] != part[:-1, 1]
    once[new] = 1
    ends = np.append(new[1:], len(part)) if len(new) else new
    start, length = (part[:, 1] >> 18) & 0x7FFFFFFF, (part[:, 1] >> 9) & 0x1FF
    words = np.add.reduceat(((part[:, 1] >> 1) & 0xFF) * once, new) if len(new) else new
    keep = words >= least_words
    new, ends, words = new[keep], ends[keep], words[keep]
    last = ends - 1
    return pd.DataFrame({
        "doc_id": part[new, 0], "tag": (part[new, 1] >> 49).astype(np.int32), "span_start": start[new].astype(np.int32), "span_end": (start[last] + length[last]).astype(np.int32),
        "n_words": words.astype(np.int32), "first_docs": pd.Series([np.unique(part[s:e, 2]) for s, e in zip(new.tolist(), ends.tolist(), strict=True)], dtype=object),
    })


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the whole words inside each span of byte offsets."""
    raw = text.encode("utf-8", "surrogatepass")
    out, last = [], 0
    for start, end in sorted(spans):
        while 0 < start < end and raw[start - 1] > 32:
            start += 1
        while end > start and end < len(raw) and raw[end] > 32:
            end -= 1
        if end > start:
            out.append(raw[last:start])
            last = end
    out.append(raw[last:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with repeated spans cut from ``text`` (and ``n_chars``, where there is one, counted again).

    The original of each passage stays. A document of which no word is left goes; all others stay, with all columns:
    those with a null doc_id, a null or an empty text unchanged, repeated rows alike, several texts with one doc_id
    each by its own spans. Names of other columns cannot clash; an empty table stays empty.
    """
    repeats = _repeats(docs)
    spans = _runs(repeats, least_words).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("span_start", "span_end")).alias("spans"))
    spans = materialize(spans.select(F.col("doc_id").alias("span_doc"), "tag", "spans").groupBy("span_doc").agg(F.collect_list(F.struct("tag", "spans")).alias("by_tag")), compact=True)
    discard(repeats)
    # Only documents that may have spans are shuffled.
    may_have = F.coalesce(member_filter(spans, "span_doc")(F.coalesce(F.col("doc_id").cast("long"), F.lit(0))) & F.col("doc_id").isNotNull(), F.lit(False))
    rest = docs.where(~may_have)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    joined = docs.where(may_have).select(F.col("doc_id").cast("long").alias("join_id"), row).join(spans, F.col("join_id") == F.col("span_doc"), "left")

    @F.pandas_udf(StringType())
    def cut_text(text: pd.Series, by_tag: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None else _without_of(t, s) for t, s in zip(text, by_tag, strict=True)], dtype=object)

    # So marked, the function is not called again by the filter below.
    new = cut_text.asNondeterministic()(F.col("row.text").cast("string"), F.col("by_tag"))
    joined = joined.withColumn("new_text", new).where(F.col("by_tag").isNull() | ~F.coalesce(F.col("row.text"), F.lit("")).rlike(r"\S") | F.col("new_text").rlike(r"\S"))
    named = {"text": F.col("new_text"), "n_chars": F.coalesce(F.length("new_text"), F.lit(0)).cast("long")}
    cut = joined.select(*[named[c].alias(c) if c in named else F.col(f"row.`{c}`") for c in docs.columns])
    plain = {"text": F.col("text").cast("string"), "n_chars": F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).cast("long")}
    return cut.unionByName(rest.select(*[plain[c].alias(c) if c in plain else F.col(f"`{c}`") for c in docs.columns]))


def _without_of(text: str, by_tag: list[dict]) -> str:
    spans = [(s["span_start"], s["span_end"]) for g in by_tag if g["tag"] == text_tag(text) for s in g["spans"]] if len(by_tag) else []
    return without(text, spans) if spans else text
