"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, materialize, slices

#: Words of a seed. A benchmark of more items than ITEMS, or more letters than LETTERS, is taken in blocks of so many on
#: average: the bound of what is broadcast.
SEED_WORDS, ITEMS, LETTERS = 3, 20_000, 20_000_000
#: Scores of the alignment, and the share of an item's greatest score from which a passage is a copy of it.
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SCORE = 0.5
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment of two word-id sequences by Smith-Waterman: its score and the end of it in ``passage``.

    Row by row; a run of gaps along the row is a running maximum.
    """
    n = len(passage)
    steps = np.arange(n + 1) * -GAP
    row = np.zeros(n + 1, np.int64)
    best, at = 0, 0
    for word in item:
        new = np.zeros(n + 1, np.int64)
        new[1:] = np.maximum(row[:-1] + np.where(passage == word, MATCH, MISMATCH), row[1:] + GAP)
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + steps) - steps
        row = new
        if (top := int(row.max())) > best:
            best, at = top, int(row.argmax())
    return best, at


def aligned_from(item: np.ndarray, passage: np.ndarray) -> int:
    """Where in ``passage`` the best alignment begins that ends with it, or a share of it that has the best score.

    The cells of the same rows carry where their alignment began: that of the match or mismatch before them first, then
    of the gap in the passage, then of the gap in the item.
    """
    n = len(passage)
    steps, places = np.arange(n + 1) * -GAP, np.arange(n + 1)
    row, begin = np.zeros(n + 1, np.int64), places.copy()
    best, found = 0, 0
    for word in item:
        both = np.zeros(n + 1, np.int64)
        both[1:] = row[:-1] + np.where(passage == word, MATCH, MISMATCH)
        over = row + GAP
        over[0] = 0
        new = np.maximum(np.maximum(both, over), 0)
        start = np.where(new == 0, places, np.where((both == new) & (places > 0), np.r_[0, begin[:-1]], begin))
        # Along the row a gap comes from the last cell whose own score it continues.
        raised = new + steps
        top = np.maximum.accumulate(raised)
        source = np.maximum.accumulate(np.where(raised == top, places, 0))
        row, begin = top - steps, start[source]
        if (most := int(row.max())) > best:
            best, found = most, int(begin[int(row.argmax())])
    return found


class Seeds:
    """The n-grams of a block of benchmark items, looked up in a text by binary search."""

    def __init__(self, items: list[tuple[int, str]], n: int = SEED_WORDS):
        self.n, self.ids = n, [i for i, _ in items]
        vocabulary: dict[str, int] = {}
        self.items = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int64) for _, t in items]
        self.own = [np.unique(w, return_counts=True) for w in self.items]
        self.vocabulary, self.base = vocabulary, len(vocabulary) + 1
        pairs = [(int(k), i) for i, w in enumerate(self.items) for k in np.unique(self.keys(w))]
        self.keys_all = np.array(sorted({k for k, _ in pairs}), np.int64)
        at = {int(k): j for j, k in enumerate(self.keys_all)}
        self.owners: list[list[int]] = [[] for _ in at]
        for k, i in pairs:
            self.owners[at[k]].append(i)

    def keys(self, words: np.ndarray) -> np.ndarray:
        """One number for each n-gram, -1 where a word is unknown. A shorter item is one n-gram by itself."""
        n = min(self.n, len(words))
        if n == 0:
            return np.zeros(0, np.int64)
        m = len(words) - n + 1
        key, known = np.full(m, n, np.int64), np.ones(m, bool)
        for k in range(n):
            part = words[k : k + m]
            # Wraps around for vocabularies of millions of words; a clash only adds a candidate for the alignment.
            key = key * np.int64(self.base) + part + 1
            known &= part >= 0
        return np.where(known, np.abs(key), -1)

    def find(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word ids, positions, seed numbers) of a text's seeds."""
        get = self.vocabulary.get
        words = np.array([get(w, -1) for w in words_of(text)], np.int64)
        if not len(self.keys_all) or not len(words):
            return words, np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = self.keys(words)
        places = np.flatnonzero(keys >= 0)
        found = np.searchsorted(self.keys_all, keys[places]).clip(max=len(self.keys_all) - 1)
        hit = self.keys_all[found] == keys[places]
        return words, places[hit], found[hit]

    def shared(self, i: int, words: np.ndarray) -> int:
        """How many words of item ``i``, each as often as it stands there, are among ``words``: no alignment matches more."""
        own, counts = self.own[i]
        at = np.searchsorted(own, words).clip(max=len(own) - 1)
        return int(np.minimum(np.bincount(at[own[at] == words], minlength=len(own)), counts).sum())

    def windows(self, i: int, at: list[tuple[int, int]], n_words: int) -> list[tuple[int, int, int]]:
        """(least rarity, first word, last word + 1) of the stretches around an item's seeds, given as places and rarities in order."""
        reach = 2 * len(self.items[i])
        out, start, rarest = [], at[0][0], at[0][1]
        for k, (p, n) in enumerate(at):
            rarest = min(rarest, n)
            if k + 1 == len(at) or at[k + 1][0] - p > reach:
                out.append((rarest, max(0, start - reach), min(n_words, p + reach + self.n)))
                if k + 1 < len(at):
                    start, rarest = at[k + 1]
        return out

    def candidates(self, words: np.ndarray, places: np.ndarray, seeds: np.ndarray, least: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(item, first word, words from there on, places of its seeds among them, seeds) of the items that a text may hold a copy of.

        An alignment of m matches scores at most MATCH * m, so an item is none where too few of the words around its
        seeds are its own; the words are those from the first stretch around seeds that may do to the last.
        """
        near: dict[int, list[tuple[int, int]]] = {}
        for p, s in zip(places.tolist(), seeds.tolist(), strict=True):
            for i in self.owners[s]:
                near.setdefault(i, []).append((p, s))
        for i, at in near.items():
            good = [(low, high) for _, low, high in self.windows(i, at, len(words)) if self.shared(i, words[low:high]) >= least * len(self.items[i])]
            if good:
                low, high = good[0][0], good[-1][1]
                held = np.array([(p - low, s) for p, s in at if low <= p < high], np.int64)
                yield i, low, words[low:high], held[:, 0], held[:, 1]

    def best(self, i: int, first: int, words: np.ndarray, places: np.ndarray, rarity: np.ndarray, least: float) -> tuple[int, float, int, int] | None:
        """(item id, score, first word, last word + 1) of the best copy of a candidate, the first of equal ones.

        The words around the rarest seeds are aligned first; those around others only where they could still score
        more, so that common seeds cost next to nothing and lose nothing.
        """
        item, best = self.items[i], (0.0, 0, 0)
        for _, low, high in sorted(self.windows(i, list(zip(places.tolist(), rarity.tolist(), strict=True)), len(words))):
            most = self.shared(i, words[low:high]) / len(item)
            if most < least or (most, -low) < (best[0], -best[1]):
                continue
            score, end = align(item, words[low:high])
            share = score / (MATCH * len(item))
            if (share, -low) > (best[0], -best[1]):
                best = (share, low, low + end)
        if best[0] < least:
            return None
        return self.ids[i], best[0], first + best[1] + aligned_from(item, words[best[1] : best[2]]), first + best[2]

    def copies(self, text: str | None, held: np.ndarray | None, least: float) -> list[tuple[int, float, int, int]]:
        """The best copies of one text, where ``held`` says how many documents hold each seed."""
        found = self.candidates(*self.find(text), least)
        return [b for i, low, words, places, seeds in found if (b := self.best(i, low, words, places, seeds * 0 if held is None else held[seeds], least))]


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE, items: int = ITEMS) -> DataFrame:
    """Documents that hold a copy, paraphrased or edited, of a benchmark item: doc_id, item_id, score, start, end.

    Words are runs of letters, digits and underscores in lower case. Documents that hold an n-gram of an item are joined
    to it, rare n-grams first: how many documents hold each is counted before. Common ones are followed too wherever
    the words around them could still score enough, so no result depends on the other documents. A copy of which no
    SEED_WORDS words in a row are left is not found.
    ``score`` is the alignment's share of the item's greatest score (1 for a verbatim copy), ``start`` and ``end`` are
    its first word and the one after its last; of equal alignments of an item the first in the text is reported.
    Documents are never shuffled: only blocks of about ``items`` benchmark items are sent to them, and documents are
    read once for each block. What may be a copy is written out with the words around it, and aligned once the counts,
    of which there is one for each n-gram of the block, are known.

    Items without words and null ids are left out; null and empty texts match nothing; repeated rows and repeated items
    give a row each; other columns are ignored. A very long text is aligned only around its seeds, one window at a time.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tests = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    n_items, letters = tests.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    n_blocks = max(1, -(-n_items // items), -(-letters // LETTERS))
    schema = "doc_id long, item_id long, score double, start long, end long"
    out = None
    for block in range(n_blocks):
        part = tests if n_blocks == 1 else tests.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block)
        found = _against(spark, rows, Seeds([(r[0], r[1]) for r in part.orderBy("item_id", "text").collect()]), least, schema)
        out = found if out is None else out.unionByName(found)
    return out


def _against(spark, rows: DataFrame, seeds: Seeds, least: float, schema: str) -> DataFrame:
    shared = spark.sparkContext.broadcast(seeds)

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        counts = np.zeros(len(index.keys_all), np.int64)
        names = ["doc_id", "item", "first", "words", "places", "seeds"]
        for batch in slices(batches):
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                found = index.find(text)
                counts[np.unique(found[2])] += 1
                out += [(doc, *c) for c in index.candidates(*found, least)]
            yield pd.DataFrame(out, columns=names)
        held = np.flatnonzero(counts)
        # How many of the task's documents hold each seed goes out beside its candidates.
        yield pd.DataFrame([(None, -1, 0, [], counts[held], held)], columns=names)

    found = materialize(rows.mapInPandas(searched, "doc_id long, item int, first long, words array<long>, places array<long>, seeds array<long>"))
    pairs = found.where("item < 0").select(F.explode(F.arrays_zip("seeds", "places")).alias("x"))
    totals = pairs.groupBy(F.col("x.seeds").alias("seed")).agg(F.sum("x.places").alias("n")).toPandas()
    counts = np.zeros(len(seeds.keys_all), np.int64)
    counts[totals["seed"].to_numpy(np.int64)] = totals["n"]
    held = spark.sparkContext.broadcast(counts)

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for batch in slices(batches):
            rows_ = []
            for doc, i, first, words, places, own in zip(*[batch[c] for c in ("doc_id", "item", "first", "words", "places", "seeds")], strict=True):
                if best := index.best(i, first, words, places, held.value[own], least):
                    rows_.append((doc, *best))
            yield pd.DataFrame(rows_, columns=["doc_id", "item_id", "score", "start", "end"])

    return found.where("item >= 0").mapInPandas(aligned, schema)
