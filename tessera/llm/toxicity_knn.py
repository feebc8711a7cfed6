"""Toxicity by the nearest labelled examples under exact TF-IDF cosine."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, least_by_hash, materialize, slices

#: Labelled rows the index may hold (chosen by a hash of doc_id): the bound of what is broadcast.
MAX_EXAMPLES = 5_000
#: Nearest examples that vote; examples of one block of the index; weight of the base rate in a vote.
NEIGHBOURS, BLOCK, PRIOR = 15, 64, 0.15
#: A term in more than this share of the examples has a full row of weights instead of a list.
LONG = 1 / 8
#: Texts scored together, and entries of lists that are added up at once.
TEXTS, ENTRIES = 32, 1 << 20
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> Counter:
    return Counter(WORD.findall((text or "").lower()))


class BlockMaxIndex:
    """Inverted lists over unit vectors; of terms in many vectors, full rows of weights and the greatest weight in each block.

    A search adds up the lists first. What the long terms can add to a vector is bounded by the greatest weights of
    its block; only blocks in which that may lift a vector to the ``k`` best are multiplied with the rows of the long
    terms. So the neighbours are those of a full search. Ties go to the smaller of ``ids``.
    """

    def __init__(self, where: np.ndarray, terms: np.ndarray, weights: np.ndarray, ids: np.ndarray, n_terms: int, block: int = BLOCK):
        self.ids, self.n, self.block = ids, len(ids), block
        self.n_blocks = max(1, -(-self.n // block))
        sizes = np.bincount(terms, minlength=n_terms)
        long = np.flatnonzero(sizes > max(LONG * self.n, 1))
        self.row = np.full(n_terms, -1, np.int32)
        self.row[long] = np.arange(len(long))
        self.rows = np.zeros((len(long), self.n_blocks * block))
        at = self.row[terms]
        self.rows[at[at >= 0], where[at >= 0]] = weights[at >= 0]
        self.top = self.rows.reshape(len(long), self.n_blocks, block).max(axis=2)
        where, terms, weights = where[at < 0], terms[at < 0], weights[at < 0]
        order = np.argsort(terms, kind="stable")
        self.where, self.what = where[order].astype(np.int32), weights[order]
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=n_terms))])

    def lists(self, of: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        """Sums over the lists of ``terms`` for each of n queries."""
        width = self.n_blocks * self.block
        out = np.zeros(n * width)
        sizes = self.ends[terms + 1] - self.ends[terms]
        total = np.cumsum(sizes)
        begin = 0
        while begin < len(terms):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + ENTRIES)))
            some = sizes[begin:end]
            first = np.repeat(self.ends[terms[begin:end]] - np.cumsum(some) + some, some)
            at = first + np.arange(len(first))
            out += np.bincount(np.repeat(of[begin:end] * width, some) + self.where[at], np.repeat(weights[begin:end], some) * self.what[at], len(out))
            begin = end
        return out.reshape(n, width)

    def search(self, of: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(positions, cosines) of the up to k nearest of each of n unit queries, given as entries (query, term, weight)."""
        if not self.n:
            return [(np.zeros(0, int), np.zeros(0))] * n
        at = self.row[terms]
        score = self.lists(of[at < 0], terms[at < 0], weights[at < 0], n)
        if len(self.rows):
            long = np.zeros((n, len(self.rows)))
            long[of[at >= 0], at[at >= 0]] = weights[at >= 0]
            # A block that cannot get to what k vectors surely reach is not multiplied.
            best = score.reshape(n, self.n_blocks, self.block).max(axis=2)
            open_blocks = best + long @ self.top >= _reached(best, k)[:, None] - 1e-9
            if open_blocks.mean() > 0.5:
                score += long @ self.rows
            else:
                for b in np.flatnonzero(open_blocks.any(axis=0)).tolist():
                    rows, part = np.flatnonzero(open_blocks[:, b]), slice(b * self.block, (b + 1) * self.block)
                    score[rows, part] += long[rows] @ self.rows[:, part]
        reached = _reached(score.reshape(n, self.n_blocks, self.block).max(axis=2), k)
        out = []
        for s, low in zip(score, reached.tolist(), strict=True):
            near = np.flatnonzero((s >= low - 1e-9) & (s > 0))
            at = s[near].round(12)
            order = np.lexsort((self.ids[near], -at))[:k]
            out.append((near[order], at[order]))
        return out


def _reached(best: np.ndarray, k: int) -> np.ndarray:
    """What at least k vectors of each query reach: the k-th greatest of its blocks' best scores."""
    return np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k] if best.shape[1] > k else np.zeros(len(best))


def unit(of: np.ndarray, terms: np.ndarray, counts: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """Weights of the entries (vector, term, count) of n vectors, so that each vector has length 1."""
    weights = (1 + np.log(counts)) * idf[terms]
    return weights / np.sqrt(np.bincount(of, weights * weights, n))[of]


def label_weights(n_all: np.ndarray, n_pos: np.ndarray, n: int, positive: int) -> np.ndarray:
    """How much each term's presence goes with the label: chi-square over the number of rows, from 0 to 1.

    It depends on shares alone. A term that says nothing of the label keeps the weight of a chance half-row, so that
    every term counts.
    """
    a, total = n_pos.astype(float), n_all.astype(float)
    b, c, d = total - a, positive - a, n - positive - (total - a)
    return ((a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1e-9)) + 0.5 / max(n, 1)


class Scorer:
    """Scores texts by the examples, given by ids, labels, numbers of terms, terms and counts."""

    def __init__(self, terms: dict[str, int], idf: np.ndarray, ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, entries: np.ndarray, counts: np.ndarray, k: int = NEIGHBOURS):
        self.terms, self.idf, self.k = terms, idf, k
        of = np.repeat(np.arange(len(ids)), sizes)
        weights = unit(of, entries, counts, idf, len(ids))
        # Examples with the same heaviest term stand in the same block, which keeps the bounds of blocks tight.
        heaviest = np.full(len(ids), -1, np.int64)
        by_weight = np.argsort(weights, kind="stable")
        heaviest[of[by_weight]] = entries[by_weight]
        order = np.lexsort((ids, heaviest))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.y, self.ids = labels[order].astype(float), ids[order]
        self.index = BlockMaxIndex(place[of], entries, weights, self.ids, len(idf))
        rest = labels[sizes == 0]
        self.base = float((labels.sum() + 1) / (len(labels) + 20))
        self.rest = float((rest.sum() + self.base) / (len(rest) + 1))

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[int], list[float]]]:
        """(score, ids of the voters, their cosines) of each text."""
        of, terms, counts = entries_of(texts, self.terms)
        found = self.index.search(of, terms, unit(of, terms, counts, self.idf, len(texts)), len(texts), self.k)
        none = np.bincount(of, minlength=len(texts)) == 0
        out: list[tuple[float, list[int], list[float]]] = []
        for (at, near), empty in zip(found, none.tolist(), strict=True):
            votes = near**2
            score = self.rest if empty or not self.index.n else float((votes @ self.y[at] + PRIOR * self.base) / (votes.sum() + PRIOR))
            out.append((score, self.ids[at].tolist(), near.tolist()))
        return out


def entries_of(texts: list[str | None], terms: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of the known terms of each text."""
    of, at, counts = [], [], []
    get = terms.get
    for i, text in enumerate(texts):
        words = words_of(text)
        found = [(t, n) for w, n in words.items() if (t := get(w)) is not None]
        of.append(np.full(len(found), i))
        at += [f[0] for f in found]
        counts += [f[1] for f in found]
    return np.concatenate(of) if of else np.zeros(0, np.int64), np.array(at, np.int64), np.array(counts, float)


#: What this worker built last, by a name of its query: the numbers of the terms, and the scorer.
TERMS: dict[str, dict[str, int]] = {}
SCORERS: dict[str, Scorer] = {}


def numbered(name: str, terms: list[str]) -> dict[str, int]:
    if name not in TERMS:
        TERMS.clear()
        SCORERS.clear()
        TERMS[name] = {t: i for i, t in enumerate(terms)}
    return TERMS[name]


def toxicity(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, k: int = NEIGHBOURS) -> DataFrame:
    """Scores every whole text by its nearest labelled examples: doc_id, score, neighbours, similarities.

    All words of a bounded sample of the labelled rows (``max_examples``, by a hash of doc_id) span the vector space,
    in which each example and each document has a TF-IDF vector with document frequencies counted over all documents,
    times how much a term goes with the label (:func:`label_weights`). Votes of the ``k`` nearest by exact cosine,
    weighted by squared similarity and drawn to the base rate, give the score; the voters are its evidence. A text
    without any of the terms (an empty or null one too) is scored by the examples that have none either. Conflicting
    labels of one doc_id count as toxic; of several texts of one doc_id the first in order is the example; null labels
    are ignored; with no labels at all scores are a constant; repeated rows are scored each; other columns are
    ignored. The index (at most ``max_examples`` vectors, with all terms of those texts) passes the driver and is
    broadcast; documents are never shuffled.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chosen = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    chosen = least_by_hash(chosen, "label_id", max_examples)
    sample = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    sample = materialize(sample.groupBy("doc_id", "y").agg(F.min("text").alias("text")))

    def example_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            out: dict[str, list[int]] = {}
            for text, y in zip(batch["text"], batch["y"], strict=True):
                for t in words_of(text):
                    c = out.setdefault(t, [0, 0])
                    c[0] += 1
                    c[1] += y
            yield pd.DataFrame({"term": list(out), "n_all": [c[0] for c in out.values()], "n_pos": [c[1] for c in out.values()]})

    n, n_pos = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    stats = sample.mapInPandas(example_terms, "term string, n_all long, n_pos long").groupBy("term").agg(F.sum("n_all").alias("n_all"), F.sum("n_pos").alias("n_pos"))
    stats = stats.toArrow().to_pandas().sort_values("term", ignore_index=True)
    n_terms = len(stats)
    known = spark.sparkContext.broadcast((uuid.uuid4().hex, stats["term"].tolist()))

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms, found = numbered(*known.value), np.zeros(n_terms + 1, np.int64)
        for batch in slices(batches):
            for text in batch["text"]:
                found[[t for w in set(WORD.findall(text.lower())) if (t := terms.get(w)) is not None]] += 1
            found[-1] += len(batch)
        at = np.flatnonzero(found)
        yield pd.DataFrame({"at": at, "n": found[at]})

    counted = rows.mapInPandas(frequencies, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    df = np.zeros(n_terms + 1, np.int64)
    df[counted["at"].to_numpy(int)] = counted["n"].to_numpy(int)
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1) * label_weights(stats["n_all"].to_numpy(int), stats["n_pos"].to_numpy(int), n, n_pos)
    del stats, counted

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = numbered(*known.value)
        for batch in slices(batches):
            of, at, counts = entries_of(batch["text"].tolist(), terms)
            ends = np.searchsorted(of, np.arange(1, len(batch)))
            packed = [[p.tobytes() for p in np.split(x.astype(np.int32), ends)] for x in (at, counts)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "t": packed[0], "n": packed[1]})

    examples = sample.mapInPandas(vectors, "doc_id long, y int, t binary, n binary").toArrow().to_pandas()
    sizes = np.array([len(t) // 4 for t in examples["t"]], np.int64)
    entries, counts = (np.frombuffer(b"".join(examples[c]), np.int32) for c in "tn")
    shared = spark.sparkContext.broadcast((idf, examples["doc_id"].to_numpy(np.int64), examples["y"].to_numpy(np.int64), sizes, entries, counts, k))
    del examples, entries, counts

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, terms = known.value
        by_word = numbered(name, terms)
        if name not in SCORERS:
            SCORERS[name] = Scorer(by_word, *shared.value)
        scorer = SCORERS[name]
        for batch in slices(batches, TEXTS):
            found = scorer.scores(batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": [f[0] for f in found], "neighbours": [f[1] for f in found], "similarities": [f[2] for f in found]})

    return rows.mapInPandas(scored, "doc_id long, score double, neighbours array<long>, similarities array<double>")
