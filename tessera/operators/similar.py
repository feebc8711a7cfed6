"""Similar records by text ratio among the newest ones."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of title and description, letters of the description that count, and newest records that a record is
#: compared with (fixed values).
TITLE, DESCRIPTION, LETTERS, NEWEST = 0.6, 0.4, 200, 500
#: Places of the letters' counts; letters share one by their code.
PLACES = 64
#: Letters of a gram, and places of the grams' counts, which grams share by a hash.
GRAM, GRAM_PLACES = 4, 1024
#: From so many letters on a text's frequent letters begin no match (difflib's rule).
LONG = 200


def ratio(a: str, b: str) -> float:
    """Matching-blocks ratio of two texts in lower case; 0 where one is empty."""
    return SequenceMatcher(None, a.lower(), b.lower()).ratio() if a and b else 0.0


def letter_counts(texts: list[str]) -> np.ndarray:
    """Counts of the letters of each text: the sum of the lesser counts bounds what two texts can match."""
    out = np.zeros((len(texts), PLACES), np.int32)
    for row, t in zip(out, texts, strict=True):
        row += np.bincount(np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) % PLACES, minlength=PLACES).astype(np.int32)
    return out


def most_ratio(counts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Bounds of the ratios of one text with each of several, 0 where one is empty."""
    n, m = counts.sum(), of.sum(axis=1)
    return np.where((n > 0) & (m > 0), 2 * np.minimum(counts, of).sum(axis=1) / np.maximum(n + m, 1), 0.0)


class Grams:
    """Bounds of the ratios with texts of LONG letters and more, from common grams.

    In such a text letters that stand there more than 1 + a hundredth of its length times begin no match: each matching
    block holds a rare letter's place, or is what two stretches between such blocks begin with. So there are at most 2 r
    + 1 blocks, where r is the number of rare letters in common, and blocks of m letters in all hold m - (GRAM - 1) times
    their number common grams at least. Grams that share a place only raise the bound.
    """

    def __init__(self, texts: list[str]):
        texts = [t.lower() for t in texts]
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.counts = np.zeros((GRAM_PLACES, len(texts)), np.int16)
        self.rare = np.zeros((GRAM_PLACES, len(texts)), np.int16)
        for k, t in enumerate(texts):
            if len(t) >= LONG:
                np.add.at(self.counts[:, k], gram_places(t), 1)
                for c, n in Counter(t).items():
                    self.rare[ord(c) % GRAM_PLACES, k] += n if n <= len(t) // 100 + 1 else 0

    def most(self, text: str, which: np.ndarray) -> np.ndarray:
        """Bounds of the ratios of ``text`` with the texts of some numbers; 1 for those that are too short."""
        text = text.lower()
        letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) % GRAM_PLACES
        common, rare = in_common(self.counts, gram_places(text)), in_common(self.rare, letters)
        bounds = 2 * (common + (GRAM - 1) * (2 * rare + 1)) / (len(text) + np.maximum(self.sizes, 1))
        return np.where(self.sizes < LONG, 1.0, bounds)[which]


def in_common(counts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Of each column the sum of the lesser counts, its own and those of some places."""
    own, n = np.unique(places, return_counts=True)
    return np.minimum(counts[own], n[:, None].astype(np.int16)).sum(axis=0, dtype=np.int64)


def gram_places(text: str) -> np.ndarray:
    """The places of a text's grams, one for each; GRAM_PLACES of them are told apart."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(max(len(x) - GRAM + 1, 0), np.uint64)
    for i in range(GRAM):
        h = h * np.uint64(1_000_003) + x[i : len(x) - GRAM + 1 + i]
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)


def similar_to_newest(df: DataFrame, key: str, title: Column, description: Column, order: list[Column], least: float = 0.8, newest: int = NEWEST) -> DataFrame:
    """(a, b, similarity): each record a with those of the ``newest`` records b, other than itself, that reach ``least``.

    The similarity is .6 of the whole titles' ratio and .4 of that of the descriptions' first 200 letters. As a lookup
    for one record is, the search is limited to the newest records, here for every record at once; so the work grows
    with the rows. Only these, ``newest`` rows, are sent to the tasks; a bound from letter counts spares most ratios.
    """
    rows = df.select(F.col(key).cast("string").alias("id"), F.coalesce(title, F.lit("")).alias("t"), F.substring(F.coalesce(description, F.lit("")), 1, LETTERS).alias("d"))
    last = df.orderBy(*order).limit(newest).select(F.col(key).cast("string").alias("id"), F.coalesce(title, F.lit("")).alias("t"), F.substring(F.coalesce(description, F.lit("")), 1, LETTERS).alias("d")).collect()
    shared = df.sparkSession.sparkContext.broadcast([tuple(r) for r in last])

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        others = shared.value
        t_counts, d_counts = letter_counts([o[1] for o in others]), letter_counts([o[2] for o in others])
        d_grams = Grams([o[2] for o in others])
        # What a matcher learns of the text compared with is kept; the other text changes.
        matchers = [SequenceMatcher(None, "", o[2].lower()) for o in others]
        for batch in batches:
            out = []
            for i, t, d, tc, dc in zip(batch["id"], batch["t"], batch["d"], letter_counts(batch["t"].tolist()), letter_counts(batch["d"].tolist()), strict=True):
                bound = TITLE * most_ratio(tc, t_counts) + DESCRIPTION * most_ratio(dc, d_counts)
                which = np.flatnonzero(bound >= least - 1e-9)
                if len(which):
                    of_t = TITLE * most_ratio(tc, t_counts[which])
                    which = which[of_t + DESCRIPTION * np.where(d_counts[which].any(axis=1), d_grams.most(d, which), 0.0) >= least - 1e-9]
                low = d.lower()
                for k in which.tolist():
                    b, bt, bd = others[k]
                    if b == i:
                        continue
                    if d and bd:
                        matchers[k].set_seq1(low)
                    if (of_d := DESCRIPTION * matchers[k].ratio() if d and bd else 0.0) + TITLE < least:
                        continue
                    if (s := TITLE * ratio(t, bt) + of_d) >= least:
                        out.append((i, b, s))
            yield pd.DataFrame(out, columns=["a", "b", "similarity"])

    return rows.mapInPandas(compared, "a string, b string, similarity double")


def top_similar(pairs: DataFrame, k: int = 10) -> DataFrame:
    """The k most similar partners of each record."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), F.asc("b")))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)
