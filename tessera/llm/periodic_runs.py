"""Runs of periodic words: branching tandem repeats from a suffix tree by smaller-half traversal, rotated to maximal runs."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches

#: A run has at least so many words, and at least so many of its periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words of the texts whose trees are built together; a longer text stands alone.
BATCH_WORDS = 100_000
#: Leaves that are looked at together.
LEAVES = 1 << 20


def stretches(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the stretches of words begin and end outside of which no run can be.

    Every three words in a row within a run come at least three times in it. So a run lies where at least
    LEAST_WORDS - 2 threes in a row come three times in their text. Threes are counted by a hash with the text's
    number; a collision only keeps words that could go.
    """
    n = len(words) - 2
    if n < LEAST_WORDS - 2:
        return np.empty(0, int), np.empty(0, int)
    w = words.astype(np.uint64)
    with np.errstate(over="ignore"):
        mixed = [(w + np.uint64(1)) * np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
        threes = mixed[0][:n] + (mixed[1][1 : n + 1] ^ (mixed[1][1 : n + 1] >> np.uint64(29))) + (mixed[2][2 : n + 2] ^ (mixed[2][2 : n + 2] >> np.uint64(31)))
        threes = (threes ^ (threes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + owner[:n].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    order = np.argsort(threes)
    ordered = threes[order]
    head = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    count = np.diff(np.r_[head, n])
    often = np.zeros(n, bool)
    often[order[np.repeat(count >= 3, count)]] = True
    often &= owner[:n] == owner[2 : n + 2]
    change = np.diff(np.r_[0, often.astype(np.int8), 0])
    begin, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    # Threes of two texts that lie side by side are parted by two that reach over the border.
    long = end - begin >= LEAST_WORDS - 2
    return begin[long], end[long] + 2


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order and the place of each, by doubling; only those not yet told apart are sorted again."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    head = np.flatnonzero(np.r_[True, s[order][1:] != s[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(head, np.diff(np.r_[head, n]))
    open_ = np.flatnonzero(np.repeat(np.diff(np.r_[head, n]) > 1, np.diff(np.r_[head, n])))
    h = 1
    while len(open_):
        at = order[open_]
        behind = at + h
        key = rank[at] * (n + 1) + np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[open_] = at
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[head, len(key)])
        rank[at] = np.repeat(open_[head], size)
        open_ = open_[np.repeat(size > 1, size)]
        h *= 2
    return order, rank


def common_prefixes(s: list[int], order: list[int]) -> list[int]:
    """Words that each suffix of ``order`` has in common with the one before it. ``s`` ends with a word of its own."""
    n = len(s)
    before = [-1] * n
    for a, b in itertools.pairwise(order):
        before[b] = a
    out, k = [0] * n, 0
    for i, j in enumerate(before):
        if j < 0:
            k = 0
            continue
        while s[i + k] == s[j + k]:
            k += 1
        out[i] = k
        if k:
            k -= 1
    return [out[i] for i in order]


def tree(prefixes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The inner nodes of the suffix tree below its root, by their children: each child's node, first and last place, and the node's depth."""
    node: list[int] = []
    first: list[int] = []
    last: list[int] = []
    depths: list[int] = []
    stack: list[tuple[int, list[int]]] = []
    for k, depth in enumerate(itertools.chain(itertools.islice(prefixes, 1, None), [0]), 1):
        low = k - 1
        while stack and depth < stack[-1][0]:
            d, cuts = stack.pop()
            low = cuts[0]
            node += [len(depths)] * len(cuts)
            first += cuts
            last += cuts[1:]
            last.append(k)
            depths.append(d)
        if depth:
            if stack and stack[-1][0] == depth:
                stack[-1][1].append(k)
            else:
                stack.append((depth, [low, k]))
    return np.array(node, np.int64), np.array(first, np.int64), np.array(last, np.int64), np.array(depths, np.int64)


def branching_repeats(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and root lengths of all branching tandem repeats of ``s``, which ends with a word of its own.

    At each node of depth d the leaves of all children but the largest are looked at: for a leaf i, whether i + d or
    i - d is a leaf below the node too. Each leaf is in such a list at most log2(n) times. A repeat branches if it
    cannot be moved one word to the right.
    """
    order, rank = suffix_array(s)
    node, first, last, depths = tree(common_prefixes(s.tolist(), order.tolist()))
    if not len(node):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    head = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    low, high = first[head], np.maximum.reduceat(last, head)
    size = last - first
    by = np.lexsort((-size, node))
    largest = np.zeros(len(node), bool)
    largest[by[head]] = True
    node, first, size = node[~largest], first[~largest], size[~largest]
    starts, roots = [], []
    upto = np.cumsum(size)
    done = 0
    while done < len(node):
        stop = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + LEAVES, "right")))
        n, f, z = node[done:stop], first[done:stop], size[done:stop]
        place = np.repeat(f - (np.cumsum(z) - z), z) + np.arange(z.sum())
        of = np.repeat(n, z)
        leaf, depth = order[place], depths[of]
        for start, other in ((leaf, leaf + depth), (leaf - depth, leaf - depth)):
            inside = (other >= 0) & (other < len(s))
            at = rank[np.where(inside, other, 0)]
            found = inside & (at >= low[of]) & (at < high[of])
            p, d = start[found], depth[found]
            branches = s[p + d] != s[p + 2 * d]
            starts.append(p[branches])
            roots.append(d[branches])
        done = stop
    both = np.unique(np.stack([np.concatenate(starts), np.concatenate(roots)], 1), axis=0)
    return both[:, 0], both[:, 1]


def maximal_runs(s: np.ndarray) -> list[tuple[int, int, int]]:
    """Start, length and smallest period of the maximal runs of ``s``, as long as LEAST_WORDS and LEAST_PERIODS ask.

    Every branching repeat ends where a run ends. It is rotated to the left while it stays a repeat, which gives the
    run; repeats of the same end that lie within a run of smaller period have roots that are powers, and merge with it.
    """
    starts, roots = branching_repeats(s)
    words = s.tolist()
    out: list[tuple[int, int, int]] = []
    ends = starts + 2 * roots
    by = np.lexsort((roots, ends))
    at, here = -1, []
    for p, d, end in zip(starts[by].tolist(), roots[by].tolist(), ends[by].tolist(), strict=True):
        if end != at:
            at, here = end, []
        if any(start <= p for start in here):
            continue
        start = p
        while start and words[start - 1] == words[start - 1 + d]:
            start -= 1
        here.append(start)
        if end - start >= max(LEAST_WORDS, LEAST_PERIODS * d):
            out.append((start, end - start, d))
    return out


def runs_of_texts(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as words: (start, length, period) in order of start, then period."""
    numbers: dict[bytes, int] = {}
    sizes = [len(t) for t in texts]
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), np.int64, sum(sizes))
    owner = np.repeat(np.arange(len(texts)), sizes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    begin, end = stretches(words, owner)
    if not len(begin):
        return out
    # A word of one text is another word than the same word of another text; each stretch ends with a word of its own.
    length = end - begin + 1
    offset = np.cumsum(length) - length
    source = np.arange(length.sum()) + np.repeat(begin - offset, length)
    ends = offset + length - 1
    source[ends] = 0
    s = owner[source] * len(numbers) + words[source]
    s[ends] = len(texts) * len(numbers) + np.arange(len(ends))
    first_word = np.cumsum(sizes) - np.array(sizes)
    for start, size, period in maximal_runs(s):
        k = int(np.searchsorted(offset, start, "right")) - 1
        at = int(begin[k]) + start - int(offset[k])
        text = int(owner[at])
        out[text].append((at - int(first_word[text]), size, period))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words), bool)
    for start, length, period in runs:
        drop[start + period : start + length] = True
    return [w for w, gone in zip(words, drop.tolist(), strict=True) if not gone]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """The runs of every text and what is left without repetition: doc_id, runs, collapsed; a row for each row.

    Words are what stands between blanks (0x20, 0x09 to 0x0D). A run is a stretch of words with smallest period q, as
    long as max(6, 4 q), that no neighbouring word extends; runs may overlap. ``runs`` lists (start, length, period),
    numbered from 0, by start, then period. ``collapsed`` has the words outside of runs and in the first period of each,
    joined by one space; a word is dropped if any run holds it after its first period.

    Null and blank texts have no runs and collapse to an empty text. Rows are judged one by one, so repeated rows and a
    null doc_id change nothing. A text is worked on whole, in O(n log n) time and O(n) memory for n words; an empty
    table gives no rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids: list = []
            texts: list[list[bytes]] = []
            total = 0
            for i, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                words = (text or "").encode().split()
                if texts and total + len(words) > BATCH_WORDS:
                    yield frame(ids, texts)
                    ids, texts, total = [], [], 0
                ids.append(i)
                texts.append(words)
                total += len(words)
            if texts:
                yield frame(ids, texts)

    def frame(ids: list, texts: list[list[bytes]]) -> pd.DataFrame:
        runs = runs_of_texts(texts)
        return pd.DataFrame({
            "doc_id": pd.array(ids, dtype="string"), "runs": [[{"start": a, "length": n, "period": q} for a, n, q in found] for found in runs],
            "collapsed": [b" ".join(collapse(t, found)).decode() for t, found in zip(texts, runs, strict=True)],
        })

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInPandas(work, "doc_id string, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
