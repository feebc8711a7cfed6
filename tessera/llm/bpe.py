"""Byte-pair encoding by forced-boundary splitting.

A merge can only join two neighbouring symbols that stand next to each other inside some vocabulary token. Where a
pair of neighbouring symbols occurs inside no token, no merge can ever span it: the text can be cut there. The
fragments between such certain cuts are encoded independently, and the ids are concatenated.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, slices

#: Stretches and fragments whose ids each task remembers at least; twice as many at most.
REMEMBERED = 150_000
#: Control characters that are white space to str.split() alone.
CONTROLS = re.compile("[\x1c-\x1f]")
#: White space as the file's pattern sees it (fixed values of the Unicode property White_Space).
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters and numbers that are newer than Python's tables (fixed values: code points, both ends included).
# fmt: off
NEW_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
# fmt: on
NEWER = frozenset(map(chr, NEW_LOWER))


def class_ranges(kind: str, new: list[tuple[int, int]]) -> str:
    """The code points of one major category as ranges for a character class."""
    out: list[list[int]] = []
    extra = {c for a, b in new for c in range(a, b + 1)}
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == kind or c in extra:
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    return "".join([f"\\U{a:08x}-\\U{b:08x}" for a, b in out])


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return [hidden.get(b) or chr(b) for b in range(256)]


class Recent:
    """The ids of the keys met last, in two generations: when the new one is full the old one goes, so that keys in
    use stay and memory is bounded."""

    def __init__(self, size: int):
        self.size = size
        self.new: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}

    def get(self, key: str) -> list[int] | None:
        ids = self.new.get(key)
        if ids is None and (ids := self.old.get(key)) is not None:
            self.put(key, ids)
        return ids

    def put(self, key: str, ids: list[int]) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = ids


class WordBpe:
    """Encoder and decoder of a tokenizer file with word-end suffixes, made for use inside a task."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: r for r, pair in enumerate(merges)}
        self.letters = byte_letters()
        self.inside, self.inside_end = self._neighbours()
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # The classes are spelled out, since regular expression libraries differ in the Unicode version they know.
        classes = {"\\p{L}": class_ranges("L", NEW_LETTERS), "\\p{N}": class_ranges("N", NEW_NUMBERS), "\\s": SPACE}
        plain = {"\\p{L}": "A-Za-z", "\\p{N}": "0-9", "\\s": "\\t\\n\\x0b\\x0c\\r "}

        def spelled(by: dict[str, str]) -> str:
            out = pattern
            for name, ranges in by.items():
                out = out.replace(f"[{name}]", f"[{ranges}]").replace(name, ranges)
            return out

        self.words, self.plain_words = regex.compile(spelled(classes)), re.compile(spelled(plain))
        self.blank = regex.compile(f"[{SPACE}]+")
        self.cuts = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.known, self.known_fragments = Recent(REMEMBERED), Recent(REMEMBERED // 2)

    def _neighbours(self) -> tuple[set[str], set[str]]:
        """Pairs of letters that stand side by side in some token: anywhere, and as the last two of a word."""
        inside, at_end = set(), set()
        for token in self.vocab:
            body = token.removesuffix(self.end)
            pairs = [body[i : i + 2] for i in range(len(body) - 1)]
            if body != token and pairs:
                at_end.add(pairs.pop())
            inside.update(pairs)
        return inside, at_end

    def fragments(self, letters: str) -> list[str]:
        """Cuts a word wherever two neighbours occur side by side in no token; the last one carries the word end."""
        inside, start, out = self.inside, 0, []
        last = len(letters) - 1
        for i in range(1, last):
            if letters[i - 1 : i + 1] not in inside:
                out.append(letters[start:i])
                start = i
        if last and letters[last - 1 :] not in self.inside_end:
            out.append(letters[start:last])
            start = last
        out.append(letters[start:] + self.end)
        return out

    def _merge(self, part: str) -> list[int]:
        """Applies the merges to one fragment, lowest rank first and leftmost first."""
        body = part.removesuffix(self.end)
        symbols = list(body)
        if body != part:
            symbols[-1] += self.end
        none = len(self.ranks)
        if len(symbols) > 48:
            return self._merge_long(symbols)
        rank = self.ranks.get
        found = [rank(pair, none) for pair in zip(symbols, symbols[1:], strict=False)]
        while found and (low := min(found)) < none:
            i = found.index(low)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del found[i]
            if i:
                found[i - 1] = rank((symbols[i - 1], symbols[i]), none)
            if i < len(found):
                found[i] = rank((symbols[i], symbols[i + 1]), none)
        return [self.vocab[s] for s in symbols]

    def _merge_long(self, symbols: list[str]) -> list[int]:
        """As above for long fragments: a heap over a linked list, so that time grows as n log n."""
        parts: list[str | None] = list(symbols)
        after, before = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
        ranks = self.ranks
        heap = [(r, i, pair) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := ranks.get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if parts[i] != pair[0] or j < 0 or parts[j] != pair[1]:
                continue
            parts[i], parts[j], after[i] = pair[0] + pair[1], None, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (r := ranks.get((parts[k], parts[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k, (parts[k], parts[after[k]])))
        return [self.vocab[p] for p in parts if p is not None]

    def _word(self, word: str) -> list[int]:
        out: list[int] = []
        seen = self.known_fragments
        plain = word.isascii() and word.isprintable()
        for part in self.fragments(word if plain else "".join([self.letters[b] for b in word.encode()])):
            ids = seen.get(part)
            if ids is None:
                ids = self._merge(part)
                if len(part) <= 64:
                    seen.put(part, ids)
            out += ids
        return out

    def _lower(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        if not text.isascii() and not NEWER.isdisjoint(text):
            text = text.translate(NEW_LOWER)
        return "".join([c.lower() for c in text]) if "Σ" in text else text.lower()

    def _pieces(self, text: str) -> list[str]:
        """Stretches between white space, which no word spans. str.split() also cuts at four control characters."""
        return self.blank.split(text) if CONTROLS.search(text) else text.split()

    def _ids(self, piece: str) -> list[int]:
        words = (self.plain_words if piece.isascii() else self.words).findall(piece)
        ids = [i for word in words for i in self._word(word)]
        if len(piece) <= 64:
            self.known.put(piece, ids)
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for part in self.cuts.split(text or "") if self.cuts else [text or ""]:
            if part in self.special:
                out.append(self.special[part])
                continue
            pieces = self._pieces(self._lower(part))
            # Most pieces are in the newer generation; it may become the older one meanwhile, and is right then too.
            for piece, ids in zip(pieces, map(self.known.new.get, pieces), strict=True):
                if ids is None and (ids := self.known.get(piece)) is None:
                    ids = self._ids(piece)
                out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The file has no decoder, so tokens are joined by spaces as they stand in the vocabulary."""
        return " ".join(map(self.tokens.__getitem__, ids))


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def bpe_encode(docs: DataFrame, path: str, digest_only: bool = False) -> DataFrame:
    """Encodes each row's whole text: doc_id, ids, decoded, or with ``digest_only`` their digests.

    ``path`` is the vocabulary file, found on every executor. A null text counts as empty; an empty text has no ids
    and decodes to an empty string; repeated rows are encoded each; other columns are ignored. Digest columns:
    n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256 (UTF-8), both lowercase hex.
    One narrow stage: nothing is shuffled and a task holds one batch of texts.
    """

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(path)
        for batch in slices(batches):
            ids = [bpe.encode(t) for t in batch["text"]]
            decoded = [bpe.decode(i) for i in ids]
            if digest_only:
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"],
                    "n_tokens": [len(i) for i in ids],
                    "ids_sha256": [hashlib.sha256(np.asarray(i, dtype="<u4").tobytes()).hexdigest() for i in ids],
                    "decoded_sha256": [hashlib.sha256(d.encode()).hexdigest() for d in decoded],
                })
            else:
                yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [np.asarray(i, dtype=np.int32) for i in ids], "decoded": decoded})

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest_only else "doc_id long, ids array<int>, decoded string"
    return rows.mapInPandas(encoded, out)
