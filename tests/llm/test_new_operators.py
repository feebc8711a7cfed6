"""Mixing sources, runs of periodic words and the Merkle manifest: against plain versions, and on odd tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import merkle_manifest, periodic_runs, source_mix
from tessera.llm.queries import queries, table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_runs(words, least=6, periods=4):
    number = {}
    a = np.array([number.setdefault(w, len(number)) for w in words])
    best = {}
    for q in range(1, len(a) // periods + 1):
        change = np.diff(np.r_[0, (a[:-q] == a[q:]).astype(int), 0])
        for s, e in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist(), strict=True):
            if e + q - s >= max(least, periods * q):
                best.setdefault((s, e + q - s), q)
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 30)), max_size=5), min_size=1, max_size=4))
def test_runs_equal_all_periods(texts):
    words = [[b"%d" % root[i % len(root)] for root, n in parts for i in range(n)] for parts in texts]
    assert periodic_runs.runs_of_texts(words) == [plain_runs(w) for w in words]


def test_runs_in_random_words():
    rng = random.Random(3)
    for _ in range(200):
        texts = []
        for _ in range(4):
            w = [b"%d" % rng.randrange(rng.choice([1, 2, 4, 50])) for _ in range(rng.randint(0, 80))]
            for _ in range(rng.randint(0, 2)):
                root = [b"%d" % rng.randrange(9) for _ in range(rng.randint(1, 12))]
                at = rng.randint(0, len(w))
                w[at:at] = (root * 7)[: rng.randint(4, 6 * len(root) + 4)]
            texts.append(w)
        assert periodic_runs.runs_of_texts(texts) == [plain_runs(w) for w in texts]


def test_parts_of_the_tree():
    s = np.array([1, 2, 1, 2, 1, 9, 2, 1, 8])
    order, rank = periodic_runs.suffix_array(s)
    assert order.tolist() == sorted(range(9), key=lambda i: s[i:].tolist()) and (rank[order] == np.arange(9)).all()
    shared = periodic_runs.common_prefixes(s.tolist(), order.tolist())
    assert shared[1:] == [next(k for k in range(9) if s[a + k] != s[b + k]) for a, b in zip(order, order[1:], strict=False)]
    starts, roots = periodic_runs.branching_repeats(s)
    # All squares that do not go on to the right: 1 2 1 2 does, 2 1 2 1 does not.
    assert sorted(zip(starts.tolist(), roots.tolist(), strict=True)) == [(1, 2)]


def test_long_texts_of_one_word_and_of_none():
    assert periodic_runs.runs_of_texts([[b"a"] * 200_000]) == [[(0, 200_000, 1)]]
    rng = random.Random(1)
    root = [b"%d" % rng.randrange(1000) for _ in range(20_000)]
    assert periodic_runs.runs_of_texts([root * 4 + root[:7], root]) == [[(0, 80_007, 20_000)], []]


def test_runs_table(spark):
    rows = [(0, "a\x0ba\ta a a a b", "x"), (1, None, "x"), (None, "", "y"), (2, " \n", "y"), (2, "é\x1cé " * 6, None), (2, "x y " * 4 + "x", "z"), (2, "x y " * 4 + "x", "z"), (3, "p q r " * 3 + "p q", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumn("collapsed", F.lit(1))
    got = Counter((r.doc_id, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic_runs.periodic_runs(docs).collect())
    assert got == Counter({(0, ((0, 6, 1),), "a b"): 1, (1, (), ""): 1, (None, (), ""): 1, (2, (), ""): 1, (2, ((0, 6, 1),), "é\x1cé"): 1, (2, ((0, 9, 2),), "x y"): 2, (3, (), "p q r p q r p q r p q"): 1})
    assert periodic_runs.periodic_runs(docs.where("false")).count() == 0


def test_runs_query_equals_plain(spark, duck):
    got = {r.doc_id: tuple(r)[1:] for r in queries()["op12_periodic_runs"](spark, DATA).collect()}
    n_runs = 0
    for i, text in duck.execute("select doc_id, text from documents").fetchall():
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = plain_runs(words)
        n_runs += len(runs)
        gone = {k for s, z, q in runs for k in range(s + q, s + z)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        lines = "".join(f"{s},{z},{q}\n" for s, z, q in runs)
        left = hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest()
        assert got.pop(i) == (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines), left)
    assert not got and n_runs > 20


def plain_manifest(rows):
    """Leaf, subroot, root, siblings of each row, for rows as tuples of DOCS, by dicts and lists."""

    def leaf(r):
        return sha(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r[0], r[3], r[2], r[4], r[1])])

    def grow(nodes):
        proofs = [[] for _ in nodes]
        under = [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            up, above = [], []
            for s in range(0, len(nodes), 3):
                run = nodes[s : s + 3]
                for k in range(len(run)):
                    for i in under[s + k]:
                        proofs[i].append((run[:k], run[k + 1 :]))
                up.append(sha(*run))
                above.append(sum(under[s : s + 3], []))
            nodes, under = up, above
        return nodes[0], proofs

    by_source = defaultdict(list)
    for r in rows:
        by_source[r[3]].append((r[0] is not None, r[0] or 0, leaf(r)))
    out, subroots = {}, []
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        leaves = [d for *_, d in sorted(by_source[s])]
        root, proofs = grow(leaves)
        subroots.append(root)
        out[s] = (leaves, proofs)
    root, tops = grow(subroots)
    return [(d, sub, root, p + top) for s, sub, top in zip(sources, subroots, tops, strict=True) for d, p in zip(*out[s], strict=True)]


@pytest.mark.parametrize("n_sources", [1, 2, 7])
def test_manifest_equals_plain(spark, n_sources):
    rng = random.Random(n_sources)
    rows = [(i, rng.choice(["a\nb", "", None, "é漢" * 9]), rng.choice(["en", None]), rng.choice([f"s{k}" for k in range(n_sources - 1)] + [None, "é"][: n_sources > 2]) if n_sources > 1 else "s", rng.choice([None, 3])) for i in rng.sample(range(-50, 400), 170)]
    rows += [rows[5], rows[5], (None, "x", None, None, None), (None, "x", None, None, None), (None, "y", None, "s0", 1), (7_000_000_000, "long " * 100_000, "en", "alone", 1)]
    docs = spark.createDataFrame(rows, DOCS).select("*", F.lit(1).alias("tree"), F.lit("x").alias("digest"))
    made = merkle_manifest.manifest(docs, lambda: F.when(F.col("doc_id") % 2 == 0, F.lit("0" * 64)))
    got = made.withColumn("folded", merkle_manifest.folded(F.col("leaf"), F.col("proof"))).withColumn("wrong", merkle_manifest.folded(F.coalesce("carried", "leaf"), F.col("proof"))).withColumn("all", merkle_manifest.proof_digest(F.col("proof"))).collect()
    plain = plain_manifest(rows)
    assert sorted((r.leaf, r.subroot, r.root, r["all"]) for r in got) == sorted((leaf, sub, root, sha(*["".join(a + b) for a, b in proof])) for leaf, sub, root, proof in plain)
    assert all(r.folded == r.root for r in got)
    assert all((r.wrong == r.root) == (r.carried is None) for r in got)


def test_manifest_of_nothing_and_of_one_row(spark):
    docs = spark.createDataFrame([(1, "t", None, None, None)], DOCS)
    assert merkle_manifest.manifest(docs.where("false")).count() == 0
    row = merkle_manifest.manifest(docs).first()
    assert row.leaf == row.subroot == row.root == sha("1:1", "-", "-", "-", "1:t") and row.proof == []


def test_permutations(spark):
    sizes = [1, 2, 3, 10, 97, 1000]
    df = spark.createDataFrame([(n, i) for n in sizes for i in range(n)], "n long, i long").withColumn("to", source_mix.permuted(F.col("i"), F.col("n"), source_mix._keys(F.col("n"), "test", F.col("n"))))
    got = defaultdict(list)
    for r in df.orderBy("n", "i").collect():
        got[r.n].append(r.to)
    assert all(sorted(got[n]) == list(range(n)) for n in sizes)
    x = np.array(got[1000])
    # No trace of the order: neighbours lie as far apart as in a random permutation, on average a third.
    assert abs(np.abs(np.diff(x)).mean() / 333 - 1) < 0.1 and abs(np.corrcoef(np.arange(1000), x)[0, 1]) < 0.1


def test_running_sums(spark):
    rows = [(g, i, (g + 1) * i % 7) for g in range(3) for i in range(50)]
    got = source_mix.running(spark.createDataFrame(rows, "g int, i long, v long"), "g", "i", "v", width=8).collect()
    assert {(r.g, r.i): r.before for r in got} == {(g, i): sum(v for h, j, v in rows if h == g and j < i) for g, i, _ in rows}


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        w = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / w > 2 * sizes[s]}
        if not full:
            return out | {s: left * weight[s] / w for s in open_}
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2.0 * sizes[s] for s in full)
        open_ -= full
    return out


def test_mix_meets_targets_and_gives_whole_blocks(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(rng.choice([0, 1, 5, 40, 300]))) or rng.choice([None, "", " \t"]), "en", rng.choice(["a", "a", "a", "B", "c", None]), 1) for i in range(300)]
    rows += [(300, "lonely text of one source", "en", "tiny", 1), (301, None, None, "none", None), (None, "no id " * 50, "en", "c", 1), (None, "no id either", "en", "c", 1), (None, None, None, None, None), rows[4], rows[4], (4, "an other text", None, rows[4][3], None), (302, "long " * 60_000, "en", "B", 1)]
    docs = spark.createDataFrame(rows, DOCS).select("*", F.lit("x").alias("block"), F.lit(0).alias("size"))
    size = lambda t: len((t or "").encode().split())
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    expected = plain_targets(sizes)
    mixed = source_mix.mix(docs, block_words=16, shard_slots=64)
    got = source_mix.taken(mixed).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], size(r[1])) for r in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    taken = Counter()
    by_target = {round(t, 6): s for s, t in expected.items()}
    for r in got:
        assert r.source_size == sizes[by_target[round(r.target, 6)]]
        taken[by_target[round(r.target, 6)]] += r.taken
    assert all(abs(taken[s] - expected[s]) <= 24 for s in expected)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, source_mix.taken(source_mix.mix(docs.repartition(7), block_words=16, shard_slots=64)).collect()), key=str)
    # The mix itself: each slot once, blocks of 16 words, every word in them as often as was counted.
    out = source_mix.texts(mixed, docs).collect()
    assert len({(r.shard, r.slot) for r in out}) == len(out) == mixed.sources.agg(F.sum("quota")).first()[0]
    assert all(0 <= r.slot < 64 for r in out) and {r.shard for r in out} == set(range(-(-len(out) // 64)))
    assert sum(size(r.text) != 16 for r in out) <= 2 * len(sizes)
    words = Counter(w for r in out for w in r.text.split())
    for r in rows[:300]:
        if r[1] and r is not rows[4] and r[1].strip():
            assert {words[w] for w in r[1].split()} <= {0, 1, 2}
    assert sum(words.values()) == sum(taken.values())
    # Shards mix the sources: no shard holds one only.
    per_shard = defaultdict(Counter)
    for r in out:
        per_shard[r.shard][r.source] += 1
    assert all(len(c) > 1 for c in per_shard.values() if sum(c.values()) == 64)


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([(1, None, None, "a", None)], DOCS)
    assert source_mix.taken(source_mix.mix(docs.where("false"))).count() == 0
    assert [tuple(r) for r in source_mix.taken(source_mix.mix(docs)).collect()] == [(1, 0, 0, 0.0, 0)]


def test_mix_has_no_python(spark):
    plan = source_mix.taken(source_mix.mix(table(spark, DATA, "documents")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
