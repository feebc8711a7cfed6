"""The operators as Spark jobs: against SQL and brute force, and on odd tables."""

import math
import random
import re
import unicodedata

import numpy as np
import pytest
from conftest import DATA, rows_of
from pyspark.sql import functions as F

from tessera.llm import bpe, chunk_dedup, common, decontaminate, embedding_dedup, html_main, ngram_join, quality_rules, toxicity_knn, url_reputation, warc_fixity
from tessera.llm.queries import VOCABULARY, held_out, oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, duck, name):
    assert rows_of(queries()[name](spark, DATA).toPandas()) == rows_of(duck.execute(oracle_sql()[name]).df())


def words(rng, n):
    return ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(n)]


def components_of(pairs, ids):
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 99), (99, 105), (7, 7)]
    out = common.components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r.node: r.component for r in out.collect()} == {i: 0 for i in range(41)} | {99: 99, 100: 99, 105: 99}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ngram_join_is_exact(spark):
    rng = random.Random(11)
    docs, base = {}, [words(rng, 80) for _ in range(4)]
    passage = words(rng, 60)
    for i in range(150):
        w = list(base[i % 4]) if i % 3 else words(rng, 40) + passage
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice("xyz") * 5
        docs[i] = " ".join(w)
    docs |= {200: None, 201: "", 202: " \n", 203: "a b", 204: "A  B", 205: "one", 206: docs[5], 207: docs[5].upper()}
    for n, percent in ((3, 90), (5, 80)):
        sets = {i: set(ngram_join.shingles(t, n).tolist()) for i, t in docs.items()}
        pairs = [(a, b) for a in docs for b in docs if a < b and sets[a] and sets[b] and ngram_join.linked(len(sets[a]), len(sets[b]), len(sets[a] & sets[b]), percent)]
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), n, percent).collect()}
        assert got == {i: (len(sets[i]), c) for i, c in components_of(pairs, docs).items()}


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((5, 16))
    rows = [(i, i % 2, (centre[i % 5] + rng.standard_normal(16) * rng.choice([0.02, 0.1, 1.0])).tolist()) for i in range(200)]
    rows += [(300, 0, rows[0][2]), (301, 0, rows[0][2]), (302, None, rows[0][2]), (303, 0, None), (304, 0, [0.0] * 16), (305, 0, [1.0] * 15 + [None]), (306, 0, [float("nan")] * 16), (307, 0, [1e-200] * 16), (308, 0, [2e-200] * 16), (309, 0, [])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("kept", F.lit("x"))
    valid = [(i, l, np.array(e) / np.abs(e).max()) for i, l, e in rows if l is not None and e and None not in e and np.isfinite(e).all() and any(e)]
    pairs = [(a, b) for a, la, x in valid for b, lb, y in valid if a < b and la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98]
    root = components_of(pairs, [r[0] for r in rows])
    expected = {r[0]: (sum(r[0] in p for p in pairs), root[r[0]], root[r[0]] == r[0]) for r in rows}
    for block in (1024, 8):
        got = embedding_dedup.near_duplicates(df, block=block)
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got.collect()} == expected


def test_repeated_vec_ids_are_vectors_each(spark):
    x, near, far = [1.0, 0.0, 0.0], [1.0, 0.01, 0.0], [0.0, 1.0, 0.0]
    near_far = [0.0, 1.0, 0.02]
    cases = [
        ([(1, x), (1, near)], [(1, 1, 1), (1, 1, 1)]),
        ([(1, x), (1, near), (2, x), (2, near)], [(1, 3, 1), (1, 3, 1), (2, 3, 1), (2, 3, 1)]),
        ([(1, x), (1, far), (2, near)], [(1, 0, 1), (1, 1, 1), (2, 1, 1)]),
        # What one vector of an id reaches, the other reaches.
        ([(5, x), (5, far), (3, near), (4, near_far)], [(3, 1, 3), (4, 1, 3), (5, 1, 3), (5, 1, 3)]),
        ([(1, x), (5, x), (5, far), (7, far)], [(1, 1, 1), (5, 1, 1), (5, 1, 1), (7, 1, 1)]),
    ]
    for rows, expected in cases:
        df = spark.createDataFrame([(i, 0, v) for i, v in rows], "vec_id long, label int, embedding array<double>")
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()) == expected


def test_signs_grow_with_the_vectors():
    assert embedding_dedup.signs_and_tables(0, 0.98) == embedding_dedup.signs_and_tables(50_000, 0.98) == (12, 24)
    bits, tables = embedding_dedup.signs_and_tables(10**9, 0.98)
    assert 16 * 2**bits >= 10**9 and (1 - (1 - math.acos(0.98) / math.pi) ** bits) ** tables <= embedding_dedup.MISS and bits * tables < 2500


def test_fixity_finds_what_was_done(spark):
    pages = spark.createDataFrame([(i, f"http://a/{i}", "x" * (i * 37 % 900)) for i in range(3000)] + [(None, None, None)] * 3 + [(None, "u", "long " * 50_000)], "page_id long, url string, html string")
    records = warc_fixity.warc_records(pages)
    assert sorted((r.volume, r.n) for r in records.groupBy("volume").agg(F.count("*").alias("n")).collect()) == [(-1, 2), (0, 1024), (1, 1024), (2, 952)]
    a = warc_fixity.manifest(records)
    i = F.col("page_id")
    altered = pages.withColumn("html", F.when(i.isin(5, 2500), F.translate("html", "x", "y")).otherwise(F.col("html")))
    b = warc_fixity.manifest(warc_fixity.warc_records(altered)).where(i.isNull() | (i != 1500))
    got = {r.volume: r for r in warc_fixity.audit(a, b, range_bytes=4096, fan_out=4).collect()}
    assert {v: r.bad_pages for v, r in got.items()} == {-1: [], 0: [5], 1: [1500], 2: [2500]}
    assert got[-1].intact and got[-1].n_compared == 0 and not got[0].intact and 0 < got[0].n_compared < 120 and got[0].n_records == 1024
    assert all(r.intact and r.n_compared == 0 for r in warc_fixity.audit(a, a).collect())
    assert warc_fixity.audit(a.where("false"), a.where("false")).count() == 0
    assert {r.volume: len(r.bad_pages) for r in warc_fixity.audit(a.where("false"), a.where("volume = 2")).collect()} == {2: 952}
    # A record lost before the replica was written, one that grew, and one without an id that changed: the rest only moved.
    moved = pages.where(i.isNull() | ~i.isin(40, 41)).withColumn("html", F.when(i == 1100, F.lit("grown")).when(i.isNull() & F.col("url").isNull(), F.lit("z")).otherwise(F.col("html")))
    got = {r.volume: r for r in warc_fixity.audit(a, warc_fixity.manifest(warc_fixity.warc_records(moved)), range_bytes=4096, fan_out=4).collect()}
    assert {v: (r.bad_pages, r.n_nameless) for v, r in got.items()} == {-1: ([], 2), 0: ([40, 41], 0), 1: ([1100], 0), 2: ([], 0)}
    assert got[0].n_shifted == 1024 - 42 and got[2].n_shifted == 0 and 0 < got[1].n_shifted < 1024
    # Copies of a record count.
    twice = a.unionByName(a.where("page_id = 7"))
    assert {r.volume: r.bad_pages for r in warc_fixity.audit(a, twice).collect() if not r.intact} == {0: [7]}


def test_fixity_reads_below_wrong_nodes_only(spark):
    pages = spark.createDataFrame([(i, "u", "x" * 400) for i in range(4096)], "page_id long, url string, html string")
    a = warc_fixity.manifest(warc_fixity.warc_records(pages))
    b = warc_fixity.manifest(warc_fixity.warc_records(pages.withColumn("html", F.when(F.col("page_id") == 2000, F.translate("html", "x", "y")).otherwise(F.col("html")))))
    got = {r.volume: r.n_compared for r in warc_fixity.audit(a, b, range_bytes=4096, fan_out=4).collect()}
    # Below the one wrong root: its children, then four each of one wrong node.
    nodes = -(-sum(len(f"WARC/1.1..WARC-Type: response..WARC-Record-ID: <urn:page:{i}>..WARC-Target-URI: u..Content-Length: 400....") + 404 for i in range(1024, 2048)) // 4096)
    assert got == {0: 0, 1: -(-nodes // 16) + 4 + 4, 2: 0, 3: 0}


def test_url_rules_and_reputation(spark):
    urls = ["https://A.example.com:80/en/7?x", "http://b.com/en/1", "x://c.net/de/8/1", "x://example.net/de/81", "y://z.example.net/de/81#u", "no url", None, "", "a://", "http://org/es/", "http://notcom/en/"]
    urls += [f"http://spam.example.com/fr/{i}" for i in range(40)] + [f"http://fine.example.com/fr/{100 + i}" for i in range(40)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1)).withColumn("verdict", F.lit(1))
    labels = spark.createDataFrame([(i, 0) for i in range(40)] + [(100 + i, 1) for i in range(40)] + [(500, None)], "doc_id long, quality int")
    got = {r.page_id: r for r in url_reputation.url_filter(pages, labels).collect()}
    # No page of a.example.com is labelled, but half of those of its domain are bad.
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(11)] == [
        ("a.example.com:80", "/en/7", None, "block"), ("b.com", "/en/1", "com/en/", "block"), ("c.net", "/de/8/1", "net/de/", "allow"), ("example.net", "/de/81", "example.net/de/8", "block"), ("z.example.net", "/de/81", "example.net/de/8", "block"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("org", "/es/", "org/es/", "block"), ("notcom", "/en/", None, "allow"),
    ]
    assert {got[i].verdict for i in range(11, 51)} == {"block"} and {got[i].verdict for i in range(51, 91)} == {"allow"}
    assert url_reputation.url_filter(pages, labels.where("false")).where("rule is null and verdict <> 'allow'").count() == 0
    # Pages of a host without a label, in a domain with bad ones, go by the domain; those of other domains are not blocked.
    bad = spark.createDataFrame([(i, 0) for i in range(40)], "doc_id long, quality int")
    got = {r.page_id: r.verdict for r in url_reputation.url_filter(pages, bad).collect()}
    assert got[0] == got[60] == "block" and {got[i] for i in (5, 6, 7, 8, 10)} == {"allow"}


def test_sample_by_hash(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    every = [r.k for r in df.orderBy(F.xxhash64("k"), "k").limit(100).collect()]
    assert [r.k for r in common.least_by_hash(df, "k", 100).collect()] == every
    assert common.least_by_hash(df.where("k < 50"), "k", 100).count() == 50 and common.least_by_hash(df.where("false"), "k", 5).count() == 0


def test_long_and_null_urls(spark):
    long = "http://a.com/" + "x" * 200_000
    rows = [(1, long), (1, long), (None, long), (2, None), (3, "http://" + "a." * 5000 + "com/en/"), (4, "://"), (5, "http://[::1]:80/en/")]
    got = sorted(((r.page_id, r.host[:9], len(r.path), r.rule, r.verdict) for r in url_reputation.url_filter(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([(1, 0), (None, 1)], "doc_id long, quality int")).collect()), key=str)
    assert got == sorted([(1, "a.com", 200_001, None, "allow")] * 2 + [(None, "a.com", 200_001, None, "allow"), (2, "", 0, None, "allow"), (3, "a.a.a.a.a", 4, "com/en/", "block"), (4, "", 0, None, "allow"), (5, "[::1]:80", 4, None, "allow")], key=str)


def test_levels_of_hosts(spark):
    hosts = ["a.b.com", "com", "", "x.co.uk", "y.x.co.uk:81", "u:p@a.b.org", "10.0.0.1:80", "[::1]:5", "z.co.info"]
    domain, suffix = url_reputation.levels(F.col("h"))
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select(domain, suffix).collect()
    assert [tuple(r) for r in got] == [("b.com", "com"), ("com", "com"), ("", ""), ("x.co.uk", "co.uk"), ("x.co.uk", "co.uk"), ("b.org", "org"), ("10.0.0.1", ""), ("[::1]", ""), ("co.info", "info")]


def test_repeated_passages(spark):
    rng = random.Random(8)
    passages = [" ".join(words(rng, 60)) for _ in range(5)]
    docs = {i: " ".join(words(rng, 80)) for i in range(40)}
    for i in range(10, 20):
        docs[i] = docs[i] + "\n" + passages[i % 5] + " " + " ".join(words(rng, 20))
    docs |= {50: docs[3], 60: None, 61: "", 62: "é" * 3000}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("n_chars", F.length("text").cast("long"))
    got = chunk_dedup.repeated_spans(df).collect()
    assert {r.doc_id for r in got} - {62} == set(range(15, 20)) | {50}
    assert {tuple(r.first_docs) for r in got if r.doc_id == 15} == {(10,)} and {tuple(r.first_docs) for r in got if r.doc_id == 50} == {(3,)}
    left = {r.doc_id: r for r in chunk_dedup.remove_repeats(df).collect()}
    assert 50 not in left and left[3].text == docs[3] and left[60].text is None and left[61].text == "" and left[10].text == docs[10]
    for i in range(15, 20):
        assert len(left[i].text.split()) < 125 and left[i].text.startswith(" ".join(docs[i].split()[:70])) and left[i].n_chars == len(left[i].text)
    assert chunk_dedup.remove_repeats(df).columns == df.columns


def plain_spans(docs):
    """Repeated spans of (doc_id, text) rows by a dict of chunks, as (doc_id, text, start, end, words, first docs)."""
    once = sorted({(i, t) for i, t in docs if i is not None and t}, key=lambda r: (r[0], r[1]))
    cut = {}
    for i, t in once:
        raw = t.encode("utf-8", "surrogatepass")
        ends = chunk_dedup.cuts(np.frombuffer(raw, np.uint8)).tolist()
        cut[i, t] = [(s, e, raw[s:e], sum(w[0] not in b" \t\n\x0b\f\r" and (k == 0 or raw[k - 1] in b" \t\n\x0b\f\r") for k in range(s, e) for w in (raw[k : k + 1],))) for s, e in zip([0, *ends], ends, strict=False)]
    first = {}
    for (i, t), pieces in cut.items():
        for s, _, c, _ in pieces:
            first[c] = min(first.get(c, (i,)), (i,))
    out = []
    for (i, t), pieces in cut.items():
        seen, run = set(), []
        for s, e, c, w in [*pieces, (-1, -1, b"", 0)]:
            if e > 0 and (first[c][0] != i or c in seen):
                run.append((s, e, w, first[c][0]))
            elif run:
                if sum(r[2] for r in run) >= chunk_dedup.LEAST_WORDS:
                    out.append((i, t, run[0][0], run[-1][1], sum(r[2] for r in run), tuple(sorted({r[3] for r in run}))))
                run = []
            seen.add(c)
    return sorted(out)


def test_repeated_spans_equal_brute_force(spark, duck):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    rng = random.Random(6)
    common = " ".join(words(rng, 70))
    more = [(10_000 + i, " ".join(words(rng, 30)) + " " + common + " " + " ".join(words(rng, 5 * i))) for i in range(6)]
    more += [(10_100, "echo " * 400), (10_101, common), (10_101, common), (10_101, common + " other text of the same id " + common), (10_102, None), (10_103, "")]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    texts = {(r.doc_id, chunk_dedup.text_tag(r.text)): r.text for r in docs.collect() if r.text}
    got = sorted((r.doc_id, texts[r.doc_id, r.tag], r.span_start, r.span_end, r.n_words, tuple(r.first_docs)) for r in chunk_dedup.repeated_spans(docs).collect())
    assert got == plain_spans([tuple(r) for r in docs.collect()]) and len(got) > 20
    left = sorted((r.doc_id, r.text) for r in chunk_dedup.remove_repeats(docs).collect() if r.text)
    plain, spans = [], {}
    for i, t, s, e, *_ in got:
        spans.setdefault((i, t), []).append((s, e))
    for r in docs.collect():
        if r.text and ((new := chunk_dedup.without(r.text, spans[r.doc_id, r.text]) if (r.doc_id, r.text) in spans else r.text).strip() or (r.doc_id, r.text) not in spans):
            plain.append((r.doc_id, new))
    assert left == sorted(plain)


def test_contamination(spark):
    rng = random.Random(2)
    items = [(i, " ".join(words(rng, rng.randint(14, 40)))) for i in range(12)]
    docs = [(i, " ".join(words(rng, 60))) for i in range(60)]
    docs += [(100 + i, docs[i][1] + " " + t.upper() + ". " + docs[i + 1][1]) for i, t in items] + [(200, None), (201, ""), (None, items[0][1])]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (98, None), (99, ""), (None, "x y z")], "item_id long, text string")
    for block in (20_000, 5):
        got = decontaminate.contaminated(df.withColumn("score", F.lit("x")), bench, items=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == {(100 + i, i) for i in range(12)} | {(None, 0)} and {r.score for r in got} == {1.0}
    assert decontaminate.contaminated(df, bench.where("false")).count() == 0


def test_decontamination_of_common_edited_copies(spark):
    rng = random.Random(8)
    item, other = words(rng, 30), words(rng, 30)
    copy = [f"x{k}" if k % 5 == 2 else w for k, w in enumerate(item)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other))], "item_id long, text string")
    for n, held in ((200, 1), (200, 60), (1000, 2)):
        docs = [(i, " ".join(words(rng, 20) + (copy if i < held else []) + words(rng, 20))) for i in range(n)]
        got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
        assert sorted((r.doc_id, r.item_id, round(r.score, 6)) for r in got) == [(i, 1, 0.7) for i in range(held)]


def held_out_figures(spark, name, column, sought):
    """Recall and precision of the label ``sought`` on held-out rows, mean squared error of the score and that of a
    constant, and how far the mean score of five equal ranges of scores is from the share of 1 there."""
    sf = DATA.replace("0.001", "0.1")
    out = queries()[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col(column).alias("y")), "doc_id").where("held_out").cache()
    right = F.count_if((F.col("predicted") == sought) & (F.col("y") == sought))
    row = out.agg(
        F.count_if((F.col("score") < 0) | (F.col("score") > 1) | F.col("score").isNull()).alias("odd"), (right / F.count_if(F.col("y") == sought)).alias("recall"),
        (right / F.count_if(F.col("predicted") == sought)).alias("precision"), F.avg(F.pow(F.col("score") - F.col("y"), 2)).alias("error"), F.var_pop("y").alias("constant"),
    ).first()
    ranges = out.groupBy(F.floor(F.col("score") * 5)).agg(F.count("*").alias("n"), F.abs(F.avg("score") - F.avg("y")).alias("gap"))
    off = ranges.agg(F.sum(F.col("n") * F.col("gap")) / F.sum("n")).first()[0]
    assert row.odd == 0 and off < 0.05
    return row


def test_quality_held_out(spark, duck):
    row = held_out_figures(spark, "op6_quality", "quality", 0)
    assert row.recall >= 0.85 and row.precision >= 0.85 and row.error < row.constant / 4


def test_toxicity_held_out(spark, duck):
    row = held_out_figures(spark, "op10_toxicity", "toxic", 1)
    assert row.recall >= 0.85 and row.precision >= 0.85 and row.error < row.constant / 4


def test_quality_equals_plain_rules(spark, duck):
    """The compiled Columns against the same statistics and rules in plain Python, on the whole smallest table."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = quality_rules.train(docs, spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/labels.parquet"))
    model.weights += [(quality_rules.Rule(((n, op, t),)), w) for n, op, t, w in (("upper", ">", 0.02, 0.4), ("distinct_root", "<=", 6.0, -0.3), ("ends", ">", 0.5, 0.2), ("repeated_lines", ">", 0.1, -1.0), ("symbols", ">", 0.01, 0.1), ("repeated_next", ">", 0.0, 0.7))]
    scored = quality_rules.quality_scores(docs, model)
    got = {r.doc_id: r.score for r in scored.collect()}
    for r in docs.collect():
        stats = plain_statistics(r.text or "")
        total = model.bias + sum(w for rule, w in model.weights if all(stats[s] <= t if op == "<=" else stats[s] > t for s, op, t in rule.terms))
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-total))) < 1e-9
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 2


def plain_statistics(text):
    ws, lines = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w], [x for x in text.split("\n") if x]
    n, kinds = len(text), [unicodedata.category(c) for c in text]
    share = lambda a, b: a / b if b else 0.0
    values = (
        len(ws), share(n, len(ws)), share(len(set(ws)), len(ws)), share(len(set(ws)), math.sqrt(len(ws))), share(sum(a == b for a, b in zip(ws, ws[1:], strict=False)), len(ws)),
        share(len(lines) - len(set(lines)), len(lines)), share(len(ws), len(lines)), share(kinds.count("Lu"), n), share(sum(k[0] == "L" for k in kinds), n), share(kinds.count("Nd"), n),
        share(sum(c in ".,;:?" for c in text), n), share(text.count("!"), n), share(sum(c in "#$%&*+/<=>@\\^_`|~[]{}-" for c in text), n), share(sum(bool(re.search(r"[.!?]['\"]?[ \t\n\x0b\f\r]*$", x)) for x in lines), len(lines)),
    )
    return dict(zip(quality_rules.NAMES, values, strict=True))


def test_toxicity_equals_full_search(spark, duck):
    """Scores and voters of every document of the smallest table against a full search over all labelled rows."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    texts, known = {r.doc_id: r.text or "" for r in docs.collect()}, {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    got = {r.doc_id: r for r in toxicity_knn.toxicity(docs, labels).collect()}
    bags = {i: toxicity_knn.words_of(t) for i, t in texts.items()}
    held = {i: bags[i] for i in known if i in bags}
    n, n_pos, every = len(held), sum(known[i] for i in held), {t for b in held.values() for t in b}
    weight = {}
    for t in every:
        a, total = sum(known[i] for i, b in held.items() if t in b), sum(t in b for b in held.values())
        b, c, d = total - a, n_pos - a, n - n_pos - (total - a)
        chi = (a * d - b * c) ** 2 / max((a + b) * (c + d) * (a + c) * (b + d), 1e-9) + 0.5 / n
        weight[t] = (math.log((1 + len(texts)) / (1 + sum(t in x for x in bags.values()))) + 1) * chi

    def vector(bag):
        v = {t: (1 + math.log(k)) * weight[t] for t, k in bag.items() if t in weight}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()} if size else {}

    examples, base = {i: vector(b) for i, b in held.items()}, (n_pos + 1) / (n + 20)
    empty = [known[i] for i, v in examples.items() if not v]
    for i, bag in bags.items():
        q = vector(bag)
        near = sorted(((-round(s, 12), e) for e, v in examples.items() if (s := sum(x * v.get(t, 0.0) for t, x in q.items())) > 0))[: toxicity_knn.NEIGHBOURS]
        votes = [s * s for s, _ in near]
        score = (sum(v * known[e] for v, (_, e) in zip(votes, near, strict=True)) + 0.15 * base) / (sum(votes) + 0.15) if q else (sum(empty) + base) / (len(empty) + 1)
        assert abs(got[i].score - score) < 1e-9 and np.allclose(got[i].similarities, [-s for s, _ in near])


def test_toxicity_uses_every_term(spark):
    rng = random.Random(4)
    common = words(rng, 40)
    for n in (160, 1600):
        texts, labels = [], []
        own = ["".join(rng.choices("qrstuvwxyz", k=9)) for _ in range(n)]
        for i in range(n):
            toxic = i % 10 == 0
            mark = " vile" if toxic and i % 30 == 0 else ""
            texts.append((i, " ".join(rng.choices(common, k=12) + [own[i]]) + mark))
            labels.append((i, int(toxic)))
        texts += [(n, " ".join(rng.choices(common, k=12)) + " vile"), (n + 1, own[7]), (n + 2, "unheard ofword")]
        docs, known = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
        got = {r.doc_id: r for r in toxicity_knn.toxicity(docs, known).where(f"doc_id >= {n}").collect()}
        assert got[n].score > 0.5 and all(i % 30 == 0 for i in got[n].neighbours[:5])
        assert got[n + 1].neighbours[0] == 7 and got[n + 1].score < 0.2
        assert got[n + 2].neighbours == []


def test_rules_read_from_trees():
    text = "Tree 0 (weight 1.0):\n    If (feature 0 <= 0.5)\n     If (feature 1 > 2.0)\n      Predict: 1.0\n     Else (feature 1 <= 2.0)\n      Predict: 0.0\n    Else (feature 0 > 0.5)\n     Predict: 0.0\n"
    rules = [str(r) for r in quality_rules.tree_rules(text, ["a", "b"])]
    assert rules == ["a <= 0.5", "a <= 0.5 and b > 2", "a <= 0.5 and b <= 2", "a > 0.5"]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls, empties, a long text, ties, repeats, and columns whose names the operators use inside."""
    rows = [(1, "some words here. and more words!"), (1, "some words here. and more words!"), (2, None), (3, ""), (None, "no id"), (4, "long " * 60_000), (5, " \n\t"), (6, "\ud7ff\x00 odd \x1c text"), (7, "Some  WORDS here. and more words!")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("score", "component_id", "row", "spans", "y", "label_id", "join_id", "digest", "n_words", "rep", "ids", "node", "kept_id", "leak_id", "new_text"):
        df = df.withColumn(c, F.lit("mine"))
    return df


def test_odd_tables(spark, odd):
    empty = odd.where("false")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (4, 0, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "some words here"), (2, None)], "item_id long, text string")
    for docs in (odd, empty):
        n = docs.count()
        assert bpe.bpe_encode(docs, VOCABULARY).count() == bpe.bpe_encode(docs, VOCABULARY, True).count() == n
        assert ngram_join.ngram_jaccard_join(docs).count() == n
        assert chunk_dedup.repeated_spans(docs).where("doc_id <> 4").count() == 0
        assert chunk_dedup.remove_repeats(docs).columns == docs.columns
        assert {r.doc_id for r in decontaminate.contaminated(docs, bench).collect()} == ({1, 7} if n else set())
        for l in (labels, labels.where("false")):
            assert quality_rules.quality_scores(docs, quality_rules.train(docs, l)).where("score between 0 and 1").count() == n
            assert toxicity_knn.toxicity(docs, l).where("score between 0 and 1").count() == n
        assert quality_rules.keep_good(docs, quality_rules.RuleEnsemble(0.0, []), 0.5).columns == docs.columns
    pages = odd.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"), F.lit(None).cast("string").alias("url"), F.lit("mine").alias("volume"), F.lit(1).alias("text"))
    assert html_main.extract_main_text(pages).count() == 9 and html_main.extract_main_text(pages.where("false")).count() == 0
    m = warc_fixity.manifest(warc_fixity.warc_records(pages))
    assert all(r.intact for r in warc_fixity.audit(m, m).collect())
    assert url_reputation.url_filter(pages, labels).count() == 9
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_join(odd).where("doc_id is not null").collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 1}


def test_main_text_query_equals_a_plain_reading(spark, duck):
    """Every page of the smallest table: the blocks of its article, read without ratios, as these pages have nothing else in it."""
    import html

    got = {r.page_id: (r.text, r.n_chars) for r in queries()["op8_main_text"](spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", article)]
        text = "\n".join([b for b in parts if b])
        assert got[r.page_id] == (text, len(text))


def test_long_and_odd_pages(spark):
    long = "<article>" + "<p>word, word and word.</p>" * 30_000 + "</article>"
    rows = [(1, "u", long), (2, None, None), (None, "u", ""), (3, "u", "<p>a</p>"), (3, "u", "<p>a</p>"), (4, "u", "<" * 5000), (5, "u", "<div>" * 3000 + "deep" + "</div>" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine"))
    got = sorted(((r.page_id, r.text[:10], r.n_chars) for r in html_main.extract_main_text(pages).collect()), key=str)
    assert got == sorted([(1, "word, word", 30_000 * 21 - 1), (2, "", 0), (None, "", 0), (3, "a", 1), (3, "a", 1), (4, "<" * 10, 5000), (5, "deep", 4)], key=str)


def test_embeddings_empty(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0


def test_pipeline_stages(spark, duck, odd, tmp_path):
    import corpus_pipeline as p

    assert len(p.STAGES) == 5 and p.ORACLE_SQL is None
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in p.STAGES:
        for table in (odd, odd.where("false")):
            out = stage(spark, table, DATA)
            assert out.count() <= table.count() and (name == p.STAGES[-1][0] or out.columns == table.columns)
    stages = dict(p.STAGES)
    kept = sorted(((r.doc_id, r.text) for r in stages["n-gram Jaccard join"](spark, odd, DATA).collect()), key=str)
    assert kept == sorted({(r.doc_id, r.text) for r in odd.collect() if r.doc_id != 7}, key=str)
    two = spark.createDataFrame([(1, "one text of an id"), (1, "another text of it"), (1, "one text of an id"), (None, "x"), (None, "x"), (None, None)], "doc_id long, text string")
    assert stages["n-gram Jaccard join"](spark, two, DATA).count() == 4
    assert docs.columns == stages["benchmark decontamination"](spark, docs, DATA).columns


def test_pipeline_equals_plain_stages(spark, duck):
    """run() against the stages chained in plain Python over the whole smallest table."""
    from tokenizers import Tokenizer

    import corpus_pipeline as p

    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = quality_rules.train(docs, labels)
    for i, t in list(texts.items()):
        stats = plain_statistics(t or "")
        total = model.bias + sum(w for rule, w in model.weights if all(stats[s] <= x if op == "<=" else stats[s] > x for s, op, x in rule.terms))
        if 1 / (1 + math.exp(-total)) < 0.3:
            del texts[i]
    n_good = len(texts)
    sets = {i: set(ngram_join.shingles(t, 5).tolist()) for i, t in texts.items()}
    pairs = [(a, b) for a in texts for b in texts if a < b and sets[a] and sets[b] and ngram_join.linked(len(sets[a]), len(sets[b]), len(sets[a] & sets[b]), 80)]
    texts = {i: texts[i] for i, c in components_of(pairs, texts).items() if i == c}
    n_single = len(texts)
    spans = {}
    for i, _, s, e, *_ in plain_spans(texts.items()):
        spans.setdefault(i, []).append((s, e))
    texts = {i: new for i, t in texts.items() if (new := chunk_dedup.without(t, spans[i]) if i in spans else t) is not None and (i not in spans or new.strip())}
    leaks = {i for i, t in texts.items() if plain_copies(t, items)}
    texts = {i: t for i, t in texts.items() if i not in leaks}
    assert n_single < n_good < docs.count() and spans and leaks
    library = Tokenizer.from_file(VOCABULARY)
    library.no_truncation()
    library.no_padding()
    expected = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in texts.items()}
    got = {r.doc_id: r for r in p.run(spark, DATA).collect()}
    assert {i: list(r.ids) for i, r in got.items()} == expected
    assert all(got[i].decoded == library.decode(ids, skip_special_tokens=False) for i, ids in expected.items())


def plain_copies(text, items):
    """Every item aligned with the whole text, where three words in a row are common: {item: score}."""
    vocabulary, out = {}, {}
    passage = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in decontaminate.words_of(text)], np.int64)
    grams = {tuple(passage[k : k + 3].tolist()) for k in range(len(passage) - 2)}
    for i, t in items:
        item = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in decontaminate.words_of(t)], np.int64)
        if len(item) > 2 and not grams.isdisjoint({tuple(item[k : k + 3].tolist()) for k in range(len(item) - 2)}):
            score = decontaminate.align(item, passage)[0] / (decontaminate.MATCH * len(item))
            if score >= decontaminate.LEAST_SCORE:
                out[i] = score
    return out


def test_contamination_equals_alignment_of_everything(spark, duck):
    """Every item against every text of the smallest table, and edited copies of the items besides."""
    rng = random.Random(12)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    for k, (_, t) in enumerate(items * 6):
        copy = []
        for w in t.split():
            edit = rng.random() * (2.5 if k % 2 else 1)
            copy += [] if edit < 0.1 else [w, "between"] if edit < 0.2 else ["changed"] if edit < 0.35 else [w]
        docs.append((100_000 + k, " ".join(words(rng, 30) + copy + words(rng, 30))))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()
    expected = {(d, i): s for d, t in docs for i, s in plain_copies(t, items).items()}
    assert {(r.doc_id, r.item_id): round(r.score, 9) for r in got} == {k: round(s, 9) for k, s in expected.items()}
    assert 20 < sum(d >= 100_000 for d, _ in expected) and any(d < 100_000 for d, _ in expected)


def test_bpe_query_equals_the_library(spark, duck):
    import hashlib

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    library.no_truncation()
    library.no_padding()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries()["op4_bpe"](spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[r.doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_strength_of_priors_is_learned(spark):
    def weight(rows):
        df = spark.createDataFrame(rows, "b long, n long, m double")
        return url_reputation.prior_weight(df, "b", "n", F.col("m"))

    rng = np.random.default_rng(1)
    alike = [(int(rng.binomial(40, 0.3)), 40, 0.3) for _ in range(400)]
    apart = [(40 if i % 10 < 3 else 0, 40, 0.3) for i in range(400)]
    true = [(int(rng.binomial(40, p)), 40, 0.3) for p in rng.beta(6, 14, 2000)]
    assert weight(apart) == pytest.approx(url_reputation.LEAST_WEIGHT) and weight(alike) > 100 and 14 < weight(true) < 28
    assert weight([(1, 1, 0.5), (0, 0, 0.5)]) == weight([]) == url_reputation.PRIOR_WEIGHT and weight([(0, 9, 0.0)]) == url_reputation.PRIOR_WEIGHT
    # The same outcomes of one host count for more or less as its siblings are apart or alike.
    hosts = [(f"{k}.d.com", "d.com", "com", b, n) for k, (b, n) in enumerate([(6, 10)] + [(0, 40), (40, 40)] * 10)], [(f"{k}.d.com", "d.com", "com", b, n) for k, (b, n) in enumerate([(6, 10)] + [(20, 40)] * 20)]
    apart, alike = ({r.host: r for r in url_reputation.reputation(spark.createDataFrame(h, "host string, domain string, suffix string, n_bad long, n_pages long")).collect()} for h in hosts)
    assert apart["0.d.com"].bad_share == pytest.approx(0.6, abs=0.02) and alike["0.d.com"].bad_share == pytest.approx(0.5, abs=0.02) and apart["2.d.com"].bad_low > 0.9 > 0.02 > apart["1.d.com"].bad_share
