"""Operators on the golden tables and on small fixtures."""

import random
from datetime import date

import numpy as np
from conftest import DATA
from pyspark.sql import functions as F

from tessera.operators import ml, reports, search, similar, state
from tessera.sources import feeds, pages

DAY = date(2024, 6, 15)


def golden(spark):
    schema = "id string, source_id string, title string, country_iso string, level_norm string, mission_tags array<string>, international_eligible boolean, deadline string, status string, deleted_at timestamp, last_seen_at string, apply_url string, created_at date, org_name string, description_snippet string"
    d = [
        ("j1", "s1", "Health Officer", "KE", "mid", ["health", "wash"], True, "2024-07-01", "active", None, "06-14", "https://a.org/jobs/1"),
        ("j2", "s1", "WASH Engineer", "KE", "senior", ["wash"], False, None, "active", None, "06-13", "https://a.org/p/2?utm_source=x"),
        ("j3", "s1", "WASH Engineer", "UG", "senior", [], None, "2024-06-15", "active", None, "06-12", "https://a.org/p/2"),
        ("j4", "s2", "Intern", None, "intern", None, True, "2024-06-14", "active", None, "06-11", "https://b.org/careers"),
        ("j5", "s2", "Finance Lead", "KE", "lead", ["governance", "unknown_tag"], False, "2024-08-01", "active", None, None, None),
        ("j6", "s2", "HR", "IN", "mid", ["health"], True, None, "active", __import__("datetime").datetime(2024, 6, 10), "06-09", "https://b.org/x"),
        ("j7", "s3", "Data Analyst", "IN", "mid", ["health"], None, None, "closed", None, "06-08", "https://c.org/y"),
    ]
    return spark.createDataFrame([(*r, None, None, None) for r in d], schema).withColumn("deadline", F.col("deadline").cast("date"))


def ids(df):
    return [r.id for r in df.collect()]


def test_search(spark):
    j = golden(spark)
    v = search.visible(j, DAY)
    assert ids(v.orderBy("id")) == ["j1", "j2", "j3", "j5"]
    assert [tuple(r) for r in search.facet(v, "country_iso").collect()] == [("KE", 3), ("UG", 1)]
    assert [tuple(r) for r in search.facet(v, "level_norm").collect()] == [("senior", 2), ("lead", 1), ("mid", 1)]
    assert [tuple(r) for r in search.facet(v, "international_eligible", None).collect()] == [("false", 2), ("true", 1)]
    assert [tuple(r) for r in search.array_facet(v, "mission_tags").collect()] == [("wash", 2), ("governance", 1), ("health", 1), ("unknown_tag", 1)]
    assert ids(v.orderBy(*search.order_columns("newest"))) == ["j5", "j1", "j2", "j3"]
    assert ids(v.orderBy(*search.order_columns("closing_soon"))) == ["j3", "j1", "j5", "j2"]
    page, total = search.search(j, search.SearchRequest(q="wash"), DAY)
    assert sorted(ids(page)) == ["j2", "j3"] and total.first().total == 2
    for filters, expected in (({"mission_tags": ["WASH"]}, ["j1", "j2"]), ({"level_norm": "Sr."}, ["j2", "j3"]), ({"level_norm": "garbage"}, ["j1", "j2", "j3", "j5"])):
        assert sorted(ids(search.matches(j, search.SearchRequest(filters=filters), DAY))) == expected


def test_search_plan_pushes_filters(spark, tmp_path):
    golden(spark).write.parquet(str(tmp_path / "jobs"))
    plan = search.facet(search.visible(spark.read.parquet(str(tmp_path / "jobs")), DAY), "country_iso")._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "EqualTo(status,active)" in plan and "Python" not in plan
    assert "ReadSchema: struct<country_iso:string,deadline:date,status:string,deleted_at:timestamp>" in plan


def test_reports(spark):
    j = golden(spark)
    stored = j.where("deleted_at is null and status = 'active'")
    from tessera.functions.constants import LISTING_GLOBAL

    r = reports.url_report(stored, None, LISTING_GLOBAL).first()
    assert (r.total_jobs, r.unique_urls, r.null_urls, r.listing_urls) == (5, 4, 1, 2)
    s1 = reports.url_report(j.where("deleted_at is null and source_id = 's1'"), "source_id").first()
    assert (s1.total_jobs, s1.unique_urls, s1.listing_urls, round(s1.quality_score, 4)) == (3, 3, 1, 91.6667)
    sources = spark.createDataFrame([("s1",), ("s2",), ("s3",), ("s4",)], "sid string")
    zero = reports.with_zero(sources, search.visible(j, DAY), "sid", "source_id").orderBy("sid").collect()
    assert [r.n for r in zero] == [3, 1, 0, 0]
    from tessera.functions.links import normalize_url

    assert [(r.url, r.n) for r in reports.duplicate_groups(j, normalize_url(F.col("apply_url")), "title", "last_seen_at").collect()] == [("https://a.org/p/2", 2)]
    tags = spark.createDataFrame([("health",), ("wash",), ("governance",)], "key string")
    assert [tuple(r) for r in reports.unknown_tags(j, "mission_tags", tags, "key").collect()] == [("unknown_tag", 1)]
    m = spark.range(1).select(reports.set_metrics(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"), F.lit("d"))).alias("m")).first()[0]
    assert round(m.precision, 4) == 0.3333 and m.recall == 0.5 and round(m.f1, 4) == 0.4


def test_upsert_is_idempotent_and_revives(spark):
    old = spark.createDataFrame([("a", "x", None), ("b", "y", "2024-01-01 00:00:00"), ("c", "z", None)], "k string, v string, deleted_at string").withColumn("deleted_at", F.col("deleted_at").cast("timestamp"))
    new = spark.createDataFrame([("a", None), ("b", "y"), ("d", "w"), (None, "lost")], "k string, v string")
    out = state.upsert(old, new, ["k"], revive=True)
    got = {r.k: (r.v, r.deleted_at, r.outcome) for r in out.collect()}
    assert got == {"a": ("x", None, "skipped"), "b": ("y", None, "updated"), "c": ("z", None, "kept"), "d": ("w", None, "inserted")}
    again = state.upsert(out.drop("outcome"), new, ["k"], revive=True)
    assert {r.outcome for r in again.collect()} == {"skipped", "kept"}


def test_cascade_and_deletes(spark):
    j = golden(spark)
    left = j.select("source_id").distinct().where("source_id <> 's1'")
    assert state.cascade(left, j, "source_id", "source_id").count() == 4
    kept, gone = state.hard_delete(j, F.col("source_id") == "s1", "closed down")
    assert kept.count() == 4 and gone.count() == 3
    assert state.without_expired(j, "2024-06-15").count() == 6


def test_feeds(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>A job</title><link>https://a.org/1</link><description>d</description></item><item><title></title><link>x</link></item></channel></rss>")
    assert [tuple(r) for r in feeds.rss_items(spark, str(tmp_path / "feed.xml")).collect()] == [("A job", "https://a.org/1", "d")]
    docs = spark.createDataFrame([('{"results": [{"name": "T", "id": 7, "duty_station": "X"}, {"id": 8}]}',), ('[{"title": "U", "link": "https://u"}]',), ("junk",)], "body string")
    got = {(r.title, r.apply_url, r.location_raw) for r in feeds.json_items(docs, "body", F.lit("https://api/")).collect()}
    assert got == {("T", "https://api/7", "X"), ("U", "https://u", None)}
    files = spark.createDataFrame([("a.org", "# c\nUser-agent: *\nDisallow: /x\nDisallow:\nCrawl-delay: 1.5\nUser-agent: other\nDisallow: /y"), ("b.org", "")], "host string, body string")
    assert {r.host: (r.disallow, r.crawl_delay_ms) for r in feeds.robots(files).collect()} == {"a.org": (["/x"], 1500), "b.org": ([], None)}


def test_stored_pages(spark, tmp_path):
    for d, text in (("a", "<p>one\ntwo</p>"), ("b/c", "")):
        (tmp_path / d).mkdir(parents=True)
        (tmp_path / d / "x.html").write_text(text)
    got = {r.path.rsplit("/", 2)[1]: r.html for r in feeds.stored_pages(spark, str(tmp_path)).collect()}
    assert got["a"] == "<p>one\ntwo</p>" and set(got) <= {"a", "c"}


def test_pages_are_stored_by_tasks(spark, tmp_path):
    rows = [(i, f"<p>{i}\u00e9\n\r\n" * (i % 3)) for i in range(-1, 300)]
    feeds.store_pages(spark.createDataFrame(rows, "page_id long, html string"), f"file://{tmp_path}/html")
    # A file for each page in a few folders and nothing beside; before, a folder and a checksum for each.
    files = [p for p in (tmp_path / "html").rglob("*") if p.is_file()]
    assert len(files) == len(rows) and len({p.parent for p in files}) <= feeds.FOLDERS and all(p.suffix == ".html" for p in files)
    got = {int(r.path.rsplit("=", 1)[1].split(".")[0]): r.html for r in feeds.stored_pages(spark, f"file://{tmp_path}/html").collect()}
    assert got == {i: html + "\n" for i, html in rows}
    feeds.store_pages(spark.createDataFrame([(7, "a"), (7, "b")], "page_id long, html string"), f"file://{tmp_path}/same")
    assert sorted(r.html for r in feeds.stored_pages(spark, f"file://{tmp_path}/same").collect()) == ["a\n", "b\n"]


PAGE = """<html><head><title>Job</title><script type="application/ld+json">{"@graph": [{"@type": "JobPosting", "title": "Nurse", "hiringOrganization": {"name": "Org"},
"jobLocation": {"address": {"addressLocality": "Nairobi", "addressCountry": "KE"}}, "datePosted": "2024-01-01", "validThrough": "2024-02-01", "url": "https://o/1"}]}</script></head>
<body><h1>Nurse position: vacancy</h1><dl><dt>Location:</dt><dd>Kisumu</dd><dt>Closing date</dt><dd>2024-02-02</dd></dl><table><tr><th>Job title</th><th>Duty station</th><th>Deadline</th></tr>
<tr><td><a href="/job/5">Doctor</a></td><td>Lamu</td><td>1 May 2024</td></tr></table></body></html>"""


def test_pages(spark):
    p = spark.createDataFrame([(1, "https://o/job/1", PAGE), (2, "https://o/x", None)], "page_id long, url string, html string")
    ld = pages.json_ld(p).first()
    assert (ld.title, ld.employer, ld.location, ld.deadline) == ("Nurse", "Org", "Nairobi, KE", "2024-02-01")
    best = {r.field: (r.value, r.stage) for r in pages.best_fields(pages.field_rows(p)).where("page_id = '1'").collect()}
    assert best["title"] == ("Nurse", "jsonld") and best["location"] == ("Nairobi, KE", "jsonld")
    assert [tuple(r)[2:] for r in pages.table_rows(p).collect()] == [("Doctor", "Lamu", "1 May 2024", "/job/5")]
    out = {r.page_id: r for r in pages.extract(p).collect()}
    assert out["1"].is_job and out["2"].confidence == 0.0


def test_similar_equals_a_loop(spark):
    rng = random.Random(3)
    words = ["health", "officer", "in", "Nairobi", "WASH", "senior", "data", "analyst", "été"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 6))) if i % 9 else None, " ".join(rng.choices(words, k=50)) if i % 4 else ("d" if i % 8 else None)) for i in range(160)]
    rows += [(600 + i, f"{rows[i][1]} {i}", rows[i][2]) for i in range(10, 30)]
    rows += [(500, rows[3][1] + "!", rows[3][2]), (501, "", "x"), (502, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "id int, title string, description string")
    got = similar.similar_to_newest(df, "id", F.col("title"), F.col("description"), [F.desc("id")], 0.8, newest=40).collect()
    newest = sorted(rows, key=lambda r: -r[0])[:40]
    expected = {}
    for a, t, d in rows:
        for b, bt, bd in newest:
            s = 0.6 * similar.ratio(t or "", bt or "") + 0.4 * similar.ratio((d or "")[:200], (bd or "")[:200])
            if a != b and s >= 0.8:
                expected[str(a), str(b)] = round(s, 9)
    assert {(r.a, r.b): round(r.similarity, 9) for r in got} == expected and len(expected) > 8
    top = similar.top_similar(spark.createDataFrame(got), 1).collect()
    assert len(top) == len({r.a for r in got}) and all(r.similarity == max(g.similarity for g in got if g.a == r.a) for r in top)


def test_state_of_streams_equals_loops(spark):
    from conftest import DATA

    from tessera.plans.registry import queries
    from tessera.streaming.monitors import BREAKER

    events = [(r.at, r.user_id, r.event_type, r.d, r.h) for r in spark.read.parquet(f"{DATA}/events.parquet").selectExpr("cast(cast(ts as timestamp) as double) as at", "user_id", "event_type", "date_format(ts, 'yyyy-MM-dd') as d", "date_format(ts, 'yyyy-MM-dd HH') as h").orderBy("ts", "event_id").collect()]
    groups, buckets = {}, {}
    for at, user, kind, d, h in events:
        groups.setdefault(f"{user}/{d}", []).append((at, kind == "error"))
        buckets.setdefault(f"{kind}/{h}", []).append(at)
    opened = set()
    for key, calls in groups.items():
        since, kept = None, []
        for at, failed in sorted(calls):
            if since is not None and at - since >= BREAKER["reset_s"]:
                since, kept = None, []
            kept = [c for c in kept if at - c[0] < 86400] + [(at, failed)]
            if since is None and len(kept) >= 2 and sum(c[1] for c in kept) >= BREAKER["share"] * len(kept):
                since = at
                opened.add((key, round(at, 3), len(kept), sum(c[1] for c in kept)))
    got = {(r.key, round(r.opened_at, 3), r.calls, r.errors) for r in queries()["stateful_breaker"](spark, DATA).collect()}
    assert got == opened and opened
    passed = {}
    for key, times in buckets.items():
        tokens, last, n = 1.0, times[0], 0
        for at in times:
            tokens, last = min(1.0, tokens + (at - last) / 1800), at
            if tokens >= 1:
                tokens, n = tokens - 1, n + 1
        passed[key] = (len(times), n)
    assert {r.key: (r.n, r.n_passed) for r in queries()["stateful_buckets"](spark, DATA).collect()} == passed


def test_rollout_is_md5_modulo(spark):
    import hashlib

    urls = [f"https://a.org/{i}" for i in range(50)]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(search.rolled_out(F.col("u"), 30)).collect()] == [int(hashlib.md5(u.encode()).hexdigest(), 16) % 100 < 30 for u in urls]


def test_longest_run_of_failures_comes_with_the_bound(spark, duck):
    from conftest import DATA

    from tessera.plans.registry import oracle_sql, queries

    got = queries()["consecutive_failures"](spark, DATA)
    assert got.columns == ["source_id", "low", "longest"] == duck.execute(oracle_sql()["consecutive_failures"]).df().columns.tolist()
    assert {r.low for r in got.collect()} == {5}


def test_grams_bound_the_ratios_of_long_texts():
    rng, words = random.Random(4), "data officer in the field of health and water for a team that writes reports quickly über zéro x9 jazz".split()
    texts = [" ".join(rng.choices(words, k=60))[: rng.choice([120, 199, 200, 200, 230])] for _ in range(60)]
    texts += ["".join(rng.choices("etaoinshrd ", k=205)) + rng.choice("qxz") for _ in range(40)]
    texts += [t[:90] + texts[0][90:] for t in texts[1:8]] + ["a" * 200, "ab" * 100, "İ" * 200, ""]
    grams = similar.Grams(texts)
    every, spared = np.arange(len(texts)), 0
    for a in texts:
        bounds = grams.most(a, every)
        ratios = np.array([similar.ratio(a, b) for b in texts])
        assert (bounds >= ratios - 1e-9).all()
        spared += (bounds < 0.5).sum()
    assert spared > len(texts) ** 2 / 10


def test_best_fields_are_chosen_before_they_are_dealt(spark):
    from conftest import DATA

    from tessera.plans.registry import queries

    plan = queries()["page_best_fields"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    # Pages are read by a Python task once, and nothing is ranked by a window or joined.
    assert plan.count("MapInPandas") == 1 and "Window" not in plan and "Join" not in plan


def test_training_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        seen.add(1)
        return text

    texts = [None if k % 10 == 9 else f"every x{k} {'good' if k % 2 else 'poor'} {'b' if k % 4 < 2 else 'c'} d d" for k in range(40)]
    rows = spark.createDataFrame([(k, t, k % 2) for k, t in enumerate(texts)], "id long, text string, label int").repartition(3)
    model = ml.train(rows.withColumn("text", read("text")), "text", "label")
    assert seen.value == 40
    right = ml.scores(model.transform(rows.where("text is not null")), "label").first()
    assert (right.n, right.accuracy) == (36, 1.0)


def test_vocabulary_has_the_most_frequent_terms_and_ties_by_code_point(spark):
    kept = [["all", "z", "b", "a"], ["all", "z", "b", "a"], ["all", "z", "c"], ["all", "c", "once", "once", "once", "once"], ["all"], []]
    for parts in (1, 2, 5):
        rows = spark.createDataFrame([(k,) for k in kept], "kept array<string>").repartition(parts)
        assert ml.vocabulary(rows, "kept", 10, 2, 4.9) == ["z", "a", "b", "c"]
        assert ml.vocabulary(rows, "kept", 2, 2, 5.5) == ["all", "z"]
        assert ml.vocabulary(rows, "kept", 2, 2, 4.9) == ["z", "a"]


def test_training_equals_the_plain_pipeline(spark, duck):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, StopWordsRemover, VectorAssembler

    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").select("doc_id", "text", F.col("quality").cast("double").alias("label")).localCheckpoint()
    n = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    stages = [RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\W+"), StopWordsRemover(inputCol="words", outputCol="kept"), NGram(n=2, inputCol="kept", outputCol="pairs")]
    for c in ("kept", "pairs"):
        stages += [CountVectorizer(inputCol=c, outputCol=f"n_{c}", vocabSize=10**6, minDF=2, maxDF=0.95), IDF(inputCol=f"n_{c}", outputCol=f"w_{c}")]
    stages += [VectorAssembler(inputCols=["w_kept", "w_pairs"], outputCol="features"), LogisticRegression(weightCol="weight", regParam=0.01, maxIter=30)]
    weight = F.lit(sum(n.values())) / (2 * F.when(F.col("label") == 1, n[1]).otherwise(n[0]))
    plain, ours = Pipeline(stages=stages).fit(rows.withColumn("weight", weight)), ml.train(rows, "text", "label", 10**6)
    of = [{r[0]: r[1][1] for r in m.transform(rows).select("doc_id", "probability").collect()} for m in (plain, ours)]
    assert of[0].keys() == of[1].keys() and max(abs(of[0][k] - of[1][k]) for k in of[0]) < 1e-6


def test_classifier_takes_null_texts_as_empty(spark, tmp_path):
    from tessera.plans.registry import queries

    d = spark.range(60).select(F.col("id").alias("doc_id"), F.expr("if(id % 3 = 0, null, concat('word of ', if(id % 2 = 0, 'good', 'poor'), ' text'))").alias("text"))
    d.write.parquet(f"{tmp_path}/documents.parquet")
    d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    assert queries()["text_classifier"](spark, str(tmp_path)).first().n == ml.split(d.withColumn("quality", (F.col("doc_id") % 2).cast("int")), "doc_id", "quality")[1].count() > 0
