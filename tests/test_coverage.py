"""Feeds in a column, duplicate urls, and counts over several windows, on small and odd tables."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.operators import admin, coverage
from tessera.sources import feeds

FEEDS = {
    1: "<rss><channel><item><title> One &amp; two </title><link>http://a/1</link><description>d</description></item><item><title>No link</title></item><item><link>http://a/2</link></item></channel></rss>",
    2: '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">Atom</title><link rel="self" href="http://self"/><link href="http://a/3"/><content>c</content><updated>2024-01-01</updated></entry><entry><title>By id</title><id>http://a/4</id></entry></feed>',
    3: '<rdf:RDF xmlns:rdf="r" xmlns:dc="d"><item><title>Rdf</title><link>http://a/5</link><dc:location>Rome</dc:location></item></rdf:RDF>',
    4: "<rss><channel><item><title>Cut off</title>", 5: None, 6: "", 7: "no xml at all", 8: '<rss><channel><item><title><![CDATA[A <b>bold</b> one]]></title><link>http://a/6</link><description>' + "x" * 2000 + "</description></item></channel></rss>",
}


def test_feeds(spark):
    df = spark.createDataFrame(list(FEEDS.items()), "id int, body string").withColumn("title0", F.lit(1))
    got = {(r.id, r.position): (r.title, r.apply_url, r.description_snippet, r.location_raw, r.posted) for r in feeds.feed_items(df, "body").collect()}
    assert got == {
        (1, 0): ("One & two", "http://a/1", "d", None, None), (2, 0): ("Atom", "http://a/3", "c", None, "2024-01-01"), (2, 1): ("By id", "http://a/4", None, None, None),
        (3, 0): ("Rdf", "http://a/5", None, "Rome", None), (8, 0): ("A <b>bold</b> one", "http://a/6", "x" * 500, None, None),
    }
    assert {4} <= {r.id for r in feeds.broken_feeds(df, "body").collect()} <= {4, 7}
    assert feeds.feed_items(df.where("false"), "body").count() == 0


def test_duplicate_urls(spark):
    rows = [("http://a/x/", "T1"), ("http://a/x?q=1", None), ("http://a/x#f", "T1"), (" http://a/x ", "L" * 300), ("http://b", "alone"), (None, "n"), ("", "e"), ("/", "s"), ("?q", "t")] + [("http://hot", "same")] * 500
    df = spark.createDataFrame(rows, "url string, title string")
    expected = {"http://a/x": (4, sorted(["T1", "T1", "Unknown", "L" * 100])), "http://hot": (500, ["same"] * 500)}
    assert {r.url: (r.n, r.titles) for r in admin.duplicate_urls(df, "url", "title").collect()} == expected
    assert {r.url: (r.n, r.titles) for r in admin.duplicate_urls(df, "url", "title", most=2).collect()} == {u: (n, t[:2]) for u, (n, t) in expected.items()}


def test_counts_over_windows_equal_a_loop(spark):
    rng, now = random.Random(4), datetime(2024, 3, 1)
    rows = [(rng.randrange(4) if i % 9 else None, now - timedelta(hours=rng.randrange(-5, 900)), rng.choice([None, "a", "b", "c"]), rng.randrange(10)) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, at timestamp, v string, x int").withColumn("last", F.lit(1)).withColumn("seen", F.lit(1))
    got = {r.key: r for r in coverage.windowed_counts(df, "k", "at", "2024-03-01", {"x": F.col("x")}, {"v": F.col("v")}).collect()}
    for key in range(4):
        for w, hours in coverage.WINDOWS.items():
            mine = [r for r in rows if r[0] == key and now - timedelta(hours=hours) <= r[1] <= now]
            assert (got[key][f"n_{w}"], got[key][f"x_{w}"], got[key][f"v_{w}"]) == (len(mine), sum(r[3] for r in mine), len({r[2] for r in mine} - {None}))
        assert got[key]["last"] == max(r[1] for r in rows if r[0] == key and r[1] <= now)
    sources = spark.createDataFrame([(1,), (77,)], "k int")
    out = {r.k: r for r in coverage.coverage(sources, {"a": coverage.windowed_counts(df, "k", "at", "2024-03-01", {}, {})}, "k").collect()}
    assert out[77].a_n_24h == 0 and out[77].a_last is None and out[1].a_n_30d == got[1].n_30d


def test_sketches_merge_within_their_error(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("k"), F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, cast(id % 29 as int))").alias("at"), F.concat(F.lit("v"), F.col("id") % 20_000).alias("v"))
    daily = coverage.daily_sketches(df, ["k"], "at", F.col("v"))
    exact = df.where("at < '2024-01-30' and at >= '2024-01-23'").groupBy("k").agg(F.count_distinct("v").alias("n"), F.count("*").alias("rows"))
    both = coverage.merged(daily, ["k"], "2024-01-30", {"7d": 7, "30d": 30}).where("window = '7d'").drop("n").join(exact, "k").collect()
    assert len(both) == 3 and all(abs(r.estimate - r.n) <= 0.04 * r.n for r in both)
    assert coverage.merged(daily, ["k"], "2023-01-01", {"7d": 7}).count() == 0
