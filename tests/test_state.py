"""Streams in event time against loops, snapshots that go on after a stop, and the history of records."""

from collections import deque
from datetime import datetime, timedelta, timezone

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tessera.operators import audit
from tessera.plans.history_queries import ADD, SNAPSHOT, summed
from tessera.plans.registry import queries
from tessera.streaming import monitors, ordered, snapshots


def calls_of(duck):
    """The calls of each service in order of time, without the minutes that the watermark has not passed."""
    rows = duck.execute("select user_id % 8, event_type = 'error', epoch_us(ts) from events").fetchall()
    calls, last = {}, 0
    for service, failed, us in rows:
        at = int((1.7e9 + (us / 1e6 - 1.7e9) / 500) * 1e6) / 1e6
        calls.setdefault(str(service), []).append((at, failed))
        last = max(last, at)
    mark = last - 30
    return {k: sorted(c for c in v if (c[0] // 60 + 1) * 60 <= mark) for k, v in calls.items()}


def plain_breaker(calls):
    out, kept, since = [], [], None
    for at, failed in calls:
        trial = False
        if since is not None:
            if at - since < 60:
                continue
            since, trial = None, True
            out.append((at, "half_open"))
        kept = [c for c in kept if at - c[0] <= 300] + [(at, failed)]
        bad = len(kept) >= 10 and sum(f for _, f in kept) >= 0.1 * len(kept)
        if trial and not failed:
            out.append((at, "closed"))
        elif bad:
            since = at
            out.append((at, "open"))
        elif trial:
            out.append((at, "closed"))
    return out


def test_breaker_equals_a_loop(spark, duck):
    got = {}
    for r in queries()["breaker_changes"](spark, DATA).collect():
        got.setdefault(r.key, []).append((round(r["at"], 3), r.state))
    expected = {k: [(round(at, 3), s) for at, s in plain_breaker(c)] for k, c in calls_of(duck).items()}
    order = {"half_open": 0, "open": 1, "closed": 1}
    assert {k: sorted(v, key=lambda x: (x[0], order[x[1]])) for k, v in got.items()} == {k: v for k, v in expected.items() if v}
    assert {s for v in got.values() for _, s in v} == {"open", "half_open", "closed"}


def test_buckets_equal_a_loop(spark, duck):
    expected = {}
    for k, calls in calls_of(duck).items():
        tokens, last, n = 3.0, calls[0][0], 0
        for at, _ in calls:
            tokens, last = min(3.0, tokens + (at - last) * 0.02), at
            if tokens >= 1:
                tokens, n = tokens - 1, n + 1
        expected[k] = (len(calls), n)
    got = {r.key: (r.n, r.n_passed) for r in queries()["bucket_passes"](spark, DATA).collect()}
    assert got == expected and any(n < m for m, n in got.values())


def test_breaker_steps_keep_the_window():
    calls = deque()
    out, since = ordered.breaker_steps(calls, None, [(i, i % 10 == 0) for i in range(9)], 300, 10, 0.1, 60)
    assert (out, since) == ([], None)
    out, since = ordered.breaker_steps(calls, since, [(9, False), (30, True), (69, True), (70, False), (400, False)], 300, 10, 0.1, 60)
    assert out == [(9, "open", 10, 1), (69, "half_open", 10, 1), (69, "open", 11, 2)] + [(400, "half_open", 11, 2), (400, "closed", 1, 0)] and since is None and list(calls) == [(400, False)]


def test_state_is_dropped_and_order_of_arrival_is_not(spark, tmp_path):
    zero = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [("a", zero + timedelta(seconds=5 * i), i % 3 == 0) for i in range(40)] + [("b", zero + timedelta(seconds=i), True) for i in range(9)]
    found = []
    for name, order in (("up", rows), ("down", rows[::-1])):
        folder = str(tmp_path / name)
        for i, part in enumerate([order[:20], order[20:], [("end", zero + timedelta(hours=3), False)], [("end", zero + timedelta(hours=6), False)]]):
            spark.createDataFrame(part, "k string, ts timestamp, failed boolean").coalesce(1).write.parquet(f"{folder}/{i}")
        before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        try:
            stream = spark.readStream.schema("k string, ts timestamp, failed boolean").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder).withWatermark("ts", "1 hour")
            query = ordered.timed_breaker(stream, "k", "ts", F.col("failed")).writeStream.format("parquet").option("path", f"{folder}-out").option("checkpointLocation", f"{folder}-mark").trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        found.append(sorted(tuple(r) for r in spark.read.parquet(f"{folder}-out").collect()))
        # What is left is the last event, which no later one has pushed past the watermark: its minute, and nothing of a or b.
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
    plain = plain_breaker([((ts - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds(), f) for k, ts, f in rows if k == "a"])
    assert found[0] == found[1] and [(r[1], r[2]) for r in found[0]] == sorted(plain) and plain


def test_snapshot_goes_on_after_a_stop(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("user_id", "event_type", "event_id", "ts")
    expected = sorted(tuple(r) for r in summed(events).collect())
    folder = str(tmp_path / "events")
    events.where("event_id % 3 = 0").repartition(2).write.parquet(folder)
    kept = snapshots.Snapshot(spark, str(tmp_path / "snapshot"), **SNAPSHOT)
    assert kept.read().count() == 0 and kept.versions() == []

    def go_on():
        # Nothing is shared with the run before but the folders.
        now = snapshots.Snapshot(spark, str(tmp_path / "snapshot"), **SNAPSHOT)
        snapshots.run(monitors.events(spark, folder, watermark=None, per_trigger=1), now, summed, ADD).awaitTermination()
        return now

    assert sorted(tuple(r) for r in go_on().read().collect()) == sorted(tuple(r) for r in summed(events.where("event_id % 3 = 0")).collect())
    # A batch that wrote its buckets and stopped before its list counts for nothing.
    spark.createDataFrame([(1, 10**6, 0, 0)], "user_id long, n long, n_failed long, last_event long").write.parquet(str(tmp_path / "snapshot" / "data" / "version=2" / "bucket=0"))
    spark.createDataFrame([(0, 2)], "bucket int, version long").write.parquet(str(tmp_path / "snapshot" / "versions" / "_temporary-2"))
    events.where("event_id % 3 = 1").coalesce(1).write.mode("append").parquet(folder)
    events.where("event_id % 3 = 2").coalesce(1).write.mode("append").parquet(folder)
    now = go_on()
    assert sorted(tuple(r) for r in now.read().collect()) == expected and now.versions() == [0, 1, 2, 3]
    # The same batch again changes nothing.
    assert now.apply(summed(events), 3, ADD) == []
    # A batch of one user rewrites one bucket; the others' files stay.
    one = events.where("user_id = 1").limit(1)
    places = now.places()
    touched = now.apply(summed(one), 4, ADD)
    assert len(touched) == 1 and {b: v for b, v in now.places().items() if b not in touched} == {b: v for b, v in places.items() if b not in touched}
    assert now.apply(summed(one.where("false")), 5, ADD) == [] and now.versions()[-1] == 5
    rows = sorted(tuple(r) for r in now.read().collect())
    assert now.vacuum(1) and now.versions() == [5] and sorted(tuple(r) for r in now.read().collect()) == rows


def test_audit_of_odd_records(spark):
    schema = "k string, a string, b long"
    before = spark.createDataFrame([("same", "x", 1), ("gone", "y", None), ("null", None, None), ("changed", "p", 2)], schema).withColumn("id", F.lit(1))
    after = spark.createDataFrame([("same", "x", 1), ("new", None, 3), ("null", None, None), ("changed", None, 5)], schema).withColumn("id", F.lit(1))
    got = audit.changes(before, after, "k", ["a", "b"], F.lit("2024-01-01").cast("timestamp"), F.lit("me"))
    assert sorted((r.id, r.field, r.old, r.new) for r in got.collect()) == [("changed", "a", "p", None), ("changed", "b", "2", "5"), ("gone", "a", "y", None), ("new", "b", None, "3")]
    assert audit.changes(before.where("false"), after.where("false"), "k", ["a"], F.lit(None).cast("timestamp"), F.lit("")).count() == 0


@pytest.mark.parametrize("when, expected", [("2024-01-01", {}), ("2024-01-02", {"r": "one"}), ("2024-01-03 12:00:00", {"r": "two"}), ("2024-01-09", {"r": None})])
def test_history_at_a_time(spark, tmp_path, when, expected):
    day = lambda d: datetime(2024, 1, d)
    rows = [("r", "f", None, "one", day(2), "x"), ("r", "f", "one", "zwo", day(3), "x")]
    audit.append(spark.createDataFrame(rows, audit.CHANGE), str(tmp_path / "log"), 0)
    audit.append(spark.createDataFrame(rows, audit.CHANGE), str(tmp_path / "log"), 0)
    audit.append(spark.createDataFrame([("r", "f", "one", "two", day(3), "y"), ("r", "f", "two", None, day(5), "y")], audit.CHANGE), str(tmp_path / "log"), 1)
    held = audit.intervals(audit.log(spark, str(tmp_path / "log")))
    assert held.count() == 3
    assert {r.id: r.f for r in audit.state_at(held, F.lit(when).cast("timestamp"), ["f"]).collect()} == expected
    looked = spark.createDataFrame([("r", when, 7), ("q", when, 8)], "k string, t string, f0 int").withColumn("t", F.col("t").cast("timestamp")).withColumn("id", F.lit("clash"))
    assert {(r.k, r.f) for r in audit.as_of_join(looked, held, "k", "t", "f").collect()} == {("r", expected.get("r")), ("q", None)}


def test_breaker_goes_on_over_batches_without_a_call_for_each_key(spark, tmp_path, monkeypatch):
    import random

    monkeypatch.setattr(monitors.StatefulProcessor, "__init__", lambda *_: pytest.fail("a state of its own for each key"))
    rng, folder, batches = random.Random(5), str(tmp_path / "in"), []
    for b in range(3):
        # A tenth comes a batch late.
        rows = [(f"k{rng.randrange(12)}", 1.7e9 + 200 * (b - (rng.random() < 0.1)) + rng.randrange(2000) / 10, rng.random() < 0.2) for _ in range(300)]
        batches.append(rows)
        spark.createDataFrame(rows, "k string, at double, failed boolean").selectExpr("k", "cast(at as timestamp) as ts", "failed").coalesce(1).write.mode("append").parquet(folder)
    stream = monitors.events(spark, folder, per_trigger=1)
    got = sorted((r.key, round(r.opened_at, 3), r.calls, r.errors) for r in monitors.run_breaker(stream, "k", "ts", F.col("failed"), window_s=60, least_calls=3, reset_s=20).collect())
    expected, state = [], {}
    for rows in batches:
        for k, at, failed in sorted(rows):
            since, calls = state.get(k, (None, []))
            if since is not None and at - since >= 20:
                since, calls = None, []
            calls = [c for c in calls if at - c[0] < 60] + [(at, failed)]
            if since is None and len(calls) >= 3 and sum(c[1] for c in calls) >= 0.1 * len(calls):
                since = at
                expected.append((k, round(at, 3), len(calls), sum(c[1] for c in calls)))
            state[k] = (since, calls)
    assert got == sorted(expected) and len(expected) > 30
