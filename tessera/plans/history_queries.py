"""Queries over durable snapshots and the history of records."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.operators import admin, audit, coverage
from tessera.plans.views import AS_OF, JOBS_SQL, jobs, table
from tessera.session import shared_dir
from tessera.sources import feeds
from tessera.streaming import monitors, snapshots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("n_failed"), F.max("event_id").alias("last_event"))


SNAPSHOT = {"keys": ("user_id",), "schema": "user_id long, n long, n_failed long, last_event long", "buckets": 8}
ADD = snapshots.adding(("user_id",), ["n", "n_failed"], ["last_event"])


@query("select user_id, count(*) as n, count(case when event_type = 'error' then 1 end) as n_failed, max(event_id) as last_event from events group by 1")
def durable_upserts(spark, sf_dir):
    """Counters per user in a versioned snapshot that three micro-batches of the events are merged into (T5, K1)."""
    folder = _folder(spark)
    table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts").repartitionByRange(6, "ts").write.parquet(f"{folder}/events")
    stream = monitors.events(spark, f"{folder}/events", watermark=None, per_trigger=2)
    kept = snapshots.Snapshot(spark, f"{folder}/snapshot", **SNAPSHOT)
    snapshots.run(stream, kept, summed, ADD).awaitTermination()
    return kept.read()


def _log(spark, sf_dir) -> DataFrame:
    """Every user's event type and value as fields that events change, appended in two batches."""
    e, folder = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), _folder(spark)
    cells = F.explode(F.array(F.struct(F.lit("event_type").alias("field"), F.col("event_type").alias("new")), F.struct(F.lit("value").alias("field"), F.round("value", 3).cast("string").alias("new"))))
    rows = e.select(F.col("user_id").cast("string").alias("id"), cells.alias("x"), F.col("ts").alias("at"), F.lit("stream").alias("by"), "event_id").select("id", "x.field", F.lit(None).cast("string").alias("old"), "x.new", "at", "by", "event_id")
    for batch in (0, 1):
        audit.append(rows.where(F.col("event_id") % 2 == batch).drop("event_id"), folder, batch)
    return audit.log(spark, folder)


DATES = ["2024-01-05", "2024-01-15", "2024-01-28 12:30:00"]


@query("select d as as_of, cast(user_id as varchar) as id, arg_max(event_type, (ts, event_id % 2, event_type)) as event_type, count(*) as n_before from events, (values " + ", ".join(f"('{d}')" for d in DATES) + ") t(d) where ts <= cast(d as timestamp) group by 1, 2")
def state_at_dates(spark, sf_dir):
    """The last event type of every user at three times, from the time each value held, and how many changes came before."""
    rows = _log(spark, sf_dir)
    held = audit.intervals(rows)
    out = None
    for d in DATES:
        when = F.lit(d).cast("timestamp")
        n = rows.where((F.col("field") == "event_type") & (F.col("at") <= when)).groupBy(F.col("id").alias("n_id")).agg(F.count("*").alias("n_before"))
        now = audit.state_at(held, when, ["event_type"]).join(n, F.col("id") == F.col("n_id")).select(F.lit(d).alias("as_of"), "id", "event_type", "n_before")
        out = now if out is None else out.unionByName(now)
    return out


@query("""with looked as (select event_id, user_id, ts + interval '1 hour' as at from events where event_type = 'purchase'), c as (select user_id, ts, arg_max(event_type, (event_id % 2, event_type)) as event_type from events group by 1, 2)
    select l.event_id, l.user_id, c.event_type as event_type from looked l asof left join c on l.user_id = c.user_id and l.at >= c.ts""")
def as_of_events(spark, sf_dir):
    """What every user's last event was an hour after each of their purchases."""
    held = audit.intervals(_log(spark, sf_dir))
    looked = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", "user_id", (F.col("ts").cast("timestamp") + F.expr("interval 1 hour")).alias("at"))
    return audit.as_of_join(looked, held, "user_id", "at", "event_type").select("event_id", "user_id", "event_type")


@query("""with a as (select event_id as id, event_type, cast(cast(floor(value) as bigint) as varchar) as level from events where event_id % 5 <> 0), b as (select event_id as id, case when event_id % 3 = 0 then upper(event_type) else event_type end as event_type, case when event_id % 4 > 0 then cast(cast(floor(value) as bigint) as varchar) end as level from events where event_id % 7 <> 0),
    x as (select coalesce(a.id, b.id) as id, a.event_type as t, b.event_type as u, a.level as l, b.level as m from a full join b on a.id = b.id)
    select cast(id as varchar) as id, 'event_type' as field, t as old, u as new from x where t is distinct from u union all select cast(id as varchar), 'level', l, m from x where l is distinct from m""")
def audit_changes(spark, sf_dir):
    """The fields that differ between two states of the events as records, new and lost records too."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type", F.floor("value").cast("string").alias("level"))
    before = e.where("id % 5 <> 0")
    after = e.where("id % 7 <> 0").withColumn("event_type", F.when(F.col("id") % 3 == 0, F.upper("event_type")).otherwise(F.col("event_type"))).withColumn("level", F.when(F.col("id") % 4 > 0, F.col("level")))
    return audit.changes(before, after, "id", ["event_type", "level"], F.lit("2024-02-01").cast("timestamp"), F.lit("drill")).select("id", "field", "old", "new")


# Coverage over several windows.

_W = {"24h": "24 hours", "7d": "168 hours", "30d": "720 hours"}


def _counts(name: str, source: str, sums: str = "") -> str:
    cols = ", ".join(f"count(case when ts >= timestamp '{AS_OF}' - interval '{h}' then 1 end) as n_{w}, count(distinct case when ts >= timestamp '{AS_OF}' - interval '{h}' then v end) as ids_{w}" + (f", coalesce(sum(case when ts >= timestamp '{AS_OF}' - interval '{h}' then x end), 0) as found_{w}" if sums else "") for w, h in _W.items())
    return f"{name} as (select user_id, {cols}, max(ts) as last from ({source}) where ts <= timestamp '{AS_OF}' and ts >= timestamp '{AS_OF}' - interval '720 hours' group by user_id)"


@query("with " + ", ".join([
    _counts("l", "select user_id, ts, event_id % 50 as v, cast(floor(value) as bigint) as x from events", "x"), _counts("j", "select user_id, ts, event_id % 200 as v, 0 as x from events where event_type = 'purchase'"), _counts("f", "select user_id, ts, event_id as v, 0 as x from events where event_type = 'error' and event_id % 3 <> 0"),
]) + " select c_custkey, " + ", ".join(f"coalesce(l.n_{w}, 0) as logs_{w}, coalesce(l.ids_{w}, 0) as urls_{w}, cast(coalesce(l.found_{w}, 0) as bigint) as found_{w}, coalesce(j.ids_{w}, 0) as jobs_{w}, coalesce(f.n_{w}, 0) as failures_{w}" for w in _W) + ", strftime(l.last, '%Y-%m-%d %H:%M:%S') as last from customer left join l on l.user_id = c_custkey left join j on j.user_id = c_custkey left join f on f.user_id = c_custkey")
def coverage_windows(spark, sf_dir):
    """Logs, distinct urls, jobs and failures of each source in the last day, week and month: three kinds of children, each counted before the join."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    children = {
        "l": coverage.windowed_counts(e, "user_id", "ts", AS_OF, {"found": F.floor("value")}, {"urls": F.col("event_id") % 50}),
        "j": coverage.windowed_counts(e.where("event_type = 'purchase'"), "user_id", "ts", AS_OF, {}, {"ids": F.col("event_id") % 200}),
        "f": coverage.windowed_counts(e.where("event_type = 'error' and event_id % 3 <> 0"), "user_id", "ts", AS_OF, {}, {}),
    }
    out = coverage.coverage(table(spark, sf_dir, "customer").select("c_custkey"), children, "c_custkey")
    cols = [c for w in _W for c in (F.col(f"l_n_{w}").alias(f"logs_{w}"), F.col(f"l_urls_{w}").alias(f"urls_{w}"), F.col(f"l_found_{w}").cast("long").alias(f"found_{w}"), F.col(f"j_ids_{w}").alias(f"jobs_{w}"), F.col(f"f_n_{w}").alias(f"failures_{w}"))]
    return out.select("c_custkey", *cols, F.date_format("l_last", "yyyy-MM-dd HH:mm:ss").alias("last"))


@query("""with w as (select * from (values ('1d', 1), ('7d', 7), ('30d', 30)) t(period, days)), x as (select event_type, period, count(*) as n, count(distinct user_id) as users, count(distinct event_id) as ids from events, w where cast(ts as date) < date '""" + AS_OF + """' and cast(ts as date) >= date '""" + AS_OF + """' - days::integer group by 1, 2)
    select event_type, period, n, users, true as users_near, ids, true as ids_near from x""")
def distinct_sketches(spark, sf_dir):
    """Distinct users and events by type over three windows, exact, and whether estimates merged from daily sketches are within 5 %."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    days = {"1d": 1, "7d": 7, "30d": 30}
    inside = F.array_compact(F.array(*[F.when((F.to_date("ts") < F.lit(AS_OF).cast("date")) & (F.to_date("ts") >= F.date_sub(F.lit(AS_OF).cast("date"), d)), F.lit(w)) for w, d in days.items()]))
    out = e.withColumn("period", F.explode(inside)).groupBy("event_type", "period").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_distinct("event_id").alias("ids"))
    for name, value in (("users", "user_id"), ("ids", "event_id")):
        sketch = coverage.merged(coverage.daily_sketches(e, ["event_type"], "ts", F.col(value)), ["event_type"], AS_OF, days)
        out = out.join(sketch.select("event_type", F.col("window").alias("period"), "estimate"), ["event_type", "period"]).withColumn(f"{name}_near", F.abs(F.col("estimate") - F.col(name)) <= 0.05 * F.col(name)).drop("estimate")
    return out


# Feeds in a column, made of the documents: RSS, RSS without a channel, Atom, and one that is cut off.

_XML = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_LINE = "trim(regexp_replace(split_part(coalesce(text, ''), chr(10), 1), '[\\x00-\\x1F]', '', 'g'))"


@query(f"""with d as (select doc_id, source, {_LINE} as t, trim(regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x0D]', '', 'g')) as body from documents where doc_id % 4 < 3)
    select doc_id, 0 as position, t as title, 'http://h/' || doc_id as apply_url, case when doc_id % 4 < 2 then substr(body, 1, 500) else source end as description_snippet from d where t <> ''
    union all select doc_id, 1, 'Second of ' || source, 'http://h/b', null from d where doc_id % 4 = 0""")
def feed_records(spark, sf_dir):
    """The items of feeds that stand in a column, one feed for each document, a quarter of them cut off."""

    def escaped(c):
        return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    d = table(spark, sf_dir, "documents")
    k, link = F.col("doc_id") % 4, F.concat(F.lit("http://h/"), F.col("doc_id").cast("string"))
    line = escaped(F.regexp_replace(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), r"[\x00-\x1F]", ""))
    body = escaped(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x0D]", "")))
    item = F.concat(F.lit("<item><title> "), line, F.lit("</title><link>"), link, F.lit("</link><description>"), body, F.lit("</description></item>"))
    second = F.concat(F.lit("<item><title>Second of "), F.col("source"), F.lit("</title><guid>http://h/b</guid></item><item><title></title><link>x</link></item>"))
    rss = F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>Feed</title>'), item, second, F.lit("</channel></rss>"))
    rdf = F.concat(F.lit('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/"><channel><title>Feed</title></channel>'), item, F.lit("</rdf:RDF>"))
    atom = F.concat(F.lit('<a:feed xmlns:a="http://www.w3.org/2005/Atom"><a:entry><a:title type="text">'), line, F.lit('</a:title><a:link rel="self" href="http://no"/><a:link href="'), link, F.lit('"/><a:summary>'), F.col("source"), F.lit("</a:summary></a:entry></a:feed>"))
    xml = F.when(k == 0, rss).when(k == 1, rdf).when(k == 2, atom).otherwise(F.concat(F.lit("<rss><channel>"), item))
    return feeds.feed_items(d.select("doc_id", xml.alias("xml")), "xml").select("doc_id", "position", "title", "apply_url", "description_snippet")


@query("""with p as (select split_part(split_part(rtrim(trim(url), '/'), '#', 1), '?', 1) as url, substr(coalesce(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), 'Unknown'), 1, 100) as title from pages where url is not null)
    select url, count(*) as n, list_sort(list(title)) as titles from p where url <> '' group by url having count(*) > 1""")
def duplicate_page_urls(spark, sf_dir):
    """Addresses that several crawled pages have, without query and fragment, and the pages' titles."""
    p = table(spark, sf_dir, "pages").select("url", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))
    return admin.duplicate_urls(p, "url", "title")


@query("""with stored as (select distinct 'level' as type, lower(event_type) as raw_value, 'own' as canonical_key from events union select distinct 'level', lower(c_mktsegment), 'own' from customer union select distinct 'level', case when c_custkey % 2 = 0 then 'sr' else 'entry' end, 'own' from customer)
    select raw_value, canonical_key from stored""")
def synonyms_in_use(spark, sf_dir):
    """Synonyms stored in tables, gaps filled by the built-in ones: what the stored ones give (S3)."""
    e, c = table(spark, sf_dir, "events"), table(spark, sf_dir, "customer")
    stored = e.select(F.upper("event_type").alias("raw_value")).union(c.select("c_mktsegment")).union(c.select(F.when(F.col("c_custkey") % 2 == 0, "SR").otherwise("Entry"))).distinct()
    own = feeds.synonyms(stored.select(F.lit("level").alias("type"), "raw_value", F.lit("own").alias("canonical_key")))
    # Built-in ones fill the gaps; those that a table overrides are gone.
    return own.where("type = 'level' and canonical_key = 'own'").select("raw_value", "canonical_key")


@query("""with e as (select user_id, ts, event_id, event_type, sum(case when event_type <> 'error' then 1 else 0 end) over (partition by user_id order by ts, event_id) as g from events),
    r as (select user_id, g, count(*) as run from e where event_type = 'error' group by 1, 2) select user_id as source_id, max(run) as longest, count(*) as n_runs, count(case when run >= 2 then 1 end) as n_alarms from r group by 1""")
def failure_runs(spark, sf_dir):
    """Runs of failures of each source: the longest, how many, and how many reach two."""
    from pyspark.sql import Window

    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("g", F.sum((F.col("event_type") != "error").cast("int")).over(by)).where("event_type = 'error'")
    runs = e.groupBy(F.col("user_id").alias("source_id"), "g").agg(F.count("*").alias("run"))
    return runs.groupBy("source_id").agg(F.max("run").alias("longest"), F.count("*").alias("n_runs"), F.count_if(F.col("run") >= 2).alias("n_alarms"))


@query("select page_id, md5(html || chr(10)) as digest from pages where html is not null")
def stored_page_files(spark, sf_dir):
    """Pages kept as files of their own and read back whole by path."""
    folder = _folder(spark)
    feeds.store_pages(table(spark, sf_dir, "pages").where("html is not null").select("page_id", "html"), f"{folder}/html")
    back = feeds.stored_pages(spark, f"{folder}/html")
    return back.select(F.regexp_extract("path", "page_id=(-?[0-9]+)[./]", 1).cast("long").alias("page_id"), F.md5("html").alias("digest"))


@query(f"with {JOBS_SQL}, known as (select * from (values " + ", ".join(f"('{k}', '{v}')" for k, v in C.COUNTRIES.items()) + ") t(code, name)), levels as (select unnest([" + ", ".join(f"'{x}'" for x in C.LEVELS) + "]) as key)\n"
       "select coalesce(name, '(unknown)') as country, level_norm, count(*) as n, level_norm in (select key from levels) as known_level from jobs left join known on code = country_iso group by all")  # fmt: skip
def lookup_countries(spark, sf_dir):
    """Records by the name that the lookup table has for their country, and whether their level is in its table."""
    tables = feeds.lookups(spark)
    j = jobs(spark, sf_dir).join(tables["countries"], F.col("country_iso") == F.col("code"), "left")
    j = j.join(tables["levels"], F.col("level_norm") == F.col("key"), "left")
    known = F.when(F.col("level_norm").isNotNull(), F.col("key").isNotNull())
    return j.groupBy(F.coalesce("name", F.lit("(unknown)")).alias("country"), "level_norm", known.alias("known_level")).agg(F.count("*").alias("n"))


@query("""with old as (select c_custkey as k, c_name as title, case when c_custkey % 11 = 0 then '2024-01-01' end as deleted_at from customer where c_custkey % 3 <> 0),
    new as (select c_custkey as k, case when c_custkey % 7 = 0 then null when c_custkey % 2 = 0 then c_name else c_name || '!' end as title from customer where c_custkey % 4 <> 1)
    select coalesce(old.k, new.k) as k, coalesce(new.title, old.title) as title, deleted_at, case when new.k is null then 'kept' when old.k is null then 'inserted' when coalesce(new.title, old.title) is distinct from old.title then 'updated' else 'skipped' end as outcome from old full join new on old.k = new.k""")
def feed_upserts(spark, sf_dir):
    """What a feed's items leave of the stored records: no value is lost to a null, and what was deleted stays so (K2)."""
    from tessera.operators import state

    k, name = F.col("c_custkey"), F.col("c_name")
    c = table(spark, sf_dir, "customer")
    old = c.where(k % 3 != 0).select(k.alias("k"), name.alias("title"), F.when(k % 11 == 0, "2024-01-01").alias("deleted_at"))
    new = c.where(k % 4 != 1).select(k.alias("k"), F.when(k % 7 == 0, None).when(k % 2 == 0, name).otherwise(F.concat(name, F.lit("!"))).alias("title"))
    return state.upsert(old, new, ["k"], revive=False)
