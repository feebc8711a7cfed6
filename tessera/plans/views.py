"""The driver's tables seen as the records the library works on, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The events end on 2024-01-30; every trailing window is taken from here.
AS_OF = "2024-01-31"
#: Orders are records, visible from this day on.
JOBS_AS_OF = "1998-01-01"

JOBS_SQL = """jobs as (
    select cast(o_orderkey as varchar) as id, cast(o_custkey as varchar) as source_id, c_mktsegment as org_name, p as title,
        case n_name when 'NATION_0' then 'KE' when 'NATION_1' then 'IN' when 'NATION_2' then 'FR' when 'NATION_3' then 'DE' when 'NATION_4' then 'CA' when 'NATION_5' then 'US' end as country_iso,
        case when p like '1%' then 'senior' when p like '2%' then 'mid' when p like '3%' then 'junior' end as level_norm,
        case when k % 3 = 0 then 'remote' when k % 3 = 1 then 'onsite' end as work_modality,
        case when k % 5 = 0 then null else k % 2 = 0 end as international_eligible,
        case when k % 4 = 0 then ['health', 'wash'] when k % 4 = 1 then ['wash'] when k % 4 = 2 then cast([] as varchar[]) end as mission_tags,
        case when o_orderstatus = 'F' then 'closed' else 'active' end as status,
        case when k % 7 = 0 then null else cast(o_orderdate as date) + 60 end as deadline,
        case when k % 11 = 0 then o_orderdate end as deleted_at,
        case when k % 13 = 0 then null else cast(o_orderdate as date) end as last_seen_at,
        cast(o_orderdate as date) as created_at,
        case when k % 10 = 0 then null when k % 10 = 1 then 'https://a.org/jobs/' || (k % 100) else 'https://a.org/p/' || (k % 1000) end as apply_url, o_totalprice as amount
    from (select *, o_orderkey as k, o_orderpriority as p from orders) o join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey
)"""

LOGS_SQL = """logs as (
    select event_id, user_id as source_id, ts as ran_at, case when event_type = 'error' then 'fail' else 'ok' end as status, event_type,
        cast(floor(value) as integer) as found, cast(floor(value / 4) as integer) as inserted, cast(floor(value / 8) as integer) as updated, value, props
    from events
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's segment and nation as records."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    # As text, since a column costs a call to the JVM for each of its parts.
    return o.selectExpr(
        "cast(o_orderkey as string) as id", "cast(o_custkey as string) as source_id", "c_mktsegment as org_name", "o_orderpriority as title",
        "case n_name when 'NATION_0' then 'KE' when 'NATION_1' then 'IN' when 'NATION_2' then 'FR' when 'NATION_3' then 'DE' when 'NATION_4' then 'CA' when 'NATION_5' then 'US' end as country_iso",
        "case when o_orderpriority like '1%' then 'senior' when o_orderpriority like '2%' then 'mid' when o_orderpriority like '3%' then 'junior' end as level_norm",
        "case o_orderkey % 3 when 0 then 'remote' when 1 then 'onsite' end as work_modality", "case when o_orderkey % 5 <> 0 then o_orderkey % 2 = 0 end as international_eligible",
        "case o_orderkey % 4 when 0 then array('health', 'wash') when 1 then array('wash') when 2 then cast(array() as array<string>) end as mission_tags",
        "case when o_orderstatus = 'F' then 'closed' else 'active' end as status", "case when o_orderkey % 7 <> 0 then date_add(to_date(o_orderdate), 60) end as deadline",
        "case when o_orderkey % 11 = 0 then o_orderdate end as deleted_at", "case when o_orderkey % 13 <> 0 then to_date(o_orderdate) end as last_seen_at", "to_date(o_orderdate) as created_at",
        "case o_orderkey % 10 when 0 then null when 1 then concat('https://a.org/jobs/', o_orderkey % 100) else concat('https://a.org/p/', o_orderkey % 1000) end as apply_url", "o_totalprice as amount",
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as run logs."""
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("source_id"), F.col("ts").alias("ran_at"), F.when(F.col("event_type") == "error", "fail").otherwise("ok").alias("status"), "event_type",
        F.floor(v).cast("int").alias("found"), F.floor(v / 4).cast("int").alias("inserted"), F.floor(v / 8).cast("int").alias("updated"), "value", "props",
    )
