"""Queries over records and logs: search, facets, joins, reports, state."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import repair, normalize
from tessera.functions.cells import share
from tessera.operators import reports, search, state
from tessera.plans.views import AS_OF, JOBS_AS_OF, JOBS_SQL, LOGS_SQL, jobs, logs, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DAY = date.fromisoformat(JOBS_AS_OF)
VISIBLE = f"status = 'active' and deleted_at is null and (deadline is null or deadline >= date '{JOBS_AS_OF}')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def on_jobs(rest: str) -> str:
    return f"with {JOBS_SQL} {rest}"


def on_logs(rest: str) -> str:
    return f"with {LOGS_SQL} {rest}"


PAGE_SQL = on_jobs(f"""select id, title, org_name, country_iso, level_norm, cast(deadline as varchar) as deadline, coalesce(array_to_string(mission_tags, ','), '') as tags, amount from jobs
    where {VISIBLE} and (contains(lower(title), 'e') or contains(lower(org_name), 'e')) and work_modality = 'remote' and level_norm = 'senior' and list_has_any(mission_tags, ['wash', 'health'])
    order by last_seen_at desc nulls first, created_at desc nulls first, id limit 20 offset """)


def _page(spark, sf_dir, page: int) -> DataFrame:
    request = search.SearchRequest(filters={"level_norm": "Sr.", "work_modality": "WFH", "mission_tags": ["Water", "health"], "donor_context": ["nobody"]}, page=page)
    found = search.visible(jobs(spark, sf_dir), DAY).where(search.text_match("E", ["title", "org_name"]))
    for p in search.predicates(search.canonical_filters(request.filters)):
        found = found.where(p)
    rows = search.paged(found, search.order_columns(request.sort), request.page, request.size)
    return rows.select("id", "title", "org_name", "country_iso", "level_norm", F.col("deadline").cast("string").alias("deadline"), F.coalesce(F.array_join("mission_tags", ","), F.lit("")).alias("tags"), "amount")


@query(PAGE_SQL + "20")
def search_filtered_page(spark, sf_dir):
    """The second page of a filtered search: text, scalar, flag and array filters, newest first."""
    return _page(spark, sf_dir, 2)


@query(PAGE_SQL + "0")
def search_first_page(spark, sf_dir):
    """Its first page."""
    return _page(spark, sf_dir, 1)


@query(on_jobs(f"select id, cast(deadline as varchar) as deadline from jobs where {VISIBLE} order by deadline asc nulls last, id limit 50"))
def search_closing_soon(spark, sf_dir):
    found = search.visible(jobs(spark, sf_dir), DAY)
    return search.paged(found, search.order_columns("closing_soon"), 1, 50).select("id", F.col("deadline").cast("string").alias("deadline"))


@query(on_jobs(f"select count(*) as total from jobs where {VISIBLE} and international_eligible = false"))
def search_count(spark, sf_dir):
    found = search.visible(jobs(spark, sf_dir), DAY)
    return found.where(search.predicates(search.canonical_filters({"international_eligible": "no"}))[0]).agg(F.count("*").alias("total"))


@query(on_jobs(f"select country_iso as value, count(*) as n from jobs where {VISIBLE} and country_iso is not null group by 1 order by n desc, value limit 50"))
def facet_topk(spark, sf_dir):
    return search.facet(search.visible(jobs(spark, sf_dir), DAY), "country_iso")


@query(on_jobs(f"select lower(cast(international_eligible as varchar)) as value, count(*) as n from jobs where {VISIBLE} and international_eligible is not null group by 1"))
def facet_bool(spark, sf_dir):
    return search.facet(search.visible(jobs(spark, sf_dir), DAY), "international_eligible", None)


@query("select w as value, count(*) as n from (select unnest(string_split(lower(text), ' ')) as w from documents) where w is not null group by w order by n desc, value limit 10")
def facet_array_explode(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.split(F.lower("text"), " ").alias("words"))
    return search.array_facet(words, "words")


FACETS = {"country_iso": 3, "level_norm": 2, "work_modality": 2, "org_name": 5}


@query(on_jobs(f""", pairs as ({" union all ".join(f"select '{k}' as facet, {k} as value, {n} as top from jobs where {VISIBLE}" for k, n in FACETS.items())}),
    counts as (select facet, value, top, count(*) as n from pairs where value is not null group by all)
    select facet, value, n from counts qualify row_number() over (partition by facet order by n desc, value) <= top"""))
def facet_all_onepass(spark, sf_dir):
    """Several facets in one pass over the records."""
    return search.facets(search.visible(jobs(spark, sf_dir), DAY), FACETS)


@query("select doc_id from documents where list_has_any(string_split(lower(text), ' '), ['license,', 'stupid', 'worthless'])")
def array_overlap_filter(spark, sf_dir):
    words = F.split(F.lower("text"), " ")
    return table(spark, sf_dir, "documents").where(F.arrays_overlap(words, F.array(*[F.lit(w) for w in ("license,", "stupid", "worthless")]))).select("doc_id")


@query(on_jobs(f"""select id, array_to_string(list_filter([case when list_has_any(mission_tags, ['wash']) then 'Mission: wash' end, case when level_norm = 'senior' then 'Level: senior' end,
    case when international_eligible then 'International eligible' end, case when contains(lower(org_name), 'furn') then 'Organization: ' || org_name end], lambda x: x is not null)[:3], '; ') as reasons from jobs where {VISIBLE}"""))
def reasons_slice(spark, sf_dir):
    request = search.SearchRequest(q="furn", filters={"mission_tags": ["sanitation"], "level_norm": "manager", "international_eligible": "true"})
    return search.visible(jobs(spark, sf_dir), DAY).select("id", F.array_join(search.reasons(request), "; ").alias("reasons"))


@query(on_jobs(f"select c_custkey as source_id, count(j.id) as n from customer left join (select * from jobs where {VISIBLE} and amount > 400000) j on cast(c_custkey as varchar) = j.source_id group by 1"))
def source_breakdown_zero(spark, sf_dir):
    """Sources with their number of filtered records, zeros kept."""
    found = search.visible(jobs(spark, sf_dir), DAY).where("amount > 400000").withColumn("source_id", F.col("source_id").cast("long"))
    return reports.with_zero(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id")), found, "source_id", "source_id")


@query(on_logs("select event_id, source_id, c_name, l.status, found from logs l join customer on c_custkey = source_id order by ran_at desc, event_id limit 100"))
def logs_join_sources(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    joined = logs(spark, sf_dir).join(c, F.col("source_id") == F.col("c_custkey"))
    return joined.orderBy(F.desc("ran_at"), "event_id").limit(100).select("event_id", "source_id", "c_name", "status", "found")


@query("select o_orderkey, o_custkey, c_name as source_name, c_mktsegment as source_segment from orders left join customer on c_custkey = o_custkey and c_acctbal > 0")
def nested_source_struct(spark, sf_dir):
    """Records with their source nested, null where it is missing, flattened for comparison."""
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", F.struct("c_name", "c_mktsegment").alias("source"))
    joined = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("o_orderkey", "o_custkey", F.col("source.c_name").alias("source_name"), F.col("source.c_mktsegment").alias("source_segment"))


@query("select doc_id from documents where doc_id in (select doc_id from labels)")
def semi_verify(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def anti_orphans(spark, sf_dir):
    return state.orphans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("select event_type as value, count(*) as n from events where event_type not in ('click', 'view') group by 1 order by n desc, value limit 10")
def not_in_unknown_tags(spark, sf_dir):
    known = spark.createDataFrame([("click",), ("view",)], "key string")
    return reports.unknown_tags(table(spark, sf_dir, "events").select(F.array("event_type").alias("tags")), "tags", known, "key")


@query("""select count(case when len(list_filter(w, lambda x: x in ('health', 'stupid', 'clown', 'trash'))) > 0 then 1 end) as n_known, count(case when len(list_filter(w, lambda x: x not in ('health', 'stupid', 'clown', 'trash'))) > 0 then 1 end) as n_unknown
    from (select string_split(lower(text), ' ') as w from documents)""")
def exists_over_array(spark, sf_dir):
    valid = ["health", "stupid", "clown", "trash"]
    w = table(spark, sf_dir, "documents").select(F.split(F.lower("text"), " ").alias("w"))
    return w.agg(F.count_if(F.exists("w", lambda x: x.isin(valid))).alias("n_known"), F.count_if(F.exists("w", lambda x: ~x.isin(valid))).alias("n_unknown"))


@query("""select (select count(*) from orders where o_orderstatus = 'P') as jobs, (select count(*) from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'P')) as shortlists,
    case when (select count(*) from orders where o_orderstatus = 'P') > 1000 or (select count(*) from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'P')) > 100 then 'high' when (select count(*) from orders where o_orderstatus = 'P') > 100 then 'medium' else 'low' end as risk""")
def scalar_subqueries(spark, sf_dir):
    """What a deletion would hit, and its risk."""
    hit = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return reports.deletion_impact(hit, {"shortlists": (table(spark, sf_dir, "lineitem"), "l_orderkey")}, "o_orderkey")


@query("""select c_custkey, coalesce(n_orders, 0) as n_orders, coalesce(total, 0) as total, coalesce(n_events, 0) as n_events from customer
    left join (select o_custkey, count(*) as n_orders, round(sum(o_totalprice), 2) as total from orders group by 1) o on o_custkey = c_custkey
    left join (select user_id, count(*) as n_events from events group by 1) e on user_id = c_custkey""")
def fanout_safe_coverage(spark, sf_dir):
    """Sources with aggregates of two tables, each aggregated before it is joined."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n_events"))
    return reports.coverage(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", [o, e])


LISTING = " or ".join(f"contains(apply_url, '{p}')" for p in ["/jobs", "/careers", "/vacancies", "/opportunities", "/list", "/search", "/all", "/index"])
REPORT = f"""count(*) as total_jobs, count(distinct apply_url) as unique_urls, count(case when apply_url is null then 1 end) as null_urls, count(case when {LISTING} then 1 end) as listing_urls,
    count(case when title is null or title = '' then 1 end) as missing_titles, count(case when length(title) < 6 then 1 end) as short_titles"""


@query(on_jobs(f""", r as (select org_name, {REPORT.replace('< 6', '< 5')} from jobs where deleted_at is null group by 1)
    select *, total_jobs - null_urls - unique_urls as duplicate_urls,
    round(greatest(0, least(100, 100 - (null_urls / total_jobs * 30 + listing_urls / total_jobs * 25 + missing_titles / total_jobs * 20 + short_titles / total_jobs * 10 + (total_jobs - null_urls - unique_urls) / total_jobs * 15))), 6) as quality_score from r"""))
def quality_report_conditional(spark, sf_dir):
    """Url and title faults per source, with the weighted score."""
    out = reports.url_report(jobs(spark, sf_dir).where("deleted_at is null"), "org_name")
    return out.withColumn("quality_score", F.round("quality_score", 6))


@query(on_jobs("""select apply_url as url, count(*) as n, array_to_string((list(id order by created_at desc nulls last, id desc))[:3], ',') as titles from jobs where apply_url is not null group by 1 having count(*) > 1 order by n desc, url limit 10"""))
def dup_groups_array_agg(spark, sf_dir):
    return reports.duplicate_groups(jobs(spark, sf_dir), F.col("apply_url"), "id", "created_at").withColumn("titles", F.array_join("titles", ","))


@query(on_jobs("""select org_name, count(*) as n from (select org_name from jobs where apply_url is null union all select org_name from jobs where contains(apply_url, '/jobs') or contains(apply_url, '/careers')) group by 1 order by n desc, org_name limit 10"""))
def union_all_issues(spark, sf_dir):
    from tessera.functions.constants import LISTING_ISSUES
    from tessera.functions.quality import is_listing

    j = jobs(spark, sf_dir)
    return reports.issue_counts([j.where("apply_url is null"), j.where(is_listing(F.col("apply_url"), LISTING_ISSUES))], "org_name")


@query(on_logs(f""", w as (select '7d' as period, * from logs where ran_at >= timestamp '{AS_OF}' - interval 7 day and ran_at < timestamp '{AS_OF}' union all select '30d' as period, * from logs where ran_at >= timestamp '{AS_OF}' - interval 30 day and ran_at < timestamp '{AS_OF}')
    select period, count(*) as n, count(case when status = 'ok' then 1 end) as n_ok, count(case when status = 'fail' then 1 end) as n_failed, round(avg(value), 6) as mean, round(sum(value), 4) as total from w group by 1"""))
def crawl_overview(spark, sf_dir):
    out = reports.run_overview(logs(spark, sf_dir), "ran_at", "status", "value", AS_OF, {"7d": "7 days", "30d": "30 days"}, "ok", "fail")
    return out.withColumns({"mean": F.round("mean", 6), "total": F.round("total", 4)})


@query(on_logs("select cast(cast(ran_at as date) as varchar) as day, count(*) as n, count(case when status = 'ok' then 1 end) as n_good, round(100.0 * count(case when status = 'ok' then 1 end) / count(*), 6) as rate from logs group by 1"))
def daily_trend(spark, sf_dir):
    out = reports.daily(logs(spark, sf_dir), "ran_at", F.col("status") == "ok")
    return out.withColumns({"day": F.col("day").cast("string"), "rate": F.round("rate", 6)})


@query(on_logs("select source_id, cast(sum(inserted + updated) as bigint) as changes, count(*) as n, round(100.0 * count(case when status = 'ok' then 1 end) / count(*), 6) as rate from logs group by 1 order by changes desc, source_id limit 10"))
def top_sources_success(spark, sf_dir):
    out = logs(spark, sf_dir).groupBy("source_id").agg(F.sum(F.col("inserted") + F.col("updated")).alias("changes"), F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("ok"))
    return out.withColumn("rate", F.round(share(F.col("ok") * 100, F.col("n")), 6)).drop("ok").orderBy(F.desc("changes"), "source_id").limit(10)


@query("select case when value >= 90 then 'very high' when value >= 70 then 'high' when value >= 50 then 'medium' when value is not null then 'low' else 'none' end as bucket, count(*) as n from events group by 1")
def histogram_case(spark, sf_dir):
    v = F.col("value")
    bucket = F.when(v >= 90, "very high").when(v >= 70, "high").when(v >= 50, "medium").when(v.isNotNull(), "low").otherwise("none")
    return table(spark, sf_dir, "events").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("select event_type, count(*) as n, round(100.0 * count(*) / (select count(*) from events), 6) as percent from events group by 1")
def percent_of_total(spark, sf_dir):
    return reports.distribution(table(spark, sf_dir, "events"), "event_type").withColumn("percent", F.round("percent", 6))


@query("select event_type, cast(sum(try_cast(json_extract_string(props, '$.k') as integer)) as bigint) as total, count(try_cast(json_extract_string(props, '$.k') as integer)) as n from events group by 1")
def json_extract_sum(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count(k).alias("n"))


@query(on_logs(", x as (select * from logs qualify row_number() over (partition by source_id order by ran_at desc, event_id) <= 10) select source_id, count(*) as n, round(100.0 * count(case when status = 'ok' then 1 end) / count(*), 6) as rate from x group by 1"))
def last_n_then_agg(spark, sf_dir):
    """Success rate of the last ten runs of every source at once."""
    last = reports.last_n(logs(spark, sf_dir), "source_id", [F.desc("ran_at"), F.asc("event_id")], 10)
    return last.groupBy("source_id").agg(F.count("*").alias("n"), F.round(share(F.count_if(F.col("status") == "ok") * 100, F.count("*")), 6).alias("rate"))


@query(on_logs("select source_id, arg_max(event_id, (ran_at, event_id)) as event_id, arg_max(status, (ran_at, event_id)) as status from logs group by 1"))
def latest_per_key(spark, sf_dir):
    row = F.struct("ran_at", "event_id", "status")
    out = logs(spark, sf_dir).groupBy("source_id").agg(F.max(row).alias("r"))
    return out.select("source_id", "r.event_id", "r.status")


@query("select doc_id from documents qualify row_number() over (partition by md5(lower(trim(text))) order by doc_id) = 1")
def first_seen_dedupe(spark, sf_dir):
    """First document of each text."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.md5(F.lower(F.trim("text"))).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


UPSERT = """with old as (select c_custkey, c_name, c_acctbal, c_mktsegment from customer where c_custkey % 3 <> 0),
    new as (select c_custkey, case when c_custkey % 2 = 0 then c_name else c_name || '!' end as c_name, case when c_custkey % 5 = 0 then null else c_acctbal end as c_acctbal, c_mktsegment from customer where c_custkey % 4 <> 1),
    j as (select coalesce(o.c_custkey, n.c_custkey) as c_custkey, coalesce(n.c_name, o.c_name) as c_name, coalesce(n.c_acctbal, o.c_acctbal) as c_acctbal, coalesce(n.c_mktsegment, o.c_mktsegment) as c_mktsegment,
        case when n.c_custkey is null then 'kept' when o.c_custkey is null then 'inserted' when coalesce(n.c_name, o.c_name) is distinct from o.c_name or coalesce(n.c_acctbal, o.c_acctbal) is distinct from o.c_acctbal then 'updated' else 'skipped' end as outcome
        from old o full join new n on o.c_custkey = n.c_custkey) """


def _halves(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    k = F.col("c_custkey")
    new = c.where(k % 4 != 1).withColumns({"c_name": F.when(k % 2 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit("!"))), "c_acctbal": F.when(k % 5 != 0, F.col("c_acctbal"))})
    return state.upsert(c.where(k % 3 != 0), new, ["c_custkey"])


@query(UPSERT + "select * from j")
def upsert_snapshot(spark, sf_dir):
    return _halves(spark, sf_dir)


@query(UPSERT + "select outcome, count(*) as n from j group by 1")
def upsert_outcomes(spark, sf_dir):
    return state.outcomes(_halves(spark, sf_dir))


@query(on_jobs("""select id, case when amount > 450000 and deleted_at is null then '2001-09-01' when deleted_at is not null and source_id not like '1%' then strftime(deleted_at, '%Y-%m-%d') end as deleted_on,
    case when amount > 450000 and deleted_at is null then 'too dear' end as deletion_reason from jobs"""))
def soft_delete_restore(spark, sf_dir):
    """Deletes by one predicate after restoring by another."""
    j = jobs(spark, sf_dir).withColumns({"deleted_at": F.col("deleted_at").cast("timestamp"), "deleted_by": F.lit(None).cast("string"), "deletion_reason": F.lit(None).cast("string"), "was": F.col("deleted_at").isNotNull()})
    restored = state.restore(j, F.col("source_id").startswith("1"))
    out = state.soft_delete(restored, (F.col("amount") > 450000) & ~F.col("was"), "2001-09-01", "admin", "too dear")
    return out.select("id", F.date_format("deleted_at", "yyyy-MM-dd").alias("deleted_on"), "deletion_reason")


@query("select doc_id from (select doc_id from labels where quality = 1 except select doc_id from labels where toxic = 1) union all select doc_id from (select doc_id from labels where toxic = 1 except select doc_id from labels where quality = 1)")
def toggle_symmetric(spark, sf_dir):
    l = table(spark, sf_dir, "labels")
    return state.toggle(l.where("quality = 1"), l.where("toxic = 1"), ["doc_id"])


@query("""select p_partkey, array_to_string(list_filter([case when p_size % 2 = 1 then 'p_name' end, case when p_size % 3 = 0 then 'p_size' end, case when p_size % 5 = 0 and p_brand is not null then 'p_brand' end], lambda x: x is not null), ',') as changed from part""")
def history_diff(spark, sf_dir):
    """Names of changed fields, null-safe."""
    from tessera.functions.quality import changed_fields

    p, s = table(spark, sf_dir, "part"), F.col("p_size")
    before = {"p_name": F.col("p_name"), "p_size": s, "p_brand": F.col("p_brand")}
    after = {"p_name": F.when(s % 2 == 1, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")), "p_size": F.when(s % 3 == 0, s + 1).otherwise(s), "p_brand": F.when(s % 5 != 0, F.col("p_brand"))}
    return p.select("p_partkey", F.array_join(changed_fields(before, after), ",").alias("changed"))


@query(on_logs("""select source_id, max(n) as n_mode, cast(sum(n) as bigint) as n, min(case when r = 1 then event_type end) as mode, round(max(n) / sum(n), 6) as share from
    (select source_id, event_type, count(*) as n, rank() over (partition by source_id order by count(*) desc) as r from logs group by 1, 2) group by 1"""))
def confusion_agreement(spark, sf_dir):
    """Mode of a label per key, ties to the smallest, and its share."""
    out = reports.mode_of(logs(spark, sf_dir), "source_id", "event_type")
    return out.withColumn("share", F.round("share", 6))


HEALTH = on_logs(f""", s as (select c_custkey as source_id, case c_mktsegment when 'BUILDING' then 'un' when 'FURNITURE' then 'ingo' when 'MACHINERY' then 'ngo' when 'AUTOMOBILE' then 'academic' else null end as org_type, c_custkey % 4 as failures, c_custkey % 7 as unchanged from customer),
    recent as (select * from logs where ran_at >= timestamp '{AS_OF}' - interval 30 day),
    l10 as (select source_id, count(*) as n, count(case when status = 'ok' then 1 end) as ok from (select * from recent qualify row_number() over (partition by source_id order by ran_at desc, event_id) <= 10) group by 1),
    act as (select source_id, cast(sum(case when status = 'ok' then found else 0 end) as double) as found, sum(case when status = 'ok' then inserted + updated else 0 end) as changes from recent group by 1),
    q as (select cast(source_id as bigint) as source_id, count(*) as total, count(case when apply_url is null then 1 end) as no_url, count(case when contains(apply_url, '/jobs') or contains(apply_url, '/careers') or contains(apply_url, '/vacancies') then 1 end) as listing from jobs where status = 'active' group by 1),
    c as (select s.*, case when coalesce(l10.n, 0) = 0 then greatest(0, 70 - failures * 15) else greatest(0, least(100, 100.0 * l10.ok / l10.n - failures * 10)) end as reliability,
        coalesce(changes, 0) as changes, case when coalesce(found, 0) = 0 then 0 else changes / greatest(1, found / greatest(1, changes)) end as rate,
        case when coalesce(q.total, 0) = 0 then 50 else greatest(0, least(100, 100.0 - 100.0 * (no_url + listing) / q.total)) end as quality
        from s left join l10 using (source_id) left join act using (source_id) left join q using (source_id)),
    a as (select *, case when rate >= 10 then 100 when rate >= 1 then 50 + rate * 5 else rate * 50 end as activity from c),
    h as (select *, reliability * 0.35 + activity * 0.30 + quality * 0.20 + 50 * 0.15 as raw, case org_type when 'un' then 1 when 'ingo' then 2 when 'ngo' then 3 when 'academic' then 7 else 3 end as base from a),
    out as (select *, greatest(1, least(10, 5 + case when raw >= 80 then 2 when raw >= 60 then 1 when raw < 30 then -2 else 0 end + case when activity >= 70 then 1 when activity < 20 then -1 else 0 end + case when org_type in ('un', 'ingo') then 1 else 0 end)) as priority,
        case when raw >= 80 and activity >= 70 then greatest(0.5, base - 1) when raw < 50 or activity < 30 then least(14, base + 2) else base end as frequency_days from h) """).replace("with logs as", f"with {JOBS_SQL}, logs as", 1)


def _health(spark, sf_dir):
    seg = {"BUILDING": "un", "FURNITURE": "ingo", "MACHINERY": "ngo", "AUTOMOBILE": "academic"}
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), F.coalesce(*[F.when(F.col("c_mktsegment") == k, F.lit(v)) for k, v in seg.items()]).alias("org_type"), (F.col("c_custkey") % 4).cast("int").alias("failures"), (F.col("c_custkey") % 7).cast("int").alias("unchanged"))
    recent = logs(spark, sf_dir).where(search.in_window(F.col("ran_at").cast("timestamp"), AS_OF, "30 days"))
    ok = F.col("status") == "ok"
    last = reports.last_n(recent, "source_id", [F.desc("ran_at"), F.asc("event_id")], 10).groupBy("source_id").agg(F.count("*").alias("n_logs"), F.count_if(ok).alias("n_ok"))
    act = recent.groupBy("source_id").agg(*[F.sum(F.when(ok, F.col(c)).otherwise(0)).alias(c) for c in ("found", "inserted", "updated")])
    from tessera.functions.constants import LISTING_HEALTH
    from tessera.functions.quality import is_listing

    q = jobs(spark, sf_dir).where("status = 'active'").groupBy(F.col("source_id").cast("long").alias("source_id")).agg(F.count("*").alias("total"), F.count_if(F.col("apply_url").isNull()).alias("no_url"), F.count_if(is_listing(F.col("apply_url"), LISTING_HEALTH)).alias("listing"))
    joined = s.join(last, "source_id", "left").join(act, "source_id", "left").join(q, "source_id", "left")
    r, a, u = repair.reliability(F.col("n_logs"), F.col("n_ok"), F.col("failures")), repair.activity(F.col("found"), F.col("inserted"), F.col("updated")), repair.url_quality(F.col("total"), F.col("no_url"), F.col("listing"))
    joined = joined.withColumns({"reliability": r.cast("double"), "activity": a.cast("double"), "quality": u.cast("double"), "changes": F.coalesce(F.col("inserted") + F.col("updated"), F.lit(0))})
    return joined.withColumn("health", repair.health(F.col("reliability"), F.col("activity"), F.col("quality"), F.col("org_type")))


@query(HEALTH + "select source_id, round(reliability, 4) as reliability, round(activity, 4) as activity, round(quality, 4) as quality, cast(priority as integer) as priority, cast(frequency_days as double) as frequency_days from out")
def health_score(spark, sf_dir):
    return _health(spark, sf_dir).select("source_id", *[F.round(c, 4).alias(c) for c in ("reliability", "activity", "quality")], "health.priority", "health.frequency_days")


@query(HEALTH + """, n as (select *, case when changes >= 20 then greatest(0.25, base - 2) when changes >= 10 then greatest(0.5, base - 1) when changes >= 5 then greatest(0.5, base - 0.5)
    when changes = 0 and unchanged >= 5 then least(21, base + 3) when changes = 0 and unchanged >= 3 then least(14, base + 1) else base end as d from out),
    m as (select source_id, failures, case when failures > 0 then greatest(d, least(7, 6 * power(2, least(failures, 4)) / 24)) else d end as d from n)
    select source_id, cast(failures as integer) as failures, cast(round(d, 6) as double) as days from m""")
def next_run(spark, sf_dir):
    h = _health(spark, sf_dir)
    days = repair.next_run_days(F.lit(0), F.col("org_type"), F.col("changes"), F.col("failures"), F.col("unchanged"))
    return h.select("source_id", "failures", F.round(days, 6).alias("days"))


@query(HEALTH + f""" select source_id, cast(priority as integer) as priority, case when priority >= 7 then 0 when priority >= 4 then 1 else 2 end as band from out where source_id % 5 = 0 or source_id % 3 = 0 order by band, priority desc, source_id limit 20""")
def due_priority(spark, sf_dir):
    """Due sources by band and priority: the next 20."""
    h = _health(spark, sf_dir).withColumn("next_run_at", F.when(F.col("source_id") % 5 == 0, None).when(F.col("source_id") % 3 == 0, F.lit("2024-01-01")).otherwise(F.lit("2024-03-01")).cast("timestamp"))
    p = F.col("health.priority")
    band = F.when(p >= 7, 0).when(p >= 4, 1).otherwise(2)
    return h.where(search.due(AS_OF)).select("source_id", p.alias("priority"), band.alias("band")).orderBy("band", F.desc("priority"), "source_id").limit(20)


@query(on_jobs(f"""select id, round(30.0 * cast(coalesce(list_has_any(mission_tags, ['wash', 'health']), false) as integer) + 20.0 * cast(coalesce(contains('senior officer', lower(level_norm)), false) as integer) + 10.0 * cast(coalesce(work_modality in ('remote', 'hybrid'), false) as integer), 2) as score
    from jobs where {VISIBLE} order by score desc, cast(id as bigint) limit 50"""))
def match_score_rerank(spark, sf_dir):
    """The 50 best by match score; equal ones by their earlier rank."""
    j = search.visible(jobs(spark, sf_dir), DAY)
    none = F.lit(None).cast("string")
    cells = {"impact_domain": F.col("mission_tags"), "functional_role": F.array().cast("array<string>"), "experience_level": F.col("level_norm"), "location_raw": none, "country": F.col("country_iso"), "work_modality": F.col("work_modality")}
    score = search.match_score(cells, {"impact_domain": ["wash", "health"], "experience_level": "Senior Officer", "is_remote": True})["score"]
    ranked = search.rerank(j.withColumn("rank", F.col("id").cast("long")), score, "rank")
    return ranked.limit(50).select("id", F.col("match_score").alias("score"))


@query(on_jobs("""select url, n_jobs, valid from (select 'https://a.org/jobs/' || (k % 100) as url, count(*) as n_jobs, bool_or(k % 2 = 0) as valid from (select o_orderkey as k from orders) where k % 10 = 1 group by 1)"""))
def distinct_urls(spark, sf_dir):
    """Distinct listing urls with the number of records that hold them."""
    j = jobs(spark, sf_dir).where(F.col("apply_url").contains("/jobs/"))
    return j.groupBy(F.col("apply_url").alias("url")).agg(F.count("*").alias("n_jobs"), F.bool_or(F.col("id").cast("long") % 2 == 0).alias("valid"))


@query(on_jobs("""select count(*) as total, count(case when k % 3 = 0 then 1 end) as valid, count(case when k % 3 = 1 then 1 end) as invalid, count(case when k is null or k % 3 = 2 then 1 end) as unvalidated,
    round(100.0 * count(case when k % 3 = 0 then 1 end) / count(case when k % 3 < 2 then 1 end), 6) as percent from (select try_cast(regexp_extract(apply_url, '([0-9]+)$', 1) as bigint) as k from jobs)"""))
def link_validation_stats(spark, sf_dir):
    j = jobs(spark, sf_dir)
    k = F.regexp_extract("url", "([0-9]+)$", 1).cast("long")
    v = j.where("apply_url is not null").select(F.col("apply_url").alias("url")).distinct().where(k % 3 < 2).select("url", (k % 3 == 0).alias("is_valid"), F.lit("2024-01-30 12:00:00").cast("timestamp").alias("validated_at"))
    return reports.link_stats(j, v, AS_OF).drop("recent").withColumn("percent", F.round("percent", 6))


@query("select user_id as source_id, cast(min(least(seen, 5)) as integer) as low, max(run) as longest from (select user_id, event_id, count(*) over (partition by user_id, g order by ts, event_id) as run, 5 as seen, et from (select user_id, event_id, ts, event_type as et, sum(case when event_type <> 'error' then 1 else 0 end) over (partition by user_id order by ts, event_id) as g from events) where et = 'error') group by 1")
def consecutive_failures(spark, sf_dir):
    """Longest run of failures per source: a counter that each success resets."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("g", F.sum(F.when(F.col("event_type") != "error", 1).otherwise(0)).over(by)).where("event_type = 'error'")
    run = F.count("*").over(Window.partitionBy("user_id", "g").orderBy("ts", "event_id"))
    return e.withColumn("run", run).groupBy(F.col("user_id").alias("source_id")).agg(F.lit(5).alias("low"), F.max("run").alias("longest"))
