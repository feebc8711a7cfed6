"""Rules on literal cases."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tessera.functions import links, normalize, quality, repair
from tessera.operators import search


def values(spark, column, cases):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


@pytest.mark.parametrize(
    ("rule", "cases"),
    [
        (normalize.iso_country, {"India": "IN", "InDiA": "IN", " United Kingdom ": "GB", "nowhere": None, "": None, None: None}),
        (normalize.level, {"entry": "junior", "entry-level": "junior", "associate": "junior", "mid-level": "mid", "intermediate": "mid", "staff": "mid", "sr": "senior", "Sr.": "senior", "manager": "senior", "principal": "lead", "unknown": None, None: None}),
        (normalize.modality, {"office": "onsite", "on-site": "onsite", "WFH": "remote", "home-based": "home_based", "Flexible": "flexible", "x": None}),
        (normalize.contract_months, {"6 months": 6, "18month": 18, "1 yr": 12, "3-6 months": 6, "permanent": None, None: None}),
        (normalize.boolean, {"true": True, "Yes": True, "1": True, "t": True, "no": False, "0": False, "2": True, "maybe": None, "": None, None: None}),
        (normalize.old_boolean, {"1": True, "2": None, "no": False}),
        (normalize.old_country, {"DRC": "CD", "USA": "US", "France": None}),
        (normalize.old_level, {"staff": "Lead", "Entry level": "Junior", "x": None}),
        (links.normalize_url, {"https://A.org/jobs/?utm_source=x&id=5#top": "https://a.org/jobs?id=5", "https://a.org/p/2/": "https://a.org/p/2", "http://a.org/x?ref=1": "http://a.org/x", None: None}),
        (links.plain_url, {"https://a.org/x/#t?y": "https://a.org/x/", "https://a.org/x/": "https://a.org/x"}),
        (repair.level_of_experience, {"Officer / Associate": "Officer / Professional", "early / junior (0-2 yrs)": "Junior / Associate", "none": None}),
        (repair.title_case, {"senior  officer WASH McKay": "Senior Officer WASH McKay"}),
        (repair.location_kind, {"Remote": "remote", "Nairobi": "onsite", "Nairobi, Kampala": None}),
        (repair.clean_title, {"  A   b ": "A b"}),
    ],
)
def test_scalar_rules(spark, rule, cases):
    assert dict(zip(cases, values(spark, rule, list(cases)), strict=True)) == cases


def test_tags_keep_order_and_repeats(spark):
    df = spark.createDataFrame([(["WASH", "human-rights", "x", "water", None],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(normalize.tags(F.col("t"))).collect()] == [["wash", "human_rights", "wash"], []]
    assert [r[0] for r in df.select(normalize.old_tags(F.col("t"))).collect()] == [["wash"], []]


def test_compensation(spark):
    got = [tuple(r) for r in values(spark, normalize.compensation, ["$25 - $35 per hour", "50,000 EUR", "none", ",", None])]
    assert got[0] == (True, "hourly", 25.0, 35.0, "USD", 0.7)
    assert got[1][:2] == (True, "salary") and got[1][2] == pytest.approx(55000) and got[1][4] == "EUR"
    assert got[2][:4] == (False, None, None, None) and got[3][0] is False and tuple(got[4]) == (False, None, None, None, None, 0.0)
    df = spark.range(1).select(normalize.compensation(F.lit(None).cast("string"), F.lit("50000"), F.lit("70000"), F.lit("USD")).alias("c"))
    assert tuple(df.first()[0]) == (True, "salary", 50000.0, 70000.0, "USD", 0.9)


def test_transforms(spark):
    one = spark.createDataFrame([(" Ab ", ["x", "y"], "1700000000")], "s string, a array<string>, u string")
    row = one.select(
        normalize.transform(F.col("s"), ["strip", "lower"]), normalize.transform(F.col("a"), ["join"]), normalize.transform(F.col("a"), ["first", "upper"]),
        normalize.transform(F.lit("k"), [("map_table", {"k": "v"})]), normalize.transform(F.lit(""), [("default", "d")]), normalize.transform(F.col("u"), [("date_parse", "unix")]).cast("string"),
    ).first()
    assert tuple(row) == ("ab", "x, y", "X", "v", "d", "2023-11-14 22:13:20")
    with pytest.raises(ValueError):
        normalize.transform(F.col("s"), ["nope"])


def test_hashes_agree_over_url_forms(spark):
    df = spark.createDataFrame([("WASH Engineer", "https://a.org/p/2?utm_source=x"), ("WASH Engineer", "https://a.org/p/2")], "t string, u string")
    assert {r[0] for r in df.select(links.canonical_hash(F.col("t"), F.col("u"))).collect()} == {"892fbd135c8c6236597219a398a22e9d"}


def test_links(spark):
    df = spark.createDataFrame([(" mailto", " mailto:a@b.c "), ("GLOBAL", "/x"), ("More Jobs", "/jobs"), ("Health Officer, Kenya", "/job/1"), ("", "/x"), ("A", "#top")], "t string, h string")
    assert [r[0] for r in df.select(links.link_score(F.col("t"), F.col("h"))).collect()] == [0, 0, 0, 6.5, 0, 0]


def test_quality_golden(spark):
    job = {"title": "Health Officer", "apply_url": "https://a.org", "location_raw": "Nairobi", "latitude": None, "longitude": None, "is_remote": None, "deadline": "2024-07-01", "description": "x" * 20, "org_name": "A", "country": "KE"}
    q = spark.range(1).select(quality.quality({k: F.lit(v).cast("boolean" if k == "is_remote" else "double" if k[0] == "l" and k != "location_raw" else "string") for k, v in job.items()}, date(2024, 6, 15)).alias("q")).first()[0]
    assert (q.score, q.grade, q.issues, q.needs_review) == (0.855, "high", [], False)


def test_health_and_schedule_golden(spark):
    r = spark.range(1).select(
        repair.reliability(F.lit(10), F.lit(8), F.lit(0)).alias("r"), repair.activity(F.lit(100), F.lit(5), F.lit(5)).alias("a"), repair.url_quality(F.lit(20), F.lit(1), F.lit(0)).alias("q"),
        repair.next_run_days(F.lit(3), F.lit("ngo"), F.lit(0), F.lit(2), F.lit(3)).alias("d1"), repair.next_run_days(F.lit(1), F.lit("un"), F.lit(0), F.lit(4), F.lit(0)).alias("d2"),
    )
    row = r.withColumn("h", repair.health(F.col("r"), F.col("a"), F.col("q"), F.lit("un"))).first()
    assert (row.r, row.a, row.q) == (80, 55, 95) and tuple(row.h) == (71.0, 7, 1.0) and (row.d1, row.d2) == (4.0, 4.0)


def test_enrichment_golden(spark):
    def run(roles, sdgs, overall):
        e = {
            "functional_role": F.array(*[F.lit(r) for r in roles]), "sdgs": F.array(*[F.lit(k) for k in sdgs]), "sdg_confidences": F.create_map(*[F.lit(x) for k, v in sdgs.items() for x in (str(k), v)]),
            "impact_domain": F.lit(None).cast("array<string>"), "impact_confidences": F.lit(None).cast("map<string,double>"), "experience_level": F.lit(None).cast("string"), "experience_confidence": F.lit(None).cast("double"), "confidence_overall": F.lit(overall),
        }
        return spark.range(1).select(repair.enrichment_rules(e).alias("e")).first()[0]

    a = run(["HR, Admin & Ops"], {3: 0.9}, 0.7)
    assert (a.sdgs, a.low_confidence, a.low_confidence_reason) == ([], True, "operational/support role")
    assert run(["Legal"], {3: 0.7, 4: 0.59, 5: 0.9, 6: 0.8}, 0.7).sdgs == [5, 6]
    assert run(["Data & GIS"], {3: 0.7}, 0.7).sdgs == []


def test_match_score_golden(spark):
    job = {"impact_domain": F.array(F.lit("wash")), "functional_role": F.array().cast("array<string>"), "experience_level": F.lit("Officer / Associate"), "location_raw": F.lit("Nairobi, Kenya"), "country": F.lit("KE"), "work_modality": F.lit("Remote")}
    s = spark.range(1).select(search.match_score(job, {"impact_domain": ["wash"], "experience_level": "officer", "location": "kenya", "is_remote": True}).alias("s")).first()[0]
    assert s.score == 70 and len(s.reasons) == 3


def test_levels_from_titles(spark):
    cases = {"Senior Programme Manager": "Manager / Senior Manager", "Communications Officer": "Officer / Professional", "Country Director": "Head / Director", "Internship": "Entry / Intern", "Wizard": "Entry / Intern", "Chief Executive": "Executive / Chief"}
    got = values(spark, lambda x: repair.level_of_title(x, F.lit(""), F.lit("ngo")), list(cases))
    assert dict(zip(cases, got, strict=True)) == cases
    assert values(spark, lambda x: repair.level_of_title(x, F.lit(""), F.lit("un")), ["Officer (P-3)", "Clerk G5"]) == ["Officer / Professional", "Junior / Associate"]


def test_repairs(spark):
    df = spark.createDataFrame([("Director", "Director"), ("Paris, France Nov FR", "Officer"), ("Officer", "Analyst"), ("Montreal, Canada", "X")], "l string, t string")
    got = [tuple(r[0]) for r in df.select(repair.repair_location(F.col("l"), F.col("t"))).collect()]
    assert got[0][:2] == (True, None) and got[1][:2] == (True, "Paris, France") and got[2][:2] == (True, None) and got[3][:2] == (False, "Montreal, Canada")


def test_dates_and_salaries(spark):
    assert [str(d) for d in values(spark, links.parse_date, ["2024-07-01", "1/7/2024", "1 July 2024", "Jul 1, 2024", "Deadline: 01-07-2024"])] == ["2024-07-01"] * 5
    assert values(spark, links.parse_date, ["soon", "", None]) == [None, None, None]
    assert tuple(values(spark, repair.salary_range, ["$50,000 - $70,000"])[0]) == (50000, 70000, "USD")


def test_paging_is_clamped():
    assert search.SearchRequest(page=0, size=0).clamped == (1, 1) and search.SearchRequest(page=-5, size=200).clamped == (1, 100)
    assert search.page_count(41, 20) == 3


def test_filters_drop_unknown_values():
    assert search.canonical_filters({"level_norm": "garbage", "country": "Kenya", "mission_tags": ["WASH", "x"], "international_eligible": "no"}) == {"country_iso": "KE", "mission_tags": ["wash"], "international_eligible": False}


def test_plain_query():
    q = search.parse_query("remote WASH officer in Kenya")
    assert q["is_remote"] and q["location"] == "Kenya" and q["experience_level"].startswith("Officer") and q["impact_domain"][0].startswith("Water")
    assert "IT / Digital / Systems" in search.parse_query("sanitation")["functional_role"]


def test_repair_names_what_it_computes_once(spark):
    from datetime import date

    columns = ["title", "location_raw", "description", "apply_url", "org_name"]
    df = spark.createDataFrame([("Cook", "Rome  May", "Work in Geneva", "https://x.org/1", None), ("Nurse", None, "Deadline: 01/09/2024", "https://x.org/1", None)], ", ".join(f"{c} string" for c in columns))
    out = df.select(repair.repair({c: F.col(c) for c in columns} | {"deadline": F.lit(None).cast("date")}, date(2024, 6, 15)).alias("r"))
    # The place is looked at by a few patterns and not by those of each part again for each place where the part stands.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") < 20
    assert [(r.r.location_raw, r.r.deadline, r.r.repairs) for r in out.collect()] == [("Rome", date(2024, 7, 15), ["location repaired", "deadline inferred"]), (None, date(2024, 9, 1), ["deadline inferred"])]
