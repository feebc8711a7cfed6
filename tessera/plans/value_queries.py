"""Queries of the value rules: normalisation, validation, repair, levels and enrichment over values dealt to the rows.

Every row of a driver table gets raw values from the lists below, by its key, in several spellings.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.functions import links, normalize, quality, repair
from tessera.operators import search
from tessera.plans.views import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DAY = date(2024, 6, 15)
TODAY = f"date '{DAY}'"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def text(x: str | None) -> str:
    return "null" if x is None else "'" + x.replace("'", "''") + "'"


#: A value as a function that makes its Column, and as SQL.
Dealt = tuple[Callable[[], Column], str]


def one_of(cases: list, every: int = 1) -> Dealt:
    """The case that a row's doc_id chooses; ``every`` ids in a row have the same."""

    def column() -> Column:
        k = F.pmod(F.floor(F.col("doc_id") / every), F.lit(len(cases))).cast("int")
        return F.get(F.array(*[F.lit(c).cast("string") for c in cases]), k)

    return column, f"([{', '.join(map(text, cases))}])[doc_id // {every} % {len(cases)} + 1]"


def spelled(value: Dealt) -> Dealt:
    """As it stands, in capitals, or with blanks around, by doc_id."""

    def column() -> Column:
        c, k = value[0](), F.col("doc_id") % 3
        return F.when(k == 0, c).when(k == 1, F.upper(c)).otherwise(F.concat(F.lit("  "), c, F.lit(" ")))

    return column, f"case doc_id % 3 when 0 then {value[1]} when 1 then upper({value[1]}) else '  ' || {value[1]} || ' ' end"


def map_sql(pairs: dict, key: str) -> str:
    return f"map {{{', '.join(f'{text(k)}: {text(v)}' for k, v in pairs.items())}}}[{key}]"


def in_sql(values) -> str:
    return "(" + ", ".join(map(text, values)) + ")"


def documents(spark: SparkSession, sf_dir: str, **columns: Dealt) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").withColumns({k: c() for k, (c, _) in columns.items()})


def dealt(**columns: Dealt) -> str:
    return "with d as (select doc_id, " + ", ".join(f"{s} as {k}" for k, (_, s) in columns.items()) + " from documents) "


SCALARS = {
    "country": spelled(one_of(["india", "Kenya", "united kingdom", "Atlantis", "", None, "south africa"])),
    "grade": spelled(one_of(["entry-level", "mid", "sr.", "manager", "principal", "boss", None, "lead", "staff"], 2)),
    "place": spelled(one_of(["office", "wfh", "home-based", "Flexible", "home based", "moon", None, "hybrid"], 3)),
}


@query(dealt(**SCALARS) + f"""select doc_id, {map_sql({v.lower(): k for k, v in C.COUNTRIES.items()}, 'lower(trim(country))')} as iso,
    coalesce({map_sql(C.LEVEL_SYNONYMS, 'lower(trim(grade))')}, case when lower(trim(grade)) in {in_sql(C.LEVELS)} then lower(trim(grade)) end) as level,
    coalesce({map_sql(C.MODALITY_SYNONYMS, 'lower(trim(place))')}, case when translate(lower(trim(place)), '- ', '__') in {in_sql(C.MODALITIES)} then translate(lower(trim(place)), '- ', '__') end) as modality from d""")
def normalize_scalars(spark, sf_dir):
    """Country, level and work modality of raw values."""
    d = documents(spark, sf_dir, **SCALARS)
    return d.select("doc_id", normalize.iso_country(F.col("country")).alias("iso"), normalize.level(F.col("grade")).alias("level"), normalize.modality(F.col("place")).alias("modality"))


@query(dealt(**SCALARS) + f"select doc_id, {map_sql(C.OLD_COUNTRIES, 'lower(trim(country))')} as iso, {map_sql(C.OLD_LEVELS, 'lower(trim(grade))')} as level, case when lower(trim(place)) in ('yes') then true end as flag from d")
def normalize_legacy(spark, sf_dir):
    """The older profile of normalisation (X11)."""
    d = documents(spark, sf_dir, **SCALARS)
    return d.select("doc_id", normalize.old_country(F.col("country")).alias("iso"), normalize.old_level(F.col("grade")).alias("level"), normalize.old_boolean(F.col("place")).alias("flag"))


LISTS = {
    "tags": one_of(["WASH,human-rights,Water", "healthcare, x,youth", "medical,medical", "human rights,Food Security", "", "climate"]),
    "benefits": one_of(["Health Insurance,visa-sponsorship", "pension,gold", "hazard pay", "", "travel,travel"], 2),
    "policies": one_of(["pay transparent", "Gender-Friendly,none", "", "disability_friendly"], 3),
    "donors": one_of(["USAID,World Bank", "eu,me", "giz", ""], 4),
}


def _lists(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir, **LISTS)
    return d.select("doc_id", *[F.when(F.col(c) != "", F.split(c, ",")).alias(c) for c in LISTS])


LISTS_SQL = dealt(**LISTS).rstrip() + ", l as (select doc_id, " + ", ".join(f"case when {c} <> '' then string_split({c}, ',') end as {c}" for c in LISTS) + " from d) "
PLAIN_TAG = "replace(lower(trim(x)), '-', '_')"
TAG_SQL = f"coalesce({map_sql(C.MISSION_SYNONYMS, 'lower(trim(x))')}, {map_sql(C.MISSION_SYNONYMS, PLAIN_TAG)}, case when replace(lower(trim(x)), '-', '_') in {in_sql(C.MISSIONS)} then replace(lower(trim(x)), '-', '_') end)"
NORMAL_SQL = {"tags": f"coalesce(list_filter(list_transform(tags, lambda x: {TAG_SQL}), lambda x: x is not null), [])"} | {
    c: f"coalesce(list_filter(list_transform({c}, lambda x: translate(lower(trim(x)), '- ', '__')), lambda x: x in {in_sql(v)}), [])" for c, v in (("benefits", C.BENEFITS), ("policies", C.POLICIES), ("donors", C.DONORS))
}


@query(LISTS_SQL + "select doc_id, " + ", ".join(f"array_to_string({s}, ',') as {c}" for c, s in NORMAL_SQL.items()) + " from l")
def normalize_arrays(spark, sf_dir):
    """Tags, benefits, policies and donors."""
    rules = {"tags": normalize.tags, "benefits": normalize.benefits, "policies": normalize.policies, "donors": normalize.donors}
    return _lists(spark, sf_dir).select("doc_id", *[F.array_join(f(F.col(c)), ",").alias(c) for c, f in rules.items()])


@query(LISTS_SQL + """, n as (select doc_id, tags, benefits, """ + ", ".join(f"{NORMAL_SQL[c]} as n_{c}" for c in ("tags", "benefits")) + """ from l),
    u as (select doc_id, 'tags' as field, unnest(list_distinct(list_transform(tags, lambda x: lower(trim(x))))) as value, n_tags as done from n union all
        select doc_id, 'benefits', unnest(list_distinct(list_transform(benefits, lambda x: lower(trim(x))))), n_benefits from n)
    select doc_id, field, value from u where not list_contains(done, value)""")
def normalize_unknowns(spark, sf_dir):
    """What normalisation loses, by field."""
    d = _lists(spark, sf_dir)
    lost = normalize.unknowns({"tags": (F.col("tags"), normalize.tags(F.col("tags"))), "benefits": (F.col("benefits"), normalize.benefits(F.col("benefits")))})
    return d.select("doc_id", F.explode(lost).alias("u")).select("doc_id", "u.field", "u.value")


CHECKED = {"level": one_of(["mid", "boss", None, "senior"]), "modality": one_of(["remote", "moon", None], 4), "tags": one_of(["wash,health", "wash,gold,tin", "", "youth"], 2)}


@query(dealt(**CHECKED) + f"""select doc_id, array_to_string(list_filter([case when level not in {in_sql(C.LEVELS)} then 'Invalid level: ' || level end, case when modality not in {in_sql(C.MODALITIES)} then 'Invalid modality: ' || modality end,
    case when len(list_filter(string_split(tags, ','), lambda x: x <> '' and x not in {in_sql(C.MISSIONS)})) > 0 then 'Invalid tags: ' || array_to_string(list_filter(string_split(tags, ','), lambda x: x not in {in_sql(C.MISSIONS)}), ', ') end], lambda x: x is not null), '; ') as errors from d""")
def lookup_validation(spark, sf_dir):
    """Values that no lookup table has, null passing."""
    d = documents(spark, sf_dir, **CHECKED).withColumn("tags", F.filter(F.split("tags", ","), lambda x: x != ""))
    errors = normalize.lookup_errors({"level": (F.col("level"), C.LEVELS), "modality": (F.col("modality"), C.MODALITIES)}, {"tags": (F.col("tags"), C.MISSIONS)})
    return d.select("doc_id", F.array_join(errors, "; ").alias("errors"))


@query("""select doc_id, upper(trim(lang)) as lang, case source when 'web' then 'internet' when 'books' then 'library' else source end as source, coalesce(nullif(trim(case when doc_id % 3 = 0 then ' ' else lang end), ''), 'none') as given,
    lang || ' / ' || source as joined, strftime(make_timestamp(1700000000000000 + doc_id * 1000000), '%Y-%m-%d %H:%M:%S') as at from documents""")
def transform_chain(spark, sf_dir):
    """Chains of named transforms."""
    d = table(spark, sf_dir, "documents")
    t = normalize.transform
    at = t((F.col("doc_id") + 1_700_000_000).cast("string"), [("date_parse", "unix")])
    given = t(F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("lang")), [("default", "none"), "strip"])
    return d.select("doc_id", t(F.col("lang"), ["strip", "upper"]).alias("lang"), t(F.col("source"), [("map_table", {"web": "internet", "books": "library"})]).alias("source"), given.alias("given"), t(F.array("lang", "source"), [("join", " / ")]).alias("joined"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("select p_name as text, p_brand as type, cast(p_size / 50.0 as double) as confidence from part where contains(lower(p_name), 're') order by p_partkey limit 8")
def autocomplete(spark, sf_dir):
    """The first eight entries of a vocabulary that contain what was typed."""
    v = table(spark, sf_dir, "part").select(F.col("p_name").alias("text"), F.col("p_brand").alias("type"), (F.col("p_size") / 50.0).cast("double").alias("confidence"), F.col("p_partkey").alias("position"))
    return search.suggestions(v, " Re ")


BATCH = {
    "title": one_of(["Officer", "  abc ", "", None, "Data Analyst"]), "url": one_of(["https://a.org/x/1", "https://a.org/jobs/2", "nowhere", "", "https://a.org", None, "https://a.org/p?q=1"], 2),
    "canonical": one_of(["0123456789", "abc", "", None], 3),
}


@query(dealt(**BATCH) + """, e as (select doc_id, list_filter([case when coalesce(title, '') = '' then 'Missing title' end, case when title <> '' and length(trim(title)) < 5 then 'Title too short' end, case when coalesce(url, '') = '' then 'Missing apply_url' end,
        case when url <> '' and not regexp_matches(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+') then 'Invalid URL format' end,
        case when url <> '' and (contains(url, '/jobs') or contains(url, '/search')) then 'URL appears to be listing page' end, case when url <> '' and split_part(split_part(rtrim(url, '/'), '#', 1), '?', 1) = 'https://a.org' then 'URL is base URL' end,
        case when coalesce(canonical, '') = '' then 'Missing canonical_hash' end, case when length(canonical) between 1 and 7 then 'canonical_hash too short' end], lambda x: x is not null) as errors, url from d) """
    "select doc_id, array_to_string(errors, '; ') as errors from e")
def batch_errors(spark, sf_dir):
    """All reasons against the records of a batch."""
    d = documents(spark, sf_dir, **BATCH)
    return d.select("doc_id", F.array_join(quality.batch_errors(F.col("title"), F.col("url"), F.col("canonical"), F.lit("https://a.org/")), "; ").alias("errors"))


@query(SQL["batch_errors"].rpartition("select doc_id")[0] + "select count(*) as n, count(case when len(errors) = 0 then 1 end) as valid, count(case when len(errors) > 0 then 1 end) as invalid, cast(coalesce(sum(len(errors)), 0) as bigint) as n_errors from e")
def batch_summary(spark, sf_dir):
    """How many records of a batch are valid, and errors in all."""
    from tessera.operators import admin

    d = documents(spark, sf_dir, **BATCH)
    return admin.batch_summary(d, quality.batch_errors(F.col("title"), F.col("url"), F.col("canonical"), F.lit("https://a.org/")))


ROWS = {
    "title": one_of(["Programme Officer", "Home", "12-05-2024", "5 May 2024", "Nairobi, Kenya", "job", "Read more", "Contact us and about", "Blog", "Engineer, Nairobi", "Data Entry", "Senior nurse wanted", "42 42", None]),
    "url": one_of(["https://a.org/job/1", "#top", "https://a.org/x", "", "javascript:void", None], 14),
}


def any_sql(of: str, parts) -> str:
    return "(" + " or ".join(f"contains({of}, {text(p)})" for p in parts) + ")"


@query(dealt(**ROWS) + f""", x as (select *, trim(title) as t, trim(url) as u, lower(trim(title)) as l, {" + ".join(f"cast(contains(lower(trim(title)), {text(w)}) as integer)" for w in C.NAV_WORDS)} as navs, {any_sql('lower(trim(title))', C.TITLE_WORDS)} as named from d)
    select doc_id, case when title is null or t = '' or length(t) < 5 then 'missing title' when url is null or u = '' then 'missing url' when navs > 0 and (length(t) < 25 or navs >= 2) then 'navigation' when {" or ".join(f"regexp_matches(l, {text(p)})" for p in C.DATE_TITLES)} then 'date'
        when len(string_split(t, ',')) = 2 and len(list_filter(string_split(t, ','), lambda p: length(trim(p)) < 20 and regexp_matches(trim(p), '^[A-Z]'))) = 2 and not {any_sql('l', C.ROLE_WORDS)} then 'location'
        when starts_with(u, '#') or starts_with(u, 'javascript:') then 'invalid url' when l in {in_sql(C.GENERIC_TITLES)} and not named then 'generic' when {" or ".join(f"regexp_matches(l, {text(p)})" for p in C.NON_TITLES)} then 'not a posting'
        when not {any_sql('lower(u)', C.URL_WORDS)} and length(t) < 15 and not named then 'url unlike a posting' end as error from x""")
def extraction_filter(spark, sf_dir):
    """Why an extracted row is no posting."""
    d = documents(spark, sf_dir, **ROWS)
    return d.select("doc_id", quality.extraction_error(F.col("title"), F.col("url")).alias("error"))


UNTIDY = {
    "title": one_of(["Job Title: Nurse   at  home", "Position : Cook", "Driver", None]), "place": one_of(["Duty Station: Lamu", "Based in   Rome", "Oslo  Norway", ""], 2),
    "due": one_of(["Deadline: 2024-05-01", "Apply by 1 May 2024", "2024-01-02"], 3), "url": one_of(["https://a.org/x#top", " https://a.org/y ", None], 4),
}


@query(dealt(**UNTIDY) + """select doc_id, regexp_replace(regexp_replace(trim(title), '(?i)^(Job Title|Position|Title)[:\\s]+', ''), '\\s+', ' ', 'g') as title, regexp_replace(regexp_replace(trim(place), '(?i)^(Location|Duty Station|Based in)[:\\s]+', ''), '\\s+', ' ', 'g') as place,
    regexp_replace(trim(due), '(?i)^(Deadline|Closing|Apply by|Due)[:\\s]+', '') as due, split_part(trim(url), '#', 1) as url from d""")
def extraction_tidy(spark, sf_dir):
    """Fields without labels, runs of blanks and fragments."""
    d = documents(spark, sf_dir, **UNTIDY)
    row = quality.tidy(F.col("title"), F.col("place"), F.col("due"), F.col("url"))
    return d.select("doc_id", row.alias("r")).select("doc_id", "r.title", F.col("r.location_raw").alias("place"), F.col("r.deadline").alias("due"), F.col("r.apply_url").alias("url"))


FLAGGED = {"title": one_of(["Nurse", " ", None]), "posted": one_of(["2024-05-01", "2024-01-01", None], 2), "due": one_of(["2024-03-01", "soon", None, "2024-06-30"], 3), "place": one_of(["Global", "Rome", " various ", None], 5)}


@query(dealt(**FLAGGED) + """select doc_id, array_to_string(list_filter([case when coalesce(trim(title), '') = '' then 'missing title' end, case when try_cast(due as date) < try_cast(posted as date) then 'deadline before posting' end,
    case when due is not null and try_cast(due as date) is null then 'unreadable date' end, case when lower(trim(place)) in ('global', 'multiple', 'various', 'worldwide', 'anywhere') then 'generic location' end], lambda x: x is not null), '; ') as flags from d""")
def extraction_review_flags(spark, sf_dir):
    """Why an extracted row needs a look by hand (X22); dates by the date parser."""
    d = documents(spark, sf_dir, **FLAGGED)
    flags = links.extraction_flags(F.col("title"), links.parse_date(F.col("posted")), links.parse_date(F.col("due")), F.col("due"), F.col("place"))
    return d.select("doc_id", F.array_join(flags, "; ").alias("flags"))


DATES = {"raw": one_of(["2024-05-01", "1/5/2024", "Deadline: 1 May 2024", "01.05.2024", "May 1, 2024", "1 May 2024", "5-13-2024", "2024-05-01T10:00:00", "tomorrow", None])}


@query(dealt(**DATES) + """, x as (select doc_id, regexp_replace(trim(raw), '(?i)^(deadline|closing|apply by|due)[:\\s]+', '') as r from d)
    select doc_id, strftime(coalesce(try_cast(regexp_extract(r, '^([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) as date), cast(try_strptime(r, ['%d/%m/%Y', '%d-%m-%Y', '%d.%m.%Y', '%d %B %Y', '%B %d, %Y']) as date)), '%Y-%m-%d') as day from x""")
def deadline_parser(spark, sf_dir):
    """Dates in the formats seen, day before month."""
    d = documents(spark, sf_dir, **DATES)
    return d.select("doc_id", F.date_format(links.parse_date(F.col("raw")), "yyyy-MM-dd").alias("day"))


CONFIDENT = {"title": one_of(["Nurse", "", None]), "employer": one_of(["Org", None], 2), "place": one_of(["Rome", ""], 3), "due": one_of(["2024-01-01", None, None], 4)}


@query(dealt(**CONFIDENT) + """, n as (select doc_id, cast(coalesce(title, '') <> '' as integer) as a, cast(coalesce(employer, '') <> '' as integer) as b, cast(coalesce(place, '') <> '' as integer) as c, cast(coalesce(due, '') <> '' as integer) as e from d)
    select doc_id, round(coalesce((0.9 * a + 0.7 * b + 0.5 * c + 0.4 * e) / nullif(a + b + c + e, 0), 0), 6)::double as confidence, 4 - a - b - c - e > 1 as needs_model from n""")
def field_confidence(spark, sf_dir):
    """Mean confidence of the fields found, and whether too much is missing."""
    d = documents(spark, sf_dir, **CONFIDENT)
    names = {"title": ("title", 0.9), "employer": ("employer", 0.7), "location": ("place", 0.5), "deadline": ("due", 0.4)}
    cells = F.create_map(*[x for f, (c, w) in names.items() for x in (F.lit(f), F.struct(F.col(c).alias("value"), F.lit(w).alias("confidence")))])
    return d.select("doc_id", F.round(quality.overall_confidence(cells), 6).alias("confidence"), quality.needs_model(cells).alias("needs_model"))


NAMED = {"title": one_of(["  Senior   officer ", "Womenâ€™s rights", "say â€œhi", "plain", None])}


@query(dealt(**NAMED) + "select doc_id, replace(replace(trim(regexp_replace(title, '\\s+', ' ', 'g')), 'â€™', ''''), 'â€œ', '\"') as title from d")
def clean_titles(spark, sf_dir):
    """Titles with single blanks and repaired quotes."""
    d = documents(spark, sf_dir, **NAMED)
    return d.select("doc_id", repair.clean_title(F.col("title")).alias("title"))


PLACED = {
    "title": one_of(["Programme Officer", "Cook", "Nairobi", "Data Manager Rome"]),
    "place": one_of(["Programme Officer", "Nairobi", "", None, "Programme Officer Rome", "Senior Manager", "Rome Nov", "Paris, France", "ab", "Lamu 31/12/2024", "Oslo 5 May 2030"], 4),
}


@query(dealt(**PLACED) + """, x as (select doc_id, coalesce(regexp_extract(place, '([0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4})', 1), '') as a, coalesce(regexp_extract(place, '(?i)([0-9]{1,2}\\s+[a-z]{3,9}\\s+[0-9]{2,4})', 1), '') as b from d),
    y as (select doc_id, coalesce(cast(try_strptime(a, '%d/%m/%Y') as date), cast(try_strptime(b, '%d %B %Y') as date)) as day from x) """ + f"select doc_id, case when day > {TODAY} then strftime(day, '%Y-%m-%d') end as day from y")
def deadline_in_location(spark, sf_dir):
    """A coming date that stands in a place."""
    d = documents(spark, sf_dir, **PLACED)
    return d.select("doc_id", F.date_format(repair.deadline_in_location(F.col("place"), DAY), "yyyy-MM-dd").alias("day"))


@query(dealt(**PLACED) + f""", x as (select doc_id, lower(trim(title)) as t, lower(trim(place)) as l, place, array_to_string(list_filter(string_split(place, ' '), lambda w: lower(w) not in {in_sql(C.DATE_FRAGMENTS)}), ' ') as plain from d)
    select doc_id, case when coalesce(place, '') = '' then false when l = t then true when length(t) > 5 and contains(l, t) then true when contains(l, 'officer') or contains(l, 'manager') then true when length(place) < 3 then true else plain <> place end as repaired,
    case when coalesce(place, '') = '' then null when l = t then null when length(t) > 5 and contains(l, t) then 'Rome' when contains(l, 'officer') and contains(place, ' Rome') then null when contains(l, 'officer') or contains(l, 'manager') then null when length(place) < 3 then null else plain end as value,
    case when coalesce(place, '') = '' then null when l = t then 'Location identical to title' when length(t) > 5 and contains(l, t) then 'Location contained title' when contains(l, 'officer') or contains(l, 'manager') then 'Location was job title' when length(place) < 3 then 'Location invalid after cleaning' when plain <> place then 'Location contained date fragments' end as issue from x""")
def repair_locations(spark, sf_dir):
    """Places that are or hold a title, keywords or left-over dates."""
    d = documents(spark, sf_dir, **PLACED)
    return d.select("doc_id", repair.repair_location(F.col("place"), F.col("title")).alias("r")).select("doc_id", "r.repaired", "r.value", "r.issue")


GUESSED = {
    "descr": one_of(["Work in Geneva with us", "Deadline: 01/09/2024 sharp", "apply by 1-1-2020", "nothing", None]), "url": one_of(["https://jobs.france.org/1", "https://x.org/2", "", None], 2), "org": one_of(["UNDP", "Small NGO", None, "unesco office"], 3),
    "title": one_of(["Cook", "", "Nurse"], 5),
}


@query(dealt(**GUESSED) + """select doc_id, case when contains(lower(descr), 'geneva') then 'Geneva, Switzerland' when contains(lower(regexp_extract(url, '://([^/?#]*)', 1)), 'france') then 'Paris, France' when contains(lower(org), 'unesco') then 'Paris, France' when contains(lower(org), 'undp') then 'New York, USA' end as place,
    case when descr like 'Deadline: 01/09/2024%' then '2024-09-01' when title <> '' and url <> '' then '2024-07-15' end as due from d""")
def infer_fields(spark, sf_dir):
    """Place and deadline guessed from description, host and organisation."""
    d = documents(spark, sf_dir, **GUESSED)
    return d.select("doc_id", repair.infer_location(F.col("descr"), F.col("url"), F.col("org")).alias("place"), F.date_format(repair.infer_deadline(F.col("descr"), F.col("title"), F.col("url"), DAY), "yyyy-MM-dd").alias("due"))


BROKEN = {"title": one_of(["Programme  Officer", "Cook"]), "place": one_of(["Rome", None], 2), "descr": one_of(["Work in Geneva", None], 4)}


@query(dealt(**BROKEN) + """select doc_id, regexp_replace(title, '\\s+', ' ', 'g') as title, coalesce(place, case when descr is not null then 'Geneva, Switzerland' end) as place, case when doc_id % 3 = 0 then '2024-08-01' else '2024-07-15' end as due,
    array_to_string(list_filter([case when place is null and descr is not null then 'location inferred' end, case when doc_id % 3 <> 0 then 'deadline inferred' end, case when title like '%  %' then 'title cleaned' end], lambda x: x is not null), '; ') as repairs from d""")
def repair_records(spark, sf_dir):
    """Whole records repaired, with what was done."""
    d = documents(spark, sf_dir, **BROKEN)
    due = F.when(F.col("doc_id") % 3 == 0, F.lit("2024-08-01")).cast("date")
    r = repair.repair({"title": F.col("title"), "location_raw": F.col("place"), "deadline": due, "description": F.col("descr"), "apply_url": F.lit("https://x.org/1"), "org_name": F.lit(None).cast("string")}, DAY)
    return d.select("doc_id", r.alias("r")).select("doc_id", "r.title", F.col("r.location_raw").alias("place"), F.date_format("r.deadline", "yyyy-MM-dd").alias("due"), F.array_join("r.repairs", "; ").alias("repairs"))


LEVELLED = {
    "title": one_of(["Intern", "Chief of Staff", "Programme Officer", "Technical Advisor", "Programme P-4", "Driver G 5", "Cook", "Country Director D-1", None, ""]), "label": one_of([None, "Officer / Associate", "none", None, "Head of Unit / Director"], 10),
    "org_type": one_of(["un", "ngo"], 50),
}


@query(dealt(**LEVELLED) + """select doc_id, coalesce(case label when 'Officer / Associate' then 'Officer / Professional' when 'Head of Unit / Director' then 'Head / Director' end,
    case when coalesce(title, '') = '' then null else coalesce(case when org_type = 'un' then case title when 'Programme P-4' then null when 'Country Director D-1' then 'Head / Director' when 'Driver G 5' then 'Junior / Associate' end end,
    case when org_type = 'un' and contains(title, 'P-4') then 'Officer / Professional' end,
    case title when 'Intern' then 'Entry / Intern' when 'Chief of Staff' then 'Executive / Chief' when 'Programme Officer' then 'Officer / Professional' when 'Technical Advisor' then 'Specialist / Advisor' when 'Country Director D-1' then 'Head / Director' when 'Cook' then 'Entry / Intern' else 'Entry / Intern' end) end, 'stored') as level from d""")
def job_levels(spark, sf_dir):
    """Level by enrichment label, grade or title, else what is stored."""
    d = documents(spark, sf_dir, **LEVELLED)
    none = F.lit(None).cast("string")
    return d.select("doc_id", repair.job_level(F.col("title"), none, F.col("label"), F.col("org_type"), F.lit("stored")).alias("level"))


@query(f"""with e as (select doc_id, case when doc_id % 4 = 0 then ['Health', 'Moon'] else ['WASH'] end as domains, case doc_id % 3 when 0 then 'Junior' when 1 then 'Boss' end as level, [cast(doc_id % 20 as integer), 3] as goals, doc_id % 13 / 10.0 as c from documents)
    select doc_id, array_to_string(list_filter(domains, lambda x: x in ('Health', 'WASH')), ',') as domains, case when level = 'Junior' then level end as level, array_to_string(list_filter(goals, lambda x: x between 1 and 17), ',') as goals, case when c between 0 and 1 then round(c, 6)::double end as confidence,
    case when c between 0 and 1 then round(case when doc_id % 2 = 0 then c * 0.5 else c end, 6)::double end as scaled from e""")
def enrichment_validation(spark, sf_dir):
    """Enrichments reduced to known values and sane confidences, which are scaled by the input's quality."""
    k = F.col("doc_id")
    c = (k % 13 / 10.0).cast("double")
    e = {
        "impact_domain": F.when(k % 4 == 0, F.array(F.lit("Health"), F.lit("Moon"))).otherwise(F.array(F.lit("WASH"))), "functional_role": F.array(F.lit("Cook")), "experience_level": F.when(k % 3 == 0, "Junior").when(k % 3 == 1, "Boss"),
        "sdgs": F.array((k % 20).cast("int"), F.lit(3)), "impact_confidences": F.create_map(F.lit("Health"), c), "sdg_confidences": F.create_map(F.lit("3"), c),
    }
    v = repair.valid_enrichment(e, ["Health", "WASH"], ["Cook"], ["Junior", "Mid"])
    d = table(spark, sf_dir, "documents").select("doc_id", v.alias("v"))
    scaled = repair.scaled(F.col("v.impact_confidences"), F.when(k % 2 == 0, 0.5).otherwise(0.9))
    return d.select("doc_id", F.array_join("v.impact_domain", ",").alias("domains"), F.col("v.experience_level").alias("level"), F.array_join(F.transform("v.sdgs", lambda s: s.cast("string")), ",").alias("goals"), F.round(F.col("v.impact_confidences")["Health"], 6).alias("confidence"), F.round(scaled["Health"], 6).alias("scaled"))


@query("""with e as (select doc_id, doc_id % 100 / 100.0 as o, doc_id % 37 / 37.0 as x, doc_id % 11 / 11.0 as m, doc_id % 5 = 0 as low from documents)
    select doc_id, cast(o < 0.60 as integer) + cast(x <> 0 and x < 0.65 as integer) + cast(m < 0.70 as integer) + cast(low as integer) as n_reasons, low or o < 0.60 or (x <> 0 and x < 0.65) or m < 0.70 as review from e""")
def enrichment_review(spark, sf_dir):
    """Which enrichments go to review."""
    k = F.col("doc_id")
    reasons = repair.review_reasons(k % 100 / 100.0, k % 37 / 37.0, F.create_map(F.lit("Health"), k % 11 / 11.0), k % 5 == 0)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(reasons).alias("n_reasons"), (F.size(reasons) > 0).alias("review"))


TEXTS = {"title": one_of(["senior  officer", "WASH McKay lead", "", "nurse"]), "org": one_of(["Red Cross", "", None], 2), "descr": one_of(["too short", "A long description that names the Red Cross and goes on for a while, as it has to.", None], 3), "url": one_of(["https://a.org/1", ""], 4)}


@query(dealt(**TEXTS) + """, x as (select *, trim(regexp_replace(coalesce(descr, ''), '\\s+', ' ', 'g')) as s from d),
    y as (select *, case when length(s) < 50 and url <> '' then s || ' [Full description available at: ' || url || ']' else s end as t from x)
    select doc_id, case title when 'senior  officer' then 'Senior Officer' when 'WASH McKay lead' then 'WASH McKay Lead' when 'nurse' then 'Nurse' else '' end as title, trim(case when coalesce(org, '') = '' or contains(lower(t), lower(org)) then t else 'Organization: ' || org || '. ' || t end) as descr,
    concat_ws(' | ', nullif(title, ''), nullif(org, ''), substr(descr, 1, 500), 'k1 | k2') as input from y""")
def enhanced_texts(spark, sf_dir):
    """Title case, fuller descriptions and the input of an embedding."""
    d = documents(spark, sf_dir, **TEXTS)
    keywords = F.array(F.lit("k1"), F.lit("k2"))
    return d.select("doc_id", repair.title_case(F.col("title")).alias("title"), repair.enhanced(F.col("descr"), F.col("url"), F.col("org")).alias("descr"), repair.embedding_input(F.col("title"), F.col("org"), F.col("descr"), keywords).alias("input"))


@query("""with e as (select event_id, case event_type when 'error' then 'fail' else 'ok' end as s, event_id % 3 as changes, user_id % 6 as f, user_id % 4 as u from events)
    select event_id, cast(case when s <> 'ok' then f + 1 else 0 end as bigint) as failures, cast(case when s <> 'ok' then u when changes = 0 then u + 1 else 0 end as bigint) as unchanged, case when s <> 'ok' and f + 1 >= 5 then 'paused' else 'active' end as status from e""")
def run_counters(spark, sf_dir):
    """Counters of failures and of runs without change, with the pause after five failures."""
    e = table(spark, sf_dir, "events")
    c = repair.counters(F.when(F.col("event_type") == "error", "fail").otherwise("ok"), F.col("event_id") % 3, F.col("user_id") % 6, F.col("user_id") % 4)
    return e.select("event_id", c.alias("c")).select("event_id", F.col("c.failures").cast("long").alias("failures"), F.col("c.unchanged").cast("long").alias("unchanged"), "c.status")


HEURISTIC = {"place": one_of(["Remote", "Work from Home", "Rome", "Rome; Oslo", "Rome/Oslo", None, "Online, anywhere"]), "pay": one_of(["$50,000 - $70,000", "40000–45000 EUR", "none", "£30,000 - £31,000", None], 7)}


@query(dealt(**HEURISTIC).replace("with d as", "with e as") + """, d as (select doc_id, place, case when pay not like '£%' then pay end as pay from e) select doc_id, case when contains(lower(place), 'remote') or contains(lower(place), 'work from home') or contains(lower(place), 'online') then 'remote' when place is not null and not regexp_matches(place, '[/;,]') then 'onsite' end as kind,
    try_cast(replace(regexp_extract(pay, '([0-9,]+)\\s*[-–]', 1), ',', '') as bigint) as low, try_cast(replace(regexp_extract(pay, '[-–]\\s*[$£]?([0-9,]+)', 1), ',', '') as bigint) as high,
    case when pay like '$%' then 'USD' when pay like '%EUR' then 'EUR' end as currency from d""")
def place_and_pay(spark, sf_dir):
    """Remote or on site by words, and pay ranges, of which only a dollar sign may stand after the dash."""
    d = documents(spark, sf_dir, **HEURISTIC)
    pay = repair.salary_range(F.col("pay"))
    return d.select("doc_id", repair.location_kind(F.col("place")).alias("kind"), pay["min"].alias("low"), pay["max"].alias("high"), pay["currency"].alias("currency"))


@query("""with u as (select page_id, case page_id % 4 when 0 then url || '?job_id=' || page_id || '&x=1' when 1 then url || '#part' when 2 then url || '?x=1&VacancyNo=7' else url end as u from pages),
    b as (select page_id, u, regexp_replace(regexp_replace(u, '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') as b from u),
    p as (select page_id, split_part(b, '?', 1) as path, list_filter(string_split(regexp_extract(b, '^[^?]*[?](.*)$', 1), '&'), lambda p: contains(lower(p), 'id') or contains(lower(p), 'job') or contains(lower(p), 'position') or contains(lower(p), 'vacancy')) as ids from b)
    select page_id, substr(sha256(path || case when len(ids) > 0 then '?' || array_to_string(ids, '&') else '' end), 1, 16) as id from p""")
def canonical_ids(spark, sf_dir):
    """Ids of pages by host, path and the parameters that look like ids."""
    k, u = F.col("page_id"), F.col("url")
    url = F.when(k % 4 == 0, F.concat(u, F.lit("?job_id="), k.cast("string"), F.lit("&x=1"))).when(k % 4 == 1, F.concat(u, F.lit("#part"))).when(k % 4 == 2, F.concat(u, F.lit("?x=1&VacancyNo=7"))).otherwise(u)
    return table(spark, sf_dir, "pages").select("page_id", links.canonical_id(url).alias("id"))


@query("select conv_id, turn, " + ", ".join([
    f"case {' '.join(f'when {any_sql(chr(120), words)} then {text(level)}' for words, level in C.QUERY_LEVELS)} else '' end as experience_level",
    f"array_to_string(list_filter(list_value({', '.join(f'case when contains(x, {text(k)}) then {text(v)} end' for k, v in C.QUERY_DOMAINS.items())}), lambda v: v is not null)[:1], '') as first_domain",
    f"array_to_string(list_filter(list_value({', '.join(f'case when contains(x, {text(k)}) then {text(v)} end' for k, v in C.QUERY_ROLES.items())}), lambda v: v is not null)[:1], '') as first_role",
    f"case {' '.join(f'when contains(x, {text(c)}) then {text(c.title())}' for c in C.QUERY_COUNTRIES)} else '' end as location",
]) + " from (select conv_id, turn, lower(text) as x from conversations where role = 'user')")
def plain_query_parts(spark, sf_dir):
    """Level, first domain, first role and country guessed from the users' turns."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    out = search.parse_queries(c, "text")
    return out.select("conv_id", "turn", "experience_level", F.coalesce(F.get("impact_domain", 0), F.lit("")).alias("first_domain"), F.coalesce(F.get("functional_role", 0), F.lit("")).alias("first_role"), "location")
