"""Faceted search over a wide record table."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.functions.cells import all_of, any_of, labels

#: Columns that a filter may name, by kind.
SCALARS = ["country_iso", "level_norm", "work_modality", "career_type", "org_type", "response_phase", "experience_level"]
FLAGS = ["international_eligible", "surge_required", "is_remote"]
ARRAYS = ["mission_tags", "crisis_type", "humanitarian_cluster", "benefits", "policy_flags", "donor_context", "impact_domain", "functional_role", "sdgs"]
TEXTS = ["title", "org_name", "description_snippet"]
#: Named filter sets.
COLLECTIONS = {
    "un-jobs": {"org_type": "un"},
    "remote": {"work_modality": "remote"},
    "consultancies": {"career_type": "consultancy"},
    "fellowships": {"career_type": "fellowship"},
    "surge": {"surge_required": True},
}


def visible(df: DataFrame, as_of: date) -> DataFrame:
    """Active records that are neither deleted nor past their deadline; the predicates reach the scan."""
    return df.where((F.col("status") == "active") & F.col("deleted_at").isNull() & (F.col("deadline").isNull() | (F.col("deadline") >= F.lit(as_of))))


def by_status(df: DataFrame, mode: str) -> DataFrame:
    """'active', 'deleted' or 'all'."""
    if mode == "deleted":
        return df.where(F.col("deleted_at").isNotNull())
    return df if mode == "all" else df.where(F.col("deleted_at").isNull())


def with_collection(name: str, filters: dict, **rest) -> SearchRequest:
    """A request for a named filter set together with the user's own filters; the set's values hold where both name one."""
    return SearchRequest(filters={**filters, **COLLECTIONS.get(name, {})}, **rest)


def text_match(q: str, columns: list[str], wildcards: bool = False) -> Column:
    """Whether any column contains ``q`` in any case. With ``wildcards``, % and _ in ``q`` act as such."""
    if wildcards:
        return F.coalesce(any_of(F.col(c).ilike(f"%{q}%") for c in columns), F.lit(False))
    return F.coalesce(any_of(F.coalesce(F.lower(F.col(c)).contains(q.lower()), F.lit(False)) for c in columns), F.lit(False))


def in_window(ts: Column, as_of: str, interval: str) -> Column:
    """Whether ``ts`` is at most ``interval`` before ``as_of``."""
    return ts >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {interval}")


def due(as_of: str, column: str = "next_run_at") -> Column:
    return F.col(column).isNull() | (F.col(column) <= F.lit(as_of).cast("timestamp"))


@dataclass(frozen=True)
class SearchRequest:
    """A query: words, raw filter values, page and order. Values that no lookup knows drop their filter."""

    q: str = ""
    filters: dict = field(default_factory=dict)
    page: int = 1
    size: int = 20
    sort: str = "newest"

    @property
    def clamped(self) -> tuple[int, int]:
        return max(1, self.page), min(100, max(1, self.size))


def canonical_filters(raw: dict) -> dict:
    """Canonical values of raw filters; unknown ones are left out rather than matching nothing."""

    def one(v: object) -> str:
        return str(v).strip().lower()

    names = {name.lower(): iso for iso, name in C.COUNTRIES.items()}
    out: dict = {}
    for k, v in raw.items():
        if v is None or v == "" or v == []:
            continue
        if k in ("country", "country_iso"):
            iso = str(v).strip().upper() if str(v).strip().upper() in C.COUNTRIES else names.get(one(v))
            out |= {"country_iso": iso} if iso else {}
        elif k == "level_norm":
            key = C.LEVEL_SYNONYMS.get(one(v), one(v))
            out |= {k: key} if key in C.LEVELS else {}
        elif k == "work_modality":
            key = C.MODALITY_SYNONYMS.get(one(v), one(v).replace("-", "_").replace(" ", "_"))
            out |= {k: key} if key in C.MODALITIES else {}
        elif k in FLAGS:
            known = {"true": True, "yes": True, "1": True, "false": False, "no": False, "0": False}
            if one(v) in known:
                out[k] = known[one(v)]
        elif k == "mission_tags":
            keys = [C.MISSION_SYNONYMS.get(one(x), one(x).replace("-", "_")) for x in v]
            out |= {k: keys} if (keys := [x for x in keys if x in C.MISSIONS]) else {}
        elif k in ("benefits", "policy_flags", "donor_context"):
            valid = {"benefits": C.BENEFITS, "policy_flags": C.POLICIES, "donor_context": C.DONORS}[k]
            keys = [x for x in (one(x).replace("-", "_").replace(" ", "_") for x in v) if x in valid]
            out |= {k: keys} if keys else {}
        elif k in ARRAYS:
            out[k] = list(v)
        elif k in SCALARS:
            out[k] = v
    return out


def predicates(filters: dict) -> list[Column]:
    """One predicate per canonical filter: equality, three-valued flags, overlap of arrays."""
    out = []
    for k, v in filters.items():
        if k in ARRAYS:
            element = "int" if k == "sdgs" else "string"
            out.append(F.coalesce(F.arrays_overlap(F.col(k), F.array(*[F.lit(x) for x in v]).cast(f"array<{element}>")), F.lit(False)))
        elif k in SCALARS or k in FLAGS:
            out.append(F.col(k) == F.lit(v))
        else:
            raise ValueError(f"no such filter: {k}")
    return out


def order_columns(sort: str) -> list[Column]:
    """Newest first with nulls before all, or closing soon with nulls last; id breaks ties."""
    if sort == "closing_soon":
        return [F.col("deadline").asc_nulls_last(), F.col("id").asc()]
    return [F.col("last_seen_at").desc_nulls_first(), F.col("created_at").desc_nulls_first(), F.col("id").asc()]


def ordered(df: DataFrame, columns: dict[str, str], by: str, descending: bool, tie: str) -> DataFrame:
    """Orders by a column that the caller may name, if ``columns`` knows it, else by the first known one."""
    name = columns.get(by, next(iter(columns.values())))
    return df.orderBy(F.col(name).desc_nulls_first() if descending else F.col(name).asc_nulls_last(), F.col(tie).asc())


def matches(df: DataFrame, request: SearchRequest, as_of: date) -> DataFrame:
    out = visible(df, as_of)
    if request.q.strip():
        out = out.where(text_match(request.q.strip(), TEXTS))
    return out.where(all_of(predicates(canonical_filters(request.filters))))


def paged(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of ``df``: a top-k, not a sort of everything."""
    page, size = max(1, page), min(100, max(1, size))
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_count(total: int, size: int) -> int:
    return ceil(total / size) if size else 0


def search(df: DataFrame, request: SearchRequest, as_of: date) -> tuple[DataFrame, DataFrame]:
    """(page of results with null arrays empty and reasons, one-row total)."""
    found = matches(df, request, as_of)
    page = paged(found, order_columns(request.sort), request.page, request.size)
    empty = {c: F.coalesce(c, F.array().cast(dict(page.dtypes)[c])) for c in ARRAYS if c in page.columns}
    return page.withColumns(empty).withColumn("reasons", reasons(request)), found.agg(F.count("*").alias("total"))


def reasons(request: SearchRequest) -> Column:
    """Up to three: mission, level, international, organisation."""
    f = canonical_filters(request.filters)
    tags = F.array(*[F.lit(t) for t in f.get("mission_tags", [])]).cast("array<string>")
    common = F.array_sort(F.array_intersect("mission_tags", tags))
    level, q = f.get("level_norm"), request.q.strip().lower()
    pairs = [
        (F.size(common) > 0, F.concat(F.lit("Mission: "), F.get(common, 0))),
        (F.col("level_norm") == F.lit(level), F.concat(F.lit("Level: "), F.col("level_norm"))),
        (F.lit(bool(f.get("international_eligible"))) & F.col("international_eligible"), "International eligible"),
        (F.lit(bool(q)) & F.lower("org_name").contains(q), F.concat(F.lit("Organization: "), F.col("org_name"))),
    ]
    return F.slice(labels(pairs), 1, 3)


def facet(df: DataFrame, column: str, top: int | None = 50) -> DataFrame:
    """Counts of a column's values, most frequent first, ties by value."""
    out = df.where(F.col(column).isNotNull()).groupBy(F.lower(F.col(column).cast("string")).alias("value") if dict(df.dtypes)[column] == "boolean" else F.col(column).alias("value")).agg(F.count("*").alias("n"))
    out = out.orderBy(F.desc("n"), F.asc("value"))
    return out if top is None else out.limit(top)


def array_facet(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    return df.select(F.explode(column).alias("value")).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("value")).limit(top)


def facets(df: DataFrame, columns: dict[str, int]) -> DataFrame:
    """(facet, value, n) of several scalar columns in one pass, each with its own limit."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("facet"), F.col(k).cast("string").alias("value")) for k in columns]))
    counts = df.select(pairs.alias("p")).select("p.*").where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), F.asc("value")))
    limits = F.create_map(*[x for k, v in columns.items() for x in (F.lit(k), F.lit(v))])
    return counts.withColumn("rank", rank).where(F.col("rank") <= limits[F.col("facet")]).drop("rank")


def parse_query(text: str) -> dict:
    """Filters guessed from a plain query by substrings, which also match inside words; ``free_text`` is what is left."""
    low = text.lower()
    out = {"impact_domain": [], "functional_role": [], "experience_level": "", "location": "", "is_remote": False, "free_text": text}
    if any(w in low for w in C.REMOTE_WORDS):
        rest = low
        for w in C.REMOTE_WORDS[:3]:
            rest = rest.replace(w, "")
        out |= {"is_remote": True, "free_text": rest.strip()}
    out["experience_level"] = next((level for words, level in C.QUERY_LEVELS if any(w in low for w in words)), "")
    for name, table in (("impact_domain", C.QUERY_DOMAINS), ("functional_role", C.QUERY_ROLES)):
        out[name] = list(dict.fromkeys(v for k, v in table.items() if k in low))[:2]
    if country := next((c for c in C.QUERY_COUNTRIES if c in low), ""):
        out |= {"location": country.title(), "free_text": out["free_text"].replace(country, "").strip()}
    return out


def parse_queries(df: DataFrame, column: str) -> DataFrame:
    """The same for a table of queries: adds is_remote, experience_level, impact_domain, functional_role, location."""
    low = F.lower(column)

    def first_two(table: dict) -> Column:
        return F.slice(F.array_distinct(labels([(low.contains(k), v) for k, v in table.items()])), 1, 2)

    return df.withColumns({
        "is_remote": F.coalesce(any_of(low.contains(w) for w in C.REMOTE_WORDS), F.lit(False)),
        "experience_level": F.coalesce(*[F.when(any_of(low.contains(w) for w in words), F.lit(v)) for words, v in C.QUERY_LEVELS], F.lit("")),
        "impact_domain": first_two(C.QUERY_DOMAINS),
        "functional_role": first_two(C.QUERY_ROLES),
        "location": F.coalesce(*[F.when(low.contains(c), F.lit(c.title())) for c in C.QUERY_COUNTRIES], F.lit("")),
    })


def suggestions(vocabulary: DataFrame, partial: str, top: int = 8) -> DataFrame:
    """Entries of a vocabulary (text, type, confidence, position) that contain ``partial``; surest first."""
    found = vocabulary.where(F.lower("text").contains(partial.strip().lower()) & F.lit(bool(partial.strip())))
    return found.orderBy(F.asc("position")).limit(top).select("text", "type", "confidence")


def match_score(job: dict[str, Column], wanted: dict) -> Column:
    """struct(score 0 to 100, up to three reasons): 30 domain, 30 role, 20 experience, 10 location, 10 remote."""

    def shared(c: Column, values: list[str]) -> Column:
        return F.array_sort(F.array_intersect(c, F.array(*[F.lit(v) for v in values]).cast("array<string>")))

    def mutual(c: Column, text: str) -> Column:
        low = F.lower(c)
        return F.lit(bool(text)) & (F.coalesce(c, F.lit("")) != "") & (low.contains(text.lower()) | F.lit(text.lower()).contains(low))

    domains, roles = shared(job["impact_domain"], wanted.get("impact_domain") or []), shared(job["functional_role"], wanted.get("functional_role") or [])
    place = F.coalesce(F.when(job["location_raw"] != "", job["location_raw"]), job["country"])
    parts = [
        (F.size(domains) > 0, 30.0, F.concat(F.lit("Matches Impact: "), F.array_join(F.slice(domains, 1, 2), ", "))),
        (F.size(roles) > 0, 30.0, F.concat(F.lit("Role: "), F.array_join(F.slice(roles, 1, 2), ", "))),
        (mutual(job["experience_level"], wanted.get("experience_level") or ""), 20.0, F.concat(F.lit("Experience: "), job["experience_level"])),
        (mutual(place, wanted.get("location") or ""), 10.0, F.concat(F.lit("Location: "), place)),
        (F.lit(bool(wanted.get("is_remote"))) & F.lower(job["work_modality"]).isin("remote", "hybrid", "work from home"), 10.0, F.lit("Remote work available")),
    ]
    score = sum((F.when(c, p).otherwise(0.0) for c, p, _ in parts), F.lit(0.0))
    return F.struct(F.least(F.lit(100.0), score).alias("score"), F.slice(labels([(c, r) for c, _, r in parts]), 1, 3).alias("reasons"))


def rerank(df: DataFrame, score: Column, rank: str) -> DataFrame:
    """Highest score first; rows of equal score keep their order by ``rank``."""
    return df.withColumn("match_score", score).orderBy(F.desc("match_score"), F.asc(rank))


def rolled_out(url: Column, percent: int, domains: list[str] | None = None) -> Column:
    """Whether md5(url) mod 100 is below ``percent``, or the host, without www., is on the list.

    The residue of the 128-bit number comes from those of its eight 16-bit parts, as 65536 is 36 modulo 100.
    """
    digest = F.md5(url)
    residue = F.lit(0)
    for k in range(8):
        residue = (residue * 36 + F.conv(F.substring(digest, 1 + 4 * k, 4), 16, 10).cast("int")) % 100
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"://([^/?#:]*)", 1)), r"^www\.", "")
    return (residue < percent) | (host.isin(domains) if domains else F.lit(False))


def policies(urls: DataFrame, known: DataFrame, defaults: dict) -> DataFrame:
    """Joins each url's host with its policy; hosts without one get the defaults."""
    host = F.lower(F.regexp_extract("url", r"://([^/?#:]*)", 1))
    joined = urls.withColumn("url_host", host).join(known, F.col("url_host") == F.col("host"), "left")
    return joined.select(*urls.columns, F.col("url_host").alias("host"), *[F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in defaults.items()])
