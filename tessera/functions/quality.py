"""Quality scores and validation of records."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.functions.cells import any_of, blank, clamp, has_any, labels, share
from tessera.functions.links import plain_url


def quality_factors(job: dict[str, Column]) -> dict[str, Column]:
    """Factor of each field: 1 good, 0.5 or 0.7 partly, 0 missing.

    ``job`` maps title, apply_url, location_raw, latitude, longitude, is_remote, deadline (a string), description,
    org_name and country to Columns.
    """
    title, url, text = F.trim(job["title"]), F.trim(job["apply_url"]), F.trim(job["description"])
    placed = ~blank(job["location_raw"])
    exact = (job["latitude"].isNotNull() & job["longitude"].isNotNull()) | F.coalesce(job["is_remote"], F.lit(False))

    def grade(c: Column, good: Column, partly: float = 0.5) -> Column:
        return F.when(blank(c), 0.0).when(good, 1.0).otherwise(partly)

    return {
        "title": grade(title, F.length(title) >= 5),
        "apply_url": grade(url, url.startswith("http://") | url.startswith("https://")),
        "location": F.when(~placed, 0.0).when(exact, 1.0).otherwise(0.7),
        "deadline": grade(job["deadline"], (F.length(job["deadline"]) == 10) & (F.length(F.regexp_replace(job["deadline"], "[^-]", "")) == 2)),
        "description": grade(text, F.length(text) >= 50),
        "org_name": F.when(blank(job["org_name"]), 0.0).otherwise(1.0),
        "geocoding": F.when(placed & exact, 1.0).otherwise(0.0),
        "country": F.when(blank(job["country"]), 0.0).otherwise(1.0),
    }


def grade(score: Column) -> Column:
    out = F.lit("very_low")
    for name, least in reversed(C.QUALITY_GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def quality(job: dict[str, Column], as_of: date) -> Column:
    """struct(score, grade, factors, issues, needs_review) of a record; deadlines count as past before ``as_of``."""
    factors = quality_factors(job)
    total = sum((factors[k] * w for k, w in C.QUALITY_WEIGHTS.items()), F.lit(0.0))
    score = F.bround(total, 3)
    past = F.try_to_date(job["deadline"], "yyyy-MM-dd") < F.lit(as_of)
    issues = labels([
        (factors["title"] == 0.5, "Title too short"),
        (factors["apply_url"] == 0.5, "Invalid URL format"),
        (factors["deadline"] == 0.5, "Deadline format unclear"),
        (~blank(job["location_raw"]) & blank(job["country"]) & ~F.coalesce(job["is_remote"], F.lit(False)), "Location present but country missing"),
        (past, "Deadline in the past"),
    ])
    # Rounded far beyond any threshold, so that sums such as .85 meet theirs.
    level = grade(F.round(total, 9))
    return F.struct(
        score.alias("score"), level.alias("grade"),
        F.create_map(*[x for k, v in factors.items() for x in (F.lit(k), v)]).alias("factors"),
        issues.alias("issues"), (level.isin("low", "very_low") | (F.size(issues) > 0)).alias("needs_review"),
    )


def is_listing(url: Column, parts=C.LISTING_SOURCE) -> Column:
    """Whether a url looks like a listing page; case counts; false for null."""
    return has_any(url, parts)


def report_score(total: Column, no_url: Column, listing: Column, no_title: Column, short_title: Column, duplicates: Column) -> Column:
    """0 to 100: less 30, 25, 20, 10 and 15 times the shares of the faults; 0 where there is nothing."""
    lost = share(no_url, total) * 30 + share(listing, total) * 25 + share(no_title, total) * 20 + share(short_title, total) * 10 + share(duplicates, total) * 15
    return F.when(total == 0, 0.0).otherwise(clamp(100 - lost, 0.0, 100.0))


def upsert_error(title: Column, url: Column) -> Column:
    """The first reason why a record may not be stored, null if there is none."""
    t, u = F.trim(title), F.trim(url)
    return F.coalesce(
        F.when(blank(title), "Missing required field: title"),
        F.when(blank(url), "Missing required field: apply_url"),
        F.when(F.length(t) < 5, F.concat(F.lit("Title too short (minimum 5 characters): "), t)),
        F.when(u.rlike(r"(?i)^(#|javascript:|mailto:|tel:|data:)"), "Invalid URL pattern"),
        F.when(~u.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), "URL missing scheme"),
        F.when(~u.rlike(r"(?i)^https?:"), "Invalid URL scheme"),
        F.when(~u.rlike(r"(?i)^https?://[^/?#\s]+"), "URL missing domain"),
        F.when(F.length(u) > 2000, "URL too long"),
    )


def upsert_warnings(title: Column, location: Column, deadline: Column) -> Column:
    return labels([
        (F.length(F.trim(title)) > 500, "Title very long"),
        (~blank(deadline) & F.try_to_date(deadline, "yyyy-MM-dd").isNull(), "Deadline format unclear"),
        (F.length(F.trim(location)) > 500, "Location very long"),
    ])


def batch_errors(title: Column, url: Column, canonical: Column, base_url: Column | None = None) -> Column:
    """All reasons against a record of a batch."""
    t, u = F.trim(title), F.trim(url)
    same = (plain_url(u) == plain_url(base_url)) if base_url is not None else F.lit(False)
    no_url = F.coalesce(url == "", F.lit(True))
    return labels([
        (F.coalesce(title == "", F.lit(True)), "Missing title"),
        ((title != "") & (F.length(t) < 5), "Title too short"),
        (no_url, "Missing apply_url"),
        (~no_url & ~u.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+"), "Invalid URL format"),
        (~no_url & is_listing(F.lower(u)), "URL appears to be listing page"),
        (~no_url & same, "URL is base URL"),
        (F.coalesce(canonical == "", F.lit(True)), "Missing canonical_hash"),
        (F.length(canonical).between(1, 7), "canonical_hash too short"),
    ])


def extraction_error(title: Column, url: Column) -> Column:
    """The first reason why an extracted row is no posting, null if it may be one."""
    t, u = F.trim(title), F.trim(url)
    low, low_url = F.lower(t), F.lower(u)
    n = F.length(t)
    navs = sum((F.when(low.contains(w), 1).otherwise(0) for w in C.NAV_WORDS), F.lit(0))
    parts = F.split(t, ",")
    places = (F.size(parts) == 2) & F.forall(parts, lambda p: (F.length(F.trim(p)) < 20) & F.trim(p).rlike(r"^\p{Lu}")) & ~has_any(low, C.ROLE_WORDS)
    named = has_any(low, C.TITLE_WORDS)
    return F.coalesce(
        F.when(blank(title) | (n < 5), "missing title"),
        F.when(blank(url), "missing url"),
        F.when((navs > 0) & ((n < 25) | (navs >= 2)), "navigation"),
        F.when(any_of(low.rlike(p) for p in C.DATE_TITLES), "date"),
        F.when(places, "location"),
        F.when(u.startswith("#") | u.startswith("javascript:"), "invalid url"),
        F.when(low.isin(C.GENERIC_TITLES) & ~named, "generic"),
        F.when(any_of(low.rlike(p) for p in C.NON_TITLES), "not a posting"),
        F.when(~has_any(low_url, C.URL_WORDS) & (n < 15) & ~named, "url unlike a posting"),
    )


def tidy(title: Column, location: Column, deadline: Column, url: Column) -> Column:
    """struct of the four fields without label prefixes, runs of blanks and fragments."""

    def without(c: Column, prefix: str) -> Column:
        return F.regexp_replace(F.trim(c), rf"(?i)^({prefix})[:\s]+", "")

    def single(c: Column) -> Column:
        return F.regexp_replace(c, r"\s+", " ")

    return F.struct(
        single(without(title, "Job Title|Position|Title")).alias("title"),
        single(without(location, "Location|Duty Station|Based in")).alias("location_raw"),
        without(deadline, "Deadline|Closing|Apply by|Due").alias("deadline"),
        F.substring_index(F.trim(url), "#", 1).alias("apply_url"),
    )


def changed_fields(before: dict[str, Column], after: dict[str, Column]) -> Column:
    """Names of the fields whose values differ, null-safe, in the order of ``after``."""
    return labels([(~before[k].eqNullSafe(after[k]), k) for k in after])


def overall_confidence(fields: Column) -> Column:
    """Mean confidence over the fields (a map of structs) that hold a value, 0 if none does."""
    valid = F.filter(F.map_values(fields), lambda f: f["value"].isNotNull() & (f["value"] != ""))
    return share(F.aggregate(valid, F.lit(0.0), lambda a, f: a + f["confidence"]), F.size(valid))


def needs_model(fields: Column, critical=("title", "employer", "location", "deadline")) -> Column:
    """Whether more than one critical field is missing."""
    missing = sum((F.when(F.coalesce(fields[k]["value"], F.lit("")) == "", 1).otherwise(0) for k in critical), F.lit(0))
    return missing > 1
