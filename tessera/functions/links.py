"""Urls, hashes, links, contacts and page classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.functions.cells import any_of, bound, clamp, has_any, labels


def normalize_url(url: Column) -> Column:
    """Lower-case host, no tracking parameters, trailing slashes or fragment; null stays null."""
    base = F.regexp_replace(url, "#.*$", "")
    head = F.regexp_extract(base, r"^([^?]*)", 1)
    query = F.regexp_extract(base, r"^[^?]*\?(.*)$", 1)
    site = F.regexp_extract(head, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*)", 1)
    path = F.rtrim(F.substr(head, F.length(site) + 1), F.lit("/"))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(C.TRACKING))
    return F.concat(F.lower(site), path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def plain_url(url: Column) -> Column:
    """Without trailing slashes, then up to the fragment, then up to the query."""
    return F.substring_index(F.substring_index(F.rtrim(url, F.lit("/")), "#", 1), "?", 1)


def title_url_hash(title: Column, url: Column) -> Column:
    """md5 of lower(title|url); nulls count as empty."""
    return F.md5(F.lower(F.concat_ws("|", F.coalesce(title, F.lit("")), F.coalesce(url, F.lit("")))))


def canonical_hash(title: Column, url: Column, reference: Column | None = None) -> Column:
    """md5 of title|normalised url|reference, trimmed and lower-case, without outer bars."""
    parts = [F.lower(F.trim(title)), F.lower(normalize_url(url)), F.lower(F.trim(reference)) if reference is not None else F.lit("")]
    return F.md5(F.trim(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), F.lit("|")))


def dedupe_hash(employer: Column, title: Column, location: Column, url: Column) -> Column:
    """sha256 of the parts that are there, joined by bars; empty if none is."""
    parts = [F.when(F.trim(p) != "", F.lower(F.trim(p))) for p in (employer, title, location)] + [F.when(url != "", url)]
    joined = F.concat_ws("|", *parts)
    return F.when(joined == "", "").otherwise(F.sha2(joined, 256))


def canonical_id(url: Column) -> Column:
    """First 16 digits of sha256 of host, path and the parameters that look like ids."""
    base = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    ids = F.filter(F.split(F.regexp_extract(base, r"^[^?]*\?(.*)$", 1), "&"), lambda p: has_any(F.lower(p), ["id", "job", "position", "vacancy"]))
    return F.substring(F.sha2(F.concat(F.regexp_extract(base, r"^([^?]*)", 1), F.when(F.size(ids) > 0, F.concat(F.lit("?"), F.array_join(ids, "&"))).otherwise("")), 256), 1, 16)


def is_mailto(href: Column) -> Column:
    return F.lower(F.trim(href)).startswith("mailto:")


def is_blocked(text: Column) -> Column:
    return any_of(F.lower(F.trim(text)).startswith(b) for b in C.BLOCKED_LINKS)


def link_score(text: Column, href: Column, parent_class: Column | None = None, parent_id: Column | None = None) -> Column:
    """How likely a link leads to a posting, from 0 up; 0 for empty, mail, blocked, anchor and script links."""
    text, href = F.trim(text), F.trim(href)
    t, h = F.lower(text), F.lower(href)

    def points(condition: Column, value: float) -> Column:
        return F.when(condition, value).otherwise(0.0)

    parents = [F.lower(F.coalesce(p, F.lit(""))) for p in (parent_class, parent_id) if p is not None]
    n = F.length(text)
    score = (
        points(has_any(h, C.LINK_WORDS), 2.0)
        + points(has_any(t, C.LINK_WORDS), 1.5)
        + points(n >= 4, 0.5)
        + points(n >= 15, 1.0)
        - points(~text.rlike(r"\s") & (text == F.upper(text)) & (text != F.lower(text)) & (n < 10), 2.0)
        - points(text.contains("@") | text.endswith(".org") | text.endswith(".com"), 1.0)
        + points(has_any(h, C.DETAIL_PARTS), 1.5)
        + points(any_of(has_any(p, ["job", "position", "vacancy", "listing"]) for p in parents), 1.0)
    )
    rejected = F.coalesce((text == "") | (href == ""), F.lit(True)) | is_mailto(href) | is_blocked(text) | href.startswith("#") | href.startswith("javascript:")
    return F.when(rejected, 0.0).otherwise(F.greatest(F.lit(0.0), score))


def page_links(html: Column) -> Column:
    """Array of (text, href) of the anchors of a page, in order."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)(<a\s[^>]*>.*?</a>)"), 1)
    return F.transform(found, lambda a: F.struct(text_of(a).alias("text"), F.regexp_extract(a, r"""(?is)href\s*=\s*["']?([^"'\s>]*)""", 1).alias("href")))


def text_of(html: Column) -> Column:
    """Markup out, white space to single spaces."""
    plain = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def snippet(html: Column, size: int = 500) -> Column:
    return F.substring(text_of(html), 1, size)


def meta_title(html: Column) -> Column:
    """og:title, else the title element, else the first h1."""
    og = F.regexp_extract(html, r"""(?is)<meta[^>]+property=["']og:title["'][^>]+content=["']([^"']*)["']""", 1)
    title, h1 = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    return F.coalesce(*[F.when(F.trim(x) != "", F.trim(x)) for x in (og, title, h1)])


def meta_description(html: Column) -> Column:
    found = F.regexp_extract(html, r"""(?is)<meta[^>]+name=["']description["'][^>]+content=["']([^"']*)["']""", 1)
    return F.when(F.trim(found) != "", F.trim(found))


def emails(text: Column, most: int = 10) -> Column:
    """Distinct addresses among the first ``most`` found, in order."""
    return F.array_distinct(F.slice(F.regexp_extract_all(text, F.lit(r"\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z|]{2,})\b"), 1), 1, most))


def phones(text: Column, most: int = 10) -> Column:
    """Distinct numbers of 10 characters or more among the first ``most`` found, in order."""
    found = F.slice(F.regexp_extract_all(text, F.lit(r"(\+?[0-9\s\-()]{10,})"), 1), 1, most)
    return F.array_distinct(F.filter(F.transform(found, lambda p: F.regexp_replace(F.trim(F.regexp_replace(p, r"^\s+|\s+$", "")), r"\s+", " ")), lambda p: F.length(p) >= 10))


def page_score(html: Column, url: Column) -> Column:
    """How likely a page is a posting, 0 to 1; 0.5 and above is one."""
    text, u = F.lower(text_of(html)), F.lower(url)
    words = sum((F.when(text.contains(w), 1).otherwise(0) for w in C.PAGE_WORDS), F.lit(0))
    marked = html.rlike(r"""(?is)<[^>]+(class|id)=["'][^"']*(job|position|vacancy)""")
    control = html.rlike(r"(?is)<(a|button)[^>]*>[^<]*(apply|submit|candidate)[^<]*</(a|button)>")

    def points(condition: Column, value: float) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(0.0)

    score = F.least(words * 0.1, F.lit(0.4)) + points(has_any(u, C.PAGE_URL_PARTS), 0.3) + points(marked, 0.1) + points(control, 0.2) - points(has_any(F.substring(text, 1, 500), C.PAGE_NEGATIVES), 0.2)
    return clamp(score, 0.0, 1.0)


def deadline_text(text: Column) -> Column:
    """The date that follows deadline, closing date or apply by."""
    return F.regexp_extract(text, r"(?i)(?:deadline|closing(?: date)?|apply by)[:\s]+(\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}|\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}|[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4})", 1)


def parse_date(text: Column) -> Column:
    """A date in one of the formats seen, day before month; null for others."""
    return bound(F.trim(F.regexp_replace(text, r"(?i)^(deadline|closing|apply by|due)[:\s]+", "")), _parse_date)


def _parse_date(text: Column) -> Column:
    formats = ["yyyy-MM-dd", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy", "d/M/yy", "d-M-yy"]
    iso = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})T", 1)
    return F.coalesce(F.try_to_date(F.when(iso != "", iso), "yyyy-MM-dd"), *[F.try_to_date(text, f) for f in formats])


def extraction_flags(title: Column, posted: Column, deadline: Column, deadline_raw: Column, location: Column) -> Column:
    """Why an extracted row needs a look by hand."""
    return labels([
        (F.coalesce(F.trim(title) == "", F.lit(True)), "missing title"),
        (deadline < posted, "deadline before posting"),
        (deadline_raw.isNotNull() & deadline.isNull(), "unreadable date"),
        (F.lower(F.trim(location)).isin("global", "multiple", "various", "worldwide", "anywhere"), "generic location"),
    ])
