"""Fields from web pages: JSON-LD, labels, tables, lists, and the choice between them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import links
from tessera.functions.cells import share

FIELD = "struct<value:string,source:string,confidence:double,raw_snippet:string>"
#: Words that name a field in a label or a table header (fixed values).
LABELS = {
    "location": ["location", "duty station", "country", "city", "place"],
    "deadline": ["deadline", "closing date", "closing", "apply by", "application deadline", "due"],
    "posted_on": ["posted", "date posted", "published", "publication date"],
    "requirements": ["requirements", "qualifications", "experience"],
    "title": ["title", "job title", "position", "vacancy", "post"],
    "apply_url": ["apply", "link"],
}
#: Confidence of each stage of extraction, in the order in which they run.
STAGES = {"jsonld": 0.9, "meta": 0.7, "dom": 0.6, "heuristic": 0.55, "regex": 0.4}


def json_ld(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Postings in the JSON-LD scripts of pages: (key, title, employer, location, posted_on, deadline, apply_url).

    A script holds one object, a list, a @graph, or an itemListElement; objects of other types are left out.
    """
    script = F.regexp_extract_all("html", F.lit(r"""(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"""), 1)
    body = pages.select(key, F.explode(script).alias("body")).withColumn("body", F.trim("body"))
    lists = F.coalesce(
        F.from_json(F.when(F.col("body").startswith("["), F.col("body")), "array<string>"),
        F.from_json(F.get_json_object("body", "$['@graph']"), "array<string>"),
        F.from_json(F.get_json_object("body", "$.itemListElement"), "array<string>"),
        F.array("body"),
    )
    item = body.select(key, F.explode(lists).alias("o"))
    item = item.select(key, F.coalesce(F.get_json_object("o", "$.item"), F.col("o")).alias("o")).where(F.get_json_object("o", "$['@type']").contains("JobPosting"))

    def at(*paths: str) -> Column:
        return F.coalesce(*[F.get_json_object("o", p) for p in paths])

    address = "$.jobLocation.address"
    first = "$.jobLocation[0].address"
    place = F.concat_ws(", ", at(f"{address}.addressLocality", f"{first}.addressLocality"), at(f"{address}.addressRegion", f"{first}.addressRegion"), at(f"{address}.addressCountry.name", f"{address}.addressCountry", f"{first}.addressCountry"))
    return item.select(key, at("$.title", "$.name").alias("title"), at("$.hiringOrganization.name", "$.hiringOrganization").alias("employer"), F.when(place != "", place).alias("location"), at("$.datePosted").alias("posted_on"), at("$.validThrough").alias("deadline"), at("$.url").alias("apply_url"))


class Outline(HTMLParser):
    """Label-value pairs, table rows and anchors of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pairs: list[tuple[str, str]] = []
        self.tables: list[list[list[tuple[str, str]]]] = []
        self.links: list[tuple[str, str]] = []
        self._text: list[str] = []
        self._href = ""
        self._label: str | None = None
        self._row: list[tuple[str, str]] | None = None
        self._link: list[str] | None = None
        self._skip = 0

    def _take(self) -> str:
        text = " ".join("".join(self._text).split())
        self._text = []
        return text

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self._skip += 1
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self._row = []
            self.tables[-1].append(self._row)
        elif tag in ("td", "th", "dt", "dd", "label"):
            self._text, self._href = [], ""
        elif tag == "a":
            self._href = next((v or "" for k, v in attrs if k == "href"), "")
            self._link = []

    def handle_data(self, data):
        if not self._skip:
            self._text.append(data)
            if self._link is not None:
                self._link.append(data)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self._skip = max(0, self._skip - 1)
        elif tag == "a" and self._link is not None:
            self.links.append((" ".join("".join(self._link).split()), self._href))
            self._link = None
        elif tag in ("dt", "label"):
            self._label = self._take().rstrip(":").lower()
        elif tag == "dd" and self._label:
            self.pairs.append((self._label, self._take()))
            self._label = None
        elif tag in ("td", "th") and self._row is not None:
            text = self._take()
            if tag == "td" and len(self._row) == 1 and self._row[0][1] == "th":
                self.pairs.append((self._row[0][0].rstrip(":").lower(), text))
            self._row.append((text, "th" if tag == "th" else self._href))


def outline(page: str | None) -> Outline:
    o = Outline()
    o.feed(page or "")
    o.close()
    return o


def field_of(label: str) -> str | None:
    return next((f for f, words in LABELS.items() if any(w in label for w in words)), None)


def label_fields(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, field, value) of the labelled values of pages (dl lists, labels, th and td)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, f, v) for k, h in zip(b["k"], b["html"], strict=True) for label, v in outline(h).pairs if (f := field_of(label)) and v]
            yield pd.DataFrame(rows, columns=["k", "field", "value"])

    return pages.select(F.col(key).cast("string").alias("k"), "html").mapInPandas(read, "k string, field string, value string").withColumnRenamed("k", key)


def table_rows(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Postings in tables whose first row names a title column: (key, n, title, location, deadline, apply_url)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, h in zip(b["k"], b["html"], strict=True):
                n = 0
                for t in outline(h).tables:
                    names = [field_of(c[0].lower()) for c in t[0]] if t else []
                    if "title" not in names:
                        continue
                    for r in t[1:]:
                        cells = {f: c for f, c in zip(names, r, strict=False) if f}
                        title = cells.get("title", ("", ""))
                        if title[0]:
                            href = next((c[1] for c in [title, *r] if c[1] and c[1] != "th"), None)
                            rows.append((k, n, title[0], cells.get("location", (None,))[0], cells.get("deadline", (None,))[0], href))
                            n += 1
            yield pd.DataFrame(rows, columns=["k", "n", "title", "location", "deadline", "apply_url"])

    return pages.select(F.col(key).cast("string").alias("k"), "html").mapInPandas(read, "k string, n int, title string, location string, deadline string, apply_url string").withColumnRenamed("k", key)


def link_rows(pages: DataFrame, key: str = "page_id", least: float = 0.0, most: int | None = 500) -> DataFrame:
    """The links of each page that score above ``least``, best first, at most ``most`` a page if any: (key, rank, text, href, score)."""
    found = pages.select(key, F.posexplode(links.page_links(F.col("html"))).alias("n", "a")).select(key, "n", "a.text", "a.href")
    found = found.withColumn("score", links.link_score(F.col("text"), F.col("href"))).where(F.col("score") > least)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), F.asc("n")))
    ranked = found.withColumn("rank", rank)
    return (ranked if most is None else ranked.where(F.col("rank") <= most)).select(key, "rank", "text", "href", "score")


def field_rows(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, field, stage, confidence, value) of all stages, long."""
    k = F.col(key).cast("string").alias(key)

    def rows(df: DataFrame, stage: str, names: dict[str, Column]) -> DataFrame:
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in names.items()]))
        return df.select(k, pairs.alias("p")).select(key, "p.field", F.lit(stage).alias("stage"), F.lit(STAGES[stage]).alias("confidence"), "p.value")

    html = F.col("html")
    ld = json_ld(pages, key)
    out = rows(ld, "jsonld", {c: F.col(c) for c in ("title", "employer", "location", "posted_on", "deadline", "apply_url")})
    out = out.unionByName(rows(pages, "meta", {"title": links.meta_title(html), "description": links.meta_description(html)}))
    h1 = F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    out = out.unionByName(rows(pages, "dom", {"title": links.text_of(h1)}))
    out = out.unionByName(label_fields(pages, key).select(key, "field", F.lit("heuristic").alias("stage"), F.lit(STAGES["heuristic"]).alias("confidence"), "value"))
    out = out.unionByName(rows(pages, "regex", {"deadline": links.deadline_text(links.text_of(html))}))
    return out.where("value is not null and value <> ''")


def best_fields(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """The value of highest confidence per field; the earlier stage among equals."""
    order = F.create_map(*[x for i, s in enumerate(STAGES) for x in (F.lit(s), F.lit(i))])
    others = [c for c in rows.columns if c not in (key, "field")]
    # Grouped and not ranked, so that tasks choose before rows are dealt.
    best = rows.groupBy(key, "field").agg(F.min_by(F.struct(*others), F.struct(F.isnull("confidence"), -F.col("confidence"), order[F.col("stage")], F.col("value"))).alias("_best"))
    return best.select(*[F.col(f"_best.{c}").alias(c) if c in others else F.col(c) for c in rows.columns])


def extract(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per page: fields (a map of structs), is_job, score, confidence."""
    best = best_fields(field_rows(pages, key), key)
    cell = F.struct("value", F.col("stage").alias("source"), "confidence", F.substring("value", 1, 100).alias("raw_snippet"))
    fields = best.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", cell.alias("cell")))).alias("fields"), F.avg("confidence").alias("confidence"))
    score = links.page_score(F.col("html"), F.col("url"))
    scored = pages.select(F.col(key).cast("string").alias(key), "url", F.round(score, 2).alias("score"), (score >= 0.5).alias("is_job"), links.canonical_id(F.col("url")).alias("canonical_id"))
    return scored.join(fields, key, "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def strategy(html: Column) -> Column:
    """struct(strategy, confidence): the way of extraction that a page's structure suggests, the first among equals."""
    low = F.lower(html)

    def count(pattern: str) -> Column:
        return F.regexp_count(low, F.lit(pattern))

    scores = {
        "json_ld": F.least(count(r"application/ld\+json"), F.lit(1)) * 0.95,
        "table": F.when((count("<table") > 0) & (count("<tr") >= 3), F.least(F.lit(0.9), 0.5 + count("<tr") * 0.02)).otherwise(0.0),
        "list": F.when(count("<li") >= 3, F.least(F.lit(0.7), 0.3 + count("<li") * 0.01)).otherwise(0.0),
        "links": F.when(count("<a ") > 0, F.least(F.lit(0.5), 0.2 + count("<a ") * 0.01)).otherwise(0.0),
        "generic": F.lit(0.1),
    }
    best = F.greatest(*scores.values())
    return F.struct(F.coalesce(*[F.when(s == best, F.lit(k)) for k, s in scores.items()]).alias("strategy"), best.cast("double").alias("confidence"))


def plugin(url: Column, plugins: list[tuple[str, int, str]], preferred: Column | None = None) -> Column:
    """Name of the plugin for a page: the preferred one if known, else the first by falling priority whose host fits, else generic.

    ``plugins``: (name, priority, part of the host).
    """
    host = F.lower(F.regexp_extract(url, r"://([^/?#:]*)", 1))
    fits = [F.when(host.contains(part), F.lit(name)) for name, _, part in sorted(plugins, key=lambda p: -p[1])]
    asked = [F.when(preferred.isin([p[0] for p in plugins]), preferred)] if preferred is not None else []
    return F.coalesce(*asked, *fits, F.lit("generic"))


def enrich_from_details(jobs: DataFrame, details: DataFrame) -> DataFrame:
    """Fills missing deadline, location and grade of records from their detail pages (apply_url, html)."""
    text = links.text_of(F.col("html"))
    found = details.select(
        F.col("apply_url").alias("d_url"), links.deadline_text(text).alias("d_deadline"),
        F.regexp_extract(text, r"(?:Location|Duty station)\s*:\s*([^.;|]{2,60}?)(?=\s+[A-Z][a-z]+\s*:|[.;|]|$)", 1).alias("d_location"),
        F.regexp_extract(text, r"(?i)\b(?:grade|level)\s*:\s*([PGD]-?\d)", 1).alias("d_grade"),
    )
    joined = jobs.join(found.dropDuplicates(["d_url"]), F.col("apply_url") == F.col("d_url"), "left")
    fill = {c: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.when(F.col(f"d_{p}") != "", F.col(f"d_{p}"))) for c, p in (("deadline", "deadline"), ("location_raw", "location"), ("grade", "grade")) if c in jobs.columns}
    return joined.withColumns(fill).select(*jobs.columns)
