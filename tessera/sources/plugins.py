"""Site plugins as a table function: a page and a plugin's name in, its records out, called by lateral join."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tessera.functions.links import parse_date
from tessera.sources.nodes import read_page
from tessera.sources.pages import plugin

HEADS = ("h2", "h3", "h4", "h5", "h6")


@dataclass(frozen=True)
class Site:
    """How a site's pages are read.

    ``ways`` are tried in order until one gives records: ``labelled`` rows of tables that say Job Title, ``table`` rows
    under a header, ``containers`` by tag and part of the class, ``headings`` beside a place or a deadline.
    ``containers`` are tried in order too, each with at least ``least`` of them, then all elements of ``else_tags``. The
    title is that of the first element of ``title_tags`` in a container, ``letters`` long at least and without the
    words of ``leave_out``.
    """

    name: str
    hosts: tuple[str, ...]
    priority: int
    ways: tuple[str, ...]
    containers: tuple[tuple[str, str], ...] = ()
    least: int = 1
    else_tags: tuple[str, ...] = ()
    title_tags: tuple[str, ...] = ("h2", "h3", "h4", "a", "strong")
    letters: int = 5
    leave_out: tuple[str, ...] = ()
    #: Words of a page that cannot be read without running its scripts.
    unreadable: tuple[str, ...] = field(default=())


# Hosts, class parts and words of the sites that have a plugin.
SITES = [
    Site("undp", ("undp.org", "jobs.undp"), 90, ("labelled",)),
    Site("unesco", ("unesco.org",), 90, ("table", "containers"), (("div", "job"), ("li", "job"), ("div", "vacancy"), ("div", "position"), ("article", "job"))),
    Site("unicef", ("unicef.org",), 85, ("containers", "headings"), (("article", ""), ("div", "job"), ("div", "vacancy"), ("li", "job"), ("div", "listing"), ("div", "result"), ("div", "card"), ("div", "item"), ("div", "posting")), 1, (), (*HEADS, "a", "strong"), 10,
         ("learning and development", "compensation", "benefits", "job categories", "where we work", "more jobs", "privacy policy", "cookie statement", "job alerts", "register", "login", "subscribe", "refine search", "filter results", "choose language", "main menu", "contract type", "functional area", "next", "previous")),
    Site("amnesty", ("amnesty.org",), 80, ("containers",), (("div", "job"), ("article", "job"), ("li", "job"), ("div", "vacancy")), 2, ("div", "article", "li", "tr"), ("h2", "h3", "h4", "h5", "a", "strong"), 10, ("job alerts", "register now", "follow us", "privacy policy", "cookie statement", "main menu", "skip to", "choose language")),
    Site("save_the_children", ("savethechildren",), 80, ("containers",), (("div", "job"), ("tr", "job"), ("li", "job"), ("article", "job"), ("div", "position"), ("div", "vacancy"), ("tr", ""), ("div", "result"), ("div", "listing")), 2, (), ("h2", "h3", "h4", "a", "strong", "td"), 10,
         ("privacy policy", "unsupported browser", "save the children", "job board", "search", "filter", "sort"), ("unsupported browser",)),
    Site("generic", (), 0, ("table", "containers", "links"), (("div", "job"), ("li", "job"), ("div", "position"), ("div", "vacancy"), ("tr", "job"), ("article", "job"), ("div", "listing"), ("div", "career")), 1, (), ("h2", "h3", "h4", "a", "strong")),
]
#: Words of links that lead to postings, for pages without any structure.
LINK_WORDS = ["job", "position", "vacancy", "career", "opportunity", "consultant", "officer", "manager", "coordinator", "specialist"]
HEADER_WORDS = {"title": ["title", "position", "vacancy"], "location": ["location", "duty station", "country"], "deadline": ["deadline", "closing", "apply by"], "apply_url": ["apply", "link", "reference"]}
DATE = re.compile(r"(?i)^(\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{1,2}\s+[a-z]{3,9}\s+\d{2,4}|[a-z]{3,9}\s+\d{1,2},?\s+\d{2,4}|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)$")
#: Parts of addresses that speak for and against a posting's own page.
DETAIL, LISTING = ("/job/", "/position/", "/vacancy/", "/detail", "/view/", "/apply", "/opportunity/"), ("/jobs", "/careers", "/vacancies", "/opportunities", "/list", "/search")


def _plain(url: str) -> str:
    return url.rstrip("/").split("#")[0].split("?")[0]


class Reader:
    """The records of one page: (title, apply_url, location, deadline text, snippet)."""

    def __init__(self, site: Site, url: str | None, html: str | None):
        self.site, self.url = site, url or ""
        self.text, self.nodes = read_page(html)
        self.used: set[str] = set()

    def below(self, n: dict, tags: tuple[str, ...]) -> Iterator[dict]:
        return (x for x in self.nodes[n["pre"] + 1 : n["last"] + 1] if x["tag"] in tags)

    def words(self, n: dict) -> str:
        return self.text[n["begin"] : n["end"]].strip()

    def link(self, n: dict) -> str | None:
        """The address of the first link in a node that leads somewhere."""
        for a in self.below(n, ("a",)):
            href = (a["href"] or "").strip()
            if href and not href.startswith(("#", "javascript:")):
                return urljoin(self.url, href)
        return None

    def after(self, text: str, *labels: str) -> str | None:
        m = re.search(rf"(?i)(?:{'|'.join(labels)})\s*:?\s+([^\n\r<]+)", text)
        return m[1].strip() if m and 3 <= len(m[1].strip()) <= 100 else None

    def record(self, title: str, url: str, text: str, location: str | None = None, deadline: str | None = None) -> tuple:
        return (title[:500], url, location or self.after(text, "Location", "Duty station"), deadline or self.after(text, "Apply by", "Deadline", "Closing date"), text[:500])

    def good(self, title: str) -> bool:
        low = title.lower()
        return len(title) >= self.site.letters and not DATE.match(title) and not any(w in low for w in self.site.leave_out)

    def labelled(self) -> list[tuple]:
        """Rows that say Job Title: each takes the best link of its own that no row before it took."""
        out = []
        for row in (n for n in self.nodes if n["tag"] == "tr"):
            m = re.search(r"(?i)Job Title\s+([^\n\r]+)", self.text[row["begin"] : row["end"]])
            if not m or not self.good(m[1].strip()):
                continue
            title, best, most = m[1].strip(), None, 0.0
            for cell in self.below(row, ("td", "th")):
                inside = title.lower() in self.words(cell).lower()
                for a in self.below(cell, ("a",)):
                    href = (a["href"] or "").strip()
                    url = _plain(urljoin(self.url, href))
                    if not href or href.startswith(("#", "javascript:")) or url in self.used:
                        continue
                    low = href.lower()
                    score = (100 if inside else 50) + 50 * bool(re.search(r"/\d{4,}", low)) + 30 * any(p in low for p in DETAIL) - 100 * any(p in low for p in LISTING) - 50 * (url == _plain(self.url))
                    if score > most:
                        best, most = urljoin(self.url, href), score
            if best:
                self.used.add(_plain(best))
                out.append(self.record(title, best, self.text[row["begin"] : row["end"]].strip()))
        return out

    def table(self) -> list[tuple]:
        """Rows under a header that names columns; the title is the row's link or the title column's text."""
        out = []
        for table in (n for n in self.nodes if n["tag"] == "table"):
            columns: dict[str, int] = {}
            for row in self.below(table, ("tr",)):
                cells = [c for c in self.below(row, ("td", "th"))]
                heads = sum(c["tag"] == "th" for c in cells)
                low = self.words(row).lower()
                if 2 * heads > len(cells) or not columns and sum(any(w in low for w in ws) for ws in HEADER_WORDS.values()) >= 2:
                    found = {f: i for i, c in enumerate(cells) for f, ws in HEADER_WORDS.items() if any(w in self.words(c).lower() for w in ws)}
                    columns = columns or found
                    continue
                if len(cells) < 2:
                    continue
                at = {f: self.words(cells[i]) for f, i in columns.items() if i < len(cells)}
                a = next(self.below(row, ("a",)), None)
                title = self.words(a) if a and len(self.words(a)) >= self.site.letters else at.get("title", "")
                url = self.link(row)
                if url and self.good(title):
                    out.append(self.record(title, url, self.words(row), at.get("location"), at.get("deadline")))
            if out:
                return out
        return out

    def in_containers(self) -> list[tuple]:
        found: list[dict] = []
        for tag, part in self.site.containers:
            found = [n for n in self.nodes if n["tag"] == tag and part in n["class"]]
            if len(found) >= self.site.least:
                break
            found = []
        found = found or [n for n in self.nodes if n["tag"] in self.site.else_tags]
        out, seen = [], set()
        for n in found:
            head = next(self.below(n, self.site.title_tags), None)
            url = self.link(n)
            title = self.words(head) if head else ""
            if url and self.good(title) and (title, url) not in seen:
                seen.add((title, url))
                out.append(self.record(title, url, self.words(n)))
        return out

    def headings(self) -> list[tuple]:
        out = []
        for h in (n for n in self.nodes if n["tag"] in HEADS and n["parent"] >= 0):
            around = self.nodes[h["parent"]]
            low, url = self.words(around).lower(), self.link(around)
            if url and self.good(self.words(h)) and ("location" in low or "deadline" in low) and len(low) < 2000:
                out.append(self.record(self.words(h), url, self.words(around)))
        return out

    def links(self) -> list[tuple]:
        rows = ((self.words(a), (a["href"] or "").strip()) for a in self.nodes if a["tag"] == "a")
        good = ((t, h) for t, h in rows if h and not h.startswith(("#", "javascript:", "mailto:")) and self.good(t) and any(w in f"{t} {h}".lower() for w in LINK_WORDS))
        return [self.record(t, urljoin(self.url, h), t) for t, h in dict.fromkeys(good)]

    def records(self) -> list[tuple]:
        low = self.text.lower()
        if any(w in low for w in self.site.unreadable):
            return []
        for way in self.site.ways:
            if rows := {"labelled": self.labelled, "table": self.table, "containers": self.in_containers, "headings": self.headings, "links": self.links}[way]():
                return rows
        return []


@udtf(returnType="n int, title string, apply_url string, location string, deadline_text string, snippet string")
class SiteRecords:
    """One row for each record of a page, read the way its site asks; a name that is unknown is read as generic."""

    def eval(self, name: str, url: str, html: str):
        sites = {s.name: s for s in SITES}
        for n, row in enumerate(Reader(sites.get(name, sites["generic"]), url, html).records()):
            yield (n, *row)


def site_records(spark: SparkSession, pages: DataFrame, key: str = "page_id", preferred: str | None = None) -> DataFrame:
    """(key, plugin, n, title, apply_url, location, deadline, snippet) of pages (key, url, html), by the plugin of their host.

    ``preferred`` names a column with the plugin to take instead, where it is one. A page without records gives no
    rows; null pages none. The function is called once for each page, where the page is.
    """
    spark.udtf.register("tessera_site_records", SiteRecords)
    names = [(s.name, s.priority, h) for s in SITES for h in s.hosts]
    rows = pages.select(F.col(key).alias("page_key"), "url", "html", plugin(F.coalesce("url", F.lit("")), names, F.col(preferred) if preferred else None).alias("plugin"))
    found = spark.sql("select p.page_key, p.plugin, r.* from {pages} p, lateral tessera_site_records(p.plugin, p.url, p.html) r", pages=rows)
    deadline = F.date_format(parse_date(F.col("deadline_text")), "yyyy-MM-dd")
    return found.select(F.col("page_key").alias(key), "plugin", "n", "title", "apply_url", "location", deadline.alias("deadline"), "snippet")
