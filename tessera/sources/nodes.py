"""A page as a table of nodes, and the records in its divs and lists.

Nodes are numbered in the order in which they open (``pre``) and know the last one below them (``last``), so that a node
stands inside another if its number lies between. The nodes of a page stay together with its text in one row; rules,
containers and records are array functions over that row, and nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.cells import any_of
from tessera.functions.links import parse_date

NODE = "struct<pre:int,last:int,parent:int,level:int,tag:string,class:string,id:string,href:string,begin:int,end:int,shape:string,alike:int,n_links:int,n_solid:int,link:int,in_main:boolean>"
# Tags that hold nothing, tags that end an open one of the second list, by tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "td", "th", "div", "section", "article", "body", "html"}
# Tag and part of the class of containers, in order of preference; words of sections' classes; words of
# links and lines that lead about the site; beginnings of lines that are no title.
CONTAINERS = [("div", "job"), ("div", "position"), ("div", "vacancy"), ("li", "job"), ("li", "position"), ("article", "job"), ("div", "listing"), ("div", "item"), ("div", "card"), ("div", "post"), ("div", "entry"), ("div", "result")]
SECTION_WORDS = ["job", "position", "vacancy", "career", "opportunity"]
SITE_WORDS = ["home", "about", "contact", "login", "register", "search", "skip"]
NO_TITLE = ["Location", "Deadline"]
#: Letters that a link's text, a title without a link and the link of a container of the main content need; links of a
#: section; siblings of one shape that make a list.
LINK_LETTERS, LINE_LETTERS, SOLID_LETTERS, SECTION_LINKS, ALIKE = 5, 10, 8, 3, 3
SECTION, MAIN, REPEATED = len(CONTAINERS), len(CONTAINERS) + 1, len(CONTAINERS) + 2


class Nodes(HTMLParser):
    """The nodes of a page and its text without scripts and styles; malformed pages give the nodes their tags suggest."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[int] = []
        self.parts: list[str] = []
        self.length = 0
        self.n_open: Counter[str] = Counter()

    def _close(self, upto: int) -> None:
        while len(self.open) > upto:
            node = self.nodes[self.open.pop()]
            node["end"], node["last"] = self.length, len(self.nodes) - 1
            self.n_open[node["tag"]] -= 1

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS and self.n_open["p"]:
            self._end("p", SCOPE - {"div"})
        for ended in ENDS.get(tag, ()):
            if self.n_open[ended]:
                self._end(ended, SCOPE - {ended})
        a = dict(attrs)
        parent = self.open[-1] if self.open else -1
        self.nodes.append({"pre": len(self.nodes), "last": len(self.nodes), "parent": parent, "level": len(self.open), "tag": tag, "class": a.get("class") or "", "id": a.get("id") or "", "href": a.get("href") if tag == "a" else None, "begin": self.length, "end": self.length})
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)
            self.n_open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(len(self.open) - 1)

    def _end(self, tag: str, walls: set[str]) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            here = self.nodes[self.open[k]]["tag"]
            if here == tag:
                self._close(k)
                return
            if here in walls:
                return

    def handle_endtag(self, tag):
        if self.n_open[tag]:
            self._end(tag, set())

    def handle_data(self, data):
        if not (self.n_open["script"] or self.n_open["style"]):
            self.parts.append(data)
            self.length += len(data)


def read_page(html: str | None) -> tuple[str, list[dict]]:
    """Text and nodes of a page. Shapes are digests of a node's tag and its children's shapes, equal neighbours once."""
    p = Nodes()
    # What follows the last end of a tag holds no tag, so the parser does not look there for ends again and again.
    whole, _, rest = (html or "").rpartition(">")
    if whole:
        p.feed(whole + ">")
        p.close()
    if rest:
        p.handle_data(unescape(rest))
    p._close(0)
    text, nodes = "".join(p.parts), p.nodes
    children: list[list[int]] = [[] for _ in nodes]
    main = next((n["pre"] for n in nodes if n["tag"] == "main"), next((n["pre"] for n in nodes if n["tag"] == "div" and ("content" in n["id"].lower() or "main" in n["id"].lower())), -1))
    for n in reversed(nodes):
        below = children[n["pre"]][::-1]
        shapes = [nodes[c]["shape"] for c in below]
        n["shape"] = f"{zlib.crc32((n['tag'] + '(' + ','.join(s for i, s in enumerate(shapes) if not i or s != shapes[i - 1]) + ')').encode()):08x}"
        own = n["href"] is not None
        words = text[n["begin"] : n["end"]].strip() if own else ""
        solid = own and len(words) >= SOLID_LETTERS and not any(w in words.lower() for w in SITE_WORDS)
        n["n_links"] = own + sum(nodes[c]["n_links"] for c in below)
        n["n_solid"] = solid + sum(nodes[c]["n_solid"] for c in below)
        n["link"] = n["pre"] if own else next((nodes[c]["link"] for c in below if nodes[c]["link"] >= 0), -1)
        n["in_main"] = main >= 0 and main < n["pre"] <= nodes[main]["last"]
        if n["parent"] >= 0:
            children[n["parent"]].append(n["pre"])
    alike = Counter((n["parent"], n["shape"]) for n in nodes)
    for n in nodes:
        n["alike"] = alike[n["parent"], n["shape"]]
    return text, nodes


def page_trees(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, url, text, nodes), a row for each page. A null page has no nodes. Time and memory grow with the page."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start in range(0, len(b), 64):
                part = b.iloc[start : start + 64]
                read_ = [read_page(h) for h in part["html"]]
                yield pd.DataFrame({"k": part["k"].to_numpy(), "url": part["url"].to_numpy(), "text": [t for t, _ in read_], "nodes": [n for _, n in read_]})

    rows = pages.select(F.col(key).cast("string").alias("k"), "url", "html")
    return rows.mapInPandas(read, f"k string, url string, text string, nodes array<{NODE}>").withColumnRenamed("k", key)


def node_rows(trees: DataFrame, key: str = "page_id") -> DataFrame:
    """A row for each node: key and its fields."""
    return trees.select(key, F.explode("nodes").alias("n")).select(key, "n.*")


def rule(n: Column) -> Column:
    """Number of the first rule that makes a node a container, the lower the better; null for none."""
    low = F.lower(n["class"])
    first = [F.when((n["tag"] == tag) & n["class"].contains(part), F.lit(i)) for i, (tag, part) in enumerate(CONTAINERS)]
    section = n["tag"].isin("section", "div") & any_of(low.contains(w) for w in SECTION_WORDS) & (n["n_links"] >= SECTION_LINKS)
    main = n["in_main"] & n["tag"].isin("div", "li", "article") & (n["n_solid"] >= 1)
    repeated = (n["alike"] >= ALIKE) & (n["n_links"] >= 1) & ~n["tag"].isin("a", "td", "th", "option")
    return F.coalesce(*first, F.when(section, F.lit(SECTION)), F.when(main, F.lit(MAIN)), F.when(repeated, F.lit(REPEATED)))


def absolute(href: Column, url: Column) -> Column:
    """A link as an address: as it is with a scheme, else under the page's host or folder; null where it leads nowhere."""
    host, scheme = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1), F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    folder = F.regexp_extract(F.regexp_extract(url, r"^[^?#]*", 0), r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(?:/.*)?/)", 1)
    folder = F.when(folder.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://$") | (folder == ""), F.concat(host, F.lit("/"))).otherwise(folder)
    out = F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(host, href)).when(href.startswith("?"), F.concat(F.regexp_extract(url, r"^[^?#]*", 0), href)).otherwise(F.concat(folder, href))
    return F.when((href != "") & ~href.startswith("#") & ~href.startswith("javascript:"), out)


def div_records(trees: DataFrame, key: str = "page_id", most: int | None = None) -> DataFrame:
    """The records in the divs and lists of pages: (key, n, rule, title, apply_url, location, deadline).

    All nodes that the page's best rule takes are containers: a class that names postings; sections with such a class
    and several links; blocks of the main content with a substantial link; else siblings of one shape that hold links.
    A container's title is its first link's text, or the first line that may be one; place and deadline follow their
    words in its text. Containers without a title give nothing. ``most`` keeps the first containers of a page.
    """
    best = F.array_min(F.transform("nodes", rule))
    taken = F.filter("nodes", lambda n: rule(n) == F.col("best"))
    if most is not None:
        taken = F.slice(taken, 1, most)

    def cut(n: Column) -> Column:
        return F.substring(F.col("text"), n["begin"] + 1, n["end"] - n["begin"])

    def record(n: Column) -> Column:
        link = F.get("nodes", n["link"])
        return F.struct(F.when(n["link"] >= 0, F.trim(cut(link))).alias("link"), F.when(n["link"] >= 0, F.trim(link["href"])).alias("href"), cut(n).alias("body"))

    rows = trees.select(key, "url", "text", "nodes", best.alias("best")).where("best is not null").withColumn("taken", taken)
    rows = rows.select(key, "url", F.col("best").alias("rule"), F.posexplode(F.transform("taken", record)).alias("n", "r")).select(key, "url", "rule", "n", "r.*")
    lines = F.slice(F.filter(F.transform(F.split("body", "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, 3)
    line = F.filter(lines, lambda x: (F.length(x) >= LINE_LETTERS) & ~any_of(F.lower(x).contains(w) for w in SITE_WORDS[:4]) & ~any_of(x.startswith(w) for w in NO_TITLE))
    named = F.length("link") >= LINK_LETTERS
    rows = rows.withColumn("title", F.when(named, F.col("link")).otherwise(F.substring(F.get(line, F.lit(0)), 1, 200)))

    def after(*words: str) -> Column:
        found = [F.trim(F.regexp_extract("body", rf"(?i){w}[:\s]+([^\n\r]+)", 1)) for w in words]
        return F.coalesce(*[F.when((F.length(f) >= 3) & (F.length(f) < 100), f) for f in found])

    return rows.where("title is not null and title <> ''").select(
        key, "n", "rule", "title", absolute(F.col("href"), F.col("url")).alias("apply_url"), after("Location", "Duty Station").alias("location"),
        F.date_format(parse_date(after("Apply by", "Deadline", "Closing", "Due")), "yyyy-MM-dd").alias("deadline"),
    )
