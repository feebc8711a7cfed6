"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, slices

#: Parts of a page that are never its article.
ASIDE_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "textarea", "label", "fieldset", "input", "iframe", "object", "noscript", "figcaption"}
#: Elements whose content is not text of the page.
RAW_TAGS = {"script", "style", "noscript", "template", "svg", "math", "title", "iframe", "textarea", "canvas", "audio", "video"}
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Inline markup, which neither ends a block nor adds to a path.
INLINE_TAGS = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: An open paragraph ends where one of these begins.
ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: Elements that a sibling of the same kind ends.
ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "p": {"div", "article", "section", "body", "td", "li", "blockquote", "main"}}
#: Words in class or id that speak for boilerplate.
ASIDE_WORDS = re.compile(
    r"(?i)(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|header|footer|foot|side-?bar|sidebar\w*|aside|breadcrumbs?|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"comments?|comment-?list|replies|reply|respond|discussion|disqus|reactions?|share|sharing|social|related|recommend\w*|widget|toolbar|pagination|pager|masthead|copyright|legal|disclaimer|hidden|navigation|complementary|contentinfo|search)(?=$|[\s_-])"
)
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
CONTENT_TAGS = {"article", "main"}
#: Elements that the page goes on after where their end is missing; other raw ones hold the rest of the page then.
OPEN_RAW = {"noscript", "template", "svg", "math", "canvas", "audio", "video"}
#: A tag, whose quoted values may hold its end, or a comment. Where quotes do not pair up to the end of the page, a tag
#: ends at the next angle bracket.
TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*+(?:>|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
UNQUOTED = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|$)", re.S)
ATTR = re.compile(r"([a-zA-Z_:][\w:.-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")
#: Paths whose smoothed, fused and weighted ratio is at least this share of the page's best ratio are content.
SHARE = 0.15
#: Weight of a path in an article or main element. An article with less text than a path outside weighs less, but this at least.
ARTICLE_WEIGHT, LEAST_WEIGHT = 2.0, 1 / 3
#: Weight of a path in an element whose class or id speaks for boilerplate: it is content only where little else is.
NAMED_WEIGHT = 0.01
#: Elements on whose class and id a word such as has-sidebar says nothing about their own text.
WHOLE_TAGS = {"html", "body", *CONTENT_TAGS}
#: Children of a holder of content that come with it though no kept text follows them.
CONTENT_GROUPS = {"ul", "ol", "dl", "table", "pre", "blockquote", "figure", "p", "h1", "h2", "h3", "h4", "h5", "h6"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def marks(tag: str, attributes: str, nested: bool = False) -> tuple[bool, bool]:
    """(whether tag, role or hiding make an element boilerplate, whether its class or id speaks for it).

    An article nested in another may be a comment.
    """
    if tag in ASIDE_TAGS:
        return True, False
    if not attributes or not attributes.strip(" /"):
        return False, False
    named = False
    for m in ATTR.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id") and (nested or tag not in WHOLE_TAGS) and ASIDE_WORDS.search(value):
            named = True
        if name == "role" and value.lower() in ASIDE_ROLES:
            return True, named
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True, named
    return False, named


class Page:
    """The blocks of text of a page, in order, and the elements they stand in.

    A block: text, path, aside, marked, in main, article, link letters, element. ``marked`` blocks stand in an element
    whose class or id speaks for boilerplate; their paths differ from unmarked ones. ``article`` numbers the outermost
    article element around the block, 0 where there is none. ``parents`` and ``tags`` are of the elements, by number,
    the page itself being 0. Paths are numbered by the path above and the tag, so that depth costs nothing.
    """

    def __init__(self, page: str) -> None:
        self.blocks: list[tuple[str, tuple[int, bool], bool, bool, bool, int, int, int]] = []
        self.parents, self.tags = [0], [""]
        self.leaf = [""]
        self._paths: dict[tuple[int, str], int] = {}
        self._read(page)

    def _path(self, above: int, tag: str) -> int:
        found = self._paths.setdefault((above, tag), len(self.leaf))
        if found == len(self.leaf):
            self.leaf.append(tag)
        return found

    def _read(self, page: str) -> None:
        # Tag, aside, marked, in main, article, path, element.
        stack: list[tuple[str, bool, bool, bool, int, int, int]] = [("", False, False, False, 0, 0, 0)]
        n_open: Counter[str] = Counter()
        text: list[str] = []
        at = link = linked = n_articles = 0
        broken, endless = False, set()

        def add(part: str) -> None:
            nonlocal linked
            text.append(part)
            if link:
                linked += len("".join(part.split()))

        def flush() -> None:
            nonlocal linked
            joined = " ".join("".join(text).split())
            text.clear()
            if joined:
                _, aside, marked, main, article, path, element = stack[-1]
                self.blocks.append((joined, (path, marked), aside, marked, main, article, linked, element))
            linked = 0

        def pop_to(k: int) -> None:
            nonlocal link
            flush()
            for gone in stack[k:]:
                n_open[gone[0]] -= 1
            del stack[k:]
            # A link that nothing ends goes as far as the element around it.
            if link > k:
                link = 0

        def close(names: set[str], scope: set[str]) -> None:
            if not any(n_open[n] for n in names):
                return None
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in names:
                    return pop_to(k)
                if stack[k][0] in scope:
                    return None
            return None

        while (begin := page.find("<", at)) >= 0:
            m = None if broken else TAG.match(page, begin)
            if m is None and page[begin + 1 : begin + 2].isascii() and (page[begin + 1 : begin + 2].isalpha() or page[begin + 1 : begin + 2] == "/" and page[begin + 2 : begin + 3].isalpha()):
                broken, m = True, UNQUOTED.match(page, begin)
            elif broken:
                m = TAG.match(page, begin) if page[begin + 1 : begin + 2] in ("!", "?") else None
            if m is None:
                add(html.unescape(page[at : begin + 1]))
                at = begin + 1
                continue
            if begin > at:
                add(html.unescape(page[at:begin]))
            at = m.end()
            if m[2] is None:
                if m[0].startswith("<![CDATA["):
                    add(m[0][9:-3] if m[0].endswith("]]>") else m[0][9:])
                continue
            name = m[2].lower()
            if name == "head":
                # What stands in it is raw or void, and the first other tag begins the body.
                flush()
                continue
            if name == "br":
                text.append(" ")
            if name == "a":
                link = 0 if m[1] or "href" not in m[3].lower() else len(stack)
            if name in INLINE_TAGS and (m[1] or not any(marks(name, m[3]))):
                if not m[1] or not n_open[name]:
                    continue
            if m[1]:
                if n_open[name]:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == name:
                            pop_to(k)
                            break
                continue
            if name in RAW_TAGS:
                if m[3].rstrip().endswith("/") and name in ("svg", "math") or name in endless:
                    continue
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                if end is None and name in OPEN_RAW:
                    endless.add(name)
                    continue
                at = end.end() if end else len(page)
                if name not in INLINE_TAGS:
                    flush()
                continue
            if name in ENDS_P:
                close({"p"}, SCOPES["p"])
            if name in ENDS_SAME:
                close(ENDS_SAME[name], SCOPES[name])
            flush()
            if name not in VOID_TAGS:
                _, aside, marked, main, article, path, element = stack[-1]
                own = marks(name, m[3], article > 0)
                if name == "article" and not article:
                    article = n_articles = n_articles + 1
                self.parents.append(element)
                self.tags.append(name)
                stack.append((name, aside or own[0], marked or own[1], main or name == "main" or 'role="main"' in m[3], article, self._path(path, name), len(self.tags) - 1))
                n_open[name] += 1
        if at < len(page):
            add(html.unescape(page[at:]))
        flush()


def whole(page: Page, parts: list[tuple], keep: np.ndarray) -> np.ndarray:
    """The blocks to keep once content is chosen: its elements come whole.

    Of an article of which most text is kept, all unmarked blocks come. Elsewhere the holder of kept blocks, the element
    that their elements stand in, gives its other unmarked children too if they lie between kept ones, or if they are
    lists, tables or plain blocks that are not mostly links.
    """
    letters = np.array([len("".join(p[0].split())) for p in parts])
    keep = keep.copy()
    text: dict[int, list[int]] = {}
    for p, n, k in zip(parts, letters.tolist(), keep.tolist(), strict=True):
        if p[5] and not p[3]:
            s = text.setdefault(p[5], [0, 0])
            s[0] += n - p[6]
            s[1] += (n - p[6]) * k
    chosen = {a for a, (n, kept) in text.items() if kept and 2 * kept >= n}
    holders: dict[int, list[int]] = {}
    for i, p in enumerate(parts):
        if keep[i] and not p[5] and not p[3]:
            span = holders.setdefault(page.parents[p[7]], [i, i])
            span[1] = i
    # First and last of the blocks below each element that are not kept yet, their letters and those in links.
    n = len(page.tags)
    first, last, size, links = [len(parts)] * n, [-1] * n, [0] * n, [0] * n
    for i, p in enumerate(parts):
        if p[5] and not p[3]:
            keep[i] |= p[5] in chosen
        elif not keep[i] and not p[3]:
            e = p[7]
            first[e], last[e], size[e], links[e] = min(first[e], i), i, size[e] + int(letters[i]), links[e] + p[6]
    for e in range(n - 1, 0, -1):
        up = page.parents[e]
        first[up], last[up], size[up], links[up] = min(first[up], first[e]), max(last[up], last[e]), size[up] + size[e], links[up] + links[e]
    comes = [False] * n
    for e in range(1, n):
        up = page.parents[e]
        comes[e] = comes[up]
        if not comes[e] and up in holders and last[e] >= 0:
            between = holders[up][0] < first[e] and last[e] < holders[up][1]
            comes[e] = between or page.tags[e] in CONTENT_GROUPS and 2 * links[e] < size[e]
    for i, p in enumerate(parts):
        keep[i] |= comes[p[7]] and not p[3] and not p[5]
    return keep


def main_text(page: str | None) -> str:
    """The page's article. See :func:`extract_main_text`."""
    read = Page(page or "")
    # Parts marked as boilerplate are no candidates.
    open_parts = [p for p in read.blocks if not p[2]]
    if not open_parts:
        return ""
    paths: dict[tuple[int, bool], list[float]] = {}
    articles: dict[int, int] = {}
    outside: dict[tuple[int, bool], int] = {}
    for text, path, _, marked, _, article, linked, _ in open_parts:
        s = paths.setdefault(path, [0.0, 0.0, 0.0, 0.0, 0.0])
        letters = len("".join(text.split()))
        s[0] += len(text)
        s[1] += len(PUNCTUATION.findall(text))
        s[2] += 1
        s[3] += linked
        s[4] += letters
        if marked:
            continue
        if article:
            articles[article] = articles.get(article, 0) + letters - linked
        else:
            outside[path] = outside.get(path, 0) + letters - linked
    # Text and punctuation per node of the path, taken at each block in page order, smoothed over its neighbours on the
    # same side of an article's bounds.
    text_ratio = np.array([paths[p[1]][0] / paths[p[1]][2] for p in open_parts])
    mark_ratio = np.array([paths[p[1]][1] / paths[p[1]][2] for p in open_parts])

    # Blocks with boilerplate's names have a side of their own.
    side = np.array([-1 if p[3] else p[5] for p in open_parts])
    same = side[1:] == side[:-1]

    def smooth(x: np.ndarray) -> np.ndarray:
        before, after = x.copy(), x.copy()
        before[1:] = np.where(same, x[:-1], x[1:])
        after[:-1] = np.where(same, x[1:], x[:-1])
        return np.maximum(x, (before + x + after) / 3)

    # Links are no text of the page, but a heading may be one.
    own = np.array([1.0 if read.leaf[p[1][0]] in HEADINGS else 1 - paths[p[1]][3] / paths[p[1]][4] for p in open_parts])
    fused = np.sqrt(smooth(text_ratio) * (1 + smooth(mark_ratio))) * own * np.array([NAMED_WEIGHT if p[3] else 1.0 for p in open_parts])
    # Beside a longer text elsewhere an article element is a card or a comment.
    most = max(outside.values(), default=0)
    of_article = {a: min(ARTICLE_WEIGHT, max(LEAST_WEIGHT, ARTICLE_WEIGHT * n / most)) if most else ARTICLE_WEIGHT for a, n in articles.items()}
    weight = np.array([1.0 if p[3] else of_article[p[5]] if p[5] else ARTICLE_WEIGHT if p[4] else 1.0 for p in open_parts])
    keep = whole(read, open_parts, fused * weight >= SHARE * fused.max())
    return "\n".join([p[0] for p, k in zip(open_parts, keep, strict=True) if k])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Main text of each page: page_id, url, text, n_chars (code points).

    Text length and punctuation are summed per root-to-leaf tag path, smoothed over neighbouring blocks, fused with the
    path's share of text outside links, and thresholded on every page. An article or main element adds weight to the
    paths in it, less where another path outside holds more text; a class or id that names a sidebar, notice, advert,
    comment or the like takes most of it. Elements made for navigation, headers, footers, asides and forms, hidden ones,
    scripts and styles are no candidates. What is chosen comes whole (:func:`whole`): lists, tables and linked text of an
    article too. Character references are decoded, white space within a block becomes one space, blocks are joined by
    one newline in page order.

    Null or empty html gives an empty text; repeated pages are extracted each; other columns are ignored. Tags may miss
    their ends, those of head and body too; an unpaired quote ends with its tag. A page is read once from begin to end,
    so that time and memory grow with its length, however it is formed. One narrow stage.
    """

    def extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            texts = [main_text(h) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.mapInPandas(extracted, "page_id long, url string, text string, n_chars long")
