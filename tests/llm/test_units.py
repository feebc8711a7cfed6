"""The parts of the operators that run inside tasks, against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe, chunk_dedup, decontaminate, html_main, ngram_join, toxicity_knn
from tessera.llm.common import local_roots
from tessera.llm.queries import VOCABULARY

ODD = list("abcdeéß Σσςİ'st\x1c\x85\u200b\u3000\n12½漢😀\u0301.,!?") + ["<|endoftext|>", "<|startoftext|>", "don't", "I'LL"]


@pytest.fixture(scope="module")
def coders():
    from tokenizers import Tokenizer

    return bpe.WordBpe(VOCABULARY), Tokenizer.from_file(VOCABULARY)


def test_bpe_equals_the_library(coders):
    own, library = coders

    @settings(max_examples=400, deadline=None)
    @given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(ODD), max_size=30).map("".join)))
    def check(text):
        expected = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == expected
        assert own.decode(expected) == library.decode(expected, skip_special_tokens=False)

    check()
    assert own.encode("ab" * 5000) == library.encode("ab" * 5000, add_special_tokens=False).ids
    assert own.encode(None) == own.encode("") == []


def test_bpe_cuts_change_nothing(coders):
    own, _ = coders
    for word in ("unbelievable", "zqxjkvb", "thhaereing", "a"):
        parts = own.fragments(word)
        assert "".join(parts) == word + own.end
        assert [i for p in parts for i in own._merge(p)] == own._merge(word + own.end)


def test_local_roots():
    assert local_roots(6, np.array([0, 4, 1]), np.array([1, 5, 2])).tolist() == [0, 0, 0, 3, 4, 4]


def test_shingles_count_like_sets():
    words = "The  cat\tSAT on the cat sat on ÉTÉ".split()
    low = [w.lower() if w.isascii() else w for w in words]
    assert len(ngram_join.shingles(" ".join(words), 3)) == len({tuple(low[i : i + 3]) for i in range(len(low) - 2)})
    assert len(ngram_join.shingles("a B", 3)) == 1 and (ngram_join.shingles("a B", 3) == ngram_join.shingles("A b", 3)).all()
    assert len(ngram_join.shingles(" \n", 3)) == len(ngram_join.shingles(None, 3)) == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60), st.integers(0, 59), st.sampled_from([80, 90]))
def test_prefixes_meet(n, removed, percent):
    rng = random.Random(n * 100 + removed)
    a = set(range(n))
    b = set(list(a)[removed:]) | set(range(100, 100 + removed // 2))
    if not b or not ngram_join.linked(len(a), len(b), len(a & b), percent):
        return
    order = list(a | b)
    rng.shuffle(order)
    first = [{x for x in [y for y in order if y in s][: ngram_join.prefix_length(len(s), percent)]} for s in (a, b)]
    assert first[0] & first[1]


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 40), st.integers(1, 30), st.integers(0, 10**6), st.booleans())
def test_block_product_counts(n_docs, n_columns, seed, two):
    rng = np.random.default_rng(seed)
    held = rng.random((n_docs, n_columns)) < rng.uniform(0.05, 0.9)
    rep, member = np.nonzero(held)
    extra = rng.integers(0, 3, n_docs)
    size, component, chunk = rng.integers(20, 60, n_docs), rng.integers(0, 4, n_docs), rng.integers(0, 2, n_docs) if two else np.zeros(n_docs, int)
    if not len(rep):
        return
    group = {"member": member, "rep": rep, "size": size[rep], "component": component[rep], "total": held.sum(axis=1)[rep] + extra[rep], "chunk": chunk[rep], "block_a": np.zeros(len(rep), int), "block_b": np.full(len(rep), int(two))}
    saved = ngram_join.LONG_COLUMN, ngram_join.ROWS
    ngram_join.LONG_COLUMN, ngram_join.ROWS = 6, 7
    out = ngram_join.block_product(group, 80)
    ngram_join.LONG_COLUMN, ngram_join.ROWS = saved
    got = {} if out is None else {(a, b): (x, y, m) for a, b, x, y, m in zip(*[out[c].tolist() for c in ("a", "b", "size_a", "size_b", "met")], strict=True)}
    expected = {}
    for a in range(n_docs):
        for b in range(a + 1, n_docs):
            met = int((held[a] & held[b]).sum())
            reach = met + min(extra[a], extra[b]) + -(-80 * max(size[a], size[b]) // 100) - 1
            if met and 180 * reach >= 80 * (size[a] + size[b]) and component[a] != component[b] and 100 * min(size[a], size[b]) >= 80 * max(size[a], size[b]) and (chunk[a] != chunk[b] if two else True):
                expected[a, b] = (size[a], size[b], met)
    assert got == expected


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=800))
def test_chunks_cover_the_text(text):
    if not text:
        return
    raw = text.encode("utf-8", "surrogatepass")
    _, ends, words = chunk_dedup.chunks(text)
    assert ends[-1] == len(raw) and (np.diff(ends, prepend=0) > 0).all()
    assert words.sum() == len(raw.replace(b"\x0b", b" ").replace(b"\x0c", b" ").split())
    for e in ends[:-1]:
        assert raw[e] & 0xC0 != 0x80


def test_chunks_resist_insertions():
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(400))
    moved, same = ([bytes(d) for d in chunk_dedup.chunks(t)[0]] for t in ("new words before " + text, text))
    assert sum(d in moved for d in same) >= len(same) - 2


def test_without_keeps_whole_words():
    assert chunk_dedup.without("aa bb cc dd ée", [(4, 9)]) == "aa bb  dd ée"
    assert chunk_dedup.without("aa bb", [(0, 5)]) == ""


def brute_alignment(item, passage):
    h = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item):
        for j, b in enumerate(passage):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if a == b else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    return max(map(max, h))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=15), st.lists(st.integers(0, 4), min_size=1, max_size=25))
def test_alignment_is_smith_waterman(item, passage):
    assert decontaminate.align(np.array(item), np.array(passage))[0] == brute_alignment(item, passage)


def test_seeds_find_edited_copies():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(900)]
    items = [(i, " ".join(rng.sample(words, 30))) for i in range(20)]
    seeds = decontaminate.Seeds(items)
    use = np.array([rng.randrange(50) for _ in seeds.keys_all])
    for i, text in items:
        copy = text.split()
        for k in range(4, 30, 6):
            copy[k] = "other"
        copy.insert(8, "more")
        doc = " ".join(rng.choices(words, k=50) + copy + rng.choices(words, k=50))
        assert [c[0] for c in seeds.copies(doc, use, 0.5)] == [i]
    assert not seeds.copies(" ".join(rng.choices(words, k=400)), use, 0.5)
    assert seeds.copies(None, use, 0.5) == seeds.copies("", use, 0.5) == []


def test_block_max_search_is_exact():
    rng = np.random.default_rng(5)
    idf = np.linspace(1, 3, 40)

    def vectors(n):
        of = np.repeat(np.arange(n), rng.integers(1, 9, n))
        terms = np.concatenate([rng.choice(40, k, replace=False, p=np.linspace(1, 9, 40) / 200) for k in np.bincount(of, minlength=n)])
        return of, terms, toxicity_knn.unit(of, terms, rng.integers(1, 5, len(of)), idf, n)

    def dense(of, terms, weights, n):
        out = np.zeros((n, 40))
        out[of, terms] = weights
        return out

    ids = rng.permutation(501)
    examples, queries = vectors(500), vectors(50)
    index = toxicity_knn.BlockMaxIndex(examples[0], examples[1], examples[2], ids, 40, block=16)
    assert len(index.rows) and index.row.min() < 0
    full = (dense(*queries, 50) @ dense(*examples, 501).T).round(12)
    for s, (at, near) in zip(full, index.search(*queries, 50, 10), strict=True):
        expected = np.lexsort((ids, -s))[:10]
        assert at.tolist() == expected.tolist() and np.allclose(near, s[expected])


PAGES = {
    "<html><head><title>t</title><script>x('</p>')</script></head><body><nav><a>Home</a></nav><div class='ad'>Buy now, please.</div><article><h1>The &amp; title</h1><p><b>One\n two.<br><p>Three &copy;</p>"
    "<aside>more</aside><div class='comments'><p>nice, really</p></div></article><footer>&copy; 2024</footer></body></html>": "The & title\nOne two.\nThree ©",
    "<body><div id='sidebar'><ul><li>a</li></ul></div><div class='post'><p>A long sentence, with commas, which goes on.</p><p>Another one, rather long, which goes on too.</p></div><form>Name <input></form></body>": "A long sentence, with commas, which goes on.\nAnother one, rather long, which goes on too.",
    "": "",
    "<nav>only menu</nav>": "",
    "plain text": "plain text",
    "<article><p>cut of&am": "cut of&am",
    "<main><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></main>": "x\ny\n1\n2",
}


STORY = [f"Sentence {k} of the story, which is long, goes on for a while, and says something about {w}." for k, w in enumerate(["rain", "wind", "snow", "ice"])]
P = "".join(f"<p>{x}</p>" for x in STORY)
CARDS = "".join(f"<article class='card'><h3>Card {k}</h3><p>Short teaser {k}.</p></article>" for k in range(5))
LINKS = "<ul>" + "".join(f"<li><a href='/{k}'>Another story {k}</a></li>" for k in range(6)) + "</ul>"
ITEMS = ["two eggs and a spoon of salt", "a cup of cold water", "some flour from the mill"]
RATIO_PAGES = {
    f"<body><div class='text'>{P}</div><div>{CARDS}</div></body>": STORY,
    f"<body class='has-sidebar'><div>{P}</div></body>": STORY,
    f"<html class='no-header'><body class='search no-footer'><main class='content no-sidebar'><article class='post ad'>{P}</article></main></body></html>": STORY,
    f"<main><div>{P}</div><p>{STORY[0]}</p><div class='box'><span>Read on</span>{LINKS}</div></main>": [*STORY, STORY[0], "Read on"],
    f"<article><h1><a href='/'>The title</a></h1>{P}<ul><li>{'<li>'.join(ITEMS)}</ul>{P}</article>": ["The title", *STORY, *ITEMS, *STORY],
    f"<article>{P}<article class='comment'><p>Nice, really, a lot.</p></article></article>": STORY,
    f"<article><p>{STORY[0]} <a href='/x'>open link<p>{STORY[1]}</article>": [STORY[0] + " open link", STORY[1]],
    f"<body><article><p>{STORY[0]}</p></article><div>{P}</div></body>": [STORY[0], *STORY],
    # Names of classes are evidence, not a veto.
    f"<body><div class='content-header'>{P}</div></body>": STORY,
    f"<body><div class='content-header'>{P}</div><div class='sidebar'>{LINKS}</div></body>": STORY,
    "<article class='post related-topic'><p>a</p></article>": ["a"],
    f"<body><div class='story'>{P}</div><div class='comments'>{P}{P}</div><div id='related'><p>{STORY[0]}</p></div></body>": STORY,
}


@pytest.mark.parametrize("page", RATIO_PAGES)
def test_ratios_select_on_every_page(page):
    assert html_main.main_text(page).split("\n") == RATIO_PAGES[page]


def test_ratios_decide(monkeypatch):
    """Without the threshold on ratios all candidates would come."""
    pages = [p for p in RATIO_PAGES if "Read on" in p or "card" in p or "comments" in p]
    monkeypatch.setattr(html_main, "SHARE", 0.0)
    assert len(pages) == 3 and all(html_main.main_text(p).split("\n") != RATIO_PAGES[p] for p in pages)


def test_main_text():
    for page, expected in PAGES.items():
        assert html_main.main_text(page) == expected
    assert html_main.main_text(None) == ""
    assert html_main.main_text("<article>" + "<p>word word</p>" * 20000) == "\n".join(["word word"] * 20000)


LONG = "<p>" + "A long paragraph with many words, and commas, that says a lot about the matter at hand. " * 3 + "</p>"
PARTS = {
    "<ul>" + "".join(f"<li>{w}</li>" for w in "Salt Pepper Oil Vinegar Sugar Flour Eggs Water".split()) + "</ul>": "Salt Pepper Oil Vinegar Sugar Flour Eggs Water".split(),
    "<table>" + "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in [("Year", "Count")] + [(2000 + i, 13000 + i) for i in range(6)]) + "</table>": ["Year", "Count"] + [str(x) for i in range(6) for x in (2000 + i, 13000 + i)],
    "<dl>" + "".join(f"<dt>T{i}</dt><dd>D{i}</dd>" for i in range(4)) + "</dl>": [x for i in range(4) for x in (f"T{i}", f"D{i}")],
    "<ul>" + "".join(f'<li><a href="/r{i}">Reference {i}</a></li>' for i in range(6)) + "</ul>": [f"Reference {i}" for i in range(6)],
}
AROUND = ["<body><nav><a href=x>Menu</a></nav><article>%s</article><div class=comments><p>A comment, too.</p></div></body>", "<body><nav><a href=x>Menu</a></nav><div>%s</div><div><a href=a>Other</a> <a href=b>More</a></div></body>", "<body><main>%s</main><footer>f</footer></body>", "<body><div><a href=m>Menu</a></div>%s<footer>f</footer></body>"]


@pytest.mark.parametrize("part", PARTS)
def test_content_comes_whole(part):
    paragraph = " ".join(LONG[3:-4].split())
    for around in AROUND:
        assert html_main.main_text(around % (LONG + part + LONG)).split("\n") == [paragraph, *PARTS[part], paragraph]
        # At the end of what is no article, a list of links may be a menu.
        if "href" not in part or "article" in around:
            assert html_main.main_text(around % (LONG + LONG + part)).split("\n") == [paragraph, paragraph, *PARTS[part]]


def test_pages_that_leave_tags_out():
    assert html_main.main_text("<html><head><title>t</title><meta charset=x><p>Story goes here, and on.</p></html>") == "Story goes here, and on."
    assert html_main.main_text("<title>t</title><style>p{}</style>Just text, no tags.") == "Just text, no tags."
    assert html_main.main_text('<p>Before it, text.<svg><path d="x"><p>After the svg, more text.') == "Before it, text.\nAfter the svg, more text."
    assert html_main.main_text('<p>One "quote, and < or <3 signs.</p><p title="x>Two, with a quote left open.</p>') == 'One "quote, and < or <3 signs.\nTwo, with a quote left open.'


def test_a_megabyte_of_broken_tags_takes_seconds():
    import time

    # Each is about a megabyte; what took seconds for 24 kB before is linear.
    for page in ("<a " * 333_000 + '"', "<a \"'>" * 170_000, "<div>x" * 170_000, "<li>x" * 200_000, "</b>" * 250_000, "<svg>" * 200_000, "<!--" * 250_000, "<" * 1_000_000, "<p><b>" * 160_000, "<td><table>" * 90_000):
        began = time.perf_counter()
        html_main.main_text(page)
        assert time.perf_counter() - began < 15


def plain_span(item, passage):
    """First best alignment by a table of scores, traced back: match or mismatch first, then a gap in the passage, then in the item."""
    m, n = len(item), len(passage)
    h = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if item[i - 1] == passage[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    best = max(max(r) for r in h)
    if not best:
        return 0, 0, 0
    i, j = next((i, j) for i in range(m + 1) for j in range(n + 1) if h[i][j] == best)
    end = j
    while h[i][j]:
        if h[i][j] == h[i - 1][j - 1] + (2 if item[i - 1] == passage[j - 1] else -1):
            i, j = i - 1, j - 1
        elif h[i][j] == h[i - 1][j] - 1:
            i -= 1
        else:
            j -= 1
    return best, j, end


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=8), st.lists(st.integers(0, 3), min_size=1, max_size=14))
def test_spans_equal_a_traceback(item, passage):
    item, passage = np.array(item), np.array(passage)
    score, end = decontaminate.align(item, passage)
    best, start, stop = plain_span(item.tolist(), passage.tolist())
    assert (score, end) == (best, stop) and (not best or decontaminate.aligned_from(item, passage[:end]) == start)


def test_copies_give_the_span_of_the_copy():
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(400)]
    item = rng.sample(words[:200], 15)
    seeds = decontaminate.Seeds([(7, " ".join(item))])
    plain = rng.choices(words[200:], k=40)
    text = plain[:10] + item[:10] + plain[10:]
    for held in (None, np.zeros(len(seeds.keys_all), np.int64), np.arange(len(seeds.keys_all))):
        # Ten words of the item, then all of it with words put in between.
        assert seeds.copies(" ".join(text), held, 0.5) == [(7, 20 / 30, 10, 20)]
        edited = plain[:10] + item[:5] + ["new", "ones"] + item[5:] + plain[10:]
        assert seeds.copies(" ".join(edited), held, 0.5) == [(7, 28 / 30, 10, 27)]
        # Of two equal copies the first, whichever's seeds are rarer.
        assert seeds.copies(" ".join(text + plain + item[:10]), held, 0.5) == [(7, 20 / 30, 10, 20)]
        assert seeds.copies(" ".join(text + plain * 3 + item), held, 0.5)[0][1:] == (1.0, len(text) + 120, len(text) + 135)
