"""Pages as tables of nodes and the records in their divs and lists, against a plain walk over nested elements."""

import random
import time
from collections import Counter
from xml.etree import ElementTree

from pyspark.sql import functions as F

from tessera.sources import nodes


def test_nodes_of_wellformed_pages_equal_a_walk():
    rng = random.Random(2)

    def build(depth):
        el = ElementTree.Element(rng.choice(["div", "section", "span", "b"] if depth else ["body"]))
        el.text = rng.choice(["", "x", "two words", "é漢😀"])
        for _ in range(rng.randint(0, 4) if depth < 5 else 0):
            child = build(depth + 1)
            child.tail = rng.choice(["", "t", "\n"])
            el.append(child)
        return el

    for _ in range(30):
        root = build(0)
        text, got = nodes.read_page(ElementTree.tostring(root, encoding="unicode", method="html"))
        assert text == "".join(root.itertext())
        order = list(root.iter())
        place, parent = {id(e): i for i, e in enumerate(order)}, {id(c): p for p in order for c in p}
        for e, n in zip(order, got, strict=True):
            assert (n["tag"], n["pre"], n["last"]) == (e.tag, place[id(e)], place[id(e)] + len(list(e.iter())) - 1)
            assert n["parent"] == (place[id(parent[id(e)])] if e is not root else -1) and text[n["begin"] : n["end"]] == "".join(e.itertext())

        def shape(e):
            kids = [shape(c) for c in e]
            return (e.tag, tuple(k for i, k in enumerate(kids) if not i or k != kids[i - 1]))

        same = Counter((id(parent.get(id(e))), shape(e)) for e in order)
        assert [n["alike"] for n in got] == [same[id(parent.get(id(e))), shape(e)] for e in order]


PAGES = {
    "classes": '<div class="x card-list"><div class="card"><a href="/p/1">Nurse in Rome</a> Location: Rome\nDeadline: 2024-05-01</div><div class="card"><a href="#top">Driver wanted</a>\nDuty Station: Oslo</div><div class="card">x</div></div>',
    "jobs first": '<div class="card"><a href="a">A card it is</a></div><li class="jobs"><a href="b">A job it is</a><li class="job"><a href="/c">no</a>\nThe second job line\n',
    "sections": '<section class="Careers"><a href="1">First of three</a><a href="2">Second one</a><a href="3">Third one</a></section><section class="career"><a href="4">Alone here</a></section>',
    "main": '<div class="n"><a href="/away">Outside of main</a></div><div id="page-content"><div><a href="../up">Substantial link</a></div><li><a href="x">about us now</a></li><article>none</article></div>',
    "shapes": "<ul><li><b><a href='one?a=b'>First of list</a></b><li><b><a href='//h.org/2'>Second of list</a></b><li><b><a href='javascript:void'>Third of list</a></b></ul><p>a</p><p>b</p><p>c</p>",
    "nothing": "<p>Text</p><script>var a = '<li><a href=x>script</a></li>'</script>", "null": None, "empty": "",
}


def test_records_by_rule(spark):
    df = spark.createDataFrame([(k, "http://a.org/dir/page?q=1", h) for k, h in PAGES.items()], "page_id string, url string, html string").withColumn("text", F.lit(1)).withColumn("nodes", F.lit(2))
    trees = nodes.page_trees(df)
    got = {}
    for r in nodes.div_records(trees).orderBy("page_id", "n").collect():
        got.setdefault(r.page_id, []).append((r.rule, r.title, r.apply_url, r.location, r.deadline))
    card, li = nodes.CONTAINERS.index(("div", "card")), nodes.CONTAINERS.index(("li", "job"))
    assert got == {
        # The outer div is a card too, by part of its class; its first link is the first card's, and the date runs into the next text.
        "classes": [(card, "Nurse in Rome", "http://a.org/p/1", "Rome", None), (card, "Nurse in Rome", "http://a.org/p/1", "Rome", "2024-05-01"), (card, "Driver wanted", None, "Oslo", None)],
        "jobs first": [(li, "A job it is", "http://a.org/dir/b", None, None), (li, "The second job line", "http://a.org/c", None, None)],
        "sections": [(nodes.SECTION, "First of three", "http://a.org/dir/1", None, None)],
        "main": [(nodes.MAIN, "Substantial link", "http://a.org/dir/../up", None, None)],
        "shapes": [(nodes.REPEATED, "First of list", "http://a.org/dir/one?a=b", None, None), (nodes.REPEATED, "Second of list", "http://h.org/2", None, None), (nodes.REPEATED, "Third of list", None, None, None)],
    }
    assert [r.n for r in nodes.div_records(trees, most=1).where("page_id = 'shapes'").collect()] == [0]
    assert nodes.page_trees(df.where("false")).count() == 0 and nodes.node_rows(trees).where("page_id = 'null'").count() == 0


def test_no_shuffle(spark):
    df = spark.createDataFrame([("a", "u", "h")], "page_id string, url string, html string")
    assert "Exchange" not in nodes.div_records(nodes.page_trees(df))._jdf.queryExecution().executedPlan().toString()


def test_malformed_and_deep_pages():
    for html, tag in [("<a " * 20_000 + '"', None), ("<a " * 20_000 + '">', "a"), ("<!--" * 20_000 + ">", None), ("<" * 20_000 + ">", None), ("<div>" * 20_000 + "x", "div"), ("<li>" * 20_000, "li"), ("</p>" * 20_000, None), ("<p>" * 20_000, "p"), ("<b><li>" * 5000, "li")]:
        began = time.perf_counter()
        _, got = nodes.read_page(html)
        assert time.perf_counter() - began < 5 and (tag is None or sum(n["tag"] == tag for n in got) == max(1, html.count(f"<{tag}>")))
