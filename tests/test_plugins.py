"""Site plugins: a fixture for each site and way, and the lateral join."""

from tessera.sources import plugins

URL = "https://site.org/careers/all"
PAGES = {
    # Two rows want one link; the second takes its own next best. A date is no title.
    "undp": ("<table><tr><td>Job Title Water engineer\n</td><td><a href='/view/12345'>v</a><a href='/jobs'>all</a></td><td>Location: Oslo\nDeadline: 2024-02-03\n</td></tr>"
             "<tr><td>Job Title Water driver\n<a href='/view/12345'>same</a></td><td><a href='/apply/9'>a</a></td></tr><tr><td>Job Title 01-02-2024\n</td><td><a href='/view/3'>x</a></td></tr></table>",
             [("Water engineer", "https://site.org/view/12345", "Oslo", "2024-02-03"), ("Water driver", "https://site.org/apply/9", None, None)]),
    "unesco": ("<table><tr><th>Post title</th><th>Duty station</th><th>Closing</th></tr><tr><td><a href='a/1'>Chief of section</a></td><td>Paris</td><td>3 May 2024</td></tr><tr><td>No link here</td><td>Rome</td><td></td></tr><tr><td>Map editor</td><td>Paris</td><td><a href='#'>x</a> <a href='/e'>go</a></td></tr></table>",
               [("Chief of section", "https://site.org/careers/a/1", "Paris", "2024-05-03"), ("Map editor", "https://site.org/e", "Paris", None)]),
    "unicef": ("<section><h3>Health specialist, Chad</h3><a href='/p/1'>More</a> Location: Chad\nDeadline: 01/06/2024\n</section><section><h3>Job categories here</h3><a href='/c'>c</a> location</section>", [("Health specialist, Chad", "https://site.org/p/1", "Chad", "2024-06-01")]),
    "amnesty": ("<li><strong>Researcher on East Asia</strong> <a href='/r'>Read</a></li><li><strong>Follow us on the net</strong><a href='/f'>f</a></li><li class='job'><strong>Only one of class job</strong></li>", [("Researcher on East Asia", "https://site.org/r", None, None)]),
    "save_the_children": ("<table><tr><td>Field manager Kenya</td><td><a href='/k'>k</a></td></tr><tr><td>Sort by the date</td><td><a href='/s'>s</a></td></tr></table>", [("Field manager Kenya", "https://site.org/k", None, None)]),
    "generic": ("<a href='/about'>About us all</a><a href='/x1'>Finance officer, Lima</a><a href='mailto:a@b.c'>Job by mail</a><a href='/x1'>Finance officer, Lima</a>", [("Finance officer, Lima", "https://site.org/x1", None, None)]),
}


def test_each_site(spark):
    rows = [(k, URL, html) for k, (html, _) in PAGES.items()] + [("none", URL, None), ("broken", None, "<table><tr><td"), ("undp ", URL, "Unsupported browser")]
    df = spark.createDataFrame(rows, "page_id string, url string, html string").selectExpr("*", "page_id as wanted", "1 as title")
    got = {}
    for r in plugins.site_records(spark, df, preferred="wanted").orderBy("page_id", "n").collect():
        assert r.plugin == r.page_id
        got.setdefault(r.page_id, []).append((r.title, r.apply_url, r.location, r.deadline))
    assert got == {k: rows for k, (_, rows) in PAGES.items()}


def test_plugin_by_host_and_unreadable_pages(spark):
    html = PAGES["save_the_children"][0]
    rows = [("a", "https://jobs.savethechildren.net/x", html), ("b", "https://jobs.savethechildren.net/x", html + "Unsupported browser"), ("c", "https://x.example/", PAGES["generic"][0]), ("d", "https://careers.unesco.org/", PAGES["unesco"][0])]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    assert {(r.page_id, r.plugin) for r in plugins.site_records(spark, df).collect()} == {("a", "save_the_children"), ("c", "generic"), ("d", "unesco")}
