"""The table of elements, groups under headings, table functions and the source of pages."""

from __future__ import annotations

import http.server
import random
import threading

import pytest
from pyspark.sql import functions as F

from quillspark.operators import elements, html
from quillspark.plans.q_corpus import FIXTURE
from quillspark.sources import pages


def frame(spark, markups):
    return spark.createDataFrame(list(enumerate(markups)), "page_id long, html string")


def random_markup(rng):
    """Headings, paragraphs, items and sections, some left open, some within others."""
    words = ["alpha", "beta gamma", "a longer line of words that stays", "x", ""]
    out = []
    for _ in range(rng.randint(0, 25)):
        tag = rng.choice(["h1", "h2", "h3", "h4", "p", "li", "div", "main", "ul", "b"])
        name = rng.choice(["", "", "", ' id="tasks"', ' id="notice-board"', ' id="timeline"'])
        out.append(f"<{tag}{name if tag == 'div' else ''}>{rng.choice(words)}{f'</{tag}>' if rng.random() < 0.6 else ''}")
    return "".join(out)


@pytest.mark.parametrize("name", ["terms", "sections"])
def test_groups_of_elements_are_those_of_the_page(spark, name):
    """The windows give what a walk over each page gives."""
    rng = random.Random(11)
    markups = [None, "", FIXTURE, "<p>no heading</p>", *[random_markup(rng) for _ in range(300)]]
    found = html.extract(frame(spark, markups), name)
    got = sorted((r.page_id, r.doc_id, r.section, r.title, r.text, r.kind, tuple(sorted((r.meta or {}).items()))) for r in found.collect())
    want = sorted((k, d["doc_id"], d["section"], d["title"], d["text"], d["kind"], tuple(sorted(d["meta"].items()))) for k, m in enumerate(markups) for d in html.EXTRACTORS[name](html.Page(m)))
    assert got == want and len(want) > 100


def test_elements_of_a_page(spark):
    rows = elements.elements(frame(spark, ["<h2 id=a>One</h2><p>two<p>three", None])).orderBy("page_id", "n").collect()
    assert [(r.page_id, r.n, r.tag, r.name, r.stop, r.text) for r in rows] == [(0, 0, "", None, 4, "One two three"), (0, 1, "h2", "a", 2, "One"), (0, 2, "p", None, 3, "two"), (0, 3, "p", None, 4, "three"), (1, 0, "", None, 1, "")]


def test_heading_groups_are_islands(spark):
    rows = spark.createDataFrame([(1, 1, "p", "before"), (1, 2, "h2", "A"), (1, 3, "p", "x"), (1, 4, "p", "x"), (1, 5, "h2", ""), (1, 6, "p", "y"), (1, 7, "h2", "B"), (2, 1, "h2", "C"), (2, 2, "b", "z")], "page_id long, n int, tag string, text string")
    got = sorted((r.page_id, r.heading, r.k, r.title, r.body) for r in elements.heading_groups(rows, ["h2"], ["p"], ["page_id"]).collect())
    assert got == [(1, 2, 0, "A", "x\ny"), (1, 7, 1, "B", ""), (2, 1, 0, "C", "")]
    untitled = elements.heading_groups(rows, ["h2"], ["p"], ["page_id"], titled=False)
    assert sorted((r.page_id, r.k, r.body) for r in untitled.collect()) == [(1, 0, "x"), (1, 1, "y"), (1, 2, ""), (2, 0, "")]


def test_extractors_are_table_functions(spark):
    plan = html.extract(frame(spark, [FIXTURE]), "faqs")._jdf.queryExecution().toString()
    assert "PageDocuments" in plan and "Lateral" in plan
    with pytest.raises(KeyError):
        html.extract(frame(spark, [""]), "nothing")


@pytest.fixture
def site():
    """Fails twice before it serves /flaky, and never serves /gone."""
    calls: dict[str, int] = {}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            calls[self.path] = calls.get(self.path, 0) + 1
            bad = self.path == "/gone" or self.path == "/flaky" and calls[self.path] < 2
            self.send_response(500 if bad else 200)
            self.end_headers()
            self.wfile.write(b"" if bad else f"<p>{self.path}</p>".encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", calls
    server.shutdown()


def test_pages_are_a_data_source(spark, site):
    base, calls = site
    spark.dataSource.register(pages.PageSource)
    read = spark.read.format("pages").option("base", base).option("pages", '[["/a", false], ["/flaky", false], ["/b", true]]')
    rows = read.load()
    assert rows.rdd.getNumPartitions() == 2 and not calls
    assert {r.url.removeprefix(base): r.html for r in rows.collect()} == {"/a": "<p>/a</p>", "/flaky": "<p>/flaky</p>"}
    assert calls["/flaky"] == 2
    assert read.option("volatile", "true").load().where("volatile").select("url").first().url == f"{base}/b"


def test_a_page_that_stays_away_ends_the_job(spark, site):
    spark.dataSource.register(pages.PageSource)
    read = spark.read.format("pages").option("base", site[0]).option("attempts", 1)
    with pytest.raises(Exception, match="could not fetch"):
        read.option("pages", '[["/gone", false]]').load().collect()
    with pytest.raises(Exception, match="base"):
        spark.read.format("pages").load().collect()


def test_scraped_pages_become_documents(spark, site):
    rows = pages.fetch_pages(spark, site[0], [("/result", False)])
    made = html.dispatch(rows).select("text", "volatile").collect()
    assert [(r.text, r.volatile) for r in made] == [("/result", True)] and rows.agg(F.count("*")).first()[0] == 1


def test_references_without_their_semicolon_stay():
    from quillspark.operators import html

    page = html.Page("<body><h1>a&amp;&amp</h1><p>b & c &am &#65; &#65 &lt;&ltd &copy; &nope; &amp;lt;</p></body>")
    assert page.text() == "a&&amp b & c &am A &#65 <&ltd © &nope; &lt;"
