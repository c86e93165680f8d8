"""HTML extraction against the articles of the test pages and hand-made pages."""

import html
import re

import numpy as np
import pytest

from karstmap.llm import htmltext, queries

SF = "/root/testdata/sf0.01"


def plain(page):
    body = re.search(r"<article>(.*?)(</article>|<footer|$)", page or "", re.S)
    text = re.sub(r"</?b>", "", body[1] if body else "")
    return " ".join(html.unescape(re.sub(r"<[^>]*>?", " ", text)).split())


def test_html_query(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op6_html_extraction(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == plain(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("just &lt;text&gt; &amp; more&nbsp;&eacute;", "just <text> & more é"),
        ("<p>one<p>two <b>bold</b>ly<br>three</p><script>var t='<p>no</p>'</script><!-- no --><style>no</style>", "one two boldly three"),
        ("<nav>no</nav><main><h1>T</h1><p>a\n\t b</p></main><footer>no</footer>", "T a b"),
        ("<body><header>no</header><p>yes</p><aside>no</aside><div class='cookie-notice'>no</div><form>no<input></form><div id=comments><p>no</p></div>", "yes"),
        ("<article><p>yes</p><div class='share'>no</div><ul><li>x<li>y</ul></article><p>outside</p>", "yes x y"),
        ("<table><tr><td>a</td><td>b</td></tr></table>", "a b"),
        ("<p>cut <b", "cut"),
        ("<div><p hidden>no</p><p>a</div>b", "a b"),
        ("<form action=x><input><article><p>body</p><form>no</form></article></form>", "body"),
        ("<div class='search-results-page'><article>body</article>no</div>", "body"),
        ("<article>yes</article><section class=comments><article>no</article></section><form><article>no</article></form>", "yes"),
        ("<div>text</div><section class=comments><article>no</article></section>", "text"),
        ("<article><p>yes<form>no</form> on<div class=share><article>no</article></div></article>", "yes on"),
    ],
)
def test_blocks(page, text):
    assert " ".join(htmltext.stay_texts(htmltext.blocks_of(page))) == text


def test_differencing(spark):
    site = lambda body: f"<div>Home of all</div><div>{body}</div><div>All rights</div>"
    rows = [(i, f"http://www.a.org/x/{i}.html", site(f"own text {i}")) for i in range(9)] + [(20, "https://b.org/1", site("alone")), (21, None, site("no url")), (22, "http://[bad", None)]
    rows += [(30, "http://c.org/p", site("same " * 40)), (31, "http://c.org/p?x", site("same " * 40)), (31, "http://c.org/p?x", site("same " * 40))]
    df = spark.createDataFrame([(a, b, c, 1) for a, b, c in rows], "page_id long, url string, html string, row int")
    for size in (1000, 3, 1):
        got = htmltext.main_text(df, range_pages=size).collect()
        by = {r.page_id: r.text for r in got}
        assert len(got) == len(rows) and all(by[i] == f"own text {i}" for i in range(9))
        assert by[20] == "Home of all alone All rights" and by[22] == "" and by[21].startswith("Home")
        assert by[30] == by[31] == " ".join(["Home of all", *["same"] * 40, "All rights"])
    assert htmltext.main_text(df.limit(0)).count() == 0


def test_common_is_longest():
    draw = np.random.default_rng(11)
    for _ in range(100):
        a, b = ([str(x) for x in draw.integers(0, 4, draw.integers(0, 12))] for _ in range(2))
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        at = htmltext.common(a, b)
        assert len(at) == rows[-1][-1] and at == sorted(set(at))
        rest = iter(b)
        assert all(a[i] in rest for i in at)


def test_template_goes_however_large_and_past_copies(spark):
    site = lambda body: f"<div>{'menu of all ' * 200}</div><div>{body}</div><div>{'rights ' * 100}</div>"
    bodies = ["short one", *["copied"] * 4, "short two", *["copied"] * 3]
    df = spark.createDataFrame([(i, f"http://a.org/{i}", site(b)) for i, b in enumerate(bodies)], "page_id long, url string, html string")
    for size in (1000, 3, 1):
        got = {r.page_id: r.text for r in htmltext.main_text(df, range_pages=size).collect()}
        assert got == dict(enumerate(bodies))


def test_long_repeating_pages_are_aligned():
    draw = np.random.default_rng(13)
    a, b = ([str(x) for x in draw.integers(0, 5, 2500)] for _ in range(2))
    row = np.zeros(len(b) + 1, int)
    for x in a:
        same = np.array([x == y for y in b])
        new = np.maximum(row[1:], np.where(same, row[:-1] + 1, 0))
        row = np.concatenate([[0], np.maximum.accumulate(new)])
    at = htmltext.common(a, b)
    assert len(at) == row[-1] > 1500 and at == sorted(set(at))
    rest = iter(b)
    assert all(a[i] in rest for i in at)


def test_depth_costs_nothing():
    deep = 30_000
    blocks = htmltext.blocks_of("<div><b>" * deep + "x" + "</b><p>y</p></div>" * deep)[0]
    assert len(blocks) == deep + 1


def test_differencing_deletes_lines(spark):
    page = lambda i: f"<nav>Home</nav><p>Site line</p><div>menu</div><p>text {i}</p><p>own {i}</p><footer>all rights</footer>"
    df = spark.createDataFrame([(i, f"http://a.org/{i}", page(i)) for i in range(5)] + [(9, "http://b.org/", page(9))], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_lines, r.n_shared) for r in htmltext.main_text(df).collect()}
    assert got == {**{i: (f"text {i} own {i}", 6, 4) for i in range(5)}, 9: ("Site line menu text 9 own 9", 6, 0)}
