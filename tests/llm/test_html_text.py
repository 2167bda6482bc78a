import html
import itertools
import re

import numpy as np
import pytest

from geolens.llm import html_text as H
from geolens.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain(page):
    """The article of the given pages, whose mark-up inside it is known: h1, p, b and br."""
    article = re.search(r"<article>(.*?)(</article>|$)", page or "", re.S)[1]
    pieces = (" ".join(html.unescape(re.sub(r"<[^>]*(>|$)", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
    return "\n\n".join(x for x in pieces if x)


def test_given_pages(spark):
    want = {r["page_id"]: (r["url"], plain(r["html"])) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = {r["page_id"]: (r["url"], r["text"]) for r in QUERIES["op9_html_text"](spark, FOLDER).collect()}
    assert got == want
    assert all(r["n_chars"] == len(r["text"]) for r in QUERIES["op9_html_text"](spark, FOLDER).collect())


@pytest.mark.parametrize(
    "page, kept",
    [
        ("<article><header><h1>T&amp;t</h1></header><p>a<p>b <i>c</b></div></article>", ["T&t", "a", "b c"]),
        ("<main>x<nav>n</nav>y<aside>z</aside><form>f<input></form></main><footer>f", ["x", "y"]),
        ("<body><article>a<div class='share-bar'>s</div><ul><li>1<li>2</ul></article><div id=comments><article><p>no</p></article></div>", ["a", "1", "2"]),
        ("<article>a &lt;b&gt; &eacute;&nbsp;&#233; c&nbsp; \n d<br>e</article>", ["a <b> é é c d e"]),
        ("<article>a<script>var x='</article><p>';</script>b<style>p{}</style>c<!-- d --> e <![CDATA[f]]></article>", ["a b c e"]),
        ("<article><p>cut <a href=\"x", ["cut"]),
        ("<article><p>5 < 6 and 7 > 3</p></article>", ["5 < 6 and 7 > 3"]),
        ("<article><div hidden>h</div><div style='display: none'>i</div><p aria-hidden=true>j</p>k</article>", ["k"]),
        ("<html><head><title>t</title><body><article><p>a</article>", ["a"]),
        ("<html><head><meta charset=utf-8><title>t</title><link rel=x><article><p>a</article>", ["a"]),
        ("<head><title>t</title>\n loose <main>a</main>", ["a"]),
        ("<head><title>t</title><script>var x='<body>'</script><style>p{}</style></head><body><article>a</article>", ["a"]),
        ("<div class='layout has-sidebar'><article>a</article></div><div class=sidebar>s</div>", ["a"]),
        ("<div class='post no-comments'><main>a</main></div>", ["a"]),
        ("<form action=x><div class=menu>m</div><article>a<form>f</form></article></form>", ["a"]),
        ("<div class=sidebar><div class=widget><article>a<nav>n</nav></article></div></div>", ["a"]),
        ("<aside><article>teaser</article></aside><article>a</article>", ["a"]),
        ("<div class=comments><article>no</article></div><div hidden><article>no</article></div>", []),
        ("<article>a<section id=search>b</section><section class=social-history>c</section><div class='ad-box'>d</div></article>", ["a", "b", "c"]),
        ("<article><p class=\"a>Hello</p><p>b</p></article>", ["Hello", "b"]),
        ("<article>a<svg><p>b</p></article>", ["a", "b"]),
        ("", []),
        ("no mark-up", []),
    ],
)
def test_blocks(page, kept):
    assert [t for t, loose in H.blocks(page) if not loose] == kept


def lcs(a, b):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, j in itertools.product(range(len(a)), range(len(b))):
        best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
    return best[-1, -1]


def test_alignment_is_a_longest_common_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a, b = rng.integers(0, 5, rng.integers(0, 12)), rng.integers(0, 5, rng.integers(0, 12))
        places = H.shared_places(a, b)
        assert len(places) == lcs(a, b) and places == sorted(set(places))
        rest = iter(b.tolist())
        assert all(any(x == y for y in rest) for x in a[places].tolist())


def test_template_blocks_are_deleted(spark):
    def page(own, *extra):
        return "<body><div>Site name</div>" + "".join(f"<p>{x}</p>" for x in own) + "".join(f"<div>{x}</div>" for x in extra) + "<div>All rights reserved</div></body>"

    rows = [(i, f"http://h{i // 4}.org/a/{i % 4}", page([f"own {i}", f"more {i}"], *(["Odd"] if i == 2 else []))) for i in range(8)]
    rows += [(20, "http://alone.org/", page(["only page"])), (30, "http://copy.org/1", page(["same"])), (31, "http://copy.org/2", page(["same"]))]
    rows += [(40, None, page(["x"])), (None, "http://[bad", None), (41, "", ""), (50, "http://big.org/", "<article>" + "w " * 100_000 + "</article>"), (50, "http://big.org/", "<article>a</article>")]
    frame = spark.createDataFrame([(*r, "own") for r in rows], "page_id long, url string, html string, row string").repartition(3)
    got = [(r["page_id"], r["text"]) for r in H.main_text(frame).collect()]
    assert len(got) == len(rows)
    texts = dict(got)
    for i in range(8):
        assert texts[i] == f"own {i}\n\nmore {i}" + ("\n\nOdd" if i == 2 else "")
    assert texts[20] == texts[40].replace("x", "only page") == "Site name\n\nonly page\n\nAll rights reserved"
    assert texts[30] == texts[31] == "Site name\n\nsame\n\nAll rights reserved"  # copies say nothing about a template
    assert texts[None] == "" and texts[41] == ""
    assert sorted(len(t) for k, t in got if k == 50) == [1, 199_999]
    assert H.main_text(frame.limit(0)).count() == 0


@pytest.mark.parametrize("copies", [3, 50])
def test_equal_pages_at_one_url_get_one_text(spark, copies):
    def page(own):
        return f"<body><div>Site name</div><p>{own}</p><div>All rights reserved</div></body>"

    rows = [(0, "http://h.org/a/1", page("before")), (1000, "http://h.org/a/3", page("after"))]
    rows += [(1 + i, "http://h.org/a/2", page("copy")) for i in range(copies)]
    rows += [(500 + i, "http://h.org/a/2", page("revised")) for i in range(copies)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r["page_id"]: r["text"] for r in H.main_text(frame).collect()}
    assert got == {i: re.search("<p>(.*)</p>", x)[1] for i, _, x in rows}


def test_alignment_of_long_pages_splits_the_table(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(H, "TABLE_CELLS", 20)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(0, 40)), rng.integers(0, 6, rng.integers(0, 40))
        places = H.shared_places(a, b)
        assert len(places) == lcs(a, b) and places == sorted(set(places))
        rest = iter(b.tolist())
        assert all(any(x == y for y in rest) for x in a[places].tolist())


def test_copies_at_neighbouring_paths_get_one_text(spark):
    def page(own):
        return f"<body><div>Template line</div><p>{own}</p></body>"

    rows = [(i, f"http://h.org/a/{i}", page("copy")) for i in range(4)] + [(9, "http://h.org/a/9", page("other"))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in H.main_text(frame).collect()} == {0: "copy", 1: "copy", 2: "copy", 3: "copy", 9: "other"}
