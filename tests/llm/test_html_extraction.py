import html
import re

import pytest

from tesserae.llm import html_extraction as H

TREE = H.trained_tree()


def test_table_is_learned():
    assert all(H.kept_by(TREE, r[:-1]) == bool(r[-1]) for r in H.LABELLED)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><nav><a href=/>Home</a></nav><article><h1>T &amp; U</h1><p>one <b>two</b>\n three<p>four</article><footer>&copy; x</footer>", "T & U\none two three\nfour"),
        ("<main><p>a<br>b</p><div class='ad'>buy</div><p>c</p><aside>more</aside><form><label>q</label></form></main>", "a b\nc"),
        ("<article><p>x</p><section id=comments><p>nice one, thank you</p></section></article>", "x"),
        ("<article><script>var t='</p>';</script><style>p{}</style><p>a &lt;b&gt; c", "a <b> c"),
        ("<body class='nav-open'><article><p>kept</p><ul><li>i<li>j</ul><table><tr><td>k<td>l</table></article>", "kept\ni\nj\nk\nl"),
        ("<article><p>a<!-- <p>no</p> -->b</p><p>c <a title='x>y' href=z>d</a></p><div class=cookie-notice>ok?</div></article>", "ab\nc d"),
        ("<article><header><h1>Head</h1><p>by someone</p></header><p>body of it</p></article>", "Head\nbody of it"),
        ("", ""), ("plain words only", "plain words only"), ("<article></article>", ""), ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
    ],
)
def test_pages(page, text):
    assert H.main_text(page, TREE) == text


PARAGRAPH = " ".join(f"word{i}" for i in range(48))


@pytest.mark.parametrize(
    "wrapper",
    ["<div class='content has-sidebar'>", "<main class='main no-sidebar'>", "<article class='post legal'>", "<article id='related-work'>", "<article class='entry no-comments'>",
     "<div class='post-content social-science'>", "<div id='search-results-page'><article>", "<div class='sidebar-layout'><article>", "<div class=widget><main>", "<section id='related-work'>"],
)
def test_names_of_wrappers_void_no_article(wrapper):
    assert H.main_text(f"<body><nav><a href=/>Home</a></nav>{wrapper}<h2>On it</h2><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p>", TREE) == f"On it\n{PARAGRAPH}\n{PARAGRAPH}"


@pytest.mark.parametrize(
    "rest",
    ["<div class='cookie-notice'><p>{p}</p></div>", "<section id=comments><article class='comment'><p>{p}</p></article></section>", "<div class='post-comments'><p>{p}</p></div>", "<div class='content-sidebar'><p>{p}</p></div>",
     "<div class='comment-content'><p>{p}</p></div>", "<aside><article><p>{p}</p></article></aside>", "<div class='related-posts'><p>Read on</p><a href=/>Next one</a></div>", "<div class='ad-content'><p>{p}</p></div>",
     "<div hidden class=post><p>{p}</p></div>", "<div class='sidebar'><article><p>Short words</p><a href=/>Next</a></article></div>"],
)
def test_notices_comments_and_adverts_go(rest):
    page = f"<body><article><h1>On it</h1><p>{PARAGRAPH}</p></article>{rest.format(p='some other ' * 30)}"
    assert H.main_text(page, TREE) == f"On it\n{PARAGRAPH}"


def plain_text(page):
    """The page's article as its markup says, block by block."""
    a = page.split("<article>")[1].split("</article>")[0]
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", a.replace("<br>", " ")))
    return [x for x in (" ".join(html.unescape(q).split()) for q in parts) if x]


def test_recall_and_precision_by_block(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    right = got = want = 0
    for p in pages.collect():
        a, b = H.main_text(p.html, TREE).split("\n"), plain_text(p.html)
        right, got, want = right + len([x for x in a if x in b]), got + len(a), want + len(b)
    assert right >= 0.999 * got and right >= 0.999 * want


def test_names_and_types_of_columns(spark):
    rows = spark.createDataFrame([(1, "<p>a b c d e f g h</p>")], "page_id long, html string").selectExpr("*", "named_struct('a b', 1) AS `x y`", "map('k', 1) AS m")
    assert H.extracted(rows).first()["x y"]["a b"] == 1


def test_driver_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in H.extracted(pages).collect()}
    for p in pages.collect():
        a = p.html.split("<article>")[1].split("</article>")[0]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", a.replace("<br>", " ")))
        want = "\n".join(x for x in (" ".join(html.unescape(q).split()) for q in parts) if x)
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want)


def test_table_edges(spark):
    schema = "page_id long, url string, html string, text string, n_chars string, `a.b` int"
    rows = spark.createDataFrame([(1, None, None, "old", "x", 1), (None, "u", "<p>" + "word " * 30, None, None, 2), (1, None, None, "old", "x", 1)], schema)
    out = H.extracted(rows)
    assert out.columns == ["page_id", "url", "a.b", "text", "n_chars"]
    assert sorted(r.n_chars for r in out.collect()) == [0, 0, 149]
    assert H.extracted(rows.limit(0)).count() == 0


def test_hostile_pages_take_linear_time():
    for page in ("<" * 100_000, "<a " * 50_000, "<div>" * 20_000, "</p>" * 50_000, '<a b="' * 30_000, "<!--" * 50_000, "&" * 100_000, "<script>" * 20_000):
        H.main_text(page, TREE)
