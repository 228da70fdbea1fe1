"""Page extraction: hand-made pages, host agreement, a plain version over the test pages."""

import html
import re
import time

import pytest

from leadspark.llm import pages
from leadspark.llm.queries import op1_host_paths

TEXT = "Words of the article, enough of them to count as prose in any container."


@pytest.mark.parametrize(
    "body,want",
    [
        (f"<nav><a>Menu</a></nav><article><h1>T</h1><p>{TEXT}</p></article><footer>F</footer>", f"T\n{TEXT}"),
        (f"<div class='main'><div class='sidebar'>S S S</div><div class='post-12 body'><p>{TEXT}<p>a &amp; b&nbsp;&#233;</div></div>", f"{TEXT}\na & b é"),
        (f"<header>Site</header><main><header><h1>Title</h1><p>menu</p></header><p>{TEXT}</p><div class='comments'><p>Great {TEXT} {TEXT}</p></div></main>", f"Title\n{TEXT}"),
        (f"<article><p>{TEXT}<br>next\n  line <b>bold</b></p><form>Name <input></form><script>x('</p>')</script><ul><li>one<li>two</ul></article>", f"{TEXT} next line bold\none\ntwo"),
        (f"<article><p><b>{TEXT}<br><p>{TEXT}</article><aside>x</aside>", f"{TEXT}\n{TEXT}"),
        (f"<!-- c --><div class=cookie-notice>{TEXT}</div><div id=ad>{TEXT}</div><section><p>{TEXT}</p></section>", TEXT),
        ("no markup at all  here", "no markup at all here"),
        (f"<article><p>{TEXT}</p><p>5 < 6 & 7 > 3</p>", f"{TEXT}\n5 < 6 & 7 > 3"),
        (f"<article><p hidden>h</p><p>{TEXT}</p><style>p{{}}</style><noscript>n</noscript></article>", TEXT),
        (f"<article><table><tr><td>a<td>b<tr><td>c</table><p>{TEXT}</p></article>", f"a\nb\nc\n{TEXT}"),
    ],
)
def test_extraction(body, want):
    for page in (body, f"<!DOCTYPE html><html><head><title>x</title></head><body>{body}</body></html>"):
        best = pages.vote(page)
        assert pages.extract(page, [best[0]] if best else []) == want
        assert pages.extract(page, []) == want


ARTICLE = f"<h1>T</h1><p>{TEXT}</p><p>{TEXT}</p>"
SAID = f"T\n{TEXT}\n{TEXT}"


@pytest.mark.parametrize(
    "body,want",
    [
        (f"<div class='content-sidebar'><article>{ARTICLE}</article></div>", SAID),
        (f"<div class='layout with-sidebar'><div class=content>{ARTICLE}</div><div class=sidebar><p>{TEXT}</p></div></div>", SAID),
        (f"<div class='site-main no-sidebar'>{ARTICLE}</div>", SAID),
        (f"<article class='post tags-python comments-open'>{ARTICLE}<div id=comments><p>{TEXT} {TEXT} {TEXT}</p><p>{TEXT}</p></div></article>", SAID),
        (f"<form id=aspnetForm><div>{ARTICLE}</div><div class=cookie-bar>{TEXT}</div></form>", SAID),
        (f"<form>{ARTICLE}</form>", SAID),
        (f"<article>{ARTICLE}<div class='side-by-side'><p>left</p><p>right</p></div><p class='social-science'>end</p><div class='share-buttons'>Tweet</div></article>", f"{SAID}\nleft\nright\nend"),
        (f"<main><div class=sidebar-wrap>{ARTICLE}</div><p>z</p><div class=related-posts><p>Other</p></div></main>", f"{SAID}\nz"),
        (f"<article>{ARTICLE}<p>a <span class=ad>buy</span> b <em class=share>now</em></p></article>", f"{SAID}\na b"),
        (f"<article>{ARTICLE}</article>" + f"<div class=comments>{ARTICLE * 40}</div>", SAID),
    ],
)
def test_names_alone_drop_no_article(body, want):
    best = pages.vote(f"<body>{body}</body>")
    assert pages.extract(f"<body>{body}</body>", []) == want == pages.extract(f"<body>{body}</body>", [best[0]])


@pytest.mark.parametrize("unit", ["<div>", "<b>", "</i>", "<font><p>", "<blockquote>", "<ul><li>", "<td>", "<dl><dd><div>", "<header>", "<form class=sidebar>", "<i class=ad>x<b>", "<", "<a ", "<div class='a b-1'>x"])
def test_a_megabyte_of_nested_or_unclosed_tags(unit):
    text = unit * (1_000_000 // len(unit)) + TEXT
    began = time.process_time()
    root = pages.parse(text)
    pages.containers(root)
    _, spans = pages.parts_of(root)
    for node, _, _ in spans:
        pages._key(node)
    assert time.process_time() - began < 12


def test_a_host_of_many_templates(spark):
    """More templates than any list would keep, the rarest a hundredth of its pages; one page of each has a long teaser."""
    rows = []
    for t in range(30):
        for k in range(3 if t else 200):
            long = f"<p>{TEXT} {TEXT} {TEXT}</p>" if k == 2 else "<p>Other.</p>"
            name = "".join(chr(97 + int(d)) for d in str(t))
            rows.append((len(rows), "http://many.example/", page(f"<div class='story-{name}'><p>{TEXT}</p><p>{TEXT} {t}</p></div><div class='teaser'>{long}</div>"), f"{TEXT}\n{TEXT} {t}"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, want string").repartition(5)
    got = pages.extract_pages(df).collect()
    assert len(got) == len(rows) and [r.page_id for r in got if r.text != r.want] == []


def test_paths_are_generalised():
    a, _ = pages.vote(f"<body><div class='post-12 x'><p>{TEXT}</p></div>")
    b, _ = pages.vote(f"<body><div class='x post-7'><p>{TEXT}</p></div>")
    assert a == b == "body>div.post-#.x"


def page(inner):
    return f"<html><body>{inner}</body></html>"


def test_hosts_agree_on_a_path(spark):
    usual = [(k, f"http://h.example/{k}", page(f"<div class='story'><p>{TEXT} {k}</p></div><div class='teaser'><p>Other.</p></div>")) for k in range(20)]
    # alone, the long teaser would win; the host says that the story is the text
    odd = (99, "http://H.example:80/odd", page(f"<div class='story'><p>Short.</p></div><div class='teaser'><p>{TEXT} {TEXT} {TEXT}</p></div>"))
    rows = [*usual, odd, (100, None, page(f"<article>{TEXT}</article>")), (101, "nonsense", None), (None, "http://x/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS n_chars", "'h' AS host")
    got = {r.page_id: (r.text, r.n_chars) for r in pages.extract_pages(df).collect()}
    assert got[99] == ("Short.", 6) and got[3] == (f"{TEXT} 3", len(TEXT) + 2) and got[100][0] == TEXT and got[101] == ("", 0) and got[None] == ("", 0)


def test_odd_markup_ends():
    for text in ["<", "<a", "<!--", "<!-- x", "</", "</p>", "<p", "<script>", "<script>x", "<div class=", "<<<p>>>", "&#xFFFFFFF; &bogus;", "<p>" * 3000 + "x", "<div>" * 3000 + "x", "a" * 200_000, "<" * 50_000, "<a '" * 5_000]:
        pages.extract(text, ["body>div"])
        pages.vote(text)


def test_test_pages(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.page_id: r for r in op1_host_paths(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|<footer>)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)[^>]*>", article.replace("<br>", " "))]
        want = "\n".join(p for p in parts if p)
        assert (got[r.page_id].url, got[r.page_id].text, got[r.page_id].n_chars) == (r.url, want, len(want))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert op1_host_paths(spark, str(tmp_path)).collect() == []
