"""Main text of pages against the templates they were made from."""

import collections
import html
import math
import re

import numpy as np
import pytest

from ampere.llm import extraction
from ampere.llm.extraction import content_cluster, extract_pages, main_text, smooth

from llm_tables import SMALL


def test_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r.page_id: r for r in extract_pages(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S).group(1)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


LONG = "A long enough paragraph of the article that goes on for a while and then some more. "


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("   ", ""), ("plain  text\nonly", "plain text only"), ("<p>a</p><p>b</p>", "a b"),
    ("<nav><a href=x>menu</a></nav>", ""), ("<article></article><div class=ad>Buy now, it is cheap</div>", ""),
    (f"<body class='with-sidebar'><div class='wrap with-sidebar'><article><header class='article-header'><h1>T</h1></header>"
     f"<p class=ad>buy</p><p>{LONG}<p class=x>More</article></div><div class=sidebar><p>side</p></div></body>", f"T {LONG}More"),
    (f"<div id=header><h1>Site</h1></div><div class=nav><a>a</a></div><div id=content><h2>T</h2><p>{LONG}</p><p>Short.</p>"
     "<div class=comments><p>A reader wrote a long comment here that goes on and on and on.</p></div></div>"
     "<div id=footer>&copy; x</div>", f"T {LONG}Short."),
    (f"<main><h1>T</h1><p>{LONG}</p><aside>Aside</aside><form><label>Email</label></form><p>Two.</p><section id=comments>"
     "<article class=comment><p>Longer than all of the article itself, in fact, by a word or two or three</p></article></section></main>",
     f"T {LONG}Two."),
    ("<nav><ul><li>x<article><p>Hello&nbsp;&amp; w<b>or</b>ld<br>now &#8364;</p>", "Hello & world now €"),
    ("<script>var a='<p>no</p>'</script><style>p{}</style><article><p>yes</p><script>no</script> and</article>", "yes and"),
    ("<article><p>cut in a ta</p><p cla", "cut in a ta"), ("<article>a < b and c</article>", "a < b and c"),
    ("<!-- <p>no</p> --><article><p>yes<!-- no --></p></article>", "yes"),
    ("<article><table><tr><td>one<td>two</table><pre>a\n  b</pre></article>", "one two a b"),
    ("</div></p><article></b>text</article></html>", "text"),
])
def test_templates(page, text):
    assert main_text(page) == " ".join(text.split())


def test_content_in_sibling_elements():
    part = lambda n: f"<div><p>{LONG * n}</p></div>"
    for sizes in ((1, 3), (3, 1), (1, 1, 6), (2, 8, 2)):
        page = f"<nav><a href=x>menu</a></nav><div id=page>{''.join(map(part, sizes))}</div><footer>&copy; x</footer>"
        assert main_text(page) == " ".join((LONG * sum(sizes)).split())
    # every level of nesting has a part of the article
    menu = "<ul>" + "<li><a href=x>menu</a></li>" * 9 + "</ul>"
    page = f"{menu}<div id=page>{part(2)}<div>{part(2)}<div>{part(3)}{part(5)}</div></div></div>{menu}"
    assert main_text(page) == " ".join((LONG * 12).split())


def test_long_page():
    text = main_text("<article>" + f"<p>{LONG}</p>" * 5000 + "</article>")
    assert text == " ".join((LONG * 5000).split())


def test_smoothing_and_clusters():
    assert np.allclose(smooth(np.full(9, 3.0), 1.5), 3.0)
    values = np.array([1, 1.2, 0.8, 9, 10, 11.0])
    assert content_cluster(values).tolist() == [False] * 3 + [True] * 3
    assert content_cluster(np.ones(4)).all()
    assert content_cluster(np.array([4.0, 5, 6, 9])).all()  # not split where nothing lies near zero


def _truth(page):
    inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S).group(1)
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())


def _bare(page):
    """The page without anything that names its parts."""
    page = re.sub(r"</?(?:article|main)>", "", page)
    return re.sub(r"""\s(?:class|id|role)=(?:"[^"]*"|'[^']*'|[^\s>]+)""", "", page)


def _f1(got, want):
    got, want = collections.Counter(got.split()), collections.Counter(want.split())
    both = sum((got & want).values())
    return 2 * both / max(1, sum(got.values()) + sum(want.values()))


def test_pages_without_names_of_their_parts(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    scores = [_f1(main_text(_bare(p)), _truth(p)) for p in pages]
    assert np.mean(scores) >= 0.95 and np.mean(np.array(scores) > 0.999) >= 0.9
    # as do pages whose menus and footers are plain elements as well
    plain = [re.sub(r"<(/?)(?:nav|footer|header|aside)\b", r"<\1div", _bare(p)) for p in pages]
    assert np.mean([_f1(main_text(q), _truth(p)) for p, q in zip(pages, plain)]) >= 0.95


@pytest.mark.parametrize("wrong", ["all", "random"])
def test_clusters_decide(spark, monkeypatch, wrong):
    """Without the clusters the texts change, with and without an article element."""
    rng = np.random.default_rng(3)
    pages = [r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    right = [main_text(p) for p in pages], [main_text(_bare(p)) for p in pages]
    bits = {"all": lambda v: np.ones(len(v), bool), "random": lambda v: rng.random(len(v)) < 0.5}[wrong]
    monkeypatch.setattr(extraction, "content_cluster", bits)
    for make, want in ((str, right[0]), (_bare, right[1])):
        assert sum(main_text(make(p)) != w for p, w in zip(pages, want)) > 0.1 * len(pages)


def plain_ratios(page, sigma=1.5):
    """Ratios of a page of <p> and <div> lines, smoothed and cut by an exhaustive search of the threshold."""
    lines, tags = [], 0
    for tag, text in re.findall(r"(<[^>]*>)|([^<]+)", page):
        tags += bool(tag)
        if text.strip():
            lines.append((text.strip(), len(text.strip()) / max(1, tags)))
            tags = 0
    own = np.array([r for _, r in lines])
    smoothed = [sum(math.exp(-0.5 * ((i - j) / sigma) ** 2) * r for j, r in enumerate(own) if abs(i - j) <= 5)
                / sum(math.exp(-0.5 * ((i - j) / sigma) ** 2) for j in range(len(own)) if abs(i - j) <= 5) for i in range(len(own))]

    def upper(values):
        values = sorted([*values, 0.0, 0.0])
        cost = lambda k: np.var(values[:k]) * k + np.var(values[k:]) * (len(values) - k)
        return values[min(range(1, len(values)), key=cost)]

    high = [min(np.log1p(own)[i] >= upper(np.log1p(own)), np.log1p(smoothed)[i] >= upper(np.log1p(smoothed))) for i in range(len(own))]
    return " ".join(t for (t, _), h in zip(lines, high) if h)


def test_against_a_plain_version():
    rng = np.random.default_rng(4)
    words = lambda n: " ".join("w" * int(k) for k in rng.integers(2, 9, n))
    for _ in range(40):
        menu = lambda: "".join(f"<div><div><a href=x>{words(1)}</a></div></div>" for _ in range(rng.integers(3, 9)))
        body = "".join(f"<div><p>{words(rng.integers(40, 90))}</p></div>" for _ in range(rng.integers(2, 12)))
        page = menu() + body + menu()
        assert main_text(page) == plain_ratios(page)


def test_odd_rows(spark):
    rows = [(1, "u", "<p>x</p>", "kept"), (1, "u", "<p>x</p>", "kept"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in extract_pages(df).collect())
    assert got == [(0, None, "", 0), (1, "u", "x", 1), (1, "u", "x", 1)]
    assert extract_pages(df.limit(0)).count() == 0
