"""The main text of pages with planted truth, the linear scan against all segments, and odd markup."""

import html
import random
import time

import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import html_extraction as X

WORDS = "stone river under the light of an old & narrow <bridge> naïve “quoted”   ends".split(" ")


def _words(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def _boilerplate(r):
    link = lambda: f'<a href="/x?a=1&b=2" title="a > b">{html.escape(_words(r, 2))}</a>'
    return r.choice(
        [
            lambda: "<nav><ul>" + "".join(f"<li>{link()}" for _ in range(5)) + "</ul></nav>",
            lambda: f'<div class="ad">{html.escape(_words(r, 30))}</div>',
            lambda: f"<aside><h2>More</h2><p>{html.escape(_words(r, 60))}</aside>",
            lambda: f'<div id="sidebar"><p>{html.escape(_words(r, 60))}</p><div><p>{link()}</div></div>',
            lambda: f'<form action="/s"><label>{_words(r, 3)}</label><select><option>a<option>b</select><input value=">"></form>',
            lambda: f'<section class="user-comments"><h3>Comments</h3><article class="comment"><p>{html.escape(_words(r, 80))}</p></article></section>',
            lambda: f'<div class="cookie-notice" role="dialog">{html.escape(_words(r, 25))}</div>',
            lambda: '<script>if (a < b) document.write("<p>no</p>");</script><style>p > b {margin: 0}</style>',
            lambda: f"<!-- {_words(r, 5)} <p>no</p> -->",
            lambda: f"<footer>&copy; {html.escape(_words(r, 12))}</footer>",
        ]
    )()


def _page(seed, marked=True):
    """html of a page, and its main text."""
    r = random.Random(seed)
    title, blocks = _words(r, 6), [_words(r, r.randint(3, 60)) for _ in range(r.randint(1, 8))]
    parts = [f"<h1>{html.escape(title)}</h1>" if marked else f"<p>{html.escape(title)}</p>"]
    for b in blocks:
        if marked and r.random() < 0.3:
            parts.append(_boilerplate(r))
        shown = html.escape(b).replace(" ", r.choice([" ", "\n  ", " <b>", "&nbsp;"]), 1)
        parts.append(r.choice([f"<p>{shown}</p>", f"<p>{shown}", f"<ul><li>{shown}</ul>", f"<blockquote>{shown}<br></blockquote>", f"<table><tr><td>{shown}</table>"]) if marked else f"<p>{shown}</p>")
    inner = "".join(parts)
    inner = f"<article class='post'>{inner}</article>" if marked else f'<div class="main-column">{inner}</div>'
    around = [_boilerplate(r) for _ in range(6)]
    page = f"<!DOCTYPE html><html><head><title>{html.escape(title)} | site</title></head><body>{''.join(around[:3])}{inner}{''.join(around[3:])}" + r.choice(["</body></html>", ""])
    return page, "\n\n".join(x for x in (" ".join(b.split()) for b in (title, *blocks)) if x)


@pytest.mark.parametrize("marked", [True, False])
def test_planted(marked):
    for seed in range(300):
        page, want = _page(seed, marked)
        assert X.Page(page, X.Model()).text() == want, seed


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=30))
def test_best_segment(scores):
    found = X.best_segment(scores)
    sums = {(a, b): sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)}
    best = max(sums.values(), default=0)
    assert found == ((0, 0) if best <= 0 else min((b, a) for (a, b), s in sums.items() if s == best)[::-1])


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("plain words", "plain words"),
        ("<article></article><p>outside of an empty article</p>", "outside of an empty article"),
        ("<article><p>one<p>two<br>three</article>", "one\n\ntwo three"),
        ("<p>a < b &lt;i&gt; &amp;amp; &am</p>", "a < b <i> &amp; &am"),
        ("<ARTICLE><P CLASS=x>caps</P></ARTICLE><NAV>menu</NAV>", "caps"),
        ("<article><p title=\"a > b\">quotes</p><p title='it\"s'>more</p></article>", "quotes\n\nmore"),
        ("<article><p title=\"stray>text</p></article>", "text"),
        ("<article><p>cut off</p><a href=", "cut off"),
        ("<article><script>never closed", ""),
        ("<article>a<!-- never closed", "a"),
        ("<main><div class=ad>buy</div><p>text</p></main><p>a b c d e f g h</p>", "text"),
        ("<main><h1>x</h1><article>inner</article></main>", "inner"),
        ("<article><header><h1>Title</h1></header><p>text</p><footer>tags</footer></article>", "Title\n\ntext"),
        ("<article><b>bo</b>ld <i>wo</i>rd</article></article></div>", "bold word"),
        ("<article><![CDATA[x]]><table><tr><td>a<td>b<tr><td>c</table></article>", "a b\n\nc"),
    ],
)
def test_markup(page, want):
    assert X.Page(page, X.Model()).text() == want


def test_long_page():
    page = "<article>" + "<p><b>word &amp; <i>" * 200_000 + "</article>" + "</div>" * 50_000 + "<" * 50_000 + '<a "' * 1000
    began = time.time()
    assert len(X.Page(page, X.Model()).text()) == 200_000 * 8 - 2
    assert time.time() - began < 30


def test_fit_and_extract(spark):
    rows = [(i, f"u{i}", f"<div class='box zone'>a b c d e f g h i j k l</div><article>{'<p>one two three</p>' * (i % 3)}</article><p class='both'>x</p>", "t", 1) for i in range(40)]
    rows += [(None, None, None, None, None), (None, "u", "", "", 1), (7, "again", rows[7][2], "", 2), (90, "u", "<div class='zone'>left out here</div><section>kept text</section>", "", 1)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, text string, `n.chars` int")
    model = X.fit(pages, sample=30)
    assert model.names == {".box": False, ".zone": False, ".both": False}
    assert model.costs["p"] < model.costs["div"] == X.DEAR
    found = X.extract(pages, model)
    assert found.schema.simpleString() == "struct<page_id:int,url:string,text:string,n_chars:bigint>"
    want = [(p, u, X.Page(h or "", model).text()) for p, u, h, *_ in rows]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(((p, u, t, len(t)) for p, u, t in want), key=repr)
    assert want[7][2] == "one two three" and want[-1][2] == "kept text" and want[5][2] == "one two three\n\none two three"
    assert X.fit(pages.limit(0)) == X.Model()
    assert X.extract(pages.limit(0), X.Model()).count() == 0


def test_given_pages(spark):
    """Every given page marks its article; its text is what lies in the mark, by another reading."""
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = {r.page_id: r.text for r in X.extract(pages, X.fit(pages)).collect()}
    for p in pages.collect():
        parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", p.html, re.S)[1])
        parts = [" ".join(html.unescape(re.sub(r"</?[a-z]+>", " ", x)).split()) for x in parts]
        assert found[p.page_id] == "\n\n".join(x for x in parts if x)
