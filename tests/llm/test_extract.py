import numpy as np
import pytest

from viaduct.llm import extract

P = "Quite a long sentence of prose stands here, so that it has many characters for each of its tags."
PARAGRAPHS = "".join(f"<p>{P} {i}.</p>" for i in range(4))
WANT = "\n".join(f"{P} {i}." for i in range(4))
PAGES = {
    "article": (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=x>Menu</a></ul></nav><article><h1>Title</h1>{PARAGRAPHS}</article><footer>&copy; us</footer></body></html>", f"Title\n{WANT}"),
    "divs": (f"<div class='top-bar header'><a>Home</a></div><div id=content><h2>Title</h2>{PARAGRAPHS}</div><div id='sidebar'><p>{P}</p></div><div class=footer>{P}</div>", f"Title\n{WANT}"),
    "comments": (f"<main><article class='post has-comments'>{PARAGRAPHS}</article><section class=comments><h2>Comments</h2><article class=comment><p>{P} {P}</p></article></section></main>", WANT),
    "short lines stay": (f"<article><h1>A</h1><p>Yes.</p>{PARAGRAPHS}<p>No.</p><p>&amp;</p></article>", f"A\nYes.\n{WANT}\nNo.\n&"),
    "open tags": (f"<body><article><h1>A<p><b>One<br>two<p>Three</b><ul><li>x<li>y</ul>{PARAGRAPHS}", f"A\nOne two\nThree\nx\ny\n{WANT}"),
    "white space": (f"<article><p> a\n\t b&nbsp;c <i>d</i>e <!-- no --> f</p>{PARAGRAPHS}</article>", f"a b c de f\n{WANT}"),
    "advert inside": (f"<article>{PARAGRAPHS}<div class='ad-slot ads'><p>{P}</p></div><p>End <span class=advert>buy</span>now.</p><form><p>{P}</p></form></article>", f"{WANT}\nEnd now."),
    "script text": (f"<article><p>a<script>if (1 < 2) '</p>'</script>b</p>{PARAGRAPHS}</article>", f"ab\n{WANT}"),
    "marked wrapper": (f"<div class='page with-sidebar'><header><p>{P}</p></header><article><header><h1>T</h1></header>{PARAGRAPHS}</article></div>", f"T\n{WANT}"),
    "notice": (f"<div role=dialog><p>{P}</p></div><div class='cookie-notice'>{P}</div><div>{PARAGRAPHS}</div><p hidden>{P}</p>", WANT),
    "menu without mark": (f"<div>{PARAGRAPHS}<ul><li><a>a</a><li><a>b</a><li><a>c</a></ul></div>", WANT),
    "references": ("<article><p>1 &lt; 2 &#233; &eacute; &unknown; &am</p></article>", "1 < 2 é é &unknown; &am"),
    "nothing": ("", ""),
    "only a menu": ("<nav>Menu</nav>", ""),
    "plain": ("just text", "just text"),
    "cut": ("<article><p>text <a href='x", "text"),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    html, want = PAGES[name]
    assert extract.main_text(html) == want


def test_null_and_very_long_pages():
    assert extract.main_text(None) == ""
    many = "<article>" + "".join(f"<p>{P} {i}</p>" for i in range(20_000)) + "</article>"
    assert extract.main_text(many).count("\n") == 19_999
    assert extract.main_text("<article><p>" + "x " * 500_000 + "</p></article>") == ("x " * 500_000).strip()
    deep = extract.main_text("<div>" * 20_000 + P)
    assert deep == P
    assert extract.main_text("<b>" * 20_000 + P) == P


def test_ratios_smoothing_and_runs():
    flat = np.ones(9)
    assert np.allclose(extract.smoothed(flat), 1)
    peak = extract.smoothed(np.eye(9)[4])
    assert peak.argmax() == 4 and np.isclose(peak[3], peak[5]) and 0 < peak[2] < peak[3]
    chosen, _ = extract.content(np.array([1.0, 1, 1, 90, 80, 3, 95, 1, 1, 1]))
    assert list(np.flatnonzero(chosen)) == [3, 4, 5, 6] or list(np.flatnonzero(chosen)) == [2, 3, 4, 5, 6, 7]
    links = np.array([1, 1, 0, 1, 1, 1, 1, 0], dtype=bool)
    assert list(extract.link_runs(links, np.ones(8, dtype=bool))) == [False] * 3 + [True] * 4 + [False]


def test_rows_and_clashing_names(spark):
    rows = [(1, "u", PAGES["article"][0], "x", 1), (1, "u", PAGES["article"][0], "x", 1), (2, None, None, "x", 1), (None, "v", "", None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(extract.extract_pages(df).collect(), key=str)
    want = PAGES["article"][1]
    assert [tuple(r) for r in got] == sorted([(1, "u", want, len(want))] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=lambda r: str(got[0].__class__(page_id=r[0], url=r[1], text=r[2], n_chars=r[3])))
    assert extract.extract_pages(df.limit(0)).count() == 0
