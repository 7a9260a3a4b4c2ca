import pytest

from falloff.llm import html_text

BODY = "<p>" + "</p><p>".join(f"Paragraph {k} tells a part of the story at some length, so that its text is dense." for k in range(5)) + "</p>"


def test_article_without_its_surroundings():
    page = f"""<!doctype html><html><head><title>T</title><style>p {{}}</style><script>var a = "<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<main><article><h2>Title &amp; more</h2>{BODY}<p>Short.</p><aside>Side</aside><form><p>Sign up</p></form></article></main>
<section class="comments"><p>A reader writes a long comment that is as dense as an article is, with many words in it.</p></section>
<footer>&copy; 2020</footer></body></html>"""
    lines = html_text.main_text(page).split("\n")
    assert lines[0] == "Title & more" and lines[-1] == "Short." and len(lines) == 7


def test_white_space_references_and_inline_tags():
    assert html_text.main_text("<p>a\n  <b>b</b>&nbsp;c&#233; &lt;d&gt;</p><p> e<br>f </p>") == "a b cé <d>\ne f"


@pytest.mark.parametrize("html", [None, "", "   ", "<p></p>", "<script>x</script>", "<nav>menu</nav>", "<!-- c -->"])
def test_nothing_gives_an_empty_text(html):
    assert html_text.main_text(html) == ""


def test_broken_and_very_long_pages():
    assert html_text.main_text("<div><p>one<p>two</div></span></b>") == "one\ntwo"
    assert html_text.main_text("plain text") == "plain text"
    assert html_text.main_text("<" * 1000) is not None
    long = "".join(f"<p>line {k} of many words in a row</p>" for k in range(20_000))
    assert html_text.main_text(long).count("\n") == 19_999


def test_rows_keep_their_columns(spark):
    pages = spark.createDataFrame([(1, "u", BODY, "x"), (1, "u", BODY, "x"), (2, None, None, None)], "page_id long, url string, html string, text string")
    out = html_text.extract(pages)
    assert out.columns == pages.columns and sorted(len(r["text"]) for r in out.collect())[0] == 0
    assert html_text.extract(pages.limit(0)).count() == 0


def test_smoothing_keeps_the_mean_of_a_constant():
    import numpy as np

    assert np.allclose(html_text.smoothed(np.full(9, 3.0)), 3.0)


def dense(n, word):
    return "".join(f"<p>{word} {k} tells a part of the story at some length, so that its text is dense.</p>" for k in range(n))


@pytest.mark.parametrize("page", ["<div id=content><section>{a}</section><section>{b}</section></div>", "<div>{b}<blockquote>{a}</blockquote></div>", "<table><tr><td>{a}</td><td>{b}</td></tr></table>", "<div>{a}</div>{b}"])
def test_content_beside_the_core_stays_without_an_article(page):
    lines = html_text.main_text("<body><nav>Menu</nav>" + page.format(a=dense(9, "First"), b=dense(2, "Second")) + "<footer>Foot</footer></body>").split("\n")
    assert len(lines) == 11 and sum(x.startswith("Second") for x in lines) == 2


@pytest.mark.parametrize("page", ['<div class="layout has-sidebar">{}</div>', '<div id="page-with-header"><article>{}</article></div>', '<div class="no-comments">{}</div>', '<form id="aspnet"><div>{}</div></form>', "<form><main>{}</main></form>", '<div class="header"><main>{}</main></div>', '<section id="related-work">{}</section>'])
def test_elements_around_the_text_are_not_skipped(page):
    lines = html_text.main_text("<body>" + page.format('<h2 id="related-work">Related work</h2><p id="notice">Notice this.</p>' + BODY) + "</body>").split("\n")
    assert lines[:2] == ["Related work", "Notice this."] and len(lines) == 7


def test_marked_elements_beside_the_text_stay_out():
    others = "".join(f'<div class="{c}"><p>Other text that is as dense as an article is, with words.</p></div>' for c in ("site-footer", "cookie-notice", "sidebar", "x related-posts"))
    comments = "<section id=comments><article>" + dense(9, "Comment") + "</article></section>"
    for page in (f"<div>{BODY}{others}<form><p>Sign up</p></form></div>", f"<article>{BODY}{others}</article>{comments}"):
        assert html_text.main_text(page).count("\n") == 4


def unmarked(k):
    """A page whose elements have no telling name: a menu, ten paragraphs of which the last stands apart, a list of links."""
    links = "".join(f"<div><a href=/{j}>Go {j}</a></div>" for j in range(6 + k))
    text = "".join(f"<p>Part {j} of text {k} tells the story at such length that the line is dense, as lines are.</p>" for j in range(9))
    return f"<body><div class=x>{links}</div><div class=y>{text}</div><div class=z><p>The closing part stands apart from the others, yet it is dense as well.</p></div><div class=q>{links}</div></body>"


def test_the_ratios_decide_where_no_element_is_named(monkeypatch):
    import numpy as np

    pages = [unmarked(k) for k in range(5)]
    found = [html_text.main_text(p).split("\n") for p in pages]
    assert [len(x) for x in found] == [10] * 5 and all(x[0].startswith("Part 0") and x[-1].startswith("The closing") for x in found)
    monkeypatch.setattr(html_text, "ratios", lambda lines: np.full(len(lines), 7.0))
    assert all("Go 1" in html_text.main_text(p).split("\n") for p in pages)


def test_clusters_as_by_hand():
    """Ratios, smoothing and threshold of an unmarked page, computed line by line in plain Python."""
    import math

    page = unmarked(2)
    parser = html_text._Lines()
    parser.feed(page)
    parser.close()
    parser._end_line()
    lines = parser.lines()
    ratio = [x.length / max(1, x.tags) for x in lines]
    smooth = []
    for i in range(len(ratio)):
        w = {j: math.exp(-0.5 * (i - j) ** 2) for j in range(max(0, i - 3), min(len(ratio), i + 4))}
        smooth.append(sum(w[j] * ratio[j] for j in w) / sum(w.values()))
    mean = sum(smooth) / len(smooth)
    least = 0.8 * math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth))
    content = [x.text for x, y in zip(lines, smooth, strict=True) if y >= least]
    firm = [x.text for x, y, z in zip(lines, smooth, ratio, strict=True) if y >= least and z >= least]
    assert len(content) >= len(firm) == 10 and html_text.main_text(page).split("\n") == firm


def test_ties_repeated_rows_and_clashing_names(spark):
    same = "<div>{0}</div><nav>menu</nav><div>{0}</div>".format(dense(3, "Equal"))
    assert html_text.main_text(same) == html_text.main_text(same) and html_text.main_text(same).count("\n") == 2
    rows = spark.createDataFrame([(1, "a", same, "html", 3)] * 2, "page_id long, n_chars string, html string, text string, lines long")
    assert [r["text"].count("\n") for r in html_text.extract(rows).collect()] == [2, 2]
