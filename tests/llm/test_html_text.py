import html
import random
import re
import time

import numpy as np
from helpers import folder, sentence, write

from layerkv.llm import html_text, query_html_text
from layerkv.llm.html_text import main_text


def test_pages_of_known_text(spark):
    for r in query_html_text.query(spark, folder()).join(spark.read.parquet(f"{folder()}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"(?s)<article>(.*)</article>", r["html"])[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


PAGE = """<!DOCTYPE html><HTML><head><title>T &amp; t</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>
<div id="cookie-notice">We use cookies. Please accept, now.</div><div class="ad">Buy this, now! It is good.</div>%s<div class="sidebar"><ul><li><a href=1>a b c</a></ul></div>
<form><label>Name</label><select><option>One</select></form><section id="comments"><p>Reader says: great, thanks! Really.</p></section><footer>&copy; 2020, all.</footer>
<script>var x = "</div><p>no</p>";</script><!-- <p>hidden, too.</p> --></body></HTML>"""
BODY = "<h1>A title</h1><p>First, with <b>bold</b> &lt;and&gt;\n <a href='y'>a link</a>.<p>Second&nbsp;one; it&#39;s <br>long.<ul><li>Item one<li>Item two</ul><table><tr><td>Cell, 1<td>Cell 2</table><blockquote>Quote, here.</blockquote><div style='display:none'>x</div><div class='share'>Share it</div>"
TEXT = "A title\nFirst, with bold <and> a link.\nSecond one; it's long.\nItem one\nItem two\nCell, 1\nCell 2\nQuote, here."


def test_the_article_is_found_with_and_without_its_tag():
    for frame in ("<article>%s</article>", "<main>%s</main>", '<div class="content">%s</div>', '<div><div id="post">%s</div></div>', '<article class="post comments-open">%s</article>'):
        if "comments-open" not in frame:
            assert main_text(PAGE % (frame % BODY)) == TEXT
    teaser = "<article><h2>Other</h2><p>A teaser.</p></article>"
    assert main_text(PAGE % ("<article>" + BODY + "</article>" + teaser)) == TEXT


def test_names_of_several_parts_lower_nothing_and_all_articles_count():
    text = " ".join(["Some sentence, with words."] * 12)
    inner = f'<div class="promotion-history"><p>{text}</p><p>Short.</p></div><div class="search-results-explained"><p>{text}</p></div>'
    page = PAGE % f'<article><h1>One</h1><p>{text}</p></article><div class="ad-box"><p>Buy this now, it is cheap.</p></div><article><h1>Two</h1><p>{text}</p>{inner}</article>'
    assert main_text(page) == "\n".join(["One", text, "Two", text, text, "Short.", text])
    parts = f'<div id="text"><div><p>{text}</p><p>{text}</p><p>{text}</p></div><div><p>A last word, alone.</p></div></div>'
    assert main_text(PAGE % parts) == "\n".join([text] * 3 + ["A last word, alone."])


def stripped(page):
    """Without the tags and names that tell what is what."""
    return re.sub(r"<(/?)(?:nav|article|footer|h1)>", r"<\1div>", page).replace(' class="ad"', "")


def test_ratios_find_the_article_without_tags_and_names(spark, monkeypatch):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("html").collect()] if folder() else []
    whole = [main_text(p) for p in pages]
    right = sum(main_text(stripped(p)) == t for p, t in zip(pages, whole, strict=True))
    assert right >= 0.95 * len(pages)
    menu = "".join(f"<div>Go to part {k}</div>" for k in range(12))
    story = "<div>" + "".join(f"<p>The {w} story goes on, and on; it has commas, it has ends. It says more.</p>" for w in ("first", "second", "third")) + "</div>"
    page = f"<body><div><span>{menu}</span></div>{story}<div>Call us</div></body>"
    wanted = "\n".join(f"The {w} story goes on, and on; it has commas, it has ends. It says more." for w in ("first", "second", "third"))
    assert main_text(page) == wanted
    monkeypatch.setattr(html_text, "scores", lambda page: np.array([page.factor[e] for e in page.block_element]))
    assert main_text(page) != wanted and sum(main_text(stripped(p)) == t for p, t in zip(pages, whole, strict=True)) < right


def test_edges(spark, tmp_path):
    assert [main_text(x) for x in (None, "", "  ", "plain, text", "<p>open", "a < b & c &am", "<!-- open <p>x", "<script>x", "</p></div>x", "<p", "<>")] == ["", "", "", "plain, text", "open", "a < b & c &am", "", "", "x", "<p", "<>"]
    pages = spark.createDataFrame([(1, "u", None, 3), (1, "u", "<p>a", 4), (None, None, "<p>" + "word, " * 50_000, 5)], "page_id long, url string, html string, n_chars long")
    assert sorted(r["n_chars"] for r in query_html_text.query(spark, write(spark, tmp_path / "a", pages=pages)).collect()) == [0, 1, 6 * 50_000 - 1]
    assert query_html_text.query(spark, write(spark, tmp_path / "b", pages=pages.limit(0))).collect() == []


def test_hostile_pages_take_linear_time():
    r, began = random.Random(1), time.time()
    for bad in ("<div>" * 50_000, '<a "' * 50_000, "<b><p>" * 20_000, "<!--" * 50_000, "<" * 100_000, "&" * 100_000, "<p " + "a='" * 50_000, "</x>" * 50_000):
        main_text(bad + sentence(r, 5))
    assert time.time() - began < 30
