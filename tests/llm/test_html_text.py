from __future__ import annotations

import html
import re

import pytest

from flowloom.llm.html_text import extract_text, main_text


def direct(page: str) -> str:
    """The blocks between the article tags of the test pages."""
    article = page[page.find("<article>") + 9 : page.find("</article>")]
    blocks = [
        " ".join(html.unescape(re.sub(r"<[^>]*>", " ", block.replace("<b>", ""))).split())
        for block in re.split(r"</?(?:p|h1)>", article)
    ]
    return "\n".join(block for block in blocks if block)


def test_articles_of_the_test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = extract_text(pages).join(pages.select("page_id", "html"), "page_id").collect()
    assert len(rows) == pages.count()
    for row in rows:
        assert row.text == direct(row.html), row.page_id


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain  text", "plain text"),
        ("<script>var a='<p>no</p>'</script><style>p{}</style>", ""),
        ("<nav>menu <article><p>body text</p>", "body text"),
        ("<article><h1>A</h1></article>", "A"),
        ("<article><p>a &amp; b&nbsp;c &#233; &am", "a & b c é &am"),
        ("<article><p>one<br>two<p>three</article>", "one two\nthree"),
        (
            "<main><article><header><h1>T</h1><span>by x</span></header><p>Text of it.</p>"
            "<aside>side bar text</aside><form><label>Mail</label></form></article>"
            "<section class='comments'><article class='comment'><p>nice post</p></article>"
            "</section></main><footer>f</footer>",
            "T\nText of it.",
        ),
        (
            "<div class='menu'><a>x</a></div><div><p>Long text for the page body here.</p>"
            "<p>Short.</p></div><div id='cookie-notice'>We use cookies</div>",
            "Long text for the page body here.\nShort.",
        ),
        ("<article><p hidden>no</p><p style='display: none'>no</p><p>yes</p></article>", "yes"),
    ],
)
def test_made_pages(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    ("block", "others", "length"), [(20_000, 300, 300), (5_000, 200, 40), (100_000, 500, 500)]
)
@pytest.mark.parametrize("around", ["<article>{}</article>", "<div>{}</div>", "{}"])
def test_one_long_block_among_ordinary_ones(block, others, length, around):
    lines = ["y" * length] * others
    lines.insert(others // 2, "x" * block)
    page = around.format("".join(f"<p>{line}</p>" for line in lines))
    assert main_text(f"<html><body>{page}</body></html>") == "\n".join(lines)


def test_one_long_block_in_a_section_of_its_own():
    lines = ["y" * 300] * 300
    sections = "".join(f"<section><p>{a}</p><p>{a}</p></section>" for a in lines)
    page = f"<div>{sections}<section><pre>{'x' * 20_000}</pre></section></div>"
    assert main_text(page) == "\n".join([*lines, *lines, "x" * 20_000])


def test_links_outside_the_text_stay_out():
    links = "<ul>" + "<li><a href='/'>Some link</a></li>" * 95 + "</ul>"
    body = ["word " * 60] * 12
    page = f"<div>{links}</div><div>{''.join(f'<p>{x}</p>' for x in body)}</div>"
    assert main_text(page) == "\n".join(x.strip() for x in body)


def test_an_article_with_text_is_never_dropped():
    page = "<article><p>short</p></article><article><p>" + "long " * 900 + "</p></article>"
    assert main_text(page).startswith("short\nlong")


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body class='no-sidebar'><p>body text</p></body>", "body text"),
        ("<html id='search'><body class='has-sidebar widget'><p>text</p></body></html>", "text"),
        ("<main class='search' id='comments'><p>text</p></main>", "text"),
        ("<article class='post category-social'><p>a</p><p>b</p></article>", "a\nb"),
        ("<article class='hentry comments-open share' id='notice'><p>a</p></article>", "a"),
        (
            "<article><p>Intro.</p><h2 id='related-work'>Related work</h2><p>Others.</p>"
            "<section id='search-results'><h2>Results</h2><p>Found.</p></section>"
            "<section id='comments'><p>Remarks.</p></section><div class='share'>x</div></article>",
            "Intro.\nRelated work\nOthers.\nResults\nFound.\nRemarks.",
        ),
        ("<main><section id='notice'><p>part</p></section></main>", "part"),
        ("<main><p>part</p><div id='comments'><p>nice</p></div></main>", "part"),
        ("<p>part of it</p><div id='cookie-notice'>We</div><div class='sidebar-left'>x</div>", "part of it"),
        (
            "<article><p>a</p><article class='comment'><p>nice</p></article></article>"
            "<div class='comments'><article class='comment'><p>nice</p></article></div>",
            "a",
        ),
    ],
)
def test_names_that_hide_and_names_that_do_not(page, text):
    assert main_text(page) == text


def test_tables(spark):
    rows = [(1, None, "old"), (None, "", "x"), (2, "<p>" + "word " * 200_000, "y"), (2, "<p", "z")]
    df = spark.createDataFrame(rows, "page_id bigint, html string, text string")
    found = extract_text(df).collect()
    assert [(r.page_id, len(r.text)) for r in found][:3] == [(1, 0), (None, 0), (2, 999_999)]
    assert len(found) == 4
    assert extract_text(df.limit(0)).count() == 0
