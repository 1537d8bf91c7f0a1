"""Pages with omitted end tags, drawings and formulas."""

import time

import pytest

from textloom.llm.html_text import extract

PROSE = "A long paragraph with the words of and to in a language that is here for you to read, and some more of it."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><meta charset=x><body><article><p>{PROSE}</p></article>",
        f"<head><title>T</title><style>p{{}}</style><article><p>{PROSE}</p></article>",
        f"<head><title>T</title></head><body><article><svg width='1'/><p>{PROSE}</p></article></body>",
        f"<body><article><svg width='1'><path d='M0'/><text>label</text><p>{PROSE}</p></article><svg>",
        f"<body><article><svg><title>icon</title><text>label</text></svg><math/><p>{PROSE}</p></article>",
    ],
)
def test_omitted_ends(page):
    assert extract(page) == PROSE


def test_formulas_stay():
    assert extract(f"<article><p>{PROSE} <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p></article>") == f"{PROSE} x=1 holds."


@pytest.mark.parametrize("wrapper", ["class='layout has-sidebar'", "class=no-sidebar", "class='content-side'", "class='page with-related'", "id='search-result-page'"])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_marked_wrappers_of_the_content(wrapper, tag):
    beside = "<div class='sidebar'><p>Something else that stands beside the text and is of no use to you at all, as it is not in the article.</p></div>"
    page = f"<body><div {wrapper}><div class='inner'>{beside}<{tag}><p>{PROSE}</p>{beside}</{tag}></div></div></body>"
    assert extract(page) == PROSE


def test_comments_and_tags_keep_their_marks():
    comments = f"<div class='comments'><article class='comment-body'><p>{PROSE} I disagree.</p></article></div>"
    assert extract(f"<article><p>{PROSE}</p>{comments}</article>{comments}") == PROSE
    assert extract(f"<nav><article><p>{PROSE}</p></article></nav>") == ""


def test_linked_paragraph_of_an_article():
    assert extract(f"<article><p>{PROSE}</p><p><a href=x>{PROSE}</a> More.</p></article>") == f"{PROSE}\n\n{PROSE} More."
    assert extract(f"<article><p>{PROSE}</p></article><div><a href=x>{PROSE}</a></div>") == PROSE


@pytest.mark.parametrize("part", ["<a ", "<!", "</", '<a "', "<a '\"<b ", "<script", "<div>", "<svg>", "<!--", "<a href='\">", "&amp", "<article>", "<p><b>"])
def test_long_pages_take_linear_time(part):
    began = time.time()
    extract(part * (1_000_000 // len(part)))
    extract("<div>" * 50_000 + "</p>" * 100_000)
    assert time.time() - began < 20


def test_a_quote_without_end_takes_nothing_along():
    assert extract(f"<article><p>{PROSE}</p><a title=\"x>link</a><p>{PROSE}</p></article>").startswith(PROSE)


def test_odd_rows(spark):
    from textloom.llm.html_text import main_text

    page = f"<article><p>{PROSE}</p></article>"
    rows = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, "x"), (None, "u", "", None)], "page_id long, url string, html string, text string")
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in main_text(rows).collect())
    assert got == [(0, "", 0), (1, PROSE, len(PROSE)), (1, PROSE, len(PROSE)), (2, "", 0)] and main_text(rows.limit(0)).count() == 0
