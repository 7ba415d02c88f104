"""Template of pages that several hosts have, and of sections of a large host."""

from __future__ import annotations

import re

import pytest

from framewright.llm import html_text

SCHEMA = "page_id long, url string, html string"


def test_equal_pages_on_two_hosts(spark):
    box, other = "<div><p>All about us</p></div>", "<div><p>Follow me</p></div>"
    html = [f"<body>{box}{other}<div><p>Story {i}</p></div></body>" for i in range(8)]
    rows = [(10 * h + i, f"http://{name}.example/{i}", x) for h, name in enumerate(("www", "m")) for i, x in enumerate(html)]
    # a host of which only one box is template has one of the pages too
    rows += [(100 + i, f"http://z.example/{i}", f"<body>{box}<div><p>Own {i}</p></div></body>") for i in range(8)] + [(120, "http://z.example/0", html[0])]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[10 * h + i] == f"Story {i}" for h in range(2) for i in range(8))
    assert got[120] == "Follow me\nStory 0"


def test_a_section_of_a_large_host(spark, monkeypatch):
    monkeypatch.setattr(html_text, "MANY_PAGES", 20)
    box = "<div><p>In this section</p></div>"
    rows = [(i, f"http://h.example/{i}", f"<body>{box if i < 25 else ''}<div><p>Story {i}</p></div></body>") for i in range(100)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[3] == "Story 3" and got[50] == "Story 50"


def plain_text(page: str, others: list[str]) -> str:
    """The main text of a page by brute force: boxes of the flat test pages that enough other pages hold go."""
    boxes = re.findall(r"<(div|p|h1)\b[^>]*>(.*?)</\1>", page)
    held = [{re.sub(r"\s", "", t) for _, t in re.findall(r"<(div|p|h1)\b[^>]*>(.*?)</\1>", o)} for o in others]
    return "\n".join(t for _, t in boxes if sum(re.sub(r"\s", "", t) in h for h in held) < max(html_text.MIN_PAGES, html_text.MIN_SHARE * len(others)))


@pytest.mark.parametrize("mark", ["{}", "<article>{}</article>", "<main>{}</main>"])
def test_hashes_decide_what_is_text(spark, mark):
    """Boxes without a telling name, around the text of pages of one host: those that recur go, those that don't stay."""
    pages = []
    for i in range(12):
        own = mark.format(f"<h1>Title {i}</h1><p>first {i}</p><p>second {i * 7}</p>")
        before = "<div class='x1'>All about everything</div>" + (f"<div class='x2'>Block of kind {i % 2}</div>" if i % 3 else f"<div class='x2'>only here {i}</div>")
        pages.append(f"<html><body>{before}{own}<div>Written in the office</div><div>once {i}</div></body></html>")
    rows = [(i, "https://one.test/x", h) for i, h in enumerate(pages)] + [(99, "https://two.test/x", pages[0])]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, page in enumerate(pages):
        assert got[i] == plain_text(page, pages), i
        assert got[i] != html_text.Page(page).text()[0], "markup alone gives another text"
    alone = "Title 0\nfirst 0\nsecond 0"
    assert got[99] == (alone if "<" in mark else f"All about everything\nonly here 0\n{alone}\nWritten in the office\nonce 0")


def test_names_inside_an_article():
    page = "<article><p>a</p><div class='{}'><p>b</p></div><p>c</p></article>"
    for name in ("search", "related", "skip", "banner", "reply", "social", "promotion", "related-posts", "search-results", "banner-year"):
        assert html_text.Page(page.format(name)).text()[0] == "a\nb\nc", name
    for name in ("ad", "ads", "comment", "comments-list", "nav-list", "notice", "sidebar", "newsletter-form"):
        assert html_text.Page(page.format(name)).text()[0] == "a\nc", name
