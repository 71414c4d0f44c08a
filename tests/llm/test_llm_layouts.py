"""Main text of pages with layouts and names that training has never met."""

import os
import re

import duckdb
import pytest
from layouts import PAGES, made

from framescore.llm import html_text

#: Hand-written pages that have to come out whole: the first seven of grids and hashed names, and articles whose parts have names.
WHOLE = [*range(7), *range(18, 27)]


def _blocks(page: str) -> list[str]:
    text = html_text.main_text(html_text.train(), page)
    return text.split("\n") if text else []


@pytest.mark.parametrize("k", WHOLE)
def test_whole_article(k):
    page, want = made(*PAGES[k])
    assert _blocks(page) == want


def test_hand_written_layouts():
    right = lost = wrong = 0
    for template, blocks in PAGES:
        page, want = made(template, blocks)
        left = list(want)
        for b in _blocks(page):
            if b in left:
                left.remove(b)
                right += 1
            else:
                wrong += 1
        lost += len(left)
    assert len(PAGES) >= 50 and right / (right + lost) >= 0.97 and right / (right + wrong) >= 0.97


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_names_say_nothing():
    """Whatever the article's element is called, the texts stay the same."""
    pages = [h for (h,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id").fetchall()]
    inner = [re.search("<article>(.*)</article>", h, re.S) for h in pages]
    want = [[n.text for n in html_text.parse(m[1]) if n.tag == "#text"] for m in inner]
    assert [_blocks(h) for h in pages] == want
    for name in ("col-md-9", "col", "css-1x2y3z", "jsx-123", "flex grow", "px-4 py-2", "mw-body", "qzzkt", "Seite3", "x"):
        for h, m, w in list(zip(pages, inner, want, strict=True))[::5]:
            assert _blocks(f'{h[: m.start()]}<div class="{name}">{m[1]}</div>{h[m.end() :]}') == w, name


def test_text_as_it_stands():
    texts = lambda page: [(n.tag, n.text) for n in html_text.parse(page) if n.text]
    assert texts("<p>a<xmp>b < c &amp; <i>d</i></xmp>e") == [("#text", "a"), ("#text", "b < c &amp; <i>d</i>"), ("#text", "e")]
    assert texts("<xmp>never closed <b>") == [("#text", "never closed <b>")]
