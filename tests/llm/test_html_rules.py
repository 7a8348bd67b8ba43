"""Block rules of pages: what is kept where class words, links, titles and notes of copyright stand in an article, and a version of the rules by hand."""

import random
import re
import time
from html import escape

import pytest

from cairnledger.llm import html

LINE = "It was the best of times and it was the worst of times, as he said to her in the old house by the sea, where they had all been for so long that the days were as one."
SHORT = "So it goes on and on."


def article(inside, before="", after=""):
    return f"<html><body><nav><a href=/>Home</a></nav>{before}<article><h1>Title</h1><p>{LINE}</p>{inside}<p>{LINE}</p></article>{after}<footer>Foot</footer></body></html>"


def text(inside, **more):
    return html.main_text(article(inside, **more)).split("\n")


@pytest.mark.parametrize("name", ["legal-analysis", "side-by-side", "social-history", "searchResults_essay", "menu of-the-day"])
def test_names_that_hold_a_class_word(name):
    assert text(f'<div class="{name}"><h3>Part</h3><p>{LINE}</p><p>{SHORT}</p></div>') == ["Title", LINE, "Part", LINE, SHORT, LINE]
    assert text(f'<div class="{name}"><p>Buy now</p><p><a href=x>{LINE}</a></p></div>') == ["Title", LINE, LINE]
    assert text(f'<p class="{name}">{LINE}</p>') == ["Title", LINE, LINE, LINE]


@pytest.mark.parametrize("name", ["ad", "legal", "newsletter-box", "related-posts", "site-footer", "sidebar-left", "cookie-law-notice", "sponsored-story", "comment-list"])
def test_names_that_are_class_words(name):
    assert text(f'<div class="{name}"><p>{LINE}</p><p>{SHORT}</p></div>') == ["Title", LINE, LINE]


def test_a_title_before_the_article():
    page = f"<body><h1>The title</h1><article><p>{LINE}</p><p>{SHORT}</p></article></body>"
    assert html.main_text(page) == f"The title\n{LINE}\n{SHORT}"
    apart = f"<body><h1>The site</h1><p>Menu</p><article><p>{LINE}</p></article></body>"
    assert html.main_text(apart) == LINE
    assert html.main_text(f"<body><h3>Small</h3><article><p>{LINE}</p></article></body>") == LINE


def test_items_of_a_list_that_are_links():
    item = lambda t: f"<li><a href=x>{t}</a></li>"
    assert text(f"<ul>{item('One source')}<li>{SHORT}</li>{item('Another')}</ul>") == ["Title", LINE, "One source", SHORT, "Another", LINE]
    assert text(f"<ul>{item('Just one')}</ul>") == ["Title", LINE, "Just one", LINE]
    assert text("<ul>" + "".join(item(f"Link {i}") for i in range(5)) + "</ul>") == ["Title", LINE, LINE]


def test_notes_of_copyright():
    assert text(f"<p>© is the sign of it, as {LINE}</p>")[2].startswith("© is")
    assert text("<p>© 2024 All rights reserved</p>") == ["Title", LINE, LINE]
    assert html.main_text(article("", after=f"<p>© {LINE}</p>")) == f"Title\n{LINE}\n{LINE}"


def test_end_tags_without_a_begin_cost_nothing():
    took = []
    for n in (20_000, 80_000):
        page = "<div>" * n + f"<p>{LINE}</p>" + "</span></section>" * n
        begun = time.process_time()
        assert html.main_text(page) == LINE
        took.append(time.process_time() - begun)
    assert took[1] < 10 * took[0] + 0.5


def by_hand(blocks):
    """The rules as they are told, for blocks (text, linked, in_main, heading, item) of a page with a main region, none of which is a title or in a region that goes."""
    def links(i):
        return blocks[i][2] and not blocks[i][3] and blocks[i][1] > 0.9 * len(blocks[i][0])

    def in_list(i):
        a = b = i
        while a > 0 and links(a - 1):
            a -= 1
        while b + 1 < len(blocks) and links(b + 1):
            b += 1
        return links(i) and (b - a + 1 >= 3 or not any(blocks[j][4] for j in range(a, b + 1)))

    def stops(t):
        w = t.split()
        return sum(x.strip(".,;:!?\"'()[]#*$%&|<>").lower() in html.STOP_WORDS for x in w) / len(w)

    def label(t, linked, main, heading, item):
        if linked > 0.4 * len(t):
            return None if main else False
        if not main:
            return len(t) >= 140 and stops(t) >= 0.25
        if len(t) >= 140:
            return True
        return True if len(t) >= 40 and t[-1] in ".!?:\"'”»" and not heading else None

    kept = [b for i, b in enumerate(blocks) if not in_list(i) and (b[2] or label(*b))]
    labels = [label(*b) for b in kept]
    if True not in labels:
        labels = [True if x is None and b[2] else x for x, b in zip(labels, kept, strict=True)]
    out = []
    for i, b in enumerate(kept):
        near = [(abs(j - i) * (2 if b[3] and j < i else 1), not labels[j]) for j in range(len(kept)) if labels[j] is not None]
        before = [x for j, x in zip([j for j in range(len(kept)) if labels[j] is not None], near, strict=True) if j < i][-1:]
        after = [x for j, x in zip([j for j in range(len(kept)) if labels[j] is not None], near, strict=True) if j > i][:1]
        stays = labels[i] if labels[i] is not None else bool(before + after) and not min(before + after)[1]
        if stays:
            out.append(b[0])
    return "\n".join(out)


def test_rules_by_hand():
    rng = random.Random(8)
    pool = [LINE, SHORT, "Short", "A line of forty characters and some more, no stop", "One of the longer lines that is a sentence and ends so.", "zzz " * 50 + "zzz", "Read more"]
    kept = 0
    for _ in range(400):
        page, blocks = [], []
        for part, main in (("before", False), ("main", True), ("after", False)):
            inner = []
            for _ in range(rng.randrange(1, 8) if main else rng.randrange(3)):
                t, heading, link = rng.choice(pool), main and rng.random() < 0.2, rng.random() < 0.3
                item = not heading and rng.random() < 0.4
                blocks.append((t, len(t) if link else 0, main, heading, item))
                shown = f"<a href=x>{escape(t)}</a>" if link else escape(t)
                inner.append(f"<h3>{shown}</h3>" if heading else f"<li>{shown}</li>" if item else f"<p>{shown}</p>")
            page.append(f"<article>{''.join(inner)}</article>" if main else "".join(inner))
        got = html.main_text("<body>" + "".join(page) + "</body>")
        want = by_hand(blocks)
        if want:  # a page of which nothing is kept has a last resort, which other tests have
            assert got == want, blocks
            kept += 1
    assert kept > 300
