"""Main text of web pages by two-pass block rules.

The markup is cut into text blocks. Blocks in regions that never hold main text (menus, footers, forms, comments and the like) go.
The first pass decides the others by link density, length and stop-word density, and leaves ambiguous short ones open; that a block
lies in an article or main region is one feature, which moves the thresholds and decides nothing by itself. In the second pass an
open block takes the label of the nearest decided neighbours: of both if they agree, else of the nearer one by blocks between,
and the kept one if they are as near. A heading belongs to what follows it, so the neighbour before it counts as twice as far.
On a page where no block is decided to be kept, the open blocks of a main region are, or else those that end as a sentence does.

Words of a class are a feature where they are but part of a name: inside a main region, what stands in a `legal-analysis` or `side-by-side` is judged as
what surrounds it if it holds a full paragraph, and goes if it does not. A title right before a main region is open, as are items of a list in it that are
links, unless these are a list of nothing else.

Defined results: a null or empty page has an empty text; markup that is cut off or never closed is read to its end;
a table of pages without rows gives none; an unclosed button, menu, drawing or frame ends
at the next block; pages are independent, so repeated rows give repeated results; nothing is dropped or cut inside a kept block,
however long it is; deep nesting needs no recursion; other columns of the input are not touched.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the markup language: elements whose content is never text, elements without an end, elements that cut blocks.
SILENT = frozenset("script style noscript template iframe object svg math canvas audio video select textarea button head".split())
#: Silent elements that only their end tag ends, and those that can't hold their like.
RAW, FLAT = frozenset("script style".split()), frozenset("button select textarea iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Regions that never hold main text, by element, role, and words of class or id.
ASIDE = frozenset("nav footer aside header form menu dialog".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar side aside footer header masthead cookie cookies consent gdpr notice notification alert popup modal overlay "
    "comment comments commentlist disqus respond reply replies discussion share sharing social related recommended recommendations "
    "newsletter subscribe subscription signup login search pagination pager widget toolbar skip copyright legal".split()
)
#: Of these, elements that may be wrapped around a whole page; first words of names that say what an element has.
WEAK = frozenset("form header".split())
STATES = frozenset("no not has have with without is".split())
MAIN_WORDS = frozenset("article post entry story content".split())
#: Of the aside words, those that decide wherever they stand in a name; and words that say nothing but where or in what an element is.
HARD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr comment comments commentlist disqus respond reply "
    "replies related recommended recommendations newsletter subscribe subscription signup login".split()
)
PLACE_WORDS = frozenset("site page global main top bottom left right primary secondary mobile sticky bar box wrap wrapper container inner outer section block area list item items link links row col column text".split())
#: Frequent words of the languages at hand.
STOP_WORDS = frozenset(
    "a an and are as at be by for from has he in is it its of on or that the this to was were will with you not but his her "
    "der die das und ist in von den mit auf für ein eine als nicht zu im dem des sich auch es an er so dass "
    "le la les de des et en un une du que qui est pour dans par sur pas au avec ce il elle ne se plus ou "
    "el los las y que en una por con para su al lo como más pero sus esta es del se o".split()
)
SHORT, LONG, STOPS, LINKED, LIST = 40, 140, 0.25, 0.4, 0.9
#: Links of a paragraph at most, and items that make a list of links.
PARAGRAPH_LINKED, LIST_ITEMS = 0.25, 3
TITLES = frozenset("h1 h2".split())
HEADINGS, GONE = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("aside weak hidden".split())
ENDS = (".", "!", "?", ":", '"', "'", "\u201d", "\xbb")

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Block:
    text: str
    linked: int
    region: str  # "main", "aside", "weak" (aside by class words, form or header), "mixed" (such words in a name with others), "hidden" or "" for none
    heading: bool = False
    title: bool = False
    item: bool = False  # of a list
    group: int = 0  # of the mixed region that it is in


def words_of(names: str) -> set[str]:
    """The words of a class or id, but for names such as has-sidebar or no-comments, which say what an element has and not what it is."""
    parts = [[w.lower() for w in PARTS.findall(name)] for name in names.split()]
    return {w for words in parts if words and words[0] not in STATES for w in words}


def comment(names: str) -> bool:
    parts = [[w.lower() for w in PARTS.findall(name)] for name in names.split()]
    return any(w and w[0] not in STATES and (w[0] == "comment" or w[-1] in ("comment", "comments")) for w in parts)


def region_of(tag: str, attributes: str, around: str) -> str:
    """The region that an element opens inside another. A hidden one stays so, whatever it holds; main opens in any other, and
    article where only words of a class, a form or a header are around, but not in a firm aside, as in a list of teasers."""
    if around == "hidden":
        return around
    given = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
    names = f"{given.get('class', '')} {given.get('id', '')}"
    words, role = words_of(names), given.get("role", "").lower()
    if "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", ""):
        return "hidden"
    inside = around == "main"
    if tag == "main" or role == "main":
        return "main"
    if tag == "article":
        return "aside" if comment(names) or around == "aside" else "main"
    if around == "aside" or role in ASIDE_ROLES or tag in ASIDE - WEAK:
        return "aside"
    if around == "weak" or tag in WEAK - ({"header"} if inside else set()):
        return "weak"
    if words & ASIDE_WORDS and tag not in ("html", "body") and not (inside and words & ASIDE_WORDS <= {"header"}):
        return "mixed" if inside and not words & HARD_WORDS and words - ASIDE_WORDS - PLACE_WORDS else "weak"
    if around == "mixed":
        return around
    return "main" if words & MAIN_WORDS and tag in ("div", "section", "td") else around


def silent_end(page: str, tag: str, begin: int) -> int:
    """Where a silent element's content ends: at its end tag; if it has none, at the next block, but scripts and styles at the page's end."""
    close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, begin)
    if tag in RAW or tag == "head":
        return close.end() if close else begin if tag == "head" else len(page)
    again = re.compile(rf"<{re.escape(tag)}\b", re.I).search(page, begin) if tag in FLAT else None
    if close and not (again and again.start() < close.start()):
        return close.end()
    return next((m.start() for m in TOKEN.finditer(page, begin) if (m[2] or "").lower() in BLOCK - {"option", "legend"}), len(page))


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order, with the number of linked characters and the region of each."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []  # open elements and the regions inside them
    counts: Counter[str] = Counter()  # of the open elements by name, so that an end tag without a begin costs nothing
    held: list[str] = []
    linked = links = groups = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = SPACE.sub(" ", unescape("".join(held))).strip()
            if text:
                near = [t for t, _ in stack[-3:]]
                out.append(Block(text, min(linked, len(text)), stack[-1][1] if stack else "", any(t in HEADINGS for t in near), any(t in TITLES for t in near), "li" in near, groups))
            held.clear()
        linked = 0

    done, end = 0, len(page)
    while done < end:
        m = TOKEN.search(page, done)
        data = page[done : m.start() if m else end]
        if data:
            held.append(data)
            if links:
                linked += len(SPACE.sub(" ", unescape(data)).strip())
        if not m:
            break
        done = m.end()
        if m[0].startswith("<![CDATA["):
            continue
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCK:
                flush()
            if tag == "a":
                links = max(0, links - 1)
            while counts[tag]:  # each element is closed once, by its own end or by that of one around it
                closed, _ = stack.pop()
                counts[closed] -= 1
                if closed == tag:
                    break
            continue
        if tag in SILENT:
            if not m[3].rstrip().endswith("/"):
                done = silent_end(page, tag, done)
            continue
        if tag in BLOCK:
            flush()
        if tag == "a":
            links += 1
        if tag not in VOID and tag != "p" and not m[3].rstrip().endswith("/"):
            around = stack[-1][1] if stack else ""
            stack.append((tag, region_of(tag, m[3], around)))
            counts[tag] += 1
            groups += stack[-1][1] == "mixed" != around
        elif tag == "p" and m[3] and (region := region_of(tag, m[3], stack[-1][1] if stack else "")) in ("aside", "weak", "hidden", "mixed"):
            groups += region == "mixed" != (stack[-1][1] if stack else "")
            stack.append((tag, region))
            counts[tag] += 1
    flush()
    return out


def stop_density(text: str) -> float:
    words = [w.strip(".,;:!?\"'()[]#*$%&|<>").lower() for w in text.split()]
    return sum(w in STOP_WORDS for w in words) / len(words)


def full_paragraph(b: Block) -> bool:
    return not b.heading and len(b.text) >= LONG and b.linked <= PARAGRAPH_LINKED * len(b.text) and stop_density(b.text) >= STOPS


def first_pass(b: Block, has_main: bool = False) -> bool | None:
    """Kept, dropped, or None if the block is too short or too mixed to tell. In a main region fewer stop words and more links
    will do; outside it, on a page that has one, only a long block with many stop words is kept. A note of copyright is dropped, but in a main
    region only if it is no sentence."""
    density, main = b.linked / len(b.text), b.region == "main"
    if b.text[0] == "\xa9" and not (main and (len(b.text) >= LONG or b.text.endswith(ENDS))):
        return False
    if density > LINKED:
        return None if main else False
    stops = stop_density(b.text)
    if has_main and not main:
        return len(b.text) >= LONG and stops >= STOPS
    if len(b.text) >= LONG:
        return True if main or stops >= STOPS / 2 else None
    sentence = len(b.text) >= SHORT and b.text.endswith(ENDS) and not b.heading
    return True if sentence and (main or stops >= STOPS) else None


def second_pass(labels: list[bool | None], headings: list[bool] | None = None) -> list[bool]:
    """Open labels take those of the nearest decided neighbours; where none is decided, nothing is kept."""
    n = len(labels)
    before: list[int | None] = [None] * n
    after: list[int | None] = [None] * n
    for order, near in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = None
        for i in order:
            last = i if labels[i] is not None else last
            near[i] = last
    out = []
    for i, label in enumerate(labels):
        back = 2 if headings and headings[i] else 1
        sides = [(abs(j - i) * times, not labels[j]) for j, times in ((before[i], back), (after[i], 1)) if j is not None]
        out.append(label if label is not None else bool(sides) and not min(sides)[1])
    return out


def settled_regions(blocks: list[Block]) -> list[Block]:
    """Blocks whose mixed regions are main if they hold a full paragraph, and else weak."""
    full = {b.group for b in blocks if b.region == "mixed" and full_paragraph(b)}
    return [replace(b, region="main" if b.group in full else "weak") if b.region == "mixed" else b for b in blocks]


def candidates_of(blocks: list[Block]) -> list[Block]:
    """The blocks of a page that may be main text. On a page with a main region, lists of links in it, blocks of links that are no list's items, and what is
    dropped outside it are not even neighbours of its text."""
    inside = [b for b in blocks if b.region not in GONE]
    if not any(b.region == "main" for b in inside):
        return inside
    links = [b.region == "main" and not b.heading and b.linked > LIST * len(b.text) for b in inside]
    in_list, n = set(), 0
    for i in range(len(inside) + 1):
        if i < len(inside) and links[i]:
            n += 1
            continue
        if n >= LIST_ITEMS or n and not any(b.item for b in inside[i - n : i]):
            in_list.update(range(i - n, i))
        n = 0
    begins = lambda i: inside[i].title and i + 1 < len(inside) and inside[i + 1].region == "main"
    return [b for i, b in enumerate(inside) if i not in in_list and (b.region == "main" or begins(i) or first_pass(b, True))]


def kept_blocks(blocks: list[Block]) -> list[bool]:
    """Whether each block of a page, none of which is in a region that goes, is main text."""
    has_main = any(b.region == "main" for b in blocks)
    labels = [None if b.title and has_main and b.region != "main" else first_pass(b, has_main) for b in blocks]
    if True not in labels:
        sure = (lambda b: b.region == "main") if has_main else (lambda b: b.text.endswith(ENDS))
        labels = [True if label is None and sure(b) else label for label, b in zip(labels, blocks, strict=True)]
    return second_pass(labels, [b.heading for b in blocks])


def main_text(page: str | None) -> str:
    """The kept blocks. If only links stand outside the regions that go, words of classes, forms and headers count no more, and what they
    surround is judged by its text."""
    blocks = settled_regions(blocks_of(page or ""))
    candidates = candidates_of(blocks)
    kept = kept_blocks(candidates)
    if not any(kept) and all(b.linked for b in candidates):
        candidates = [replace(b, region="") if b.region == "weak" else b for b in blocks if b.region not in GONE - {"weak"}]
        kept = kept_blocks(candidates)
    return "\n".join(b.text for b, stays in zip(candidates, kept, strict=True) if stays)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The `keep` columns of every page, its main text, and the number of its code points."""
    fields = [f for f in pages.schema.fields if f.name in keep]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            text = [main_text(h) for h in frame.pop("__html")]
            yield frame.assign(text=text, n_chars=[len(t) for t in text])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return pages.select(*(f.name for f in fields), F.col(html_col).alias("__html")).mapInPandas(run, f"{kept}, text string, n_chars long")
