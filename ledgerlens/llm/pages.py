"""Main text of web pages from flat text blocks.

A page is read tag by tag into blocks: the text between two block-level tags,
with its word count and link density (share of words inside links). A block is
classified by its own and its neighbours' counts and densities and by a cue of
the elements around it (1: article or main text, -1: menu, header, footer,
sidebar, notice, advert, form or comment, 0: nothing told). Inside main text a
class tells a side element only if all its words do (``social-share``, but not
``share-price``), or if the element is short and mostly links; links in
headings there count as plain words. The classifier is
a decision tree (Gini splits) trained on ``LABELLED``, a small table of
hand-labelled blocks. Scripts, styles and other elements without readable
text, and all markup, are left out. The blocks that are kept are joined.

Null html is empty and gives an empty text. Malformed markup is read as far as
it goes: unknown end tags are ignored, open elements end with their parent. An
empty table gives an empty result, repeated rows give equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import ship_by_value

UNREAD = frozenset("script style noscript template svg math iframe object embed canvas audio video map head select textarea button datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul""".split())
#: Elements that end where the next of these begins.
IMPLIED = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
           "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"])}
MAIN_TAGS = frozenset(["article", "main"])
SIDE_TAGS = frozenset("nav header footer aside form menu dialog search fieldset".split())
MAIN_WORDS = frozenset("article main content post entry story".split())
SIDE_WORDS = frozenset("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar nav navbar navigation menu
breadcrumb breadcrumbs footer header masthead comment comments discussion reply replies cookie cookies consent notice notices alert popup modal
newsletter subscribe subscription signup login share sharing social related recommended widget form search disclaimer gdpr pagination pager toolbar""".split())
#: Words that say nothing of what an element is, beside side words.
SHAPES = frozenset("""area bar block box button buttons container content contents group icons inner item items link links list outer panel post posts
row section strip text title top bottom left right slot unit wrap wrapper zone article articles story stories""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of an element that is short.
SHORT = 40
#: Words after these name a part or a state of the element, not the element.
PARTS = frozenset("has with without no not show hide hides".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

#: Hand-labelled blocks: words, link density, the same of the block before and of the block after, cue, main text.
LABELLED = (
    # menus, link lists
    (1, 1.0, 0, 0.0, 1, 1.0, -1, 0), (1, 1.0, 1, 1.0, 1, 1.0, -1, 0), (2, 1.0, 1, 1.0, 7, 0.0, -1, 0), (1, 1.0, 1, 1.0, 30, 0.0, 0, 0),
    (3, 1.0, 2, 1.0, 2, 1.0, 0, 0), (12, 0.9, 40, 0.1, 10, 1.0, 0, 0), (25, 0.7, 3, 1.0, 4, 1.0, 0, 0), (15, 0.6, 12, 0.8, 3, 1.0, 0, 0),
    (2, 1.0, 1, 1.0, 90, 0.0, 0, 0), (40, 0.9, 2, 1.0, 30, 0.0, 0, 0), (10, 1.0, 30, 0.0, 25, 0.0, 0, 0), (3, 1.0, 80, 0.0, 66, 0.0, 0, 0),
    (90, 1.0, 40, 0.0, 3, 0.0, 0, 0),
    # reference lists, linked names and quotations inside articles
    (8, 1.0, 9, 1.0, 7, 1.0, 1, 1), (4, 0.75, 60, 0.0, 0, 0.0, 1, 1), (6, 0.8, 80, 0.0, 5, 0.9, 1, 1), (60, 0.8, 50, 0.0, 40, 0.0, 1, 1),
    (22, 1.0, 45, 0.0, 33, 0.0, 1, 1), (5, 1.0, 60, 0.0, 70, 0.0, 1, 1), (9, 0.6, 2, 0.0, 8, 0.0, 1, 1), (2, 1.0, 30, 0.0, 3, 1.0, 1, 1),
    # texts whose links do not make them lists: much text before and after
    (30, 0.55, 60, 0.0, 70, 0.0, 0, 1), (45, 0.6, 50, 0.1, 80, 0.0, 0, 1), (28, 0.55, 3, 1.0, 4, 1.0, 0, 0), (32, 0.6, 20, 0.9, 18, 1.0, 0, 0),
    # adverts, notices, forms, headers, footers, comments that the elements tell
    (7, 0.0, 1, 1.0, 8, 0.0, -1, 0), (12, 0.0, 2, 1.0, 10, 0.0, -1, 0), (30, 0.0, 50, 0.0, 60, 0.0, -1, 0), (80, 0.0, 100, 0.0, 40, 0.0, -1, 0),
    (8, 0.0, 90, 0.0, 0, 0.0, -1, 0), (14, 0.1, 70, 0.0, 0, 0.0, -1, 0), (5, 0.0, 0, 0.0, 3, 0.0, -1, 0), (45, 0.05, 20, 0.0, 33, 0.0, -1, 0),
    (5, 0.0, 60, 0.0, 70, 0.0, -1, 0), (7, 0.0, 45, 0.0, 80, 0.0, -1, 0), (4, 0.0, 90, 0.0, 35, 0.0, -1, 0), (9, 0.0, 50, 0.0, 60, 0.0, -1, 0),
    (3, 0.0, 33, 0.0, 41, 0.0, -1, 0), (12, 0.0, 70, 0.0, 55, 0.0, -1, 0), (25, 0.0, 60, 0.0, 48, 0.0, -1, 0), (60, 0.1, 44, 0.0, 52, 0.0, -1, 0),
    (3, 0.0, 2, 0.0, 2, 0.0, -1, 0), (120, 0.0, 60, 0.0, 20, 0.0, -1, 0), (18, 0.3, 6, 0.0, 4, 0.5, -1, 0), (1, 0.0, 33, 0.0, 1, 0.0, -1, 0),
    # short pieces between other short pieces, told by nothing
    (4, 0.0, 1, 1.0, 3, 0.0, 0, 0), (6, 0.0, 3, 1.0, 2, 1.0, 0, 0), (5, 0.0, 4, 0.0, 0, 0.0, 0, 0), (9, 0.0, 2, 0.5, 4, 0.0, 0, 0),
    (3, 0.0, 0, 0.0, 1, 1.0, 0, 0), (8, 0.0, 5, 0.0, 6, 0.0, 0, 0), (2, 0.0, 40, 0.0, 1, 1.0, 0, 0), (7, 0.0, 25, 0.0, 0, 0.0, 0, 0),
    (14, 0.0, 2, 1.0, 3, 1.0, 0, 0), (11, 0.0, 1, 1.0, 2, 1.0, 0, 0), (13, 0.2, 2, 1.0, 1, 1.0, 0, 0), (12, 0.0, 4, 1.0, 1, 1.0, 0, 0),
    # headings and short paragraphs between paragraphs, told by their neighbours
    (4, 0.0, 60, 0.0, 70, 0.0, 0, 1), (6, 0.0, 45, 0.0, 80, 0.0, 0, 1), (8, 0.0, 90, 0.0, 35, 0.0, 0, 1), (3, 0.0, 33, 0.0, 41, 0.0, 0, 1),
    # paragraphs, told by nothing
    (40, 0.0, 30, 0.0, 50, 0.0, 0, 1), (25, 0.04, 60, 0.0, 35, 0.0, 0, 1), (120, 0.02, 80, 0.0, 7, 0.0, 0, 1), (60, 0.1, 2, 1.0, 45, 0.0, 0, 1),
    (18, 0.0, 55, 0.0, 62, 0.0, 0, 1), (33, 0.2, 28, 0.0, 90, 0.1, 0, 1), (22, 0.0, 7, 0.0, 48, 0.0, 0, 1), (75, 0.0, 64, 0.0, 3, 1.0, 0, 1),
    (35, 0.0, 40, 0.0, 1, 0.0, 0, 1), (28, 0.0, 31, 0.0, 3, 0.0, 0, 1), (50, 0.0, 1, 1.0, 2, 0.5, 0, 1), (24, 0.0, 1, 0.0, 1, 0.0, 0, 1),
    (42, 0.1, 3, 0.0, 0, 0.0, 0, 1), (90, 0.0, 0, 0.0, 0, 0.0, 0, 1), (21, 0.0, 44, 0.0, 2, 1.0, 0, 1), (26, 0.15, 5, 0.0, 1, 1.0, 0, 1),
    (16, 0.0, 30, 0.0, 20, 0.0, 0, 1), (300, 0.0, 10, 0.0, 0, 0.0, 0, 1), (55, 0.3, 70, 0.05, 66, 0.0, 0, 1), (20, 0.1, 19, 0.0, 41, 0.0, 0, 1),
    (31, 0.0, 2, 1.0, 31, 0.0, 0, 1), (45, 0.0, 3, 1.0, 50, 0.0, 0, 1), (27, 0.0, 1, 1.0, 60, 0.0, 0, 1), (70, 0.0, 4, 1.0, 22, 0.0, 0, 1),
    # headings and paragraphs of articles, long and short
    (6, 0.0, 30, 0.0, 2, 1.0, 1, 1), (12, 0.0, 40, 0.0, 1, 1.0, 1, 1), (3, 0.0, 9, 0.0, 3, 1.0, 1, 1), (15, 0.1, 22, 0.0, 2, 1.0, 1, 1),
    (12, 0.0, 1, 1.0, 40, 0.0, 1, 1), (6, 0.0, 2, 1.0, 5, 0.0, 1, 1), (2, 0.0, 3, 1.0, 60, 0.0, 1, 1), (1, 0.0, 1, 1.0, 1, 0.0, 1, 1),
    (8, 0.0, 7, 0.0, 12, 0.0, 1, 1), (1, 0.0, 60, 0.0, 45, 0.0, 1, 1), (2, 0.0, 30, 0.0, 8, 0.0, 1, 1), (5, 0.0, 40, 0.0, 0, 0.0, 1, 1),
    (45, 0.0, 8, 0.0, 30, 0.0, 1, 1), (90, 0.05, 45, 0.0, 110, 0.0, 1, 1), (13, 0.3, 20, 0.0, 24, 0.0, 1, 1), (3, 0.0, 1, 1.0, 2, 0.0, 1, 1),
    (70, 0.0, 66, 0.0, 9, 0.0, 1, 1), (6, 0.0, 2, 0.0, 3, 0.0, 1, 1), (1, 0.0, 1, 0.0, 1, 0.0, 1, 1), (150, 0.2, 0, 0.0, 0, 0.0, 1, 1),
    (28, 0.4, 33, 0.0, 12, 0.0, 1, 1), (10, 0.0, 12, 0.0, 15, 0.2, 1, 1), (4, 0.25, 22, 0.0, 70, 0.0, 1, 1), (9, 0.0, 6, 1.0, 80, 0.0, 1, 1),
)


class Blocks(HTMLParser):
    """Text blocks of one page: (text, words, words in links, cue). Until the
    end of the page a block's cue is the number of its element in ``tree``."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, int, int, int]] = []
        self.open: list[tuple[str, int]] = []  # element, its number in tree
        self.tree: list[tuple[int, str, int, bool, bool]] = [(-1, "", 0, False, False)]  # element around, tag, told, main text told within others, told by part of a class
        self.counts: dict[str, int] = {}
        self.unread = 0
        self.link = 0  # depth at which a link began, plus 1
        self.parts: list[str] = []
        self.linked: list[str] = []

    def flush(self) -> None:
        words = "".join(self.parts).split()
        if words:
            self.found.append((" ".join(words), len(words), min(len(words), len(" ".join(self.linked).split())), self.open[-1][1] if self.open else 0))
        self.parts.clear()
        self.linked.clear()

    def told(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[int, bool, bool]:
        """What the element tells itself (-2: not shown), whether it is main
        text within a side element, too, and whether only a part of a class
        makes it a side element."""
        told, inner = -1 if tag in SIDE_TAGS else 1 if tag in MAIN_TAGS else 0, tag in MAIN_TAGS
        part, plain = False, told < 0
        for name, value in attrs:
            value = (value or "").lower()
            if name in ("class", "id"):
                names = [self.named(x) for x in value.split()]
                if any(words & SIDE_WORDS for words in names) and tag not in MAIN_TAGS and tag not in ("body", "html"):
                    told = min(told, -1)
                    part = True
                    plain |= any(words & SIDE_WORDS and words <= SIDE_WORDS | SHAPES for words in names)
                elif not told and any(words & MAIN_WORDS for words in names):
                    told = 1
                    # post-content, article-body: not the "content" of any box
                    inner = any(len(words & MAIN_WORDS) > 1 or words & MAIN_TAGS for words in names)
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                told, plain = -2, True
            elif name == "role" and value in SIDE_ROLES:
                told, plain = min(told, -1), True
            elif name == "role" and value in MAIN_TAGS and not told:
                told, inner = 1, True
        return told, inner and (told > 0 or tag in MAIN_TAGS), part and not plain

    @staticmethod
    def named(name: str) -> set[str]:
        """Words of one class up to the first that names a part."""
        words = name.replace("-", " ").replace("_", " ").split()
        return set(words[:next((k for k, x in enumerate(words) if x in PARTS), len(words))])

    def blocks(self) -> list[tuple[str, int, int, int]]:
        """The blocks with their cues."""
        held, main, links = ([0] * len(self.tree) for _ in range(3))  # words; words of main text; words in links
        for _, words, linked, k in self.found:
            held[k] += words
            links[k] += linked
        for k in range(len(self.tree) - 1, 0, -1):  # elements inside come after those around
            around, tag, told, inner, part = self.tree[k]
            main[k] = held[k] if told > 0 else main[k]
            held[around] += held[k]
            links[around] += links[k]
            main[around] += main[k]
        cues, hidden = [0], [False]
        for k, (around, tag, told, inner, part) in enumerate(self.tree[1:], 1):
            if part and cues[around] > 0 and not (held[k] <= SHORT and 2 * links[k] >= held[k]):
                told = 0
            if told == -1 and 2 * held[k] > held[0] and main[0] == main[k]:
                told = 0
            up = cues[around]
            if tag == "header" and up > 0:  # the head of an article
                cue = up
            elif up < 0 and told >= 0:
                cue = 1 if tag in MAIN_TAGS or inner and not hidden[around] else up
            else:
                cue = max(told, -1) or up
            cues.append(cue)
            hidden.append(told == -2 or hidden[around] and cue < 0)
        return [(text, words, 0 if cues[k] > 0 and self.tree[k][1] in HEADINGS else linked, cues[k]) for text, words, linked, k in self.found]

    def push(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tree.append((self.open[-1][1] if self.open else 0, tag, *self.told(tag, attrs)))
        self.open.append((tag, len(self.tree) - 1))
        self.counts[tag] = self.counts.get(tag, 0) + 1

    def pop(self) -> str:
        tag, _ = self.open.pop()
        self.counts[tag] -= 1
        if tag in UNREAD:
            self.unread -= 1
        if self.link > len(self.open) + 1:
            self.link = 0
        return tag

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.flush()
            while self.open and tag in IMPLIED.get(self.open[-1][0], ()):
                self.pop()
        elif tag == "br":
            self.handle_data(" ")
        if tag in VOID:
            return
        if tag == "a":
            self.link = len(self.open) + 1
        elif tag in BLOCK or tag in UNREAD:
            if tag in UNREAD:
                self.unread += 1
            self.push(tag, attrs)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # as browsers read it: <div/> opens a div

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.link = 0
        if tag in BLOCK:
            self.flush()
        if self.counts.get(tag):
            while self.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.unread:
            self.parts.append(data)
            if self.link:
                self.linked.append(data)


def page_blocks(html: str) -> list[tuple[str, int, int, int]]:
    reader = Blocks()
    reader.feed(html)
    reader.close()
    reader.flush()
    return reader.blocks()


def features(blocks: list[tuple[str, int, int, int]]) -> np.ndarray:
    """Words and link density of each block, the one before and the one after, and its cue."""
    own = np.array([(w, k / w) for _, w, k, _ in blocks])
    none = np.zeros((1, 2))
    return np.hstack([own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none]), np.array([[c] for *_, c in blocks])])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2) -> tuple:
    """Decision tree: (share of main text,) or (feature, threshold, low, high),
    split where the Gini impurity falls most."""
    share = float(y.mean())
    best = (share * (1 - share) * len(y) - 1e-9, None, None)
    if depth and 0 < share < 1:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for t in (values[1:] + values[:-1]) / 2:
                low = x[:, f] <= t
                if least <= low.sum() <= len(y) - least:
                    cost = sum(p.mean() * (1 - p.mean()) * len(p) for p in (y[low], y[~low]))
                    if cost < best[0]:
                        best = (cost, f, float(t))
    if best[1] is None:
        return (share,)
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def judge(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0] > 0.5)
    feature, threshold, low, high = tree
    left = x[:, feature] <= threshold
    return np.where(left, judge(low, x), judge(high, x))


def train(labelled: tuple = LABELLED) -> tuple:
    table = np.array(labelled, float)
    return grow(table[:, :-1], table[:, -1])


def main_text(html: str, tree: tuple) -> str:
    blocks = page_blocks(html)
    if not blocks:
        return ""
    return "\n".join(b[0] for b, keep in zip(blocks, judge(tree, features(blocks)).tolist()) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: tuple = LABELLED) -> DataFrame:
    """(page_id, url, text, n_chars): one row per row of ``pages``."""
    ship_by_value()
    tree = train(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = [main_text(h.as_py() or "", tree) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return (pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
            .mapInArrow(run, "page_id long, url string, text string, n_chars long"))
