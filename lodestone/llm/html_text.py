"""Main text of web pages (operator 7): flat text blocks, classified by a decision tree.

A page is read once, front to back, into blocks of text between block-level tags. Each block has its word count,
its link density, those of its neighbours, and where it stands (article, boilerplate element, names that hint at
boilerplate, heading). A decision tree (CART, Gini), trained at import on the small labelled table below,
says which blocks are main text. Kept blocks are joined by one space.

A class or id hints at boilerplate (2) by the words of its names; a name that says what a layout has or lacks
(no-sidebar, has-sidebar) does not hint, and one beside a name for text (entry related, post-header) hints weakly
(1), as does a form. An article or main element ends weak hints, so that the neighbours decide about blocks with a
weak hint or none outside of articles. A block with controls of a form is boilerplate.

Every page is a row of its own and nothing is shuffled. Defined cases: null or empty html gives empty text;
unclosed elements end with the element around them, also those whose text is dropped (DROPPED; raw text, RAW,
goes on to its own end tag as in a browser); a < before a letter begins a tag, as in a browser; math is text; rows
with repeated or null ids are rows like any other; other columns are ignored. Time is in proportion to the page.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "frame", "hint", "heading")

# Fixed values, a hand-labelled table: FEATURES in order (links: share of words inside links; article: 1 inside, -1
# outside of articles that hold most of a page's text, else 0; frame, heading: 0 or 1; hint: 0 to 2), then 1 for main text and 0 for boilerplate.
LABELLED = """
  1 0.00   0 0.0   0 0.0  1 0 0 0  1
  3 0.00   2 0.0  90 0.0  1 0 0 1  1
 12 0.00   0 0.0  90 0.0  1 0 0 1  1
  8 0.00   5 1.0   4 0.0  1 0 0 1  1
 90 0.00  12 0.0  40 0.0  1 0 0 0  1
 40 0.05  90 0.0   2 0.0  1 0 1 0  1
150 0.00   3 0.0   0 0.0  1 0 0 0  1
  3 0.00  25 0.0  60 0.0  1 0 0 0  1
  2 0.00   1 0.0   3 0.0  1 0 0 0  1
 60 0.20  10 0.0  70 0.1  1 0 1 0  1
  5 1.00  60 0.2  70 0.0  1 0 0 0  1
 14 0.50  70 0.0   2 1.0  1 0 0 0  1
  6 0.00  30 0.0   1 1.0  1 0 0 0  1
 10 0.90   3 0.0  25 0.0  1 0 0 0  1
  2 1.00   1 1.0   1 1.0  1 0 0 0  1
  4 1.00   3 1.0   2 1.0  1 0 0 0  1
  3 1.00   0 0.0   3 1.0  1 0 0 0  1
  6 0.00   6 1.0   6 1.0  1 0 0 0  1
  4 0.00   3 1.0   3 0.0  1 0 1 0  1
  5 0.00   2 0.0   4 1.0  1 0 0 0  1
  5 0.00  60 0.0   8 0.0  1 0 1 0  1
  2 0.00  90 0.0   3 1.0  1 1 0 0  0
 25 0.10  80 0.0   6 0.0  1 1 0 0  0
 70 0.00   6 0.0  60 0.0  1 1 0 1  0
 12 0.00   0 0.0  30 0.0  1 1 1 0  0
  4 0.60  30 0.0   0 0.0  1 1 0 0  0
 18 0.00  60 0.0  20 0.0  1 0 2 0  0
 55 0.00  18 0.0  40 0.0  1 0 2 0  0
  4 0.00  70 0.0  10 0.0  1 0 2 1  0
  3 1.00  90 0.0   3 1.0  1 0 2 0  0
 90 0.00   8 0.0   2 0.0  1 0 2 0  0
  2 0.00   2 0.0   1 0.0  1 0 2 0  0
 30 0.20  40 0.0  90 0.0  1 0 2 0  0
120 0.00  12 0.0   6 0.0  1 0 2 0  0
  6 0.00  50 0.0  35 0.0  1 0 2 0  0
  1 0.00  90 0.0   0 0.0 -1 0 0 0  0
  4 0.00  60 0.0   2 1.0 -1 0 0 0  0
 20 0.00   6 0.0  12 0.0 -1 0 0 1  0
 30 0.00   3 1.0  80 0.0 -1 0 0 0  0
 60 0.00  90 0.0   5 0.0 -1 0 1 0  0
 40 0.10  45 0.0  50 0.0 -1 0 0 0  0
  9 0.00   0 0.0   8 0.0 -1 0 1 1  0
  3 1.00  40 0.0   0 0.0 -1 0 0 0  0
  1 1.00   0 0.0   1 1.0  0 1 0 0  0
  2 1.00   1 1.0  90 0.0  0 1 0 0  0
 12 0.00  60 0.0   0 0.0  0 1 0 0  0
 30 0.00  45 0.0   0 0.0  0 1 1 0  0
 60 0.00  70 0.0  50 0.0  0 1 0 0  0
 90 0.00   8 0.0  60 0.0  0 1 0 0  0
  9 0.00   5 0.0   7 0.0  0 1 0 1  0
 35 0.00   2 1.0  80 0.0  0 1 0 0  0
  6 0.00   0 0.0   0 0.0  0 1 0 0  0
  6 0.00   1 1.0  90 0.0  0 0 2 0  0
 15 0.00   1 1.0  12 0.0  0 0 2 0  0
 40 0.00  60 0.0  35 0.0  0 0 2 0  0
 70 0.00  55 0.0  65 0.0  0 0 2 0  0
 90 0.00  90 0.0   2 0.0  0 0 2 0  0
 25 0.00  10 0.0  45 0.0  0 0 2 0  0
  5 0.00  80 0.0  80 0.0  0 0 2 1  0
  5 0.00   0 0.0   0 0.0  0 0 2 0  0
 80 0.00   5 0.0  75 0.0  0 0 0 0  1
 75 0.02  80 0.0   2 1.0  0 0 0 0  1
 60 0.10  75 0.0   0 0.0  0 0 1 0  1
 80 0.00   0 0.0   0 0.0  0 0 1 0  1
 80 0.00   3 1.0   2 1.0  0 0 1 0  1
 35 0.00  15 0.0   4 0.0  0 0 0 0  1
 28 0.00   2 1.0   3 1.0  0 0 0 0  1
 45 0.10  10 0.0   3 1.0  0 0 1 0  1
 20 0.00  90 0.0  70 0.1  0 0 0 0  1
 18 0.00  60 0.0  55 0.0  0 0 1 0  1
 18 0.00   0 0.0   0 0.0  0 0 0 0  1
  2 0.00   0 0.0   0 0.0  0 0 0 0  1
  5 0.00   0 0.0   0 0.0  0 0 1 0  1
  3 0.00   0 0.0  40 0.0  0 0 0 1  1
  3 0.00   0 0.0  80 0.0  0 0 1 1  1
  6 0.00   0 0.0   9 0.0  0 0 0 1  1
  9 0.00   6 0.0   0 0.0  0 0 0 0  1
 10 0.00   2 1.0  80 0.0  0 0 0 1  1
  4 0.00   1 1.0  60 0.0  0 0 1 1  1
  9 0.00  40 0.0  50 0.0  0 0 0 1  1
  3 0.00  40 0.0  60 0.0  0 0 0 0  1
  5 0.00  70 0.0  35 0.0  0 0 1 0  1
  8 0.00  60 0.0   0 0.0  0 0 0 0  1
  6 0.00  60 0.0   2 1.0  0 0 0 0  1
  4 0.00   8 0.0  70 0.0  0 0 0 0  1
  6 0.00   5 0.0  60 0.0  0 0 1 0  1
  5 1.00  60 0.0  70 0.0  0 0 0 0  1
  8 0.60  50 0.0  45 0.0  0 0 0 0  1
120 0.00   1 1.0   0 0.0  0 0 0 0  1
 80 0.00   2 1.0  90 0.0  0 0 0 0  1
 50 0.00   2 1.0   6 0.0  0 0 1 0  1
 30 0.00   3 1.0  40 0.0  0 0 0 0  1
 30 0.00   1 1.0   0 0.0  0 0 0 0  1
 26 0.05   4 1.0 120 0.0  0 0 1 0  1
 90 0.00   5 0.0 120 0.0  0 0 0 0  1
 60 0.05 100 0.0 110 0.0  0 0 1 0  1
 35 0.00  90 0.0 100 0.0  0 0 0 0  1
 40 0.10   0 0.0  95 0.0  0 0 0 0  1
200 0.02   4 0.0   3 0.0  0 0 0 0  1
  9 0.00 100 0.0 120 0.0  0 0 0 0  1
 14 0.00  50 0.0 100 0.0  0 0 0 1  1
 12 0.10 110 0.0 100 0.1  0 0 1 0  1
  6 0.00   0 0.0 100 0.0  0 0 0 1  1
 16 0.00   0 0.0 120 0.0  0 0 0 0  1
  1 1.00   2 0.0   1 1.0  0 0 0 0  0
  3 1.00   0 0.0 100 0.0  0 0 0 0  0
  9 0.80   3 1.0 120 0.0  0 0 0 0  0
  8 0.00   2 1.0 110 0.0  0 0 0 0  0
 40 0.80   5 1.0   4 1.0  0 0 0 0  0
 60 0.90  12 1.0   9 0.0  0 0 1 0  0
  2 1.00   0 0.0   2 1.0  0 0 0 0  0
  6 1.00   5 1.0   7 1.0  0 0 0 0  0
  8 0.90  10 1.0   3 1.0  0 0 0 0  0
 20 0.80  15 0.9  10 1.0  0 0 0 0  0
 30 0.70  20 0.8  12 1.0  0 0 0 0  0
 12 0.60   4 0.0   3 1.0  0 0 0 0  0
  7 1.00  60 0.0   6 1.0  0 0 0 0  0
  3 1.00  60 0.0   0 0.0  0 0 0 0  0
  2 1.00   2 1.0  80 0.0  0 0 0 0  0
  4 0.50   0 0.0  90 0.0  0 0 0 0  0
  5 0.00   2 1.0   3 0.0  0 0 0 0  0
  5 0.00   2 1.0   2 1.0  0 0 0 0  0
  7 0.00   3 1.0   4 1.0  0 0 1 0  0
 12 0.00   2 1.0   3 1.0  0 0 0 0  0
  4 0.00   0 0.0   1 1.0  0 0 0 0  0
  5 0.00   6 0.0   2 1.0  0 0 0 0  0
  3 0.00   4 0.0   2 1.0  0 0 0 1  0
  4 0.00   3 1.0   2 1.0  0 0 0 1  0
  4 0.00   2 1.0  70 0.0  0 0 0 0  0
  6 0.00   3 0.9  55 0.0  0 0 1 0  0
  6 0.00   3 1.0   0 0.0  0 0 0 0  0
"""


@dataclass
class Node:
    feature: int = -1
    bound: float = 0.0
    low: "Node | None" = None
    high: "Node | None" = None
    share: float = 0.0

    def __call__(self, row: tuple) -> float:
        node = self
        while node.feature >= 0:
            node = node.low if row[node.feature] <= node.bound else node.high
        return node.share


def train(rows: list[tuple], labels: list[int], depth: int = 8, leaf: int = 1) -> Node:
    """A decision tree by greatest Gini gain; ties go to the first feature and the lowest bound."""
    share = sum(labels) / len(labels)
    node = Node(share=share)
    if depth == 0 or share in (0.0, 1.0):
        return node

    def impurity(part: list[int]) -> float:
        p = sum(part) / len(part)
        return len(part) * p * (1 - p)

    best = (impurity(labels) - 1e-9, -1, 0.0)
    for f in range(len(rows[0])):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:]):
            bound = (a + b) / 2
            low = [y for r, y in zip(rows, labels) if r[f] <= bound]
            high = [y for r, y in zip(rows, labels) if r[f] > bound]
            if min(len(low), len(high)) >= leaf and (found := impurity(low) + impurity(high)) < best[0]:
                best = (found, f, bound)
    if best[1] < 0:
        return node
    _, node.feature, node.bound = best
    side = [r[node.feature] <= node.bound for r in rows]
    node.low = train([r for r, s in zip(rows, side) if s], [y for y, s in zip(labels, side) if s], depth - 1, leaf)
    node.high = train([r for r, s in zip(rows, side) if not s], [y for y, s in zip(labels, side) if not s], depth - 1, leaf)
    return node


@functools.lru_cache(1)
def tree() -> Node:
    table = [tuple(map(float, line.split())) for line in LABELLED.strip().splitlines()]
    return train([r[:-1] for r in table], [int(r[-1]) for r in table])


# Element names by their part in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math semantics mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mstyle mpadded menclose mfenced".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes".split())
DROPPED = frozenset("noscript template svg object select datalist optgroup option button canvas audio video annotation annotation-xml".split())
FRAME = frozenset("nav footer aside menu dialog fieldset legend".split())
CONTROLS = frozenset("input label textarea select button output progress meter".split())
SELF_ENDING = frozenset("p li dt dd tr td th option".split())
#: Parts of class names and ids: boilerplate; boilerplate that stands for a layout, or heads a text; layouts; texts.
HINT = re.compile(
    r"(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|nav|navbar|navigation|menu\w*|sidebar\w*|side|footer|header|masthead|breadcrumb\w*|cookie\w*|consent|notice\w*|popup|modal|overlay|newsletter|subscribe\w*|signup|login|share\w*|sharing|social|related|recommend\w*|comment\w*|reply|replies|disqus|widget\w*|pagination|pager|toolbar|skip|copyright|legal)"
)
MILD = re.compile(r"(?:sidebar\w*|side|header|masthead|banner\w*|related|recommend\w*|promo\w*|notice\w*|overlay|legal|footer)")
HEAD = frozenset("header masthead banner".split())
LAYOUT = frozenset("no not non has have with without layout template theme ".split())
TEXT = frozenset("post entry article story content main text body hentry".split())
_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert menu".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_SPACES = re.compile(r"\s+")


@functools.lru_cache(10_000)
def hint_of(names: str) -> int:
    """How much a class or id hints at boilerplate: 2 yes, 1 weakly, 0 no."""
    strong = mild = weak = text = False
    for name in names.lower().split():
        parts = [x for x in re.split(r"[-_]+", name) if x]
        if not parts or not LAYOUT.isdisjoint(parts):
            continue
        found = [x for x in parts if HINT.fullmatch(x)]
        if not found:
            text |= parts[0] in TEXT
        elif parts[0] in TEXT and HEAD.issuperset(found):
            weak = True
        elif len(parts) == 1 and MILD.fullmatch(name):
            mild = True
        else:
            strong = True
    if strong or mild and not text:
        return 2
    return int(mild or weak)


class Open:
    """Open elements with the state around each, and where those stand that an end tag or a new element can meet."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = {}
        self.solid: list[int] = []  # elements that no inline end tag reaches across
        self.hard: list[int] = []  # elements that end no element of SELF_ENDING

    def push(self, tag: str, state: int) -> None:
        at = len(self.stack)
        self.stack.append((tag, state))
        self.places.setdefault(tag, []).append(at)
        if tag not in INLINE:
            self.solid.append(at)
            if tag not in SELF_ENDING:
                self.hard.append(at)

    def ended(self, tag: str, closing: bool) -> int:
        """The open element that an end tag, or the start of a like element, ends; -1 for none."""
        where = self.places.get(tag)
        if not where or not closing and tag not in SELF_ENDING:
            return -1
        bars = (self.solid if tag in INLINE else ()) if closing else self.hard
        return where[-1] if not bars or where[-1] > bars[-1] or where[-1] == bars[-1] else -1

    def cut(self, at: int) -> int:
        """End the elements from at on; gives the state around them."""
        state = self.stack[at][1]
        while len(self.stack) > at:
            self.places[self.stack.pop()[0]].pop()
        for bars in (self.solid, self.hard):
            while bars and bars[-1] >= at:
                bars.pop()
        return state


def blocks(page: str) -> list[tuple[str, int, int, int, int, int, int]]:
    """(text, words, words in links, article, frame, hint, heading) of each block, in page order."""
    out: list[tuple] = []
    pieces: list[str] = []
    linked: list[str] = []
    opened = Open()
    # bits: 1 article, 2 frame, 4 hint, 8 heading, 16 link, 32 dropped (no other bit changes inside), 64 weak hint, 128 form
    state = at = 0
    control = False

    def flush() -> None:
        nonlocal control
        text = _SPACES.sub(" ", html.unescape("".join(pieces))).strip()
        if text:
            inside = len(html.unescape(" ".join(linked)).split()) if linked else 0
            hint = 2 if state & 4 else state >> 6 & 1
            out.append((text, len(text.split()), inside, state & 1, int(control or state & 2 > 0), hint, state >> 3 & 1))
        pieces.clear()
        linked.clear()
        control = False

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        chunk = page[at : m.start() if m else n]
        if chunk and not state & 32:
            pieces.append(chunk)
            if state & 16:
                linked.append(chunk)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA[") and not state & 32:
                pieces.append(html.escape(m[0][9:-3]))
            continue
        tag = m[2].lower()
        if not m[1]:
            if tag == "head":  # its own text elements are skipped one by one
                continue
            if tag in CONTROLS and (state & 128 or tag == "label") and not state & 32:
                control = True
            if tag in RAW:
                if not m[3].endswith("/"):
                    end = _ENDS[tag].search(page, at)
                    at = end.end() if end else n
                continue
            if tag in DROPPED and m[3].endswith("/"):
                continue
        ended = opened.ended(tag, bool(m[1]))
        if not state & 32 or ended >= 0 and not opened.stack[ended][1] & 32:
            if tag == "br":
                pieces.append(" ")
            elif tag not in INLINE and tag not in DROPPED and tag not in CONTROLS:
                flush()
        if ended >= 0:
            state = opened.cut(ended)
        if not m[1] and tag not in VOID:
            opened.push(tag, state)
            if state & 32:
                continue
            if tag in DROPPED:
                state |= 32
                continue
            if tag == "a":
                state |= 16
            elif tag in ("article", "main"):
                state = (state | 1) & ~64
            elif tag == "form":
                state |= 130 if state & 1 else 192
            elif tag in FRAME or tag == "header" and not state & 1:
                state |= 2
            elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
                state |= 8
            if m[3] and tag not in ("html", "body"):
                for name, *values in _ATTRIBUTE.findall(m[3]):
                    value, name = "".join(values), name.lower()
                    if name in ("class", "id"):
                        if tag != "main" and (hint := hint_of(value)) > (tag == "article"):
                            state |= 4 if hint == 2 else 64
                    elif name == "role" and value.lower() in _ROLE or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                        state |= 4
    flush()
    return out


def main_text(page: str | None) -> str:
    """The main text of one page."""
    found = blocks(page or "")
    decide, none = tree(), ("", 0, 0)
    held = [0, 0]  # words outside and inside of articles
    for _, words, _, article, frame, hint, _ in found:
        held[article] += words * (not frame and hint < 2)
    outside = -1 if held[1] >= max(held[0], 1) else 0
    kept = []
    for i, (text, words, links, article, *where) in enumerate(found):
        before = found[i - 1] if i else none
        after = found[i + 1] if i + 1 < len(found) else none
        row = (words, links / max(words, 1), before[1], before[2] / max(before[1], 1), after[1], after[2] / max(after[1], 1), article or outside, *where)
        if decide(row) >= 0.5:
            kept.append(text)
    return " ".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")
