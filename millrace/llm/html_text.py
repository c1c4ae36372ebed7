"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks at block-level tags. A block's features are its word
count and link density, those of the blocks before and after it, whether it stands
in an article or is a heading or a legal notice, and what the elements around it
say: an element for what stands beside (menu, footer, form), or how much of a class
or id names such a place. Elements that hold the page's article, or nearly all of its
unlinked text, say nothing: a layout's name doesn't make the page an aside. The tree
is grown from ``LABELLED`` when a task starts.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import unused

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "aside", "named", "article", "heading", "notice")

#: The labelled table: blocks of pages in page order, a page to a line. A block is + (main text) or -,
#: its words, / and those of them in links, then where it stands: a in the article, h a heading, c a legal
#: notice, s in an aside element (menu, footer, sidebar, form), n in an element whose name says aside, p in one of
#: whose name a part does. Made by hand, after common layouts: news, blogs, forums, shops, manuals, bare pages.
LABELLED = """
-1/1s -1/1s -2/2s -1/1s +9/0ah +60/0a +84/2a +12/0a +7/0ah +45/5a +120/0a -2/2s -9/0s
-3/0n -4/4n -2/2n +6/0ah +3/0a +150/4a +33/0a -14/0an -6/6an +70/0a +5/5a +4/4a +6/6a -40/0an -2/1an -65/0an -38/0an -8/2s
-2/0 -5/5 -1/1 -1/1 +8/0h +5/0 +55/0 +90/3 +7/0 +62/0 +110/9 +2/0 -3/3 -4/4 -6/0
-1/1 -2/2 -1/1 -3/3 -1/1 +5/0h +34/0 +28/1 +3/0 +2/0 -2/2 -1/1 -2/1
-4/0s -1/0s -30/30s -25/10s +11/0ah +2/2a +1/0a +20/20a +3/3a +2/2a +1/1a +90/1a +6/0ac -20/0s -50/0s -12/12s
-2/0n -20/0n -35/3n +4/0a +1/0a +8/0a +2/0a +7/0a +3/0a +6/0ah +2/0ah +9/0a +30/0a -5/5s -60/0n -80/0n
-1/0 -3/3 -8/7 -2/2 +6/0h +40/0 +9/0 +75/2 +5/0h +52/0 +200/0 -9/9 -11/11 -4/4
+7/0h +95/0 +130/0 +66/6 +10/0 +80/0 +2/0
-1/1 -1/1 -16/16 -14/14 -3/0 -12/12 -30/30 -25/22 -18/18 -3/0
-2/2 -2/2 -4/0h -3/3 -5/5 -6/6 -4/0h -8/8 -7/7 -2/0
+3/0a +250/0a +8/8a +1/1a +300/10a +1/0a
-2/2s +6/0ah +40/0a -60/0as -2/2as +25/0a -3/0as -120/4as +9/0a -30/0ans -8/0ash +70/0a -16/16as -4/0ns
-24/1s +7/0h +26/0 +31/2 +4/0h +23/0 -22/1s -40/0n -28/0n
-9/0n +12/0a +40/0a -7/0an -33/0an +50/0a -90/0an -1/1an -45/0an -120/0an -3/0s
-6/0 -3/3 +5/0h +24/0 +22/1 +48/0 +3/0 -5/0c
-10/0s -100/0s -70/7s -3/0s +5/0ah +15/15a +18/18a +25/0a +2/0a -12/0s
+60/10 +45/0 +90/20 +33/0 +12/0 +41/0 +75/0 -2/0c -6/6
-60/50 -40/40 +80/4 +55/0 -26/26 -4/2
+5/0
+2/0h +4/0
+4/0 +3/0 +6/0
+900/0
+12/0h +30/0 +25/0 -9/0c
-2/2 -3/3 +4/0h +3/0 +7/0 +50/0 -8/1c
-3/0 -2/2 -2/2 -1/1 +9/0 +40/0 +4/0
+8/0ph +30/0p +3/0p +44/2p -6/6p +12/0p
-5/5 -4/4 +6/0ph +2/0p +70/0p +5/0p -20/0n -3/3
+5/0ap +25/0ap +6/6ap +3/0a
-1/1 -12/11 -2/0 -9/9 -14/13 +10/0h +6/0 +80/0 +70/40 +30/0
-2/0c +6/0h +20/0 +30/3 -11/0c -3/3
+6/0h +90/0 +140/0 -9/0c
+7/0ah +30/0a +5/0ac +40/0a +9/0ac
+5/0ah +3/0ac +30/0a +3/0ac +60/0a +2/0ac +5/0ac +40/0a +8/0ac
+5/0h +50/0 -3/0c +60/0 -5/0c +40/0 -2/0c +9/0
+50/0 +3/0 +2/0 -1/1 -3/0 -5/5 -7/0 -9/9
+4/0h +2/0 -5/5 -4/4
+30/0 +6/0 -12/12 -8/0 -2/2
+8/0 +7/0 +1/0 -3/3 -6/6 -2/0 -4/4 -2/0
+120/0 +5/0 -2/2 -4/0 -3/3
-8/0 -6/6 -1/1 +3/0h +1/0 +15/0 +8/0 +4/0 -2/2
"""

#: Elements without text of the page, those that break blocks, and those beside the main text.
DROPPED = frozenset("head script style noscript template textarea select option svg iframe object canvas audio video map title button".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav footer aside form dialog menu fieldset".split())
#: Marked elements of a block that are looked at, from the outermost.
MARKS = 64
#: Elements around the main text, whose names tell of the page's state and layout.
WHOLE = frozenset("html body main article".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
#: What parts of a name say aside, and what parts say nothing; of the others and the first kind, the share of the first is a feature.
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar nav navbar navigation menu topbar breadcrumb breadcrumbs pagination pager footer masthead widget related recommended cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments disqus discussion discussions thread threads replies reply respond skip search toolbar paywall disclaimer copyright adsbygoogle adslot adbox adunit dfp doubleclick taboola outbrain colophon offcanvas hamburger toc".split()
)
PLAIN_NAMES = frozenset("site page main global top bottom left right upper lower primary secondary list box bar block area section wrap wrapper container content inner outer item items row col column group panel links link buttons button icons icon user reader form text body title header heading head posts post articles stories more of the and for js v1 v2 w1 x y sm md lg mobile desktop sticky fixed slot slots unit units holder placeholder".split())
RAW_TEXT = "script|style|textarea|title|noscript|template|iframe|svg|select|object|canvas|button"

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?!svg\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?<=/)>)(?P<raw>{RAW_TEXT})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>|<[!?/][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_UNQUOTED = re.compile(r"=\s*[^\s\"'>]*/$")  # a slash that ends an attribute, not the tag
_NOTICE = re.compile(r"^\W*(?:©|\(c\)|copyright\b)|\ball rights reserved\b", re.I)
#: Share of a page's unlinked words from which on an element is around the page: by itself, and with the first heading in it.
AROUND, AROUND_HEADED = 0.9, 0.5


@dataclass
class Mark:
    """An element that says aside: by its tag or role, or by some part of its name."""

    tag: bool
    named: float
    unlinked: int = 0
    headed: bool = False
    whole: bool = False
    around: bool = False


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    link_parts: list[str] = field(default_factory=list)
    marks: tuple[Mark, ...] = ()
    article: bool = False
    heading: bool = False
    top: bool = False
    text: str = ""
    words: int = 0
    links: int = 0


@cache
def aside_share(name: str) -> float:
    """How much of a class or id names what stands beside the main text; parts that say nothing don't count."""
    parts = [x.lower() for x in _PART.findall(name)]
    says = sum(x in ASIDE_NAMES for x in parts)
    other = sum(x not in ASIDE_NAMES and x not in PLAIN_NAMES for x in parts)
    return says / (says + other) if says else 0.0


def _kind(name: str, rest: str, in_article: bool) -> str | Mark:
    """What an element opens: "drop", "article", a mark or nothing of these."""
    if name in DROPPED:
        return "drop"
    tag, named = name in ASIDE or name == "header" and not in_article, 0.0
    for key, value in _ATTRIBUTE.findall(rest) if rest.strip(" /") else ():
        value = value.strip("\"'")
        if key.lower() == "role":
            tag = tag or value.strip().lower() in ASIDE_ROLES
        elif name not in WHOLE:
            named = max([named, *(1.0 if x.lower() == "header" and not in_article else aside_share(x) for x in value.split())])
    if tag or named:
        return Mark(tag, named)
    return "article" if name in ("article", "main") else ""


def blocks(page: str) -> list[Block]:
    """Non-empty text blocks in page order; tags that are not closed end with the page."""
    out, now = [], Block()
    stack: list[tuple[str, str | Mark]] = []
    depth = {"drop": 0, "article": 0, "heading": 0, "a": 0, "h1": 0}
    opened: Counter[str] = Counter()
    open_marks: list[Mark] = []
    marks: tuple[Mark, ...] = ()
    at = 0

    def kinds(name: str, kind: str | Mark) -> list[str]:
        return [k for k in (kind if isinstance(kind, str) else "", "article" if isinstance(kind, Mark) and name in ("article", "main") else "", "heading" if name in HEADINGS else "", name if name in ("a", "h1") else "") if k]

    def close() -> str:
        nonlocal marks
        name, kind = stack.pop()
        opened[name] -= 1
        for k in kinds(name, kind):
            depth[k] -= 1
        if isinstance(kind, Mark):
            open_marks.pop()
            marks = tuple(open_marks)
        return name

    def take(raw: str) -> None:
        if raw and not depth["drop"]:
            text = html.unescape(raw) if "&" in raw else raw
            if not now.parts:
                now.marks, now.article, now.heading, now.top = marks, depth["article"] > 0, depth["heading"] > 0, depth["h1"] > 0
            now.parts.append(text)
            if depth["a"]:
                now.link_parts.append(text)

    def flush() -> None:
        nonlocal now
        words = "".join(now.parts).split()
        if words:
            now.text, now.words, now.links = " ".join(words), len(words), len("".join(now.link_parts).split())
            out.append(now)
        now = Block()

    for m in _TOKEN.finditer(page):
        take(page[at : m.start()])
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if name == "svg" and m["rest"].endswith("/"):
            continue
        if name in BLOCKS or name in DROPPED:
            flush()
        if m["end"]:
            # a name that isn't open closes nothing
            while opened[name] and close() != name:
                pass
        elif name not in VOID and not (m["rest"].endswith("/") and not _UNQUOTED.search(m["rest"])):
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option", "a") and stack and stack[-1][0] == name:
                close()
            kind = _kind(name, m["rest"], bool(depth["article"]))
            if kind or name == "a" or name in BLOCKS:
                stack.append((name, kind))
                opened[name] += 1
                for k in kinds(name, kind):
                    depth[k] += 1
                if name in ("article", "main"):
                    for mark in open_marks:
                        mark.whole = True
                if isinstance(kind, Mark):
                    open_marks.append(kind)
                    marks = tuple(open_marks)
    take(page[at:])
    flush()
    _look_around(out)
    return out


def _look_around(found: list[Block]) -> None:
    """Which marked elements are around the page: they hold its article, or most of its unlinked text."""
    total = 0
    for b in found:
        own = max(0, b.words - b.links)
        total += own
        for mark in b.marks[:MARKS]:
            mark.unlinked += own
            mark.headed |= b.top
    for b in found:
        for mark in b.marks[:MARKS]:
            mark.around = mark.whole or mark.unlinked > AROUND * total or mark.headed and mark.unlinked > AROUND_HEADED * total


def features(words: np.ndarray, links: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """FEATURES of a page's blocks, from their words, words in links and (aside, named, article, heading, notice)."""
    density = np.minimum(links / np.maximum(words, 1), 1.0)
    before = lambda x: np.r_[0.0, x[:-1]]
    after = lambda x: np.r_[x[1:], 0.0]
    return np.column_stack([words, density, before(words), before(density), after(words), after(density), flags])


def block_features(found: list[Block]) -> np.ndarray:
    flags = []
    for b in found:
        said = [m for m in b.marks[:MARKS] if not m.around]
        flags.append((any(m.tag for m in said), max((m.named for m in said), default=0.0), b.article, b.heading, b.words < 60 and bool(_NOTICE.search(b.text))))
    return features(np.array([b.words for b in found], float), np.array([b.links for b in found], float), np.array(flags, float))


class DecisionTree:
    """Binary splits of least Gini impurity; leaves say which label is more frequent."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 1):
        self.root = self._grow(x, y, depth, least)

    def _grow(self, x, y, depth, least):
        share = y.mean()
        if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
            return float(share >= 0.5)
        best = (share * (1 - share) * len(y) - 1e-9, None, None)
        for k in range(x.shape[1]):
            values = np.unique(x[:, k])
            for cut in (values[1:] + values[:-1]) / 2:
                left = x[:, k] <= cut
                if least <= left.sum() <= len(y) - least:
                    a, b = y[left], y[~left]
                    loss = a.mean() * (1 - a.mean()) * len(a) + b.mean() * (1 - b.mean()) * len(b)
                    if loss < best[0] - 1e-12:
                        best = (loss, k, cut)
        if best[1] is None:
            return float(share >= 0.5)
        left = x[:, best[1]] <= best[2]
        return best[1], best[2], self._grow(x[left], y[left], depth - 1, least), self._grow(x[~left], y[~left], depth - 1, least)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))

        def walk(node, rows):
            if isinstance(node, float):
                out[rows] = node
            elif len(rows):
                left = x[rows, node[0]] <= node[1]
                walk(node[2], rows[left])
                walk(node[3], rows[~left])

        walk(self.root, np.arange(len(x)))
        return out > 0


def labelled_rows(table: str = LABELLED) -> np.ndarray:
    """FEATURES and label of each block of the labelled pages."""
    out = []
    for page in table.strip().splitlines():
        found = [re.fullmatch(r"([+-])(\d+)/(\d+)(\w*)", x).groups() for x in page.split()]
        flags = np.array([['s' in where, 1.0 if 'n' in where else 0.5 * ('p' in where), 'a' in where, 'h' in where, 'c' in where] for *_, where in found], float)
        x = features(np.array([float(n) for _, n, _, _ in found]), np.array([float(n) for _, _, n, _ in found]), flags)
        out.append(np.column_stack([x, [sign == "+" for sign, *_ in found]]))
    return np.concatenate(out)


@cache
def grown_tree(table: str = LABELLED) -> DecisionTree:
    rows = labelled_rows(table)
    return DecisionTree(rows[:, :-1], rows[:, -1], depth=10)


def main_text(page: str | None, tree: DecisionTree) -> str:
    """The page's main text: kept blocks in page order, joined by one space."""
    found = blocks(page or "")
    if not found:
        return ""
    keep = tree.predict(block_features(found))
    return " ".join(b.text for b, k in zip(found, keep) if k)


def extract_text(pages: DataFrame, html_col: str = "html", *, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with text and n_chars (code points), named with underlines before where
    ``keep`` has these names. A null or empty page, and one without main text, has the
    empty text; pages of any length are read whole, in time that grows with the
    length; repeated rows have a result each, null ids are kept, ties of the tree
    count as main text, other columns are left out, and an empty table gives no rows.
    """
    base = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").alias("_mr_html"))
    schema = T.StructType([*base.schema.fields[:-1], *(T.StructField(n, t) for n, t in zip(unused(keep, "text", "n_chars"), (T.StringType(), T.LongType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = grown_tree()
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts = [main_text(x.as_py(), tree) for x in batch.column(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return base.mapInArrow(run, schema)
