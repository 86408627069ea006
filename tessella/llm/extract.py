"""Main text of HTML pages (operator 8).

Maximum-scoring subsequence: a page is read as a run of words and tags. Words score
positive and tags negative; the weights are log odds of lying in the main content, by the
enclosing element for words and by the element for tags, counted on labelled pages (those
that mark their content by a single ``article`` or ``main``) and smoothed with priors for
what these don't show. Class and id names are features too: a name is counted by the words
under it, and doubted where its words hardly ever lie in the main content; names that the
labelled pages don't show go by a prior over their parts, outside marked content only. A
linear scan finds the best contiguous region; its blocks, without boilerplate elements
inside, are the text. Pages are read by a cursor that never looks at a place twice.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 3_000  # documented bound: about so many pages to count weights on
PRIOR_ROWS = 5.0
TINY = 1e-6  # of a word inside boilerplate
PLAIN, MAIN, HIDDEN, DOUBTED, FREE = range(5)  # places; FREE: as PLAIN on a page that marks no content
NAME_WORDS, NAME_PAGES = 20, 3  # words and pages that a class or id name must have to be judged by them
RARE, OFTEN = 0.05, 0.5  # share of its words in the main content up to which a name is doubted, from which it is trusted

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe".split())
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big button canvas cite code data del dfn em font i ins kbd label mark math meter object output q rp rt ruby s samp select small span strike strong sub sup time tt u var video wbr"
    " mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded mphantom merror mspace".split()
)
BOILERPLATE = frozenset("nav aside footer form dialog menu head".split())
CONTENT = frozenset("article main h1 h2 h3 h4 h5 h6 p blockquote pre li ul ol dl dt dd table tr td th tbody thead figure figcaption section".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption article main body html".split())
# Parts of class and id names that usually mark boilerplate, and main content.
DOUBTED_PARTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar footer header masthead topbar"
    " comment comments replies disqus respond cookie cookies consent gdpr notice alert popup modal newsletter subscribe signup login share sharing social related recommended widget"
    " toolbar pagination pager search".split()
)
TRUSTED_PARTS = frozenset("article content story post entry main text body".split())
_START = re.compile(r"<(?:/?[a-zA-Z]|[!?])")
_NAME = re.compile(r"[^\s/>]*")
_UNQUOTED = re.compile(r"""[^"'>]*""")
_ATTRIBUTE = re.compile(r"""[\s/]*(=?[^\s/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|(\S*)))?""")
_PARTS = re.compile(r"[a-z]+")


def doubted_by_parts(name: str) -> bool:
    """Prior of a name that labelled pages don't show: its last telling part decides if it is the last of all, else any doubted one."""
    parts = _PARTS.findall(name)
    if not parts or parts[-1] in TRUSTED_PARTS:
        return False
    return not DOUBTED_PARTS.isdisjoint(parts)


def _read_attributes(name: str, attributes: str) -> tuple[bool, list[str]]:
    """Whether a tag hides its element by role or attribute, and its class and id names in lower case.

    Attributes are read one after another, each with its quoted or bare value; nothing is looked for inside values.
    """
    found: dict[str, str] = {}
    for kind, *values in _ATTRIBUTE.findall(attributes) if attributes and not attributes.isspace() else ():
        found.setdefault(kind.lower(), "".join(values))  # of a repeated attribute the first counts
    names = html.unescape(f"{found.get('class', '')} {found.get('id', '')}").lower().split()
    if name in ("html", "body", "article", "main"):
        return False, names
    role = not ROLES.isdisjoint(found.get("role", "").lower().split()[:1])
    return role or found.get("aria-hidden", "").strip().lower() == "true" or "hidden" in found, names


class _Cursor:
    """Splits a page into texts and tags in one pass.

    A quote that never ends makes tags end at their first ``>`` from there on; a declaration or
    tag without one, and an element without an end, are remembered, so nothing is searched for twice.
    """

    def __init__(self, page: str):
        self.page, self.at, self.quotes = page, 0, True
        self.unclosed: set[str] = set()

    def _end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag, -1 if there is none."""
        while self.quotes:
            at = _UNQUOTED.match(self.page, at).end()
            if at == len(self.page):
                return -1
            if self.page[at] == ">":
                return at
            close = self.page.find(self.page[at], at + 1)
            if close < 0:
                self.quotes = False
            at = close + 1
        return -1

    def pieces(self) -> Iterator[tuple[str, str, str]]:
        """``(text, name, attributes)``; a tag has an empty text, an end tag a name that begins with ``/``."""
        page, size = self.page, len(self.page)
        while self.at < size:
            m = _START.search(page, self.at)
            start = m.start() if m else size
            if start > self.at:
                yield page[self.at : start], "", ""
            if not m:
                return
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                self.at = end + 3 if end >= 0 else size
                continue
            quoted = m[0][-1] not in "!?" and self.quotes
            end = self._end(m.end()) if quoted else -1
            if end < 0 and not (quoted and self.quotes):
                end = page.find(">", m.end())
            if end < 0:  # no tag ends from here on
                yield page[start:], "", ""
                return
            self.at = end + 1
            if m[0][-1] in "!?":
                continue
            close = page[start + 1] == "/"
            name = _NAME.match(page, start + 1 + close, end)
            yield "", "/" * close + name[0].lower(), page[name.end() : end]

    def skip(self, name: str) -> bool:
        """Go behind the end of an element without readable text; False if it has none."""
        if name in self.unclosed:
            return False
        close = _closing(name).search(self.page, self.at)
        if not close:
            self.unclosed.add(name)
            return False
        self.at = close.end()
        return True


@cache
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\s*>", re.I)


def events(page: str, judged: dict[str, bool] | None = None) -> Iterator[tuple[str, str, int, str, tuple[str, ...]]]:
    """The page in order as ``(kind, element, place, text, names)``; kind: ``text``, ``open``, ``close`` or, last, ``end``;
    place: HIDDEN in boilerplate, DOUBTED under a doubted name, MAIN in an article or main element, else PLAIN;
    names: class and id names of the element that opens, or of all those that close.

    ``judged``: names that labelled pages trust (True) or doubt (False); they hold everywhere but on elements that
    are blocks of text themselves, the prior of the others only outside an article or main element. Comments,
    declarations and elements without readable text are left out. An end tag closes the elements opened since its
    start tag; one without a start tag is ignored.
    """
    judged = judged or {}
    stack: list[tuple[str, bool, bool, int]] = []
    open_ = Counter()
    held: list[str] = []
    hidden = doubted = 0
    cursor = _Cursor(page)

    def place() -> int:
        return HIDDEN if hidden else DOUBTED if doubted else MAIN if open_["article"] or open_["main"] else PLAIN

    for text, name, attributes in cursor.pieces():
        if not name:
            yield "text", stack[-1][0] if stack else "", place(), text, ()
            continue
        if name[0] == "/":
            if not open_[name := name[1:]]:
                continue
            first = len(held)
            while True:
                last, was_hidden, was_doubted, n_names = stack.pop()
                open_[last] -= 1
                hidden -= was_hidden
                doubted -= was_doubted
                first -= n_names
                if last == name:
                    break
            closed = tuple(held[first:])
            del held[first:]
            yield "close", name, place(), "", closed
            continue
        if name in RAW:
            if not attributes.endswith("/") and not cursor.skip(name) and name in ("script", "style", "textarea", "title"):
                break
            continue
        if name in VOID or attributes.endswith("/") and name not in CONTENT:
            yield "open", name, place(), "", ()
            continue
        inside = open_["article"] > 0 or open_["main"] > 0
        drop, names = _read_attributes(name, attributes)
        yield "open", name, place(), "", tuple(names)
        drop |= name in BOILERPLATE or name == "header" and not inside
        doubt = False
        if name not in BLOCKS:
            doubt = any(not judged[n] if n in judged else not inside and doubted_by_parts(n) for n in names)
        stack.append((name, drop, doubt, len(names)))
        open_[name] += 1
        held += names
        hidden += drop
        doubted += doubt
    yield "end", "", place(), "", tuple(held)


def _key(kind: str, element: str, place: int) -> tuple[str, str, int]:
    known = element in CONTENT or element in INLINE or element in BOILERPLATE or element in VOID or element in ("div", "header", "body", "html", "")
    return "word" if kind == "text" else "tag", element if known else "other", place


def _label_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each key and name lies in and outside the marked content of the labelled pages of a task, and on how many pages."""
    counts: Counter = Counter()
    pages: Counter = Counter()
    for batch in batches:
        for page in batch.column(0).to_pylist():
            seen = list(events(page or ""))
            marks = [i for i, (k, e, h, *_) in enumerate(seen) if k == "open" and e in ("article", "main") and h not in (HIDDEN, DOUBTED)]
            mark = next((seen[i][1] for i in marks), None)
            if sum(seen[i][1] == mark for i in marks) != 1:
                continue
            first = next(i for i in marks if seen[i][1] == mark)
            last = next((i for i in range(len(seen) - 1, first, -1) if seen[i][:2] == ("close", mark)), len(seen))
            on_page = set()
            words, depth, since = [0, 0], Counter(), {}  # words so far outside and inside; of each open name: how often, and the words before
            for i, (kind, element, place, text, names) in enumerate(seen):
                inside = first < i < last
                n = len(text.split()) if kind == "text" else 1
                for key in [] if kind == "end" else [_key(kind, element, place), *([] if place == HIDDEN else [_key(kind, element, FREE)])]:
                    counts[key, inside] += n
                    on_page.add(key)
                if kind == "text":
                    words[inside] += n
                for x in names:  # a name counts the words under its outermost element
                    if kind == "open":
                        if not depth[x]:
                            since[x] = (*words,)
                        depth[x] += 1
                        continue
                    depth[x] -= 1
                    if not depth[x] and (found := [now - was for now, was in zip(words, since[x], strict=True)]) != [0, 0]:
                        on_page.add(("name", x, 0))
                        for side, k in enumerate(found):
                            counts[("name", x, 0), bool(side)] += k
            pages.update(on_page)
    rows = [(*key, inside, n, pages[key]) for (key, inside), n in counts.items() if n]
    columns = zip(*rows, strict=True) if rows else [()] * 6
    kinds = (pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["kind", "element", "place", "inside", "n", "pages"])


@dataclass
class Weights:
    """Counts of each key inside and in all, on labelled pages, and the class and id names that these trust or doubt."""

    counts: dict[tuple[str, str, int], tuple[int, int]]
    names: dict[str, bool] = field(default_factory=dict)

    def __post_init__(self):
        self.memo: dict[tuple, float] = {}

    def of(self, kind: str, element: str, place: int) -> float:
        key = _key(kind, element, place)
        if key not in self.memo:
            inside, n = self.counts.get(key, (0, 0))
            if place in (PLAIN, FREE):
                prior = 0.02 if element in BOILERPLATE else 0.85 if element in CONTENT else 0.7 if element in INLINE or element in VOID else 0.5
            else:
                prior = 0.02 if place in (HIDDEN, DOUBTED) and key[0] == "word" else 0.85
            p = (inside + PRIOR_ROWS * prior) / (n + PRIOR_ROWS)
            odds = math.log(p / (1 - p))
            if key[0] == "word":
                self.memo[key] = TINY if place in (HIDDEN, DOUBTED) else min(1.0, max(0.01, odds))
            else:
                self.memo[key] = min(-0.02, odds)
        return self.memo[key]


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run of the greatest sum, the first of equal ones; empty if none is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def main_text(page: str | None, weights: Weights) -> str:
    """The main text of a page, its blocks joined by one space; empty if there is none."""
    if not page:
        return ""
    seen = list(events(page, weights.names))
    marked = any(h == MAIN for _, _, h, *_ in seen)
    # where names leave nothing, they are not believed
    for unmarked in ({PLAIN: PLAIN} if marked else {PLAIN: FREE}, {PLAIN: FREE, DOUBTED: FREE}):
        own = [(k, e, unmarked.get(h, h), t) for k, e, h, t, _ in seen if k != "end"]
        a, b = best_region([weights.of(k, e, h) * (len(t.split()) if k == "text" else 1) for k, e, h, t in own])
        parts = []
        for kind, element, place, text in own[a:b]:
            if kind == "text":
                if place not in (HIDDEN, DOUBTED):
                    parts.append(html.unescape(text))
            elif element not in INLINE:
                parts.append(" ")
        if found := " ".join("".join(parts).split()):
            return found
    return ""


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> Weights:
    """Weights from about ``sample`` pages, chosen by a hash of the id (all, if there are fewer)."""
    share = min(1.0, sample / max(1, pages.count()))
    own = pages.where(F.abs(F.xxhash64(id_col) % 1_000_003) < int(share * 1_000_003) + 1).select(F.col(html_col).cast("string").alias("html"))
    counted = own.mapInArrow(_label_batches, "kind string, element string, place int, inside boolean, n long, pages long")
    counted = counted.groupBy("kind", "element", "place").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inside"), F.sum("n").alias("n"), F.sum("pages").alias("pages"))
    share = F.col("inside") / F.col("n")
    telling = (F.col("n") >= NAME_WORDS) & (F.col("pages") >= NAME_PAGES) & ((share <= RARE) | (share >= OFTEN))
    found = counted.where((F.col("kind") != "name") | telling).collect()  # a row for each known element, and for names of several sampled pages
    names = {r.element: r.inside / r.n >= OFTEN for r in found if r.kind == "name"}
    return Weights({(r.kind, r.element, r.place): (r.inside, r.n) for r in found if r.kind != "name"}, names)


def _extract_batches(batches: Iterator[pa.RecordBatch], weights) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p.as_py(), weights.value) for p in batch.column(2)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = SAMPLE) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page; null, empty and wordless pages have an empty text."""
    shared = pages.sparkSession.sparkContext.broadcast(fit(pages, id_col, html_col, sample))
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    return own.mapInArrow(partial(_extract_batches, weights=shared), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
