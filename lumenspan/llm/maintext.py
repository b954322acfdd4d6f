"""Main text of web pages as the maximum-scoring contiguous stretch of words and tags.

A page is a sequence of words and tags. Words score positive and tags negative, and a linear scan
finds the stretch of the highest sum. All weights are learned from labelled pages:

* of names (parts of class, id and role), the log odds that an element bearing them holds main text.
  Parts that few pages have count as one, which speaks for main text; so ``ad-box`` tells an advert
  and ``search-for-life`` an article about something else;
* of events (words by where they stand, tags by their name), the weights under which the best
  stretch is the labelled one, by an averaged structured perceptron. Its only rule is the method's:
  no tag scores above zero.

Elements that are menus, headers, footers, sidebars, forms and the like by their own name, and those
that the names they bear give away, are left out of what the stretch covers. Outside an article such
an element scores as one event, whatever its size, and inside one it scores nothing, so it never
parts the text before it from the text behind it.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenspan.llm import labelled_pages, shared

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|svg|iframe|select)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-z]+")
#: Elements that are never main text; those of the second kind may have been left open before it.
OUTSIDE = frozenset(("nav", "footer", "aside", "form", "button", "header", "menu", "dialog", "head", "object", "fieldset"))
_LEFT_OPEN = frozenset(("nav", "header", "menu", "form", "fieldset", "button", "head"))
_WHOLE, _TEXT = frozenset(("html", "body", "main", "article")), frozenset(("article", "main"))
_VOID = frozenset(("area", "base", "br", "col", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "embed"))
_INLINE = frozenset(
    (
        *("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd"),
        *("label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"),
    )
)
#: Start tags that end an open paragraph, and elements that end one of their like (up to the element around both).
_ENDS_P = frozenset(
    (
        *("address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer"),
        *("form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul"),
    )
)
_ENDS_LIKE = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tr": (("tr",), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "thead": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
    "option": (("option",), ("select", "datalist")),
    "a": (("a",), ()),
}
_TABLE = frozenset(("table", "tbody", "thead", "tfoot", "tr", "td", "th"))
#: Kinds of events besides tags: words, words beside the article of a page that has one, words of links, elements left out.
WORD, BESIDE, LINKED, LEFT_OUT = "word", "word beside the article", "linked word", "element left out"
_WORDS = frozenset((WORD, BESIDE, LINKED))
#: Tags of a page with an article are told apart by where they stand.
WITHIN, OUT_THERE = " in the article", " beside the article"
#: An element is left out if the names it bears are so many times as likely outside main text; names on fewer pages are one.
CERTAIN, RARE = math.log(5), 4
#: What the labelled stretch must be better by, for each word and each tag.
WORD_MARGIN, TAG_MARGIN = 0.2, 0.02
#: Labelled pages that are made besides those written by hand, and rounds of learning over them.
MADE_PAGES, ROUNDS = 2_000, 8
UNKNOWN = "?"


@dataclass
class Names:
    """What the parts of names say; ``UNKNOWN`` stands for rare ones."""

    #: Log odds that an element with the part in its name is main text.
    odds: dict[str, float]
    #: Parts that are on no element around main text.
    never: frozenset[str]

    def of(self, name: str) -> float:
        """Of one class, id or role: above zero if it speaks for main text."""
        other = self.odds.get(UNKNOWN, 0.0)
        return sum(self.odds.get(w, other) for w in parts(name))

    def tell(self, attributes: str) -> tuple[bool, bool]:
        """Of the attributes of an element: whether a name gives it away; whether it can still be around main text."""
        bad = [n for n in names_in(attributes) if self.of(n) <= -CERTAIN]
        return bool(bad), not any(w in self.never for n in bad for w in parts(n))


def names_in(attributes: str) -> list[str]:
    return "".join(f"{''.join(x)} " for x in _NAMES.findall(attributes.lower())).split() if "=" in attributes else []


def parts(name: str) -> set[str]:
    return {w for w in _SPLIT.split(name) if w}


class Page:
    """A page as elements and events. Both take time in proportion to its length."""

    def __init__(self, page: str, names: Names) -> None:
        #: Of each token: offset, innermost element (the new one of a start tag; -1: none), tag name or "", text.
        self.tokens: list[tuple[int, int, str, str]] = []
        #: Of each element: tag name, parent (-1: none), attributes, whether it is outside by its own name.
        self.names: list[str] = []
        self.parent: list[int] = []
        self.attributes: list[str] = []
        self.outside: list[bool] = []
        self._stack: list[int] = []
        self._open: dict[str, list[int]] = {}
        self._gone: set[int] = set()
        self._parse(page)
        self._weigh(names)

    def _top(self) -> int:
        stack = self._stack
        while stack and stack[-1] in self._gone:
            self._gone.discard(stack.pop())
        return stack[-1] if stack else -1

    def _last(self, *names: str) -> int:
        """The innermost open element with one of some names; -1 if there is none."""
        last = -1
        for n in names:
            held = self._open.get(n)
            if held and held[-1] > last:
                last = held[-1]
        return last

    def _close(self, to: int) -> None:
        """Close an element and all within it."""
        while self._stack:
            e = self._stack.pop()
            if e in self._gone:
                self._gone.discard(e)
                continue
            self._open[self.names[e]].pop()
            if e == to:
                return

    def _remove(self, e: int) -> None:
        """Close an inline element, but not what stands in it."""
        self._open[self.names[e]].pop()
        self._gone.add(e)

    def _make_room(self, name: str) -> None:
        """Close what a start tag ends."""
        if name in _ENDS_P and (p := self._last("p")) > self._last("button", "td", "th", "table"):
            self._close(p)
        if name in _ENDS_LIKE:
            like, around = _ENDS_LIKE[name]
            last = self._last(*like)
            if last > self._last(*around):
                self._remove(last) if name == "a" else self._close(last)
        if name in _TEXT and not self._began:
            # The main text begins in menus or headers: they were never closed, or hold the whole page.
            open_outside = [e for n in OUTSIDE for e in self._open.get(n, ()) if self.outside[e]]
            if open_outside and all(self.names[e] in _LEFT_OPEN for e in open_outside):
                self._close(min(open_outside))
        self._began = self._began or name in _TEXT

    def _begin(self, name: str, attributes: str) -> int:
        self._make_room(name)
        inside = name in ("header", "menu") and self._last("article", "main") >= 0
        e = len(self.names)
        self.parent.append(self._top())
        self.names.append(name)
        self.attributes.append(attributes if "=" in attributes and name not in _WHOLE else "")
        self.outside.append(name in OUTSIDE and not inside)
        self._stack.append(e)
        self._open.setdefault(name, []).append(e)
        return e

    def _end(self, name: str) -> None:
        e = self._last(name)
        if e < 0:
            return
        if name in _INLINE and e != self._top():
            self._remove(e)
        elif name in _TABLE or name in _WHOLE or e > self._last("td", "th", "table"):
            self._close(e)

    def _parse(self, page: str) -> None:
        self._began, at, tokens = False, 0, self.tokens
        for m in _TOKEN.finditer(page):
            if m.start() > at:
                tokens.append((at, self._top(), "", entities.unescape(page[at : m.start()])))
            at = m.end()
            name = (m["name"] or "").lower()
            if not name:
                tokens.append((m.start(), self._top(), "", " " if (m["raw"] or "").lower() in ("", "svg") else ""))
            elif m["end"]:
                e = self._top()
                self._end(name)
                tokens.append((m.start(), e, name, ""))
            elif name in _VOID or m["rest"].endswith("/"):
                self._make_room(name)
                tokens.append((m.start(), self._top(), name, ""))
            else:
                tokens.append((m.start(), self._begin(name, m["rest"]), name, ""))
        if at < len(page):
            tokens.append((at, self._top(), "", entities.unescape(page[at:])))

    def _weigh(self, names: Names) -> None:
        """Which elements are left out: by their own name, or by names they bear unless they hold the main text.

        An element can hold it unless its names are never around main text, and does if it has a main
        element in it or most of the words that could be main text; but if an article stands in no
        element that names give away, only one that has an article too.
        """
        n, told = len(self.names), {"": (False, True)}
        hint, never, linked, text, main, hinted, has_text = ([False] * (n + 1) for _ in range(7))  # the last of each stands for no element
        plain_article = False
        for e, up in enumerate(self.parent):
            given = self.attributes[e]
            if given not in told:
                told[given] = names.tell(given)
            hint[e] = told[given][0]
            never[e] = never[up] or self.outside[e] or (hint[e] and not told[given][1])
            linked[e] = linked[up] or self.names[e] == "a"
            text[e] = text[up] or self.names[e] in _TEXT
            main[e] = self.names[e] == "main" and not never[e]
            hinted[e] = hinted[up] or hint[e]
            has_text[e] = self.names[e] in _TEXT
            plain_article = plain_article or (has_text[e] and not hinted[e] and not never[e])
        words, total, articles = [0] * (n + 1), 0, 0
        for _, e, tag, said in self.tokens:
            if not tag and not never[e] and not linked[e]:
                k = len(said.split())
                words[e] += k
                total += k
                articles += k if text[e] else 0
        for e in range(n - 1, -1, -1):
            up = self.parent[e]
            words[up] += words[e]
            main[up] = main[up] or main[e]
            has_text[up] = has_text[up] or has_text[e]
        self.left_out, self.block = [False] * (n + 1), [-1] * (n + 1)
        for e, up in enumerate(self.parent):
            holds = not never[e] and (main[e] or (2 * words[e] > total and (has_text[e] or not plain_article)))
            self.left_out[e] = self.left_out[up] or self.outside[e] or (hint[e] and not holds)
            if self.left_out[e]:
                self.block[e] = self.block[up] if self.left_out[up] else e
        self.linked, self.text, self.has_article = linked, text, 2 * articles > total

    def events(self) -> Iterator[tuple[int, str, int, str, bool]]:
        """(offset, kind, how many, text, whether a new block begins) in page order; kind "" scores nothing."""
        last = -1
        for at, e, tag, said in self.tokens:
            kind, n = "", 1
            if self.left_out[e]:
                said = ""
                if (block := self.block[e]) > last:
                    last = block
                    kind = "" if self.text[self.parent[block]] else LEFT_OUT
            elif tag:
                where = "" if not self.has_article else WITHIN if self.text[e] else OUT_THERE
                kind = "" if tag in _TEXT else f"<{tag}>{where}"
            else:
                kind = LINKED if self.linked[e] else BESIDE if self.has_article and not self.text[e] else WORD
                n = len(said.split())
            if tag in ("br", "td", "th", "img"):
                said = " "
            yield at, kind, n, said, bool(tag) and tag not in _INLINE and tag not in ("td", "th")


def best_stretch(scores: Iterable[float]) -> tuple[int, int]:
    """Begin and end of the contiguous stretch of the highest sum, the first of equals; (0, 0) if none is above zero."""
    best = low = total = 0.0
    begin = end = low_at = 0
    for i, x in enumerate(scores):
        total += x
        if total < low:
            low, low_at = total, i + 1
        elif total - low > best:
            best, begin, end = total - low, low_at, i + 1
    return begin, end


@dataclass
class Model:
    names: Names
    weights: dict[str, float]

    def weight(self, kind: str) -> float:
        """Of an event; a tag that no labelled page has scores as the mean of tags."""
        w = self.weights.get(kind)
        return w if w is not None else self.weights["<>"] if kind else 0.0


def marked(page: str) -> tuple[str, list[tuple[int, int]]]:
    """A labelled page without its marks, and where main text lies."""
    pieces, spans, at = re.split(r"(\[\[|\]\])", page), [], 0
    for i in range(0, len(pieces), 2):
        if i and pieces[i - 1] == "[[":
            spans.append((at, at + len(pieces[i])))
        at += len(pieces[i])
    return "".join(pieces[::2]), spans


def learn_names(pages: list[tuple[str, list[tuple[int, int]]]]) -> Names:
    """From the elements that bear names: in main text, around it, or neither."""
    counts: dict[bool, Counter[str]] = {True: Counter(), False: Counter()}
    number = {True: 1, False: 1}
    around: list[str] = []
    on_pages: Counter[str] = Counter()
    for source, spans in pages:
        page = Page(source, Names({}, frozenset()))
        holders, e = set(), next((e for at, e, tag, _ in page.tokens if at >= spans[0][0] and not tag), -1)
        while e >= 0:
            holders.add(e)
            e = page.parent[e]
        begins: dict[int, int] = {}
        for at, e, _, _ in page.tokens:
            begins.setdefault(e, at)
        here: set[str] = set()
        for e, given in enumerate(page.attributes):
            inside = any(a <= begins[e] < b for a, b in spans)
            for name in names_in(given):
                here |= parts(name)
                if e in holders and not inside:
                    around.append(name)
                else:
                    counts[inside].update(parts(name))
                    number[inside] += 1
        on_pages.update(here)
    known = {w for w, n in on_pages.items() if n >= RARE}
    for c in counts.values():
        c[UNKNOWN] = sum(n for w, n in c.items() if w not in known)
    odds = {w: math.log((counts[True][w] + 0.5) / number[True]) - math.log((counts[False][w] + 0.5) / number[False]) for w in {*known, UNKNOWN}}
    names = Names(odds, frozenset())
    tried = {w for name in around if names.of(name) <= -CERTAIN for w in parts(name)}
    return Names(odds, frozenset(known - tried))


def learn_weights(pages: list[tuple[str, list[tuple[int, int]]]], names: Names) -> dict[str, float]:
    """Averaged structured perceptron: add what the labelled stretch has, take away what the best one has.

    Best is told with a margin: each event outside the labelled stretch counts as so much better, each
    word in it as so much worse than its weight.
    """
    seen = []
    for source, spans in pages:
        events = [(at, kind, n, bool(said.strip())) for at, kind, n, said, _ in Page(source, names).events()]
        inside = [i for i, (at, _, _, _) in enumerate(events) if spans[0][0] <= at < spans[-1][1]]
        a, b = inside[0], inside[-1] + 1
        margin = [(-WORD_MARGIN * n if a <= i < b else WORD_MARGIN * n) if kind in _WORDS else 0.0 if a <= i < b or not kind else TAG_MARGIN for i, (_, kind, n, _) in enumerate(events)]
        seen.append((events, a, b, margin))
    kinds = {kind for events, *_ in seen for _, kind, _, _ in events if kind}
    weights = {k: 1.0 if k == WORD else 0.0 for k in kinds}
    total, steps = Counter(), 0
    for _ in range(ROUNDS):
        for events, a, b, margin in seen:
            c, d = best_stretch((weights[kind] * n if kind else 0.0) + m for (_, kind, n, _), m in zip(events, margin, strict=True))
            if [i for i in range(a, b) if events[i][3]] != [i for i in range(c, d) if events[i][3]]:
                change: Counter[str] = Counter()
                for begin, end, sign in ((a, b, 1), (c, d, -1)):
                    for _, kind, n, _ in events[begin:end]:
                        change[kind] += sign * n
                size = math.sqrt(sum(n * n for k, n in change.items() if k)) or 1.0
                for k, n in change.items():
                    if k:
                        w = weights[k] + 0.1 * n / size
                        weights[k] = min(w, 0.0) if k[0] == "<" else w
            total.update(weights)
            steps += 1
    out = {k: w / steps / (total[WORD] / steps) for k, w in total.items()}
    tags = [w for k, w in out.items() if k[0] == "<"]
    return out | {"<>": sum(tags) / max(1, len(tags))}


def learn(pages: Iterable[str]) -> Model:
    """A model from pages whose main text stands between ``[[`` and ``]]``."""
    labelled = [marked(p) for p in pages]
    names = learn_names(labelled)
    return Model(names, learn_weights(labelled, names))


@lru_cache(1)
def model() -> Model:
    return learn([*labelled_pages.PAGES, *labelled_pages.made(MADE_PAGES)])


def main_text(page: str | None, by: Model | None = None) -> str:
    """The blocks of the best stretch, each with single spaces, joined by line feeds."""
    by = by or model()
    seen = list(Page(page or "", by.names).events())
    begin, end = best_stretch(by.weight(kind) * n for _, kind, n, _, _ in seen)
    blocks, own = [], []
    for _, _, _, text, fresh in seen[begin:end]:
        if fresh:
            blocks.append(" ".join("".join(own).split()))
            own = []
        own.append(text)
    blocks.append(" ".join("".join(own).split()))
    return "\n".join(b for b in blocks if b)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of ``pages``: ``id_col``, ``url_col``, ``text``, ``n_chars`` (code points).

    Null html, and a page without a word outside menus and the like, gives the empty text. Of equally
    good stretches the first is taken. Repeated rows stay repeated, the whole html is read whatever
    its length, and an empty table gives no rows. Null ids and urls are kept; other columns aren't read.
    """
    by = model()  # learned once, on the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in shared.slices(whole, 2, 8 << 20):
                texts = [main_text(h, by) for h in batch.column(2).to_pylist()]
                columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [id_col, url_col, "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    rows = pages.select(id_col, url_col, F.col(html_col).cast("string").alias("source"))
    return shared.arrow(rows, run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
