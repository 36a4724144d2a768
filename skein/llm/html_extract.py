"""Main text of web pages from the events of the standard library's streaming HTML parser.

The events give lines: the text between two block boundaries, with the number of tags and of link characters in it.
Lines under elements that never hold main text (menus, headers, footers, sidebars, notices, adverts, forms, comments,
hidden parts) are marked and count as lines without text; a form or a name around the page's only article is its frame and
marks nothing.  The text-to-tag ratios of all lines are smoothed by a Gaussian, and a threshold between their two clusters finds
the dense stretches.  The regions of the page that these lie in are the content: its article and main elements, else the
nearest common part of all.  In a region, lines that are mostly links or stand under a doubtful name stay only if
they are dense or lie within a dense stretch.  All steps are linear in the size of the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, slices

# Fixed values of HTML: elements without content, elements that stand as blocks, elements that are no main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td template tfoot th thead title tr ul".split())
NEVER = frozenset("aside audio button canvas datalist dialog fieldset footer form frameset head header iframe input label math menu nav noembed noframes noscript object option script select style svg template textarea title video".split())
ENDS_P = BLOCK - {"br", "body", "html", "head", "title", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "select"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
P_BOUNDS = frozenset(("button", "td", "th", "table", "object"))
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
PARTS = frozenset("article body div main section td".split())
# Words of class and id names that mark what is no main text.
WORDS = frozenset("ad ads adv advert adverts advertisement advertising advertisment sponsor sponsored sponsors promo promoted promotion banner cookie cookies consent gdpr notice notices notification alert warning popup modal overlay newsletter subscribe subscription signup login paywall sidebar sidebars aside rail nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer foot header masthead topbar toolbar share sharing social related recommended recommendations comment comments commentlist disqus respond replies reply widget widgets form search skip copyright disclaimer hidden".split())
# Words that name the make-up of an element and not what it holds.
PLAIN = frozenset("area articles author avatar bar block body bottom box btn button buttons center column container content date first fixed global group head heading icon inline inner item items js label last left link links list main meta mobile module outer panel post posts right row section site slot small sticky story text title toggle top unit user wrap wrapper".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# What marks an element: a name that says so in part, one that says so in whole, a form, the element itself.
WEAK, NAME, FORM, HARD = 1, 2, 3, 4


def name_mark(value: str) -> int:
    """NAME if a class or id consists of words that mark and words of make-up, WEAK if it has other words too (notice-board)."""
    best = 0
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        if not WORDS.isdisjoint(words):
            best = max(best, NAME if all(w in WORDS or w in PLAIN for w in words) else WEAK)
    return best


class _Lines(HTMLParser):
    """Collects elements (name, parent, own mark, whether a main part) and lines (text, tags, link characters, innermost element)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.names, self.parent, self.own, self.main = [""], [0], [0], [False]  # element 0 is the page
        self.stack: list[int] = [0]
        self.open: dict[str, int] = {}  # how many elements of a name are open
        self.scopes: list[int] = [0]  # open p elements in each open element that bounds them
        self.links = self.tags = self.link_chars = 0
        self.parts: list[str] = []
        self.lines: list[tuple[str, int, int, int]] = []

    def line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self.link_chars, self.stack[-1]))
            self.tags = 0
        self.parts.clear()
        self.link_chars = 0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Browsers take <![ ... > as a comment; the library raises on most."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_P and self.scopes[-1]:
            self._end("p")
        for other in SIBLINGS.get(tag, ()):
            self._end(other, ("ul", "ol", "dl", "table", "select", "menu", "datalist"))
        own = self._mark(tag, attrs)
        if tag in BLOCK or own > WEAK:
            self.line()
        self.tags += 1
        if tag in VOID:
            return
        self.parent.append(self.stack[-1])
        self.stack.append(len(self.names))
        self.names.append(tag)
        self.own.append(own if tag in BLOCK or own > WEAK else 0)
        self.main.append(self._main(tag, attrs))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.links += tag == "a"
        self.scopes[-1] += tag == "p"
        if tag in P_BOUNDS:
            self.scopes.append(0)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # browsers take <div/> as <div>, so does this; void elements need no end

    def handle_endtag(self, tag: str) -> None:
        if tag == "p" and not self.open.get("p"):
            self.line()
        self._end(tag)
        self.tags += 1

    def _end(self, tag: str, bounds: tuple[str, ...] = ()) -> None:
        if not self.open.get(tag):
            return
        names, stack = self.names, self.stack
        if bounds:
            for n in reversed(stack):
                if names[n] == tag:
                    break
                if names[n] in bounds:
                    return
        top, breaks = len(stack), False
        while names[stack[top - 1]] != tag:
            top -= 1
            breaks = breaks or names[stack[top]] in BLOCK or self.own[stack[top]] > WEAK
        if breaks or tag in BLOCK or self.own[stack[top - 1]] > WEAK:
            self.line()
        for n in stack[: top - 2 : -1]:
            name = names[n]
            self.open[name] -= 1
            self.links -= name == "a"
            if name in P_BOUNDS:
                self.scopes.pop()
            self.scopes[-1] -= name == "p"
        del stack[top - 1 :]

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.links:
            self.link_chars += len(data.strip())

    @staticmethod
    def _mark(tag: str, attrs: list[tuple[str, str | None]]) -> int:
        if tag in ("form", "fieldset"):
            return FORM
        if tag in NEVER:
            return HARD
        if tag in ("html", "body", "main"):
            return 0
        best = 0
        for name, value in attrs:
            value = value or ""
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return HARD
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return HARD
            if name == "role" and value.lower() in ROLES:
                best = max(best, FORM if value.lower() == "form" else NAME)
            if name in ("class", "id"):
                best = max(best, name_mark(value))
        return 0 if tag == "article" and best == WEAK else best

    @staticmethod
    def _main(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in ("article", "main"):
            return True
        return any((n == "role" and v in ("main", "article")) or (n == "itemprop" and v == "articleBody") for n, v in attrs)

    def summed(self, values: list[float]) -> list[float]:
        """Of each element, the sum over itself and all within; parents stand before children."""
        for n in range(len(values) - 1, 0, -1):
            values[self.parent[n]] += values[n]
        return values

    def marks(self, lifted: set[int]) -> list[int]:
        """The greatest mark on each element or around it; main parts it anew, unless something hard is around."""
        out = [0]
        for n in range(1, len(self.names)):
            around, own = out[self.parent[n]], 0 if n in lifted else self.own[n]
            out.append(0 if self.names[n] == "main" and around < HARD else max(around, own))
        return out


def smooth(ratios: np.ndarray, radius: int = 2, spread: float = 1.0) -> np.ndarray:
    kernel = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * spread * spread))
    weight = np.convolve(np.ones_like(ratios), kernel, "full")[radius:-radius]
    return np.convolve(ratios, kernel, "full")[radius:-radius] / weight


def threshold(values: np.ndarray) -> float:
    """Between the two clusters of the values' logarithms (two means); under the least value if they are all alike."""
    logs = np.log1p(values)
    low, high = logs.min(), logs.max()
    if high - low < 0.5:
        return float(values.min()) - 1
    for _ in range(50):
        cut = (low + high) / 2
        new = logs[logs <= cut].mean(), logs[logs > cut].mean()
        if new == (low, high):
            break
        low, high = new
    return float(np.expm1((low + high) / 2))


def _read(html: str) -> _Lines:
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.line()
    return parser


def _effective(page: _Lines) -> list[int]:
    """The marks, without those of the page's own frame."""
    plain = [0.0] * len(page.names)
    for text, _, links, at in page.lines:
        plain[at] += len(text) - min(links, len(text))
    size = page.summed(plain)[0]
    lifted = {n for n, own in enumerate(page.own) if own == FORM and plain[n] * 2 > size}  # a form around the page
    marks = page.marks(lifted)
    parts = [n for n in range(len(page.names)) if page.main[n] and plain[n]]
    if parts and all(marks[n] >= NAME for n in parts):
        holds = [0.0] * len(page.names)
        for n in parts:
            holds[n] = 1.0
        lifted |= {n for n, inside in enumerate(page.summed(holds)) if inside and page.own[n] < HARD}
        marks = page.marks(lifted)
    if all(marks[at] >= NAME for *_, at in page.lines):  # a name on all that there is
        marks = page.marks(lifted | {n for n, own in enumerate(page.own) if own == NAME})
    return marks


def _regions(page: _Lines, mass: list[float], count: list[float]) -> set[int]:
    """The main parts to take: all outermost ones; a part within stands for its outer one if no dense text and no further part lies outside it."""
    top, nested, best = [0], [0.0] * len(page.names), {}
    for n in range(1, len(page.names)):
        around = top[page.parent[n]]
        top.append(around or (n if page.main[n] and count[n] else 0))
    inner = [False] * len(page.names)  # inside a part that isn't outermost
    for n in range(1, len(page.names)):
        part = page.main[n] and top[n] not in (0, n)
        if part and not inner[page.parent[n]]:
            nested[top[n]] += count[n]
        inner[n] = part or inner[page.parent[n]]
        if page.main[n] and top[n]:
            best.setdefault(top[n], n)
    for n in range(1, len(page.names)):
        r = top[n]
        if page.main[n] and r not in (0, n) and mass[n] == mass[r] > 0 and count[n] == nested[r]:
            best[r] = n
    return set(best.values())


def main_text(html: str | None) -> tuple[str, int]:
    """The main text and the number of its lines; null, empty and textless pages give the empty text."""
    page = _read(html or "")
    lines, marks = page.lines, _effective(page)
    marked = [marks[at] >= NAME for *_, at in lines]
    if all(marked):
        return "", 0
    ratios = np.array([0.0 if m else max(0, len(text) - links) / max(1, tags) for (text, tags, links, _), m in zip(lines, marked, strict=True)])
    smoothed = smooth(ratios)
    cut = threshold(smoothed)
    near, solid = smoothed > cut, ratios > max(cut, 0.0) / 2
    dense = near & (ratios > 0)
    if not dense.any():
        near = dense = solid = ratios == ratios.max()
    # A line that looks like noise stays if it is dense itself, or in a dense stretch between two such lines.
    sure = solid | near & np.append(False, solid[:-1]) & np.append(solid[1:], False)
    mass, count = [0.0] * len(page.names), [0.0] * len(page.names)
    for (text, _, links, at), m, d in zip(lines, marked, dense, strict=True):
        if not m:
            mass[at] += len(text) * bool(d)
            count[at] += len(text) > links
    mass, count = page.summed(mass), page.summed(count)
    regions = _regions(page, mass, count)
    if not regions:  # the innermost part that holds all dense text
        regions = {max((n for n in range(len(page.names)) if mass[n] == mass[0] and page.names[n] in PARTS), default=0)}
    inside = []
    for n in range(len(page.names)):
        inside.append(n in regions or (n > 0 and inside[page.parent[n]]))
    kept = [text for (text, _, links, at), m, d in zip(lines, marked, sure, strict=True) if not m and inside[at] and (d or (marks[at] < WEAK and links * 2 <= len(text)))]
    return " ".join(kept), len(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_lines): one row per page, null ids, null urls and repeated rows included.

    Null html gives the empty text.  An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [main_text(x.as_py()) for x in part.column(2)]
                texts = pa.array([t for t, _ in found], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts, pa.array([len(t) for t, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], ["page_id", "url", "text", "n_chars", "n_lines"])

    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return arrow_map(chosen, run, "page_id long, url string, text string, n_chars long, n_lines long")
