"""Visible text of web pages, laid out as a browser would stack it.

A tree builder reads the page once: it implies the tags that authors leave out (a paragraph ends at the next block,
an item at the next item, cells and rows at the next ones), ignores stray end tags, and closes what is open when an
outer element ends. Visibility follows the elements that are never shown (head, script, style, template, data lists, drawings but for their text, ...), the
``hidden`` attribute, objects with data, ``display:none`` and ``visibility:hidden`` in a style attribute, hidden inputs, closed dialogs,
and all but the summary of closed details. Text that is shown is kept whole: blocks are on lines of their own, with
a blank line where a browser has a margin; list items have a marker and the indent of their depth; the cells of a
table's column begin at the same place, unless that would take far more blanks than the table has text; preformatted text keeps its spaces. There is no recursion, so depth is only
bounded by memory. Style sheets and scripts are not read: what they alone would hide is kept.

Defined cases: null and empty pages give an empty text; null ids and repeated rows are treated like others; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
NEVER = frozenset("head script style template noscript iframe noembed noframes title audio video canvas datalist rp progress meter".split())
#: What a head holds; anything else ends it.
HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head html".split())
#: Text of drawings is shown in these elements only, and never in those.
SVG_TEXT = frozenset({"text", "foreignobject"})
#: Words on either side of where one of these begins or ends are apart.
APART = frozenset({"text", "option", "optgroup", "select", "textarea"})
SVG_NEVER = frozenset("defs symbol clippath mask pattern marker metadata desc lineargradient radialgradient filter".split())
MATH_NEVER = frozenset({"annotation", "annotation-xml"})
#: Blocks with a blank line around them, and blocks without.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre xmp table figure fieldset hr".split())
PLAIN = frozenset("html body div section article main header footer nav aside address form li dt dd tr td th caption thead tbody tfoot figcaption details summary dialog legend center menu hgroup search colgroup".split())
BLOCKS = SPACED | PLAIN
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: An open element of the first kind ends when one of the second begins, unless a wall stands between.
IMPLIED = {
    "p": BLOCKS - {"html", "body", "td", "th", "tr", "caption", "thead", "tbody", "tfoot", "colgroup", "summary"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "td": frozenset({"td", "th", "tr", "thead", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "thead", "tbody", "tfoot"}),
    "tr": frozenset({"tr", "thead", "tbody", "tfoot"}),
    "thead": frozenset({"tbody", "tfoot"}),
    "tbody": frozenset({"tbody", "tfoot"}),
    "tfoot": frozenset({"tbody"}),
    "caption": frozenset({"tr", "td", "th", "thead", "tbody", "tfoot"}),
    "option": frozenset({"option", "optgroup"}),
    "optgroup": frozenset({"optgroup"}),
    "head": frozenset({"body"}) | (BLOCKS - {"html"}),
}
ENDS_BEFORE = {start: frozenset(k for k, v in IMPLIED.items() if start in v) for start in {x for v in IMPLIED.values() for x in v}}
#: Elements that implied ends don't reach through, for each kind of element that may end.
WALLS = {"p": frozenset("table td th caption object button".split()), "li": frozenset("ul ol menu table td th".split()), "dt": frozenset("dl table td th".split()), "dd": frozenset("dl table td th".split()), "option": frozenset({"select", "datalist"}), "optgroup": frozenset({"select"}), "head": frozenset()}
_TABLE_WALL = frozenset({"table"})
#: An end tag doesn't reach an element beyond these.
END_WALLS = frozenset({"table", "td", "th", "caption"})
#: A table whose columns would need more blanks than this many times its text, and a bit, has two blanks between cells.
PAD_TIMES, PAD_FREE = 16, 1 << 16

_TAG = re.compile(r"<(?:!--|(/?)([A-Za-z][^\s/>]*)|[!?/])")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: A slash at the end of a tag that belongs to a value without quotes.
_BARE_SLASH = re.compile(r"""=\s*[^\s"'>]*/$""")
_MARK = re.compile(r"""[>"']""")
_SPACES = re.compile(r"[ \t\n\f\r]+")
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)


@dataclass
class Flow:
    """Lines of one block context."""

    lines: list[str] = field(default_factory=list)
    inline: list[str] = field(default_factory=list)
    space: bool = False
    margin: bool = False
    indents: list[str] = field(default_factory=list)
    marker: str = ""
    pre: int = 0

    def text(self, data: str) -> None:
        if self.pre:
            parts = data.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            for k, part in enumerate(parts):
                if k:
                    self.line(True)
                if part:
                    self.inline.append(part)
            return
        parts = _SPACES.split(data)
        if parts[0] == "" and len(parts) > 1:
            self.space = True
        for part in parts:
            if part:
                if self.space and self.inline:
                    self.inline.append(" ")
                self.inline.append(part)
                self.space = True
        if parts[-1] != "":
            self.space = False

    def line(self, forced: bool = False) -> None:
        """End the current line; a forced end makes an empty one too."""
        if not self.inline and not forced:
            self.space = False
            return
        if self.margin and self.lines:
            self.lines.append("")
        self.margin = False
        self.lines.append(("".join(self.indents) + self.marker + "".join(self.inline)).rstrip())
        if self.marker:
            self.marker = " " * len(self.marker)
        self.inline, self.space = [], False

    def whole(self, block: list[str]) -> None:
        """Lines laid out already."""
        self.line()
        if self.margin and self.lines:
            self.lines.append("")
        self.margin = False
        for x in block:
            self.lines.append(("".join(self.indents) + self.marker + x).rstrip())
            if self.marker:
                self.marker = " " * len(self.marker)

    def done(self) -> list[str]:
        self.line()
        return self.lines


@dataclass
class Grid:
    """Cells of one table: rows of (column, columns spanned, lines). What cells above cover is kept as spans of columns, not
    column by column, so wide and deep cells cost no more than others."""

    rows: list[list[tuple[int, int, list[str]]]] = field(default_factory=list)
    caption: list[str] = field(default_factory=list)
    taken: list[tuple[int, int, int]] = field(default_factory=list)  # (from, to, first row that isn't covered), in order, apart
    fresh: list[tuple[int, int, int]] = field(default_factory=list)  # the same of the last row's cells
    covered: list[list[int]] = field(default_factory=list)  # (from, to) of what is taken, joined where it touches
    soonest: int = 1 << 60  # when the next of ``taken`` ends

    def _cover(self, spans: list[tuple[int, int, int]]) -> None:
        for lo, hi, _ in spans:
            if self.covered and self.covered[-1][1] >= lo:
                self.covered[-1][1] = hi
            else:
                self.covered.append([lo, hi])

    def row(self) -> None:
        now, fresh, self.fresh = len(self.rows), self.fresh, []
        if fresh:
            self.soonest = min(self.soonest, *[until for _, _, until in fresh])
        if fresh and (not self.taken or fresh[0][0] >= self.taken[-1][1]):
            self.taken += fresh
            self._cover(fresh)
            fresh = []
        if fresh or self.soonest <= now:
            self._lay_over(fresh, now)
        self.rows.append([])
        self.next, self.near = 0, 0

    def _lay_over(self, fresh: list[tuple[int, int, int]], now: int) -> None:
        """Fresh spans take the place of older ones where they meet; what has ended goes."""
        out, k = list(fresh), 0
        for lo, hi, until in self.taken:
            while k < len(fresh) and fresh[k][1] <= lo:
                k += 1
            at = k
            while lo < hi:
                if at == len(fresh) or fresh[at][0] >= hi:
                    out.append((lo, hi, until))
                    break
                if fresh[at][0] > lo:
                    out.append((lo, fresh[at][0], until))
                lo, at = max(lo, fresh[at][1]), at + 1
        self.taken = sorted(x for x in out if x[2] > now)
        self.soonest = min((x[2] for x in self.taken), default=1 << 60)
        self.covered = []
        self._cover(self.taken)

    def cell(self, lines: list[str], across: int, down: int) -> None:
        while self.near < len(self.covered) and self.covered[self.near][0] <= self.next:
            self.next = max(self.next, self.covered[self.near][1])
            self.near += 1
        self.rows[-1].append((self.next, across, lines))
        if down > 1:
            self.fresh.append((self.next, self.next + across, len(self.rows) - 1 + down))
        self.next += across

    def laid_out(self) -> list[str]:
        width: dict[int, int] = {}
        wide: list[tuple[int, int, int]] = []
        for row in self.rows:
            for c, across, lines in row:
                own = max(map(len, lines), default=0)
                width[c] = max(width.get(c, 0), own if across == 1 else 0)
                if across > 1:
                    wide.append((across, c, own))
        columns = sorted(width)
        for across, c, own in sorted(wide):  # what the columns that a cell spans lack goes to its last one that others use
            inside = columns[bisect_left(columns, c) : bisect_left(columns, c + across)]
            lack = own - sum(width[x] + 2 for x in inside if width[x]) + 2
            if lack > 0:
                last = max(inside)
                width[last] += lack if width[last] else lack - 2
        starts, at = {}, 0
        for c in columns:
            starts[c] = at
            at += width[c] + 2 if width[c] else 0
        chars = sum(len(x) for row in self.rows for _, _, lines in row for x in lines)
        padded = sum(starts[row[-1][0]] * max((len(lines) for _, _, lines in row), default=0) for row in self.rows if row)
        if padded > PAD_TIMES * chars + PAD_FREE:
            starts = dict.fromkeys(starts, 0)
        out = list(self.caption)
        for row in self.rows:
            for k in range(max((len(lines) for _, _, lines in row), default=0)):
                parts, length = [], 0
                for c, _, lines in row:
                    if k < len(lines) and lines[k]:
                        gap = starts[c] - length
                        pad = " " * (gap if gap > 0 else 2 if length else 0)
                        parts.append(pad + lines[k])
                        length += len(pad) + len(lines[k])
                if parts:
                    out.append("".join(parts))
        return out


@dataclass
class Open:
    tag: str
    shown: bool
    flow: Flow | None = None
    grid: Grid | None = None
    span: tuple[int, int] = (1, 1)
    counter: int = 0
    closed_details: bool = False
    saved_marker: str = ""
    within: str = ""  # svg, svg text or math, if its content isn't plain HTML


def _number(text: str | None, least: int, most: int) -> int:
    return min(most, max(least, int(text))) if text and text.strip().isascii() and text.strip().isdigit() and len(text.strip()) < 9 else 1


class Renderer:
    def __init__(self):
        self.flow = Flow()
        self.stack: list[Open] = [Open("#document", True)]
        self.open: Counter = Counter()  # open elements by tag, so that a search for none ends at once
        self.items = 0  # open list items that are shown

    # -- tree building
    def foreign(self, tag: str) -> bool:
        """Whether a tag that starts here is one of svg or math, where one may close itself."""
        return tag in ("svg", "math") or self.stack[-1].within != ""

    def start(self, tag: str, attrs: dict[str, str], closed: bool = False) -> None:
        if self.stack[-1].tag == "head" and tag not in HEAD:
            self._close_to(len(self.stack) - 1)
        for over in ENDS_BEFORE.get(tag, ()):
            self._imply_end(over)
        if tag in ("td", "th") and self._inner("tr", _TABLE_WALL) is None:
            if self._inner("table", frozenset()) is None:
                tag = "div"
            else:
                self.start("tr", {})
        elif tag == "tr" and self._inner("table", frozenset()) is None:
            tag = "div"
        top = self.stack[-1]
        style = attrs.get("style", "")
        shown = top.shown and tag not in NEVER and "hidden" not in attrs and not (style and _HIDDEN.search(style)) and not (tag == "dialog" and "open" not in attrs) and not (tag == "object" and "data" in attrs) and not (top.closed_details and tag != "summary")
        within = tag if tag in ("svg", "math") else top.within
        if top.within == "svg":
            within = "svg text" if tag == "text" else "" if tag == "foreignobject" else within
        if top.within:
            shown = shown and tag not in (MATH_NEVER if top.within == "math" else SVG_NEVER) and attrs.get("display") != "none" and attrs.get("visibility") not in ("hidden", "collapse")
        if closed and self.foreign(tag):
            return
        if tag in VOID:
            if shown:
                self._void(tag, attrs)
            return
        e = Open(tag, shown, within=within)
        self.stack.append(e)
        self.open[tag] += 1
        if shown:
            self._enter(e, attrs)

    def _inner(self, tag: str, walls: frozenset) -> int | None:
        if not self.open[tag]:
            return None
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                return k
            if self.stack[k].tag in walls:
                return None
        return None

    def _imply_end(self, tag: str) -> None:
        k = self._inner(tag, WALLS.get(tag, _TABLE_WALL))
        if k is not None:
            self._close_to(k)

    def end(self, tag: str) -> None:
        if tag in VOID and tag != "br":
            return
        if tag == "br":
            self.start("br", {})
            return
        if tag == "p" and self._inner("p", WALLS["p"]) is None:
            self.start("p", {})
        if tag in ("html", "body"):
            return
        if tag in HEADINGS:  # any heading's end ends the open heading
            if not any(self.open[h] for h in HEADINGS):
                return
            tag = next(e.tag for e in reversed(self.stack) if e.tag in HEADINGS)
        k = self._inner(tag, END_WALLS - {tag} if tag not in ("table", "tr", "thead", "tbody", "tfoot") else (_TABLE_WALL if tag != "table" else frozenset()))
        if k is not None:
            self._close_to(k)

    def _close_to(self, k: int) -> None:
        while len(self.stack) > k:
            e = self.stack.pop()
            self.open[e.tag] -= 1
            if e.shown:
                self._leave(e)

    def data(self, text: str) -> None:
        top = self.stack[-1]
        if not top.shown or top.closed_details or top.within == "svg":
            if top.tag != "head" or not text.strip(" \t\n\f\r"):
                return
            self._close_to(len(self.stack) - 1)
            return self.data(text)
        if top.tag in ("table", "tr", "thead", "tbody", "tfoot", "colgroup") and not text.strip(" \t\n\f\r"):
            return
        self.flow.text(text)

    def kept(self, text: str) -> None:
        """Text whose spaces are kept, in the open element."""
        top, flow = self.stack[-1], self.flow
        if not top.shown or top.closed_details or not text:
            return
        if flow.space and flow.inline:
            flow.inline.append(" ")
        flow.space = False
        flow.pre += 1
        flow.text(text)
        flow.pre -= 1

    # -- layout
    def _void(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "br":
            self.flow.line(True)
        elif tag == "hr":
            self.flow.line()
            self.flow.margin = True
        elif tag == "input" and attrs.get("type", "text").lower() in ("submit", "button", "reset") and attrs.get("value"):
            self.flow.text(attrs["value"])

    def _enter(self, e: Open, attrs: dict[str, str]) -> None:
        tag, flow = e.tag, self.flow
        if tag == "q":
            flow.text("“")
        if tag in APART:
            flow.space = True
        if tag == "optgroup" and attrs.get("label"):
            flow.text(attrs["label"])
            flow.space = True
        if tag not in BLOCKS:
            return
        if tag == "table":
            flow.line()
            e.grid, e.flow = Grid(), flow
            return
        if tag in ("td", "th", "caption"):
            e.flow, self.flow = flow, Flow(pre=0)
            e.span = (_number(attrs.get("colspan"), 1, 1000), _number(attrs.get("rowspan"), 1, 65534))
            return
        if tag in ("tr", "thead", "tbody", "tfoot", "colgroup"):
            grid = self._grid()
            if tag == "tr" and grid is not None:
                grid.row()
            return
        flow.line()
        nested = tag in ("ul", "ol", "menu", "dl") and self.items > 0
        if tag in SPACED and not nested:
            flow.margin = True
        if tag in ("ul", "ol", "menu", "dl"):
            flow.indents.append(flow.marker)
            flow.marker = ""
            e.counter = int(attrs["start"]) if tag == "ol" and re.fullmatch(r"-?\d{1,8}", attrs.get("start", "")) else 1
        elif tag == "li":
            self.items += 1
            owner = next((x for x in reversed(self.stack[:-1]) if x.tag in ("ul", "ol", "menu")), None)
            e.saved_marker = flow.marker
            flow.marker = "- "
            if owner is not None and owner.tag == "ol":
                flow.marker = f"{owner.counter}. "
                owner.counter += 1
        elif tag in ("dd", "blockquote"):
            self.items += tag == "dd"
            e.saved_marker = flow.marker
            flow.indents.append(flow.marker + "  " if not flow.marker.strip() else flow.marker)
            flow.marker = ""
        elif tag == "pre":
            flow.pre += 1
        elif tag == "details":
            e.closed_details = "open" not in attrs

    def _grid(self) -> Grid | None:
        return next((x.grid for x in reversed(self.stack) if x.tag == "table"), None)

    def _leave(self, e: Open) -> None:
        tag = e.tag
        if tag == "q":
            self.flow.text("”")
        if tag in APART:
            self.flow.space = True
        if tag not in BLOCKS:
            return
        if tag == "table":
            stray = self.flow
            if e.grid is not None:
                lines = e.grid.laid_out()
                stray.line()
                if lines:
                    stray.margin = bool(stray.lines) or stray.margin
                    stray.whole(lines)
                    stray.margin = True
            return
        if tag in ("td", "th", "caption"):
            lines = self.flow.done()
            self.flow = e.flow
            grid = self._grid()
            if grid is None:
                self.flow.whole(lines)
            elif tag == "caption":
                grid.caption += lines
            else:
                grid.cell(lines, *e.span)
            return
        flow = self.flow
        flow.line()
        if tag in ("ul", "ol", "menu", "dl"):
            flow.marker = flow.indents.pop()
            if tag != "menu" and not self.items:
                flow.margin = True
        elif tag in ("dd", "blockquote"):
            self.items -= tag == "dd"
            flow.indents.pop()
            flow.marker = e.saved_marker
            flow.margin = flow.margin or tag == "blockquote"
        elif tag == "li":
            self.items -= 1
            flow.marker = e.saved_marker
        else:
            if tag == "pre":
                flow.pre -= 1
            if tag in SPACED:
                flow.margin = True

    def done(self) -> str:
        self._close_to(1)
        lines = self.flow.done()
        while lines and not lines[-1]:
            lines.pop()
        return "\n".join(lines)


def tag_end(html: str, at: int, lacking: set[str]) -> int:
    """Where a tag ends, past its ``>``; quoted values may hold one. A quote that nothing closes is an ordinary letter.

    ``lacking`` remembers the quotes that have no other left in the page, so that they aren't looked for again.
    """
    while (m := _MARK.search(html, at)) is not None:
        if m[0] == ">":
            return m.end()
        at = m.end()
        if m[0] not in lacking and html[m.start() - 1] in "= \t\n":
            close = html.find(m[0], at)
            if close < 0:
                lacking.add(m[0])
            else:
                at = close + 1
    return len(html)


def visible_text(html: str | None) -> str:
    if not html:
        return ""
    r, at, n = Renderer(), 0, len(html)
    closers: dict[str, re.Pattern] = {}
    lacking: set[str] = set()
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            r.data(unescape(html[at:]))
            break
        if m.start() > at:
            r.data(unescape(html[at : m.start()]))
        if m[2] is None:
            if m[0] == "<!--":
                if html.startswith((">", "->"), m.end()):
                    at = html.index(">", m.end()) + 1
                    continue
                end, skip = html.find("-->", m.end()), 3
            else:
                end, skip = html.find(">", m.end()), 1
            at = n if end < 0 else end + skip
            continue
        tag = m[2].lower()
        stop = tag_end(html, m.end(), lacking)
        if m[1]:
            r.end(tag)
            at = stop
            continue
        inside = html[m.end() : stop - 1]
        attrs: dict[str, str] = {}
        if inside and not inside.isspace() and inside != "/":
            for a in _ATTR.finditer(inside):
                attrs.setdefault(a[1].lower(), unescape(a[2] or a[3] or a[4] or ""))
        closed = inside.endswith("/") and not _BARE_SLASH.search(inside) and r.foreign(tag)
        r.start(tag, attrs, closed)
        at = stop
        if tag in RAW and not closed:
            closer = closers.get(tag) or closers.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>]|$)", re.I))
            end = closer.search(html, at)
            if tag in ("textarea", "xmp"):
                inner = html[at : n if end is None else end.start()]
                r.kept(unescape(inner).removeprefix("\n") if tag == "textarea" else inner)
            at = n if end is None else end.start()
            if end is None:
                break
        elif tag == "plaintext":
            r.data(html[at:])
            break
        elif tag == "pre" and html.startswith("\n", at):
            at += 1
    return r.done()


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"page_id": pdf["page_id"], "text": [visible_text(x) for x in pdf["html"]]})


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text) of (page_id, html)."""
    ship(pages.sparkSession)
    return pages.select("page_id", "html").mapInPandas(_extract, "page_id long, text string")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", F.length("text").cast("long").alias("n_chars"), "text")
