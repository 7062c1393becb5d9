"""Visible text of web pages as a browser would lay it out.

A tree builder keeps the open elements: void elements close at once, end tags close what is open
inside them, and start tags imply the ends that HTML leaves out (`<li>` ends `<li>`, any block ends
`<p>`, `<td>` ends `<td>`, and so on). What isn't visible is skipped with all it holds: head,
scripts, styles, templates, `hidden`, `display: none`, closed details but for their summary. The
text of `visibility: hidden` goes too, but its layout and what is made visible again inside stay.

Blocks stand on lines of their own, with an empty line around those that browsers give a margin.
White space collapses but in `<pre>`. List items get a dash or their number (`start`, `value`,
`reversed`), indented by depth. Table cells stand in the columns that `colspan` and `rowspan` give
them, padded to their columns' widths, two spaces apart. A column is padded to PAD characters at most:
after a longer line the row goes on in the next line, still in its columns. A cell that spans rows has
its text in the first; rows without text and columns that no cell begins in are left out.

A null or empty page has an empty text. Text without any tag is one block. Rows with equal ids are
separate rows; an empty table gives no rows. Elements may nest to any depth.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docdelta.llm.common import by_batch, slices, table

PAD = 80
# Fixed names of HTML elements by how they are laid out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript title iframe object audio video canvas svg math datalist select frameset noframes".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset menu".split())
BLOCK = MARGIN | frozenset("html body div section article aside header footer nav main address li dt dd tr caption thead tbody tfoot td th form center details summary dialog figcaption legend hgroup search hr optgroup option".split())
ENDS_P = (BLOCK - frozenset("caption thead tbody tfoot tr td th option optgroup html body".split()))
#: A start tag ends the nearest open element of these, looking no further out than those.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "table", "td", "th"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table", "td", "th"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table", "td", "th"])),
    "tr": (frozenset(["tr", "caption", "colgroup"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "body": (frozenset(["head"]), frozenset()),
}
P = (frozenset(["p"]), frozenset(["td", "th", "table", "button", "caption", "object"]))
#: The most columns and rows that a cell can span, as HTML fixes them.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
_SPACE = re.compile(r"[ \t\n\r\f]+")


def styles(text: str | None) -> dict[str, str]:
    """The declarations of a style attribute in lower case; of equal names the last counts."""
    pairs = (d.partition(":") for d in (text or "").lower().split(";"))
    return {name.strip(): value.replace("!important", "").strip() for name, _, value in pairs}


def number(text: str | None, default: int | None, least: int = -(10**9), most: int = 10**9) -> int | None:
    text = (text or "").strip()
    return min(max(int(text), least), most) if re.fullmatch(r"[+-]?[0-9]{1,9}", text) else default


class Marker:
    """What stands before a list item; its number is known when its list ends."""

    def __init__(self, indent: str):
        self.indent, self.label = indent, "-"

    def __str__(self) -> str:
        return f"{self.indent}{self.label} "


class List:
    def __init__(self, tag: str, a: dict):
        self.numbered, self.step = tag == "ol", -1 if "reversed" in a else 1
        self.start = number(a.get("start"), None)
        self.items: list[tuple[Marker, str | None]] = []

    def end(self) -> None:
        if not self.numbered:
            return
        at = self.start if self.start is not None else len(self.items) if self.step < 0 else 1
        for marker, value in self.items:
            at = number(value, at)
            marker.label = f"{at}."
            at += self.step


class Flow:
    """Text laid out in lines: collapses white space and keeps the largest break asked for between blocks."""

    def __init__(self):
        self.out: list[str] = []
        self.breaks = 0
        self.space = False
        self.lead: Marker | None = None

    def text(self, text: str, plain: bool) -> None:
        if not plain:
            if not text.strip(" \t\n\r\f"):
                self.space = self.space or bool(text)
                return
            self.space = self.space or text[0] in " \t\n\r\f"
            ends = text[-1] in " \t\n\r\f"
            text = _SPACE.sub(" ", text.strip(" \t\n\r\f"))
        elif not text:
            return
        if self.breaks and self.out:
            self.out.append("\n" * self.breaks)
        elif self.space and self.out and not self.lead and not self.out[-1].endswith((" ", "\n")):
            self.out.append(" ")
        self.breaks, self.space = 0, False
        if self.lead:
            self.out.append(self.lead)
            self.lead = None
        self.out.append(text)
        if not plain:
            self.space = ends

    def line(self, n: int) -> None:
        self.breaks = max(self.breaks, n)
        self.space = False

    def newline(self) -> None:
        self.breaks += 1
        self.space = False

    def result(self) -> str:
        return "".join(map(str, self.out)).strip("\n")


class Grid:
    def __init__(self):
        self.groups: list[list[list[tuple[str, int, int]]]] = [[]]  # row groups of rows of (text, columns, rows)
        self.caption = ""

    def row(self) -> None:
        self.groups[-1].append([])

    def group(self) -> None:
        if self.groups[-1]:
            self.groups.append([])

    def cell(self, text: str, columns: int, rows: int) -> None:
        if not self.groups[-1]:
            self.row()
        self.groups[-1][-1].append((text, columns, rows))

    def placed(self) -> list[list[tuple[int, str]]]:
        """The (column, text) of each row's cells. Cells pass by what cells from above reach down into, within their group."""
        out = []
        for group in self.groups:
            above: list[tuple[int, int, int]] = []  # first column, column after the last, row after the last
            for i, row in enumerate(group):
                above = sorted(x for x in above if x[2] > i)
                cells, at, k, new = [], 0, 0, []
                for text, columns, rows in row:
                    while k < len(above) and above[k][0] <= at:
                        at = max(at, above[k][1])
                        k += 1
                    cells.append((at, text))
                    if rows != 1:
                        new.append((at, at + columns, i + rows if rows else len(group)))
                    at += columns
                above += new
                out.append(cells)
        return out

    def result(self) -> str:
        rows = [[(c, t.split("\n")) for c, t in r] for r in self.placed() if any(t.strip() for _, t in r)]
        widths: dict[int, int] = {}
        for r in rows:
            for c, lines in r:
                widths[c] = max(widths.get(c, 0), min(PAD, max(map(len, lines))))
        left, at = {}, 0
        for c in sorted(widths):
            left[c] = at
            at += widths[c] + 2
        out = [self.caption] if self.caption else []
        for r in rows:
            for k in range(max(len(lines) for _, lines in r)):
                pieces, end = [], 0
                for c, lines in r:
                    line = lines[k] if k < len(lines) else ""
                    if not line.strip():
                        continue
                    if end > left[c] - 2 and pieces:  # a longer line than its column: go on below
                        out.append("".join(pieces).rstrip())
                        pieces, end = [], 0
                    pieces += [" " * (left[c] - end), line]
                    end = left[c] + len(line)
                out.append("".join(pieces).rstrip())
        return "\n".join(out)


class Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool]] = []  # name, hides what it holds, text was visible before
        self.at: dict[str, list[int]] = {}  # name -> its places in open, so that no search goes through all of them
        self.visible, self.fresh_pre = True, False
        self.hidden = self.pre = 0
        self.flows = [Flow()]
        self.grids: list[Grid] = []
        self.lists: list[List] = []
        self.outer: list[list[List]] = []  # lists around the cells and captions at hand

    # -- tree

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.fresh_pre = False
        if tag in ENDS_P:
            self._end_open(*P)
        if tag in IMPLIED:
            self._end_open(*IMPLIED[tag])
        if tag in ("td", "th") and self.grids and self._last("tr") <= self._last("table"):
            self.handle_starttag("tr", [])
        if tag in ("td", "th", "tr", "caption", "thead", "tbody", "tfoot") and self._last("table") < 0:
            tag = "div"
        if tag in VOID:
            self._void(tag)
            return
        a = dict(attrs)
        style = styles(a.get("style"))
        hides = tag in UNSEEN or "hidden" in a or style.get("display") == "none" or (tag in ("dialog", "details") and "open" not in a)
        if tag == "summary" and self.open and self.open[-1][:2] == ("details", True) and self.hidden == 1:
            self.hidden -= 1
            self._push("summary shown", False)
            self.flows[-1].line(1)
            return
        self._push(tag, hides)
        seen = style.get("visibility")
        if seen in ("hidden", "collapse", "visible"):
            self.visible = seen == "visible"
        if hides:
            self.hidden += 1
        elif not self.hidden:
            self._begin(tag, a)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes nothing but void elements in HTML

    def handle_endtag(self, tag: str) -> None:
        self.fresh_pre = False
        if tag in VOID:
            if tag == "br":
                self._void(tag)
            return
        if tag == "p" and self._last("p") < 0:
            if not self.hidden:
                self.flows[-1].line(2)
            return
        stops = ("td", "th", "table") if tag not in ("table", "tr", "td", "th", "thead", "tbody", "tfoot", "caption") else ("table",)
        place = self._last(tag, "summary shown") if tag == "summary" else self._last(tag)
        if place >= max(self._last(*stops), 0):
            self._close_to(place)

    def _last(self, *names: str) -> int:
        """The place of the innermost open element of these names, -1 without any."""
        return max(places[-1] if (places := self.at.get(n)) else -1 for n in names)

    def _end_open(self, names: frozenset, stops: frozenset) -> None:
        place = self._last(*names)
        if place >= 0 and (not stops or place > self._last(*stops)):
            self._close_to(place)

    def _push(self, name: str, hides: bool) -> None:
        self.at.setdefault(name, []).append(len(self.open))
        self.open.append((name, hides, self.visible))

    def _close_to(self, place: int) -> None:
        while len(self.open) > place:
            self._close()

    def _close(self) -> None:
        tag, hides, visible = self.open.pop()
        self.at[tag].pop()
        if tag == "summary shown":
            self.hidden += 1
            self.flows[-1].line(1)
        elif hides:
            self.hidden -= 1
        elif not self.hidden:
            self._finish(tag)
        self.visible = visible

    # -- layout

    def _void(self, tag: str) -> None:
        if not self.hidden:
            if tag == "br":
                self.flows[-1].newline()
            elif tag == "hr":
                self.flows[-1].line(2)

    def _begin(self, tag: str, a: dict) -> None:
        flow = self.flows[-1]
        if tag in ("td", "th", "caption"):
            cell = Flow()
            cell.columns, cell.rows = number(a.get("colspan"), 1, 1, MOST_COLUMNS), number(a.get("rowspan"), 1, 0, MOST_ROWS)
            self.flows.append(cell)
            self.outer.append(self.lists)
            self.lists = []
            return
        if tag == "tr":
            self.grids[-1].row()
            return
        if tag in ("thead", "tbody", "tfoot"):
            self.grids[-1].group()
        if tag in BLOCK:
            nested = tag in ("ul", "ol", "menu") and self.lists
            flow.line(2 if tag in MARGIN and not nested else 1)
        if tag == "table":
            self.grids.append(Grid())
        elif tag == "pre":
            self.pre += 1
            self.fresh_pre = True
        elif tag in ("ul", "ol", "menu"):
            self.lists.append(List(tag, a))
        elif tag == "li":
            marker = Marker("  " * (max(len(self.lists), 1) - 1))
            if self.lists:
                self.lists[-1].items.append((marker, a.get("value")))
            flow.lead = marker if self.visible else None

    def _finish(self, tag: str) -> None:
        if tag in ("td", "th", "caption"):
            cell = self.flows.pop()
            self.lists = self.outer.pop()
            if tag == "caption":
                self.grids[-1].caption = cell.result()
            else:
                self.grids[-1].cell(cell.result(), cell.columns, cell.rows)
            return
        if tag in ("thead", "tbody", "tfoot"):
            self.grids[-1].group()
        flow = self.flows[-1]
        if tag == "table":
            text = self.grids.pop().result()
            flow.line(2)
            flow.text(text, True)
        elif tag == "pre":
            self.pre -= 1
        elif tag in ("ul", "ol", "menu"):
            self.lists.pop().end()
            flow.lead = None
        elif tag == "li":
            flow.lead = None
        if tag in BLOCK and tag != "tr":
            nested = tag in ("ul", "ol", "menu") and self.lists
            flow.line(2 if tag in MARGIN and not nested else 1)

    def handle_data(self, data: str) -> None:
        if self.fresh_pre:  # the line end right after <pre> is not part of it
            data = data.removeprefix("\r").removeprefix("\n")
            self.fresh_pre = False
        if self.visible and not self.hidden:
            self.flows[-1].text(data, self.pre > 0)

    def result(self) -> str:
        self.close()
        while self.open:
            self._close()
        return self.flows[0].result()


def page_text(html: str | None) -> str:
    page = Page()
    page.feed(html or "")
    return page.result()


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per row: page_id, text."""
    schema = pa.schema([("page_id", pa.int64()), ("text", pa.string())])
    one = by_batch(lambda b: {"page_id": b.column("page_id"), "text": [page_text(h) for h in b.column("html").to_pylist()]}, schema)

    def run(batches):
        for batch in batches:
            yield from one(slices(batch, "html"))

    return pages.select(pages[id_col].cast("long").alias("page_id"), pages[html_col].cast("string").alias("html")).mapInArrow(run, "page_id bigint, text string")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
