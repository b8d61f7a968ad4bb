"""Tables of filed pages as cells on a grid, spans resolved."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

SPAN = 200
#: Where a page is cut, a tag that is all well formed (blanks before its end are nothing), and its attributes.
TAG = re.compile("(<[^<>]*>)")
TOKEN = re.compile(r"""<(/?)([A-Za-z][A-Za-z0-9]*)((?:[ \t\r\n\f]+[A-Za-z][A-Za-z-]*=(?:"[^"<>]*"|'[^'<>]*'))*)[ \t\r\n\f]*(/?)>""")
ATTRIBUTE = re.compile(r"""([A-Za-z-]+)=(?:"([^"]*)"|'([^']*)')""")
CELLS, ENDS = ("td", "th"), ("td", "th", "tr")
#: Elements whose content is no markup.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "plaintext", "noscript"}
CELL = ["tab", "row", "col", "width", "height", "head", "style", "ref", "name", "text"]
SPACE = re.compile("[\\s\xa0\u200b\u200c\ufeff]+")


def _told(name: str, attrs: list[tuple[str, str | None]]) -> tuple[str, str, int, int, str, str]:
    """What an opening tag says: its name, id, width, height, class and the element that it refers to."""
    if not attrs:
        return name, "", 1, 1, "", ""
    given = dict(attrs)
    width, height = (min(SPAN, max(1, int(given[k]))) if str(given.get(k, "")).strip().isdecimal() else 1 for k in ("colspan", "rowspan"))
    found = re.search(r"defref_([\w-]+)", given.get("onclick") or "")
    return name, given.get("id") or "", width, height, given.get("class") or "", found[1] if found else ""


@lru_cache(1 << 14)
def _cut(tag: str) -> tuple | None:
    """(whether it opens, whether it closes, what it says) of a well-formed tag of no raw element, else None. Pages repeat few tags."""
    found = TOKEN.fullmatch(tag)
    if not found or found[2].lower() in RAW or found[1] and (found[3] or found[4]):
        return None
    slash, name, given, alone = found.groups()
    return not slash, bool(slash or alone), _told(name.lower(), [(k.lower(), unescape(a or b)) for k, a, b in ATTRIBUTE.findall(given)])


class _Tables(HTMLParser):
    """Collects (table, row, column, width, height, whether a header cell, its class, the element it refers to, its table's name, text) of each cell; a nested table counts by itself."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cells, self.count, self.open, self.hidden = [], 0, [], 0

    def read(self, page: str):
        """Feeds a whole page. Tags are cut by one pattern where all of them are well formed, else by the parser, with the same handlers."""
        parts = TAG.split(page)
        tags = list(map(_cut, parts[1::2]))
        if len(tags) != page.count("<") or None in tags:
            self.feed(page)
            self.close()
        else:
            whole = False
            for text, (opens, closes, told), inner, behind in zip(parts[::2], tags, parts[2::2], [*tags[1:], (True, False, None)]):
                if whole:  # the end of a cell that is made already
                    whole = False
                    continue
                if text and self.open:
                    self.handle_data(unescape(text) if "&" in text else text)
                if opens and not closes and told[0] in CELLS and self.open and not behind[0] and behind[2][0] in ENDS:
                    self._place(self.open[-1], told)
                    self._shut(self.open[-1], unescape(inner) if "&" in inner else inner)
                    whole = True
                    continue
                if opens:
                    self._start(told)
                if closes:
                    self.handle_endtag(told[0])
            if self.open:
                self.handle_data(unescape(parts[-1]))
        while self.open:
            self._shut(self.open.pop())

    def handle_starttag(self, tag, attrs):
        self._start(_told(tag, attrs))

    def _start(self, told):
        tag, name, width, height, style, ref = told
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "table":
            self.open.append({"id": self.count, "name": name, "row": -1, "col": 0, "taken": {}, "cell": None})
            self.count += 1
        elif self.open and tag == "tr":
            t = self.open[-1]
            self._shut(t)
            t["row"], t["col"] = t["row"] + 1, 0
            if t["taken"]:
                t["taken"] = {k: n - 1 for k, n in t["taken"].items() if n > 1}
        elif self.open and tag in CELLS:
            self._place(self.open[-1], told)
        elif self.open and self.open[-1]["cell"]:
            cell = self.open[-1]["cell"]
            cell[-1].append(" ")
            if ref and not cell[7]:
                cell[7] = ref

    def _place(self, t, told):
        """Begins a cell of a table where the spans of the others leave room."""
        if t["cell"]:
            self._shut(t)
        tag, _, width, height, style, _ = told
        if t["row"] < 0:
            t["row"] = 0
        col, taken = t["col"], t["taken"]
        while taken and any(taken.get(col + k) for k in range(width)):
            col += 1
        t["cell"] = [t["id"], t["row"], col, width, height, tag == "th", style, "", t["name"], []]
        t["new"] = {col + k: height for k in range(width)} if height > 1 else None  # cells of one row only go to the right
        t["col"] = col + width

    def _shut(self, t, text=None):
        """Ends a table's open cell, if it has one; ``text``: all that is in it, where that is known."""
        cell = t["cell"]
        if cell:
            parts = cell[9]
            text = text if text is not None else parts[0] if len(parts) == 1 else "".join(parts)
            if text and not text.isalnum():
                text = " ".join(text.split()) if text.isascii() else SPACE.sub(" ", text).strip()
            cell[9] = text
            self.cells.append(tuple(cell))
            if t["new"]:
                t["taken"] |= t["new"]
            t["cell"] = None

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif self.open and tag in ENDS:
            self._shut(self.open[-1])
        elif self.open and tag == "table":
            self._shut(self.open.pop())

    def handle_data(self, data):
        if self.open and self.open[-1]["cell"] and not self.hidden:
            self.open[-1]["cell"][-1].append(data)


def parsed(page: str | None) -> list[tuple]:
    """The cells of a page's tables as tuples (tab and so on, see :func:`table_cells`); those of one table by row and column."""
    parser = _Tables()
    parser.read(page or "")
    return parser.cells


def table_cells(df: DataFrame, key: str, html: str) -> DataFrame:
    """Each cell of each table of ``html``: key, tab, row, col (from 0), width, height, head, style, ref, name, text.

    Columns count spans of cells before it in the row and of cells above that reach down;
    spans are taken up to SPAN. head: a header cell; style: its class; ref: the element that
    a definition link in it refers to; name: the id of its table. Text has no tags, single spaces. Null, empty and broken
    pages give the cells that can be told. A page is one row.
    """
    kind = df.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32()] * 5 + [pa.bool_()] + [pa.string()] * 4
        for b in batches:
            own, found = [], []
            for k, page in enumerate(b.column(1).to_pylist()):
                cells = parsed(page)
                found += cells
                own += [k] * len(cells)
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own, pa.int64())), *columns], [key, *CELL])

    return df.select(key, html).mapInArrow(read, f"`{key}` {kind}, tab int, row int, col int, width int, height int, head boolean, style string, ref string, name string, text string")
