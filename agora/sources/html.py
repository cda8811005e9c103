"""HTML as a table of nodes: a small parser emits nodes in document order, all else is Spark's work.

A node has its place in preorder and that of its last descendant, so that anything about subtrees
is a difference of running sums within the page.  Texts stand in document order as ``pieces`` at the
node opened last before them, whosever they are; a node's own and those below it are the page's
pieces from its first to ``pieces_end``.  Every node of a page is kept, however many.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.session import spread

#: Fixed values of the HTML standard: elements without content, and those that an opening tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Ancestors that ``ancestors`` names, the nearest of a node's.
NEAREST = 8
#: Nodes and characters of markup of a batch: whole pages until there are so many; and pages that are taken at a time.
BATCH, CHARS, TAKEN = 10_000, 1 << 20, 16

#: An ampersand with the reference that it may begin; and what stands for one that begins none, which no UTF-8 text holds.
_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]{0,31};)?")
_PLAIN = "\ud800"

_TYPES = {"page_id": pa.int64(), "node": pa.int32(), "parent": pa.int32(), "last": pa.int32(), "depth": pa.int32(), "tag": pa.string(), "attrs": pa.map_(pa.string(), pa.string()), "text": pa.string(), "ancestors": pa.string(), "pieces": pa.list_(pa.string()), "pieces_end": pa.int32()}
SCHEMA = "page_id long, node int, parent int, last int, depth int, tag string, attrs map<string,string>, text string, ancestors string, pieces array<string>, pieces_end int"


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []
        self.n_pieces = 0
        self.teller = -1  # whose the last piece is

    def updatepos(self, i: int, j: int) -> int:
        return j  # lines are not counted

    def _close(self, upto: int) -> None:
        for node in self.open[upto:]:
            self.rows[node][2] = len(self.rows) - 1
            self.rows[node][9] = self.n_pieces
        del self.open[upto:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        for k in range(len(self.open) - 1, max(-1, len(self.open) - 6), -1):
            held = self.rows[self.open[k]][4]
            if (held == "p" and tag in ENDS_P) or held in ENDS_SAME.get(tag, ()):
                self._close(k)
                break
            if held in ("ul", "ol", "table", "div", "section", "article"):
                break
        path = "/".join([self.rows[n][4] for n in self.open[-NEAREST:]])
        self.rows.append([len(self.rows), self.open[-1] if self.open else -1, len(self.rows), len(self.open), tag, {k: v or "" for k, v in attrs}, [], path, [], self.n_pieces])
        if tag not in VOID:
            self.open.append(len(self.rows) - 1)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[k]][4] == tag:
                self._close(k)
                return

    def handle_data(self, data: str) -> None:
        if self.open:
            self.rows[self.open[-1]][6].append(data)
            if self.rows[-1][8] and self.teller == self.open[-1]:  # as after an end tag that ends nothing
                self.rows[-1][8][-1] += data
            else:
                self.rows[-1][8].append(data)
                self.n_pieces += 1
            self.teller = self.open[-1]


class _Closed(_Tree):
    """Takes back what stands for ampersands that begin no reference."""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        back = lambda x: x and x.replace(_PLAIN, "&")
        super().handle_starttag(back(tag), [(back(k), back(v)) for k, v in attrs])

    def handle_endtag(self, tag: str) -> None:
        super().handle_endtag(tag.replace(_PLAIN, "&"))

    def handle_data(self, data: str) -> None:
        super().handle_data(data.replace(_PLAIN, "&"))


def parsed(html: str | None, closed: bool = False, only: Collection[str] | None = None) -> list[list]:
    text = html or ""
    if closed:
        read = (lambda x: x[0] == "#" or x in html5) if only is None else (lambda x: x[:-1] in only)
        text = _REFERENCE.sub(lambda m: m[0] if m[1] and read(m[1]) else _PLAIN + (m[1] or ""), text)
    tree = _Closed() if closed and _PLAIN in text else _Tree()
    tree.feed(text)
    tree.close()
    tree._close(0)
    for row in tree.rows:
        row[6] = " ".join(row[6])
    return tree.rows


def batches(given: Iterator[pa.RecordBatch], closed: bool = False, only: Collection[str] | None = None) -> Iterator[pa.RecordBatch]:
    """The nodes of batches of pages (key, html).  A task holds those of a few pages, however many Spark hands it at once."""

    def batch(rows: list[list]) -> pa.RecordBatch:
        columns = [*zip(*rows)]
        columns[6] = [[*attrs.items()] for attrs in columns[6]]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, _TYPES.values())], [*_TYPES])

    rows: list[list] = []
    chars = 0
    for some in given:
        for at in range(0, some.num_rows, TAKEN):
            few = some.slice(at, TAKEN)
            for page, text in zip(few.column(0).to_pylist(), few.column(1).to_pylist()):
                rows += [[page, *row] for row in parsed(text, closed, only)]
                chars += len(text or "")
                if len(rows) >= BATCH or (rows and chars >= CHARS):
                    yield batch(rows)
                    rows, chars = [], 0
    if rows:
        yield batch(rows)


def nodes(pages: DataFrame, key: str = "page_id", html: str = "html", closed: bool = False, only: Collection[str] | None = None) -> DataFrame:
    """(page_id, node, parent, last, depth, tag, attrs, text, ancestors, pieces, pieces_end) of all pages; a null page has no nodes.

    References are read as the HTML standard has it, so that ``&amp`` is an ampersand even where its
    semicolon was cut off; with ``closed`` only those that end in one are, and
    of these, where ``only`` is given, those that it names.
    """

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(given, closed, only)

    return spread(pages.select(F.col(key).cast("long"), html)).mapInArrow(run, SCHEMA)
