"""Leaf blocks of the content node of web pages, by a parser that keeps a stack of open elements, so that nesting of any depth is read as it stands."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements that are blocks and those that are bold; the class of the node that holds a page's text; the part of a header that is bold.
BLOCKS = ["p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "blockquote"]
BOLD, CONTENT, HEADER_PART = ["strong", "b"], "field-content", 0.5
#: Elements without an end, elements whose text is none, and those that the start of another one ends.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
MUTE = {"script", "style", "template"}
ENDED_BY = {"p": {*BLOCKS, "ul", "ol", "table"}, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
#: Elements beyond which no start tag ends another.
FENCE = {"ul", "ol", "table", "div", "blockquote"}


def squeezed(pieces: list[str]) -> str:
    return re.sub(r"\s+", " ", " ".join(pieces).replace("\xa0", " ")).strip()


class _Open:
    """An open element: where its texts, bold texts and blocks begin, and whether a block has begun in it."""

    def __init__(self, tag: str, content: bool, text: int, bold: int, blocks: int, heavy: int):
        self.tag, self.content, self.text, self.bold, self.blocks, self.heavy, self.parted = tag, content, text, bold, blocks, heavy, False


class _Blocks(HTMLParser):
    def __init__(self, name: str):
        super().__init__(convert_charrefs=True)
        self.name, self.stack, self.texts, self.bolds, self.found = name, [], [], [], []
        self.mute = self.heavy = 0
        self.best: tuple[int, list[tuple[str, bool]]] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if tag in ENDED_BY.get(self.stack[i].tag, ()):
                self._close(i)
                break
            if self.stack[i].tag in FENCE:
                break
        content = tag == "div" and self.name in (dict(attrs).get("class") or "").split()
        if tag in BLOCKS:
            for e in reversed(self.stack):
                if e.parted:
                    break  # those around it are parted, too
                e.parted = True
        self.stack.append(_Open(tag, content, len(self.texts), len(self.bolds), len(self.found), self.heavy))
        self.mute += tag in MUTE
        self.heavy += tag in BOLD

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # in HTML a slash ends no element but void ones

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                self._close(i)
                return

    def handle_data(self, data: str) -> None:
        if not self.mute:
            self.texts.append(data)
            if self.heavy:
                self.bolds.append((self.heavy, data))

    def _close(self, to: int) -> None:
        while len(self.stack) > to:
            e = self.stack.pop()
            self.mute -= e.tag in MUTE
            self.heavy -= e.tag in BOLD
            if e.tag in BLOCKS and not e.parted and (text := squeezed(self.texts[e.text :])):
                bold = squeezed([t for heavy, t in self.bolds[e.bold :] if heavy > e.heavy])  # bold within the block, not around it
                self.found.append((text, bool(bold) and len(bold) >= HEADER_PART * len(text)))
            if e.content:
                size = len(squeezed([t.strip() for t in self.texts[e.text :] if t.strip()]))
                inside = self.found[e.blocks :] if e.parted else []
                if self.best is None or size >= self.best[0]:  # of nodes as large the outer one, which ends later
                    self.best = size, inside

    def result(self, whole: bool) -> list[tuple[str, bool]]:
        self.close()
        self._close(0)
        return self.best[1] if self.best else self.found if whole else []


def blocks_of(html: str, name: str = CONTENT, whole: bool = False) -> list[tuple[str, bool]]:
    """(text, header) of the leaf blocks of the largest node of that class; with `whole`, of the page where it has no such node."""
    parser = _Blocks(name)
    parser.feed(html)
    return parser.result(whole)


def content_blocks(pages: DataFrame, key: str, html: str, name: str = CONTENT, whole: bool = False) -> DataFrame:
    """(key, ord, text, header): the blocks of each page's content node, in order; a block is a header if half of its text is bold. A null page has none.

    Pages are parsed where they are, one at a time; nothing is shuffled.
    """
    rows = pages.select(key, html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, page in enumerate(batch.column(1)):
                found = blocks_of(page.as_py(), name, whole) if page.is_valid else []
                if found:
                    texts, heads = zip(*found, strict=True)
                    keys = batch.column(0).take(pa.array([i] * len(found)))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(range(len(found)), pa.int32()), pa.array(texts), pa.array(heads)], [key, "ord", "text", "header"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, ord int, text string, header boolean")
