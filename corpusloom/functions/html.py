"""Text of web pages by parsing, where page furniture is told by element, class and id."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.functions import patterns as P
from corpusloom.shipping import ship

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that the opening of one of these ends, if it is the innermost open one.
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BLANK = re.compile(r"\s+")


class _Page(HTMLParser):
    """Collects text outside junk elements; `body` holds what stands in the body, if there is one."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []  # name, and whether it or one around it is junk
        self.all: list[str] = []
        self.body: list[str] | None = None
        self.in_body = 0

    def _junk(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        named = " ".join(v or "" for k, v in attrs if k in ("class", "id")).lower()
        return tag in P.JUNK_TAGS or any(s in named for s in P.JUNK_SIGNATURES)

    def handle_starttag(self, tag, attrs):
        self._say(" ")
        if tag in _VOID:
            return
        while self.open and self.open[-1][0] in _ENDS.get(tag, ()):
            self._close()
        self.open.append((tag, bool(self.open and self.open[-1][1]) or self._junk(tag, attrs)))
        if tag == "body":
            self.in_body += 1
            self.body = self.body if self.body is not None else []

    def handle_startendtag(self, tag, attrs):
        self._say(" ")

    def _close(self) -> None:
        self.in_body -= self.open.pop()[0] == "body"

    def handle_endtag(self, tag):
        self._say(" ")
        if any(x == tag for x, _ in self.open):
            while self.open[-1][0] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        self._say(data)

    def _say(self, text: str) -> None:
        if self.open and self.open[-1][1]:
            return
        self.all.append(text)
        if self.in_body:
            self.body.append(text)


def page_text(html: str | None) -> str:
    """Text of a page in its body (of all of it without one), blanks joined; comments, junk elements and containers named as junk go with all they hold."""
    page = _Page()
    page.feed(html or "")
    page.close()
    return _BLANK.sub(" ", "".join(page.all if page.body is None else page.body)).strip()


def page_texts(pages: DataFrame, html: str = "html", out: str = "body") -> DataFrame:
    """pages with `out` in the place of `html`: page_text of each row, by Arrow batches; null and broken pages give what text they have."""
    at = pages.columns.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                texts = pa.array([page_text(x) for x in part.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([texts if i == at else part.column(i) for i in range(part.num_columns)], names=[out if i == at else n for i, n in enumerate(part.schema.names)])

    ship(pages.sparkSession)
    fields = ", ".join(f"`{out}` string" if n == html else f"`{n}` {kind}" for n, kind in pages.dtypes)
    return pages.mapInArrow(run, fields)
