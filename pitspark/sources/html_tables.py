"""Tables in HTML documents as rows: header and body cells laid out with their spans."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Widest span of columns that is followed, against documents that ask for millions of cells; rows end with the table.
MOST_SPAN = 1000


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[tuple[str, int, int]]]] = []
        self.open: list[list[list[tuple[str, int, int]]]] = []
        self.cell: list[str] | None = None
        self.span = (1, 1)
        self.outer: list[tuple[list[str] | None, tuple[int, int]]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "table":  # the cell around it goes on after it
            self.outer.append((self.cell, self.span))
            self.cell = None
            self.open.append([])
        elif tag == "tr" and self.open:
            self._end_cell()
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open and self.open[-1]:
            self._end_cell()
            given = {k: v for k, v in attrs}
            count = lambda k: max(1, int(given[k])) if (given.get(k) or "").isdecimal() else 1
            self.cell, self.span = [], (min(MOST_SPAN, count("colspan")), count("rowspan"))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr"):
            self._end_cell()
        elif tag == "table" and self.open:
            self._end_cell()
            self.tables.append(self.open.pop())
            self.cell, self.span = self.outer.pop()

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)

    def _end_cell(self) -> None:
        if self.cell is not None and self.open and self.open[-1]:
            self.open[-1][-1].append((" ".join("".join(self.cell).split()), *self.span))
        self.cell = None


def tables_of(html: str) -> list[list[list[str]]]:
    """The tables of a document as grids of texts; a cell that spans stands in every place it covers."""
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    while parser.open:
        parser.handle_endtag("table")
    out = []
    for rows in parser.tables:
        grid: list[list[str]] = []
        hanging: dict[int, tuple[str, int]] = {}
        for row in rows:
            line: list[str] = []
            cells = iter(row)
            while True:
                if (k := len(line)) in hanging:
                    text, left = hanging.pop(k)
                    line.append(text)
                    if left > 1:
                        hanging[k] = (text, left - 1)
                    continue
                if (cell := next(cells, None)) is None:
                    if hanging and max(hanging) > k:  # a cell of an earlier row hangs on the right of a short row
                        line.append("")
                        continue
                    break
                text, wide, high = cell
                for _ in range(wide):
                    if high > 1:
                        hanging[len(line)] = (text, high - 1)
                    line.append(text)
            grid.append(line)
        out.append(grid)
    return out


def html_rows(documents: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table_no, row_no, cells) for all tables of the documents; null documents give none."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, t, r, cells) for k, text in zip(batch[key], batch[html], strict=True) if text for t, grid in enumerate(tables_of(text)) for r, cells in enumerate(grid)]
            if rows:
                yield pd.DataFrame(rows, columns=[key, "table_no", "row_no", "cells"])

    return documents.select(key, html).mapInPandas(run, f"`{key}` {kind}, table_no int, row_no int, cells array<string>")


def typed_quotes(rows: DataFrame, key: str, names: dict[str, tuple[int, str]], header_rows: int = 1) -> DataFrame:
    """Cells of ``html_rows`` as columns: names maps a column to its place and type; numbers may have thousands commas and a
    dash for none. A key and first column that come twice with other cells fail the run."""
    cells = rows.where((F.size("cells") > max(p for p, _ in names.values())) & (F.col("row_no") >= header_rows))
    text = lambda p: F.nullif(F.trim(F.get("cells", p)), F.lit("-"))
    own = cells.select(key, *[(text(p) if kind == "string" else F.regexp_replace(text(p), ",", "").try_cast(kind)).alias(n) for n, (p, kind) in names.items()]).distinct()
    first = next(iter(names))
    counted = own.groupBy(key, first).agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct(*[n for n in names if n != first])).alias("x")).where(F.col(first).isNotNull())
    held = counted.where(F.assert_true(F.col("__n") == 1, F.lit("a quote comes twice with other cells")).isNull())
    return held.select(key, first, "x.*")
