"""Statistics tables in web pages that have been fetched already: a table (url, html) in, typed rows out.

Pages are rows, so all seasons and all result pages of a season come from one job.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Columns taken from the statistics table, and the query part of its address.
STAT_COLUMNS = ("PLAYER", "GP", "PTS", "FGA", "FTA", "BLK", "STL", "OREB", "AST", "TOV")
SEASON_QUERY = "?Season=%s&SeasonType=Playoffs"

# Fixed values of the HTML standard: row groups, largest spans.
_GROUPS = ("thead", "tbody", "tfoot")
_MOST_COLUMNS, _MOST_ROWS = 1000, 65534


def season_key(year: Column | str) -> Column:
    """'1999-00' for the season that starts in 1999."""
    start = (F.col(year) if isinstance(year, str) else year).cast("int")
    return F.format_string("%d-%02d", start, F.pmod(start + 1, F.lit(100)))


def season_keys(spark: SparkSession, first: int = 1996, last: int = 2022) -> DataFrame:
    """One row per season, by start year."""
    return spark.range(first, last + 1).select(season_key("id").alias("season_key"))


def season_start(key: Column | str) -> Column:
    return F.substring(key, 1, 4).cast("int")


def season_url(base: str, key: Column | str) -> Column:
    """Address of the statistics table of a season, under the given page address."""
    return F.format_string(base.replace("%", "%%") + SEASON_QUERY, key)


def url_param(url: Column | str, name: str) -> Column:
    """Value of a query parameter; null where the address has none or is not an address."""
    return F.try_parse_url(F.col(url) if isinstance(url, str) else url, F.lit("QUERY"), F.lit(name))


class _Tables(HTMLParser):
    """Tables of a page in the order of their start tags, as rows of (tag, text) on a grid of columns.

    Tags may be left open: a cell ends at the next cell, row or table end, a row at the next row or group of rows.
    ``found[0]`` takes the rows outside of any table. An inner table has its rows to itself; its text is part of
    the cell around it as well. Comments, scripts and styles are no text.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.found: list[list[list[tuple[str, str]]]] = [[]]
        self.open = [_Open(self.found[0])]
        self.feed(html)
        self.close()
        for table in self.open:
            table.end_row()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "table":
            self.found.append([])
            self.open.append(_Open(self.found[-1]))
        elif tag == "tr":
            self.open[-1].start_row()
        elif tag in ("td", "th"):
            self.open[-1].start_cell(tag, dict(attrs))
        elif tag in _GROUPS:
            self.open[-1].end_group()
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and len(self.open) > 1:
            self.open.pop().end_row()
        elif tag == "tr":
            self.open[-1].end_row()
        elif tag in ("td", "th"):
            self.open[-1].end_cell()
        elif tag in _GROUPS:
            self.open[-1].end_group()

    def handle_data(self, data: str) -> None:
        if self.cdata_elem not in ("script", "style"):
            for table in self.open:
                if table.cell is not None:
                    table.cell[1].append(data)


class _Open:
    """A table that is being read."""

    def __init__(self, rows: list[list[tuple[str, str]]]):
        self.rows, self.row, self.cell = rows, None, None
        self.down: dict[int, tuple[int | None, tuple[str, str]]] = {}  # column: rows still covered (None: all), cell

    def start_row(self) -> None:
        self.end_row()
        self.row = []

    def start_cell(self, tag: str, attrs: dict[str, str | None]) -> None:
        self.end_cell()
        if self.row is None:
            self.row = []
        self.cell = (tag, [], _span(attrs.get("colspan"), _MOST_COLUMNS) or 1, _span(attrs.get("rowspan"), _MOST_ROWS))

    def end_cell(self) -> None:
        if self.cell is not None:
            tag, parts, wide, high = self.cell
            text = re.sub(r"[ \t\n\x0b\f\r]+", " ", "".join(parts)).replace("\u00a0", " ").strip(" ")
            self._covered()
            for _ in range(wide):
                if high != 1:
                    self.down[len(self.row)] = (high or None, (tag, text))
                self.row.append((tag, text))
        self.cell = None

    def _covered(self) -> None:
        """Cells of rows above that reach down to the next places of this row."""
        while len(self.row) in self.down:
            self.row.append(self.down[len(self.row)][1])

    def end_row(self) -> None:
        self.end_cell()
        if self.row is not None:
            self._covered()
            self.rows.append(self.row)
            self.down = {c: (n and n - 1, cell) for c, (n, cell) in self.down.items() if n != 1}
        self.row = None

    def end_group(self) -> None:
        """No cell reaches from one group of rows into the next."""
        self.end_row()
        self.down = {}


def _span(value: str | None, most: int) -> int:
    """A span as browsers read it: 1 where it is no number; 0 rows mean all that follow."""
    digits = re.match(r"\s*([0-9]+)", value or "")
    return min(int(digits[1][:9]), most) if digits else 1


def table_rows(pages: DataFrame, url: str = "url", html: str = "html", table: int = 1) -> DataFrame:
    """(url, header, row, cells): the data rows of each page's table, in order from 1.

    ``table`` counts the tables of a page from 1, inner ones too, by their start tags; a page that has no table tag
    at all counts as one table. The first table row holds the header cells and is not a data row. Cells that span
    columns or rows are repeated in each of them. A page is read by one task as a whole, pages in Arrow batches.
    """
    @F.pandas_udf("struct<header: array<string>, cells: array<array<string>>>")
    def read(texts: pd.Series) -> pd.DataFrame:
        headers, cells = [], []
        for text in texts:
            found = _Tables(text or "").found
            tables = found[1:] or found
            rows = tables[table - 1] if 0 < table <= len(tables) else []
            headers.append([t for tag, t in rows[0] if tag == "th"] if rows else None)
            cells.append([[t for tag, t in row if tag == "td"] for row in rows[1:]])
        return pd.DataFrame({"header": headers, "cells": cells})

    return (
        pages.select(F.col(url).alias("url"), read(F.col(html)).alias("_found"))
        .select("url", "_found.header", F.posexplode("_found.cells").alias("row", "cells"))
        .select("url", "header", (F.col("row") + 1).alias("row"), "cells")
    )


def pick_columns(rows: DataFrame, names: Sequence[str] = STAT_COLUMNS, keep: Sequence[str] = ("url",)) -> DataFrame:
    """Cells by header name, one column per name in lower case.

    A name that the header lacks is an error; a cell that a short row lacks is null.
    """
    def cell(name: str) -> Column:
        at = F.array_position("header", name).cast("int")
        absent = F.concat(F.lit(f"no column {name} in the table of "), F.col("url"))
        return F.when(at == 0, F.raise_error(absent).cast("string")).otherwise(F.get("cells", at - 1))

    return rows.select(*keep, *[cell(n).alias(n.lower()) for n in names])


def season_stats(
    pages: DataFrame, names: Sequence[str] = STAT_COLUMNS, text: Sequence[str] = ("PLAYER",), url: str = "url",
    html: str = "html",
) -> DataFrame:
    """(season, statistics...) of all pages; season is the start year in the page address.

    Statistics become double, without commas between digits, and null for text that is not a number.
    """
    picked = pick_columns(table_rows(pages, url, html), names)
    typed = [
        F.col(n.lower()) if n in text else F.regexp_replace(F.col(n.lower()), r"(?<=\d),(?=\d{3})", "").try_cast("double").alias(n.lower()) for n in names
    ]
    return picked.select(season_start(url_param("url", "Season")).alias("season"), *typed)
