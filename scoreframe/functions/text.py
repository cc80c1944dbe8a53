"""Arrow functions for what has no built-in expression: sequence similarity, spans with offsets, markup parsing."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from scoreframe.functions import scalar as S


@F.pandas_udf(DoubleType())  # a type, not its name: names are parsed by a session, which importing has none of
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; 0 if a side is empty."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(StringType())
def unescape(c: pd.Series) -> pd.Series:
    """All HTML entities decoded."""
    return c.map(html.unescape, na_action="ignore")


def pair_score(a: Column, b: Column) -> Column:
    """The largest of sequence ratio, ratio of the sorted tokens and Jaccard; 1 if equal, 0 if a side is empty."""
    x, y = S.tokens(a), S.tokens(b)
    ordered = lambda t: F.array_join(F.array_sort(t), " ")
    score = F.greatest(seq_ratio(a, b), seq_ratio(ordered(x), ordered(y)), S.jaccard(x, y))
    return F.when((a == "") | (b == "") | a.isNull() | b.isNull(), 0.0).when(a == b, 1.0).otherwise(score)


class _Cells(HTMLParser):
    """Visible text, title, and the cells of tables and lists: (table, row, column, text, links)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.text, self.cells = "", [], []
        self._skip, self._in_title, self._table, self._row, self._cell, self._links = 0, False, -1, -1, None, []
        self._heading, self._in_heading = "", False

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript"):
            self._skip += 1
        elif tag == "title":
            self._in_title = True
        elif re.fullmatch("h[1-6]", tag):
            self._heading, self._in_heading = "", True
        elif tag in ("table", "ul", "ol"):
            self._table, self._row = self._table + 1, -1
        elif tag in ("tr", "li"):
            self._row, self._column = self._row + 1, -1
        if tag in ("td", "th", "li"):
            self._column += 1
            self._cell, self._links = [], []
        elif tag == "a" and self._cell is not None:
            self._links += [v for k, v in attrs if k == "href" and v]

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript"):
            self._skip = max(0, self._skip - 1)
        elif tag == "title":
            self._in_title = False
        elif re.fullmatch("h[1-6]", tag):
            self._in_heading = False
        elif tag in ("td", "th", "li") and self._cell is not None:
            self.cells.append((max(self._table, 0), max(self._row, 0), self._column, " ".join("".join(self._cell).split()), list(self._links), " ".join(self._heading.split())))
            self._cell = None

    def handle_data(self, data):
        if self._in_title:
            self.title += data
        elif not self._skip:
            self.text.append(data)
            if self._in_heading:
                self._heading += data
            if self._cell is not None:
                self._cell.append(data)

    _column = -1


def parse_html(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, title, text, cells) of each page."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for key, page in zip(frame.iloc[:, 0], frame.iloc[:, 1], strict=True):
                p = _Cells()
                p.feed(page or "")
                p.close()
                out.append((key, " ".join(p.title.split()), " ".join(" ".join(p.text).split()), [{"tab": a, "row": b, "col": c, "text": t, "links": ls, "heading": h} for a, b, c, t, ls, h in p.cells]))
            yield pd.DataFrame(out, columns=["id", "title", "text", "cells"])

    return pages.select(id_col, html_col).mapInPandas(run, f"id {kind}, title string, text string, cells array<struct<tab:int,row:int,col:int,text:string,links:array<string>,heading:string>>").withColumnRenamed("id", id_col)
