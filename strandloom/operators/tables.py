"""Tables of pages as grids: cells keep their row and column, also where they span several."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from strandloom.operators import structure

#: Tags that make up a table; tags after which a word ends.
PARTS = r"(?i)<(/?(?:table|caption|tr|td|th))\b([^>]*)>"
BREAKS = rf"(?i)<br\b[^>]*>|</?(?:{structure.TAGS})\b[^>]*>"
# The most columns and rows that a cell may span in HTML.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
SPAN = {name: re.compile(rf"(?i)\b{name}\s*=\s*[\"']?\s*(\d+)") for name in ("colspan", "rowspan")}

TABLE = StructType([StructField("ordinal", IntegerType()), StructField("caption", StringType()), StructField("header", BooleanType()), StructField("rows", ArrayType(ArrayType(StringType())))])


def events(html: Column) -> Column:
    """A page as parts `tag \\x02 attributes \\x03 text`, one for each tag of a table; the first part has no tag."""
    x = F.regexp_replace(F.coalesce(html, F.lit("")), structure.DROPPED, " ")
    for pattern, to in ((PARTS, "\x01$1\x02$2\x03"), (BREAKS, " "), (structure.INLINE, "")):
        x = F.regexp_replace(x, pattern, to)
    for entity, char in structure.ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.split(x, "\x01")


def span(attributes: str, name: str, most: int) -> int:
    found = SPAN[name].search(attributes)
    return min(int(found[1]), most) if found else 1


def laid_out(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Rows of (text, columns, rows) cells as a grid: a cell's text stands in all places that it spans, a span of no rows
    goes on to the last; short rows are filled up."""
    grid: list[dict[int, str]] = [{} for _ in rows]
    for r, cells in enumerate(rows):
        c = 0
        for text, wide, high in cells:
            while c in grid[r]:
                c += 1
            for below in range(r, min(len(rows), r + high) if high else len(rows)):
                for k in range(c, c + max(1, wide)):
                    grid[below].setdefault(k, text)
            c += max(1, wide)
    width = max((max(row, default=-1) + 1 for row in grid), default=0)
    return [[row.get(k, "") for k in range(width)] for row in grid]


def parsed(parts: list[str]) -> list[dict]:
    """The tables of a page in the order in which they begin, with their number in it; those without rows are left out. A table within a cell is one by itself, and its text is not
    part of the cell. Cells, rows and tables that are not closed end where the next begins or the page ends."""
    found: list[dict] = []
    open_: list[dict] = []

    def add(text: str) -> None:
        if open_ and open_[-1]["into"] is not None:
            open_[-1]["into"].append(text)

    for k, part in enumerate(parts):
        tag, _, rest = part.partition("\x02")
        attributes, _, text = rest.partition("\x03")
        tag = tag.lower()
        if tag == "table":
            open_.append({"ordinal": len(found), "caption": [], "rows": [], "heads": [], "into": None})
            found.append(open_[-1])
        elif open_ and k:
            table = open_[-1]
            if tag == "/table":
                open_.pop()
            elif tag == "caption":
                table["into"] = table["caption"]
            elif tag == "tr":
                table["rows"].append([])
                table["heads"].append(True)
                table["into"] = None
            elif tag in ("td", "th"):
                if not table["rows"]:
                    table["rows"].append([])
                    table["heads"].append(True)
                table["into"] = []
                table["rows"][-1].append((table["into"], span(attributes, "colspan", MOST_COLUMNS), span(attributes, "rowspan", MOST_ROWS)))
                table["heads"][-1] &= tag == "th"
            elif tag in ("/td", "/th", "/caption", "/tr"):
                table["into"] = None
        if k:
            add(text)
    plain = lambda pieces: " ".join("".join(pieces).split())
    out = []
    for table in found:
        kept = [k for k, row in enumerate(table["rows"]) if row]
        rows = laid_out([[(plain(c), w, h) for c, w, h in table["rows"][k]] for k in kept])
        if rows:
            out.append({"ordinal": table["ordinal"], "caption": plain(table["caption"]) or None, "header": bool(table["heads"][kept[0]]), "rows": rows})
    return out


@F.pandas_udf(ArrayType(TABLE))
def tables_udf(parts: pd.Series) -> pd.Series:
    return parts.map(lambda x: parsed(list(x)))


def has_table(html: Column) -> Column:
    return F.contains(F.lower(F.coalesce(html, F.lit(""))), F.lit("<table"))


def table_grid(pages: DataFrame) -> DataFrame:
    """(page_id, table_no, row_no, col_no, is_header, cell) of all tables of all pages; narrow, one scan. Only pages with a
    table are handed to Python."""
    found = pages.where(has_table(F.col("html"))).select("page_id", tables_udf(events(F.col("html"))).alias("t"))
    rows = found.select("page_id", F.posexplode("t").alias("table_no", "t")).select("page_id", "table_no", "t.header", F.posexplode("t.rows").alias("row_no", "cells"))
    return rows.select("page_id", "table_no", "row_no", F.posexplode("cells").alias("col_no", "cell"), (F.col("header") & (F.col("row_no") == 0)).alias("is_header")).select("page_id", "table_no", "row_no", "col_no", "is_header", "cell")
