"""Workbooks and charts of office documents, read from their XML."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .delimited import unique_names
from .files import binaries, parsed

#: Built-in number formats that show dates.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


def _tag(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _texts(e) -> str:
    return "".join(t.text or "" for t in e.iter() if _tag(t) == "t")


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _number(text: str) -> str:
    value = float(text)
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def sheets(data: bytes) -> Iterator[tuple]:
    """(sheet, number, row, cells) of a workbook, rows padded to the widest."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    read = lambda name: ElementTree.fromstring(z.read(name)) if name in names else None
    shared = [_texts(e) for e in read("xl/sharedStrings.xml") or []] if "xl/sharedStrings.xml" in names else []
    dates, styles = [], read("xl/styles.xml")
    if styles is not None:
        own = {int(e.get("numFmtId")): e.get("formatCode", "") for e in styles.iter() if _tag(e) == "numFmt"}
        for group in styles:
            if _tag(group) == "cellXfs":
                for x in group:
                    k = int(x.get("numFmtId", 0))
                    code = re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(k, ""))
                    dates.append(k in DATE_FORMATS or bool(re.search("[dmyhs]", code, re.I)) and k in own)
    relations = {e.get("Id"): e.get("Target") for e in read("xl/_rels/workbook.xml.rels")}
    book = read("xl/workbook.xml")
    for number, sheet in enumerate(e for e in book.iter() if _tag(e) == "sheet"):
        target = relations[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
        root = read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")
        rows: list[list[str]] = []
        for row in (e for e in root.iter() if _tag(e) == "row"):
            at = int(row.get("r", len(rows) + 1)) - 1
            while len(rows) <= at:
                rows.append([])
            for i, c in enumerate(x for x in row if _tag(x) == "c"):
                col = _column(c.get("r")) if c.get("r") else i
                kind, value = c.get("t", "n"), next((v.text or "" for v in c if _tag(v) == "v"), None)
                if kind == "inlineStr":
                    text = _texts(c)
                elif value is None:
                    text = ""
                elif kind == "s":
                    text = shared[int(value)]
                elif kind == "b":
                    text = "TRUE" if value == "1" else "FALSE"
                elif kind in ("str", "e"):
                    text = value
                elif dates and dates[int(c.get("s", 0))]:
                    text = (datetime(1899, 12, 30) + timedelta(days=float(value))).isoformat(timespec="milliseconds") + "Z"
                else:
                    text = _number(value)
                rows[at] += [""] * (col + 1 - len(rows[at]))
                rows[at][col] = text
        width = max(map(len, rows), default=0)
        for i, r in enumerate(rows):
            yield sheet.get("name"), number, i, r + [""] * (width - len(r))


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, sheet_no, row, cells): row 0 is the header."""
    return parsed(binaries(spark, path), "content", sheets, "sheet string, sheet_no int, row long, cells array<string>")


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """One sheet (the first, unless named) with ``_row_index`` and its header's names."""
    rows = read_workbook(spark, path)
    rows = rows.filter(F.col("sheet") == sheet) if sheet else rows.filter("sheet_no = 0")
    head = rows.filter("row = 0").first()
    names = unique_names(list(head["cells"])) if head else []
    return rows.filter("row > 0").select((F.col("row") - 1).alias("_row_index"), *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


def sheet_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file", "sheet_no", "sheet").agg(F.count_if(F.expr("row > 0")).alias("total_rows"), F.max(F.size("cells")).cast("long").alias("total_columns"))


def table_cells(data: bytes) -> Iterator[tuple]:
    """(slide, table, row, cells) of a presentation's tables."""
    z = zipfile.ZipFile(io.BytesIO(data))
    slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    for number, name in slides:
        root = ElementTree.fromstring(z.read(name))
        for t, table in enumerate(e for e in root.iter() if _tag(e) == "tbl"):
            for r, row in enumerate(e for e in table if _tag(e) == "tr"):
                yield number, t, r, [" ".join(x.text for x in c.iter() if _tag(x) == "t" and x.text) for c in row if _tag(c) == "tc"]


def read_slide_tables(spark: SparkSession, path: str) -> DataFrame:
    return parsed(binaries(spark, path), "content", table_cells, "slide int, table int, row int, cells array<string>")


def chart_points(data: bytes) -> Iterator[tuple]:
    """(part, chart, series, name, idx, category, value): missing points are 0, places are kept."""
    z = zipfile.ZipFile(io.BytesIO(data))
    for part in sorted(n for n in z.namelist() if re.fullmatch(r"(ppt|word|xl)/charts/chart\d*\.xml", n)):
        root = ElementTree.fromstring(z.read(part))
        for chart in (e for e in root.iter() if _tag(e) in ("lineChart", "barChart")):
            points = lambda s, name: {int(p.get("idx")): "".join(v.text or "" for v in p if _tag(v) == "v") for e in s if _tag(e) == name for p in e.iter() if _tag(p) == "pt"}
            series = [s for s in chart if _tag(s) == "ser"]
            categories = next((c for c in (points(s, "cat") for s in series) if c), {})
            for i, s in enumerate(series):
                values = points(s, "val")
                name = next(iter(points(s, "tx").values()), f"Series {i + 1}")
                for k in range(max([*categories, *values], default=-1) + 1):
                    yield part, _tag(chart), i, name, k, categories.get(k), float(values.get(k) or 0)


def read_charts(spark: SparkSession, path: str) -> DataFrame:
    return parsed(binaries(spark, path), "content", chart_points, "part string, chart string, series int, name string, idx int, category string, value double")
