"""Delimited text: lenient cells, delimiter inference, any file size."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import lines

DELIMITERS = (",", ";", "\t", "|")


def split_cells(line: str, delimiter: str, trim: bool = True) -> list[str]:
    """Cells of a line: a quote opens or closes anywhere, two inside are one, quotes are dropped."""
    cells, now, quoted, i = [], [], False, 0
    while i < len(line):
        c = line[i]
        if c == '"':
            if quoted and line[i + 1 : i + 2] == '"':
                now.append('"')
                i += 1
            else:
                quoted = not quoted
        elif c == delimiter and not quoted:
            cells.append("".join(now))
            now = []
        else:
            now.append(c)
        i += 1
    cells.append("".join(now))
    return [c.strip() for c in cells] if trim else cells


def cells(column: Column, delimiter: str, trim: bool = True) -> Column:
    """array<string> of a line. Lines without quotes are split by Spark itself."""
    import re

    @F.pandas_udf("array<string>")
    def lenient(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: None if x is None else split_cells(x, delimiter, trim))

    plain = F.split(column, re.escape(delimiter), -1)
    plain = F.transform(plain, lambda x: F.trim(x)) if trim else plain
    return F.when(F.contains(column, F.lit('"')), lenient(F.when(F.contains(column, F.lit('"')), column))).otherwise(plain)


def unquoted_count(line: str, delimiter: str) -> int:
    return len(split_cells(line, delimiter)) - 1


def infer_delimiter(sample: list[str], name: str = "") -> str:
    """Of the first ten non-blank lines: 100 for each line that has it, and 1 for each time; ties go to the earlier."""
    if name.lower().endswith(".tsv"):
        return "\t"
    found = [x.strip() for x in sample if x.strip()][:10]
    best, score = ",", 0
    for d in DELIMITERS:
        counts = [unquoted_count(x, d) for x in found]
        own = 100 * sum(c > 0 for c in counts) + sum(counts)
        if own > score:
            best, score = d, own
    return best


def unique_names(header: list[str]) -> list[str]:
    """Header names that a DataFrame can have: empty ones numbered, repeats suffixed."""
    out: list[str] = []
    for i, name in enumerate(header):
        base = name or f"Column{i + 1}"
        candidate, k = base, 2
        while candidate.lower() in {o.lower() for o in out}:
            candidate, k = f"{base}_{k}", k + 1
        out.append(candidate)
    return out


def read_grid(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """(_row_index, cells) of one file: rows without the header, ragged as they are, blank lines left out."""
    numbered = lines(spark, path).filter(F.trim("text") != "")
    head = numbered.orderBy("line").limit(10).collect()
    if not head:
        raise ValueError("CSV file is empty")
    delimiter = delimiter or infer_delimiter([r["text"] for r in head], path)
    body = numbered.filter(F.col("line") > head[0]["line"])
    return body.select((F.col("line") - head[0]["line"] - 1).alias("_row_index"), cells(F.col("text"), delimiter).alias("cells"))


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, *, multiline: bool = False) -> DataFrame:
    """One file as a DataFrame of texts with ``_row_index``: the header's names, missing cells empty.

    ``multiline``: quoted line ends stay inside their cells; Spark's own reader does it.
    """
    if multiline:
        first = spark.read.text(path).limit(10).collect()
        own = delimiter or infer_delimiter([r[0] for r in first], path)
        df = spark.read.csv(path, header=True, sep=own, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
        return df.select(F.monotonically_increasing_id().alias("_row_index"), "*")
    head = lines(spark, path).filter(F.trim("text") != "").orderBy("line").limit(10).collect()
    if not head:
        raise ValueError("CSV file is empty")
    own = delimiter or infer_delimiter([r["text"] for r in head], path)
    names = unique_names(split_cells(head[0]["text"], own))
    grid = read_grid(spark, path, own)
    return grid.select("_row_index", *[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])


def read_fixed_width(spark: SparkSession, text: str, delimiter: str) -> DataFrame:
    """An edited raw text: rows padded or cut to the header's width, cells not trimmed."""
    rows = [split_cells(x, delimiter, trim=False) for x in text.split("\n") if x.strip()]
    if not rows:
        raise ValueError("CSV file is empty")
    width = len(rows[0])
    fitted = [(i, *(r + [""] * width)[:width]) for i, r in enumerate(rows[1:])]
    return spark.createDataFrame(fitted, "_row_index long, " + ", ".join(f"`{n}` string" for n in unique_names(rows[0])))
