"""Rows as delimited text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsnum import cell_text


def quoted(cell: Column, delimiter: str = ",") -> Column:
    """A cell in quotes if it has the delimiter, a quote or a line end."""
    needs = F.contains(cell, F.lit(delimiter)) | F.contains(cell, F.lit('"')) | F.contains(cell, F.lit("\n"))
    return F.when(needs, F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


def delimited_line(df: DataFrame, columns: list[str] | None = None, delimiter: str = ",") -> Column:
    return F.concat_ws(delimiter, *[quoted(cell_text(F.col(f"`{c}`"), df.schema[c].dataType), delimiter) for c in columns or df.columns])


def plain_line(df: DataFrame, columns: list[str] | None = None, delimiter: str = "\t") -> Column:
    """Cells as they are, for a clipboard."""
    return F.concat_ws(delimiter, *[cell_text(F.col(f"`{c}`"), df.schema[c].dataType) for c in columns or df.columns])


def header_line(columns: list[str], delimiter: str = ",") -> str:
    def cell(c: str) -> str:
        return '"' + c.replace('"', '""') + '"' if any(x in c for x in (delimiter, '"', "\n")) else c

    return delimiter.join(map(cell, columns))


def write_delimited(df: DataFrame, path: str, order: str | None = None, delimiter: str = ",") -> None:
    """Part files under ``path``, each with the header. ``order`` sorts them all by ranges."""
    columns = [c for c in df.columns if c != order]
    ordered = df.orderBy(order) if order else df
    ordered.select(F.concat_ws("\x00", delimited_line(df, columns, delimiter)).alias("value")).write.text(path)


def to_delimited_text(df: DataFrame, order: str, delimiter: str = ",", rows: int = 100_000) -> str:
    """A small grid as one text, for a page or an export; refused if it has more than ``rows``."""
    columns = [c for c in df.columns if c != order]
    lines = [r[0] for r in df.orderBy(order).limit(rows + 1).select(delimited_line(df, columns, delimiter)).collect()]
    if len(lines) > rows:
        raise ValueError(f"more than {rows} rows; write them as files instead")
    return "\n".join([header_line(columns, delimiter), *lines])
