"""Column names out of CREATE TABLE statements."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that open a table constraint, not a column.
CONSTRAINTS = ("CONSTRAINT", "PRIMARY", "UNIQUE", "CHECK", "FOREIGN")
_PIECE = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|\[[^\]]*\]|.", re.S)


def definitions(sql: str) -> list[str]:
    """The comma-separated definitions between a statement's outer brackets."""
    out, now, depth = [], "", 0
    for piece in _PIECE.findall(sql):
        if piece == "(":
            depth += 1
            if depth == 1:
                continue
        elif piece == ")":
            depth -= 1
            if depth == 0:
                break
        elif piece == "," and depth == 1:
            out.append(now.strip())
            now = ""
            continue
        if depth:
            now += piece
    return [x for x in [*out, now.strip()] if x]


def column_names(sql: str | None) -> list[str]:
    """Names in order, without quotes; table constraints are left out."""
    names = []
    for definition in definitions(sql or ""):
        first = _PIECE.match(definition)[0]
        name = first[1:-1].replace(first[0] * 2, first[0]) if len(first) > 1 else re.match(r"\S+", definition)[0]
        if len(first) > 1 or name.upper() not in CONSTRAINTS:
            names.append(name)
    return names


@F.pandas_udf(T.ArrayType(T.StringType()))
def columns_of(sql: pd.Series) -> pd.Series:
    """array<string> of a column of statements."""
    return sql.map(column_names)
