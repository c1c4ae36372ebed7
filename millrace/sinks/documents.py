"""JSON values as XML, YAML and delimited text, and escapes of text."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsnum import cell_text
from .delimited import quoted

EXPORT_BYTES = 1 << 20


def _number(x: float) -> str:
    return str(int(x)) if isinstance(x, float) and x.is_integer() and abs(x) < 1e21 else json.dumps(x)


def plain_text(value: object) -> str:
    """A scalar as text, a nested value as JSON, null empty."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (dict, list)):
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return _number(value) if isinstance(value, (int, float)) else str(value)


def json_to_csv(text: str) -> str:
    """Objects as rows under the union of their keys, in order of appearance."""
    value = json.loads(text)
    rows = value if isinstance(value, list) else [value]
    objects = [r if isinstance(r, dict) else {"value": r} for r in rows]
    keys = list(dict.fromkeys(k for r in objects for k in r))
    cell = lambda x: '"' + x.replace('"', '""') + '"' if re.search(r'[",\n]', x) else x
    return "\n".join([",".join(keys), *[",".join(cell(plain_text(r.get(k))) for k in keys) for r in objects]])


def _xml_text(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = x.replace(a, b)
    return x


def xml_name(x: str) -> str:
    clean = re.sub(r"[^a-zA-Z0-9_.-]", "_", x)
    return clean if re.match("[A-Za-z_]", clean) else f"node_{clean}"


def json_to_xml(text: str) -> str:
    """A root element; members by name, items of arrays as ``item``; indented by two."""

    def element(name: str, value: object, depth: int) -> list[str]:
        pad = "  " * depth
        if isinstance(value, (dict, list)):
            inner = [(xml_name(k), v) for k, v in value.items()] if isinstance(value, dict) else [("item", v) for v in value]
            if not inner:
                return [f"{pad}<{name}></{name}>"]
            return [f"{pad}<{name}>", *[line for k, v in inner for line in element(k, v, depth + 1)], f"{pad}</{name}>"]
        return [f"{pad}<{name}>{_xml_text(plain_text(value))}</{name}>"]

    return "\n".join(['<?xml version="1.0" encoding="UTF-8"?>', *element("root", json.loads(text), 0)])


def yaml_scalar(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, (bool, int, float)):
        return plain_text(value)
    if value == "" or re.search(r"[:#\[\]{},&*!|>'\"%@`\n]|^[\s?-]|\s$", value) or re.fullmatch(r"(?i)true|false|null|yes|no|on|off|~|[-+]?[0-9.]+(e[-+]?\d+)?", value):
        return json.dumps(value, ensure_ascii=False)
    return value


def json_to_yaml(text: str) -> str:
    """Block style, texts quoted where they need it."""

    def block(value: object, depth: int) -> list[str]:
        pad = "  " * depth
        out = []
        if isinstance(value, dict):
            for k, v in value.items():
                if isinstance(v, (dict, list)) and v:
                    out += [f"{pad}{yaml_scalar(k)}:", *block(v, depth + 1)]
                else:
                    out.append(f"{pad}{yaml_scalar(k)}: {'{}' if v == {} else '[]' if v == [] else yaml_scalar(v)}")
        elif isinstance(value, list):
            for v in value:
                if isinstance(v, (dict, list)) and v:
                    inner = block(v, depth + 1)
                    out += [f"{pad}- {inner[0].lstrip()}", *inner[1:]]
                else:
                    out.append(f"{pad}- {'{}' if v == {} else '[]' if v == [] else yaml_scalar(v)}")
        return out

    value = json.loads(text)
    if isinstance(value, (dict, list)) and value:
        return "\n".join(block(value, 0))
    return "{}" if value == {} else "[]" if value == [] else yaml_scalar(value)


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}


def escape_text(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)[1:-1]


def unescape_text(text: str) -> str:
    """Backslash escapes resolved; an unknown one is its character, one at the end is an error."""
    if re.search(r"(?<!\\)(\\\\)*\\$", text):
        raise ValueError("a backslash at the end")

    def one(m: re.Match) -> str:
        if m[1]:
            return chr(int(m[1], 16))
        if m[2]:
            return chr(int(m[2], 16))
        return _ESCAPES.get(m[3], m[3])

    return re.sub(r"(?s)\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(.))", one, text)


def sorted_keys(text: str) -> str:
    return json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def mapped(f: Callable[[str], str]):
    """A text function as a vectorised column function; null stays null."""

    @F.pandas_udf(T.StringType())
    def over(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else f(x))

    return over


to_xml, to_yaml, to_csv = mapped(json_to_xml), mapped(json_to_yaml), mapped(json_to_csv)
escaped, unescaped, key_sorted = mapped(escape_text), mapped(unescape_text), mapped(sorted_keys)
pretty = mapped(lambda x: json.dumps(json.loads(x), indent=2, ensure_ascii=False))
minified = mapped(lambda x: json.dumps(json.loads(x), ensure_ascii=False, separators=(",", ":")))


def export_json(df: DataFrame, order: str, total: int, rows: int = 100_000) -> str:
    """{headers, rows, metadata} of a grid; refused if it is larger than 1 MiB. ``df`` are the filtered rows."""
    columns = [c for c in df.columns if c != order]
    cells = [list(r) for r in df.orderBy(order).select(*[cell_text(F.col(f"`{c}`"), df.schema[c].dataType) for c in columns]).limit(rows + 1).collect()]
    if len(cells) > rows:
        raise ValueError(f"more than {rows} rows; write them as files instead")
    out = json.dumps({"headers": columns, "rows": cells, "metadata": {"totalRows": total, "filteredRows": len(cells), "columns": len(columns)}}, indent=2, ensure_ascii=False)
    if len(out.encode()) > EXPORT_BYTES:
        raise ValueError("the export would be larger than 1 MiB; write it as files instead")
    return out


def column_text(df: DataFrame, column: str, order: str, rows: int = 100_000) -> str:
    """One column's cells, a line each; refused if there are more than ``rows``."""
    cells = [r[0] for r in df.orderBy(order).limit(rows + 1).select(cell_text(F.col(f"`{column}`"), df.schema[column].dataType)).collect()]
    if len(cells) > rows:
        raise ValueError(f"more than {rows} rows; write them as files instead")
    return "\n".join(cells)


def csv_line(columns: list[Column]) -> Column:
    return F.concat_ws(",", *[quoted(c) for c in columns])
