"""The packet filter: ``field op value`` as a Column, free text otherwise."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import matches

REQUIRED = ("protocol", "source", "destination", "info")
_FILTER = re.compile(r"^\s*([A-Za-z_][\w.]*)\s*(==|!=|~=|=|contains\b)\s*(.+?)\s*$", re.I)


@dataclass(frozen=True)
class PacketFilter:
    field: str
    operator: str
    value: str


def parse(query: str) -> PacketFilter | None:
    """None where the query isn't of the form ``field op value``."""
    found = _FILTER.match(query)
    if not found:
        return None
    value = found[3].strip()
    if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
        value = value[1:-1]
    return PacketFilter(found[1].lower(), found[2].lower(), value.lower())


def host_of(column: Column, compat: bool = False) -> Column:
    """The part of an endpoint before its port.

    Of an address without a port that ends in digits (IPv6, MAC) all is host;
    ``compat`` splits at the last colon whatever comes before.
    """
    return F.when(_has_port(column, compat), F.regexp_extract(column, r"^(.+):(\d+)$", 1)).otherwise(column)


def port_of(column: Column, compat: bool = False) -> Column:
    return F.when(_has_port(column, compat), F.regexp_extract(column, r"^(.+):(\d+)$", 2))


def _has_port(column: Column, compat: bool) -> Column:
    if compat:
        return column.rlike(r"^.+:\d+$")
    # one colon, or more than an address of its kind has
    return column.rlike(r"^[^:]+:\d+$|^(?:[0-9a-fA-F]{1,4}:){8}\d+$|^(?:[0-9a-fA-F]{2}:){6}\d+$|^\[.+\]:\d+$")


def _candidates(field: str, columns: dict[str, str], compat: bool) -> list[Column]:
    source, destination = F.col(columns["source"]), F.col(columns["destination"])
    host = lambda c: host_of(c, compat)
    port = lambda c: port_of(c, compat)
    known = {
        ("protocol", "proto"): [F.col(columns["protocol"])],
        ("ip", "ip.addr"): [host(source), host(destination)],
        ("src", "src.ip", "ip.src"): [host(source)],
        ("dst", "dst.ip", "ip.dst"): [host(destination)],
        ("port", "tcp.port", "udp.port"): [port(source), port(destination)],
        ("src.port", "tcp.srcport", "udp.srcport"): [port(source)],
        ("dst.port", "tcp.dstport", "udp.dstport"): [port(destination)],
        ("dns.qry.name", "http.host", "info"): [F.col(columns["info"])],
    }
    for names, found in known.items():
        if field in names:
            return found
    other = columns.get(field.replace(".", " ", 1)) or columns.get(field)
    return [F.col(other)] if other else []


def condition(df: DataFrame, query: str, *, exact: bool = False, compat: bool = False) -> Column:
    """The filter as a Column. ``==`` finds substrings like ``contains``, unless ``exact``;
    ``!=`` is its negation; a row without any value of the field never passes."""
    names = {c.lower(): c for c in df.columns}
    found = parse(query) if all(r in names for r in REQUIRED) else None
    if found is None:
        return matches(df, query.strip())
    # ports belong to a transport protocol only if the field says so
    values = [F.lower(c.cast("string")) for c in _candidates(found.field, names, compat)]
    if not values:
        return F.lit(False)
    present = reduce(lambda a, b: a | b, [F.coalesce(v != "", F.lit(False)) for v in values])
    equal = (lambda v: v == found.value) if exact and found.operator in ("==", "=", "!=") else (lambda v: F.contains(v, F.lit(found.value)))
    hit = reduce(lambda a, b: a | b, [F.coalesce(equal(v), F.lit(False)) for v in values])
    return present & (~hit if found.operator == "!=" else hit)


def filter_packets(df: DataFrame, query: str, *, exact: bool = False, compat: bool = False) -> DataFrame:
    return df.filter(condition(df, query, exact=exact, compat=compat))
