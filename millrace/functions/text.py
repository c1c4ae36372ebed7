"""Scalar functions on text, all built from Spark's own functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The five XML entities; decoding takes the ampersand last.
XML_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))

#: Media types by file extension.
MIME_TYPES = {
    "aac": "audio/aac", "flac": "audio/flac", "m4a": "audio/mp4", "mp3": "audio/mpeg", "ogg": "audio/ogg", "wav": "audio/wav",
    "avi": "video/x-msvideo", "mkv": "video/x-matroska", "mov": "video/quicktime", "mp4": "video/mp4", "webm": "video/webm",
    "bmp": "image/bmp", "gif": "image/gif", "jpeg": "image/jpeg", "jpg": "image/jpeg", "png": "image/png", "svg": "image/svg+xml", "webp": "image/webp",
}


def replace_each(col: Column, pairs) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, col)


def escape_xml(col: Column) -> Column:
    return replace_each(col, XML_ENTITIES)


def decode_xml(col: Column) -> Column:
    return replace_each(col, [(b, a) for a, b in reversed(XML_ENTITIES)])


def html_safe_json(col: Column) -> Column:
    """JSON text that may stand in a script element."""
    return replace_each(col, [("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")])


def xml_tag(col: Column) -> Column:
    """A text as an element name."""
    clean = F.regexp_replace(col, r"[^a-zA-Z0-9_.-]", "_")
    return F.when(clean.rlike(r"^[A-Za-z_]"), clean).otherwise(F.concat(F.lit("node_"), clean))


def to_base64(col: Column) -> Column:
    """UTF-8 text in base64 on one line."""
    return F.regexp_replace(F.base64(F.encode(col, "utf-8")), r"[\r\n]", "")


def from_base64(col: Column) -> Column:
    return F.decode(F.try_to_binary(F.trim(col), F.lit("base64")), "utf-8")


def hex_id(col: Column) -> Column:
    """A number as 0x and upper-case hexadecimal digits."""
    return F.concat(F.lit("0x"), F.hex(col))


def safe_file_name(col: Column) -> Column:
    return F.regexp_replace(col, r'[<>:"/\\|?*\x00-\x1F]', "_")


def mime_type(name: Column, default: str = "application/octet-stream") -> Column:
    known = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))), F.lit(default))


def archive_time(col: Column) -> Column:
    return F.try_to_timestamp(F.trim(col), F.lit("yyyy-MM-dd HH:mm:ss"))


def number_or_null(col: Column) -> Column:
    return F.trim(col).try_cast("long")


def size_label(col: Column, units: tuple[str, ...] = ("B", "KB", "MB", "GB", "TB")) -> Column:
    """Bytes with one decimal at most and the largest unit that leaves one or more."""
    from .jsnum import number_text

    out = F.concat(number_text(F.round(col / float(1024 ** (len(units) - 1)), 1)), F.lit(units[-1]))
    for k in range(len(units) - 2, -1, -1):
        out = F.when(col < 1024 ** (k + 1), F.concat(number_text(F.round(col / float(1024**k), 1)), F.lit(units[k]))).otherwise(out)
    return out


def hex_rows(content: Column, width: int = 16) -> Column:
    """array<struct(offset, hex, ascii)> of a binary's rows."""
    n = F.octet_length(content)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(width))).otherwise(F.array().cast("array<int>"))

    def row(at: Column) -> Column:
        part = F.substring(content, at + 1, F.lit(width))
        pairs = F.regexp_replace(F.lower(F.hex(part)), "(..)(?!$)", "$1 ")
        shown = F.regexp_replace(F.decode(part, "ISO-8859-1"), r"[^\x20-\x7E]", ".")
        return F.struct(F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(at)), 4, "0")).alias("offset"), pairs.alias("hex"), shown.alias("ascii"))

    return F.transform(starts, row)


def mac(content: Column) -> Column:
    return F.regexp_replace(F.lower(F.hex(content)), "(..)(?!$)", "$1:")


def ipv4(content: Column) -> Column:
    return F.concat_ws(".", *[F.conv(F.hex(F.substring(content, i + 1, 1)), 16, 10) for i in range(4)])


def ipv6(content: Column) -> Column:
    """Eight groups, none left out."""
    return F.concat_ws(":", *[F.lower(F.conv(F.hex(F.substring(content, 2 * i + 1, 2)), 16, 16)) for i in range(8)])


def looks_lon_lat(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    return min_x.between(-180, 180) & max_x.between(-180, 180) & min_y.between(-90, 90) & max_y.between(-90, 90)


def hz_to_mel(col: Column) -> Column:
    return 2595 * F.log10(1 + col / 700)


def mel_to_hz(col: Column) -> Column:
    return 700 * (F.pow(F.lit(10.0), col / 2595) - 1)


def can_physical(raw: Column, factor: Column, offset: Column) -> Column:
    return raw * factor + offset
