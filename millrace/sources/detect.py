"""What a file is, by its first bytes, its content and, last, its name."""

from __future__ import annotations

import io
import json
import re
import zipfile
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .delimited import DELIMITERS, unquoted_count
from .files import binaries, extension

HEAD_BYTES = 64 << 10
TEXT_BYTES = 16 << 10

#: Name of the format, byte signature in hexadecimal, offset. In order of precedence.
SIGNATURES = (
    ("pdf", "255044462D", 0),
    ("psd", "38425053", 0),
    ("image", "89504E470D0A1A0A", 0),
    ("image", "FFD8FF", 0),
    ("image", "474946383761", 0),
    ("image", "474946383961", 0),
)
CONTAINERS = (
    ("hdf5", "894844460D0A1A0A", 0), ("blf", "4C4F4747", 0), ("mf4", "4D44462020202020", 0), ("avro", "4F626A01", 0), ("bag", "23524F534241472056322E", 0), ("sqlite", "53514C69746520666F726D6174203300", 0),
    ("pcap", "D4C3B2A1", 0), ("pcap", "A1B2C3D4", 0), ("pcap", "4D3CB2A1", 0), ("pcap", "A1B23C4D", 0), ("pcapng", "0A0D0D0A", 0),
)
ARCHIVES = (("archive", "1F8B", 0), ("archive", "425A68", 0), ("archive", "FD377A585A00", 0), ("archive", "377ABCAF271C", 0), ("archive", "526172211A0700", 0), ("archive", "526172211A070100", 0), ("archive", "7573746172", 257))
OFFICE = {".doc": "word", ".docx": "word", ".xls": "excel", ".xlsx": "excel", ".ppt": "ppt", ".pptx": "ppt", ".hwp": "hwp", ".hwpx": "hwp"}
RAW_AUDIO = (".pcm", ".raw")
ARCHIVE_NAMES = (".zip", ".rar", ".7z", ".dmg", ".jar", ".apk", ".tar", ".tgz", ".tbz2", ".txz", ".gz", ".bz2", ".xz")
TEXT_EXTENSIONS = {
    "markdown": (".md", ".markdown"), "jsonl": (".jsonl", ".ndjson", ".jsonlines"), "json": (".json",), "yaml": (".yaml", ".yml"), "toml": (".toml",), "dbc": (".dbc",), "arxml": (".arxml",), "reqif": (".reqif",), "a2l": (".a2l",), "asc": (".asc",),
    "step": (".stp", ".step"), "plantuml": (".puml", ".plantuml", ".iuml"), "proto": (".proto",), "mermaid": (".mmd", ".mermaid"), "csv": (".csv", ".tsv"),
}


def _at(content: Column, signature: str, offset: int = 0) -> Column:
    return F.hex(F.substring(content, offset + 1, len(signature) // 2)) == signature


def _any(content: Column, *found: tuple[str, int]) -> Column:
    return reduce(lambda a, b: a | b, [_at(content, s, o) for s, o in found])


def _ascii(text: str) -> str:
    return text.encode("latin-1").hex().upper()


def signature_rules(content: Column, ext: Column, length: Column, compat: bool) -> list[tuple[str, Column, str]]:
    """(format, condition, reason) in order of precedence. ``compat``: two letters BM are
    an image and a UTF-16 mark is MP3, as lenient detectors have it."""
    b = content
    byte = lambda i: F.conv(F.hex(F.substring(b, i + 1, 1)), 16, 10).cast("int")
    mp3 = (byte(0) == 0xFF) & (byte(1).bitwiseAND(0xE0) == 0xE0)
    # a frame's layer and rate are never the reserved ones
    sure_mp3 = mp3 & (byte(1).bitwiseAND(0x06) != 0) & (byte(2).bitwiseAND(0xF0) != 0xF0)
    adts = (byte(0) == 0xFF) & (byte(1).bitwiseAND(0xF6) == 0xF0)
    bmp = _at(b, "424D") if compat else _at(b, "424D") & (F.hex(F.substring(b, 7, 4)) == "00000000")
    head = F.trim(F.decode(F.substring(b, 1, 2048), "ISO-8859-1"))
    svg = head.startswith("<svg") | (head.startswith("<?xml") & F.contains(head, F.lit("<svg")))
    riff = _at(b, _ascii("RIFF"))
    mat_text = F.decode(F.substring(b, 1, 116), "ISO-8859-1").rlike(r"(?i)^MATLAB\s+(?:5\.0|7\.)\s+MAT-file")
    mat = (ext == ".mat") & (_at(b, "894844460D0A1A0A") | mat_text | _any(b, (_ascii("IM"), 126), (_ascii("MI"), 126)))
    rules = [(f, _at(b, s, o), "its first bytes") for f, s, o in SIGNATURES]
    rules += [
        ("image", bmp, "the BMP signature"),
        ("image", riff & _at(b, _ascii("WEBP"), 8), "the WebP signature"),
        ("image", svg, "SVG markup"),
        ("audio", _any(b, (_ascii("fLaC"), 0), (_ascii("OggS"), 0), (_ascii("ID3"), 0)), "its first bytes"),
        *([] if compat else [("audio", adts, "AAC sync bytes")]),
        ("audio", mp3 if compat else sure_mp3, "an MP3 frame header"),
        ("audio", riff & _at(b, _ascii("WAVE"), 8), "the WAV signature"),
        ("audio", _at(b, _ascii("FORM")) & _any(b, (_ascii("AIFF"), 8), (_ascii("AIFC"), 8)), "the AIFF container"),
        ("audio", _any(b, ("0B77", 0), (_ascii("#!AMR\n"), 0), (_ascii("#!AMR-WB\n"), 0)), "its first bytes"),
        ("video", riff & _at(b, _ascii("AVI "), 8), "the AVI signature"),
        ("audio", _at(b, _ascii("ftyp"), 4) & (ext == ".m4a"), "an MP4 container and its name"),
        ("video", _at(b, _ascii("ftyp"), 4), "an MP4 container"),
        ("video", _at(b, "1A45DFA3") & ext.isin(".webm", ".mkv"), "an EBML container and its name"),
        ("video", (byte(0) == 0x47) & (byte(188) == 0x47) & (byte(376) == 0x47), "transport stream packets"),
        ("parquet", _at(b, _ascii("PAR1")) & (length >= 8) & F.col("tail").eqNullSafe(F.lit(_ascii("PAR1"))), "magic bytes at both ends"),
        ("shp", (ext == ".shp") & _at(b, "0000270A") & _at(b, "E8030000", 28) & (byte(32) <= 31) & _at(b, "000000", 33), "a shapefile header"),
        ("mat", mat, "a MAT-file header"),
    ]
    return rules + [(f, _at(b, s, o), "its first bytes") for f, s, o in CONTAINERS]


def _is_object(text: str) -> bool:
    try:
        return isinstance(json.loads(text, parse_constant=lambda c: 1 / 0), (dict, list))
    except (ValueError, ZeroDivisionError, RecursionError):
        return False


#: Line patterns of text formats, and of whole samples.
LINE_PATTERNS = {
    "toml table": r"^\[\[?[A-Za-z0-9_.\-\"'\s]+\]?\]$",
    "toml setting": r"^[A-Za-z0-9_.\-\"']+\s*=",
    "dbc message": r"^BO_\s+\d+\s+[A-Za-z_][\w.]*\s*:\s*\d+\s+\S+",
    "dbc signal": r"^SG_\s+[A-Za-z_][\w.]*\s*(?:M|m\d+)?\s*:",
    "dbc header": r"^(VERSION|NS_|BS_|BU_):?",
    "a2l begin": r"^/begin\s+[A-Za-z0-9_]+",
    "a2l end": r"^/end\s+[A-Za-z0-9_]+",
    "a2l version": r"^ASAP2_VERSION\b",
    "asc date": r"(?i)^date\s+",
    "asc base": r"(?i)^base\s+(hex|dec)",
    "asc event": r"^\d+(?:\.\d+)?\s+(?:CANFD|\d+\s+[0-9A-Fa-f]+x?\s+(?:Rx|Tx)\s+d\b)",
    "step start": r"(?i)^ISO-10303-21;$",
    "step header": r"(?i)^HEADER;$",
    "step schema": r"(?i)^FILE_SCHEMA\s*\(",
    "proto syntax": r'^syntax\s*=\s*"proto[23]"\s*;',
    "proto package": r"^package\s+[\w.]+\s*;",
    "proto type": r"^(message|enum|service)\s+[A-Za-z_]\w*\s*\{",
}
SAMPLE_PATTERNS = {
    "arxml": (("<?xml", "<AUTOSAR"), r"<AUTOSAR\b", r"<AR-PACKAGE\b|<SHORT-NAME\b"),
    "reqif": (("<?xml", "<REQ-IF"), r"<REQ-IF\b", r"<REQ-IF-HEADER\b|<SPEC-OBJECT\b|<SPECIFICATION\b"),
}
FIRST_LINES = {
    "plantuml": (r"^'.*$", r"(?i)^@start[a-z]+\b"),
    "mermaid": (r"^%%.*$", r"^(graph|flowchart|sequenceDiagram|classDiagram|stateDiagram(-v2)?|erDiagram|journey|gantt|pie|gitGraph|mindmap|timeline|quadrantChart|requirementDiagram|C4Context|C4Container|C4Component|C4Dynamic|C4Deployment|sankey-beta|xychart-beta|block-beta|packet-beta|architecture-beta|kanban|venn|radar-beta|treemap-beta)\b"),
}
#: The order of the text formats, and how many lines each looks at.
TEXT_ORDER = ("markdown", "jsonl", "json", "yaml", "toml", "dbc", "arxml", "reqif", "a2l", "asc", "step", "plantuml", "proto", "mermaid", "csv")
LOOK = {"toml": 20, "dbc": 80, "a2l": 120, "asc": 80, "step": 120, "proto": 80}


class _Sample:
    """A text's lines, and how often each format's line patterns occur in those it looks at."""

    def __init__(self, text: str):
        self.text = text
        self.rows = [x for x in (r.strip() for r in text.splitlines()) if x]

    def n(self, name: str) -> int:
        pattern = re.compile(LINE_PATTERNS[name])
        return sum(bool(pattern.match(x)) for x in self.rows[: LOOK[name.split()[0]]])

    def looks(self, kind: str) -> bool:
        n, rows, start = self.n, self.rows, self.text.lstrip()
        if kind in SAMPLE_PATTERNS:
            first, *patterns = SAMPLE_PATTERNS[kind]
            return start.startswith(first) and all(re.search(p, self.text) for p in patterns)
        if kind in FIRST_LINES:
            comment, pattern = FIRST_LINES[kind]
            line = next((x for x in (re.sub(comment, "", r).strip() for r in rows) if x), "")
            return bool(re.match(pattern, line))
        match kind:
            case "jsonl":
                return len(rows) > 1 and all(map(_is_object, rows[:10]))
            case "json":
                return start[:1] in ("{", "[") and _is_object(start.strip())
            case "toml":
                settings = n("toml setting")
                return settings > 2 or settings > 0 and n("toml table") > 0
            case "dbc":
                return n("dbc message") > 0 and n("dbc signal") + n("dbc header") > 0
            case "a2l":
                return n("a2l version") > 0 or n("a2l begin") > 1 and n("a2l end") > 0
            case "asc" | "step":
                return all(n(name) for name in LINE_PATTERNS if name.startswith(kind + " "))
            case "proto":
                return n("proto syntax") > 0 or n("proto package") > 0 and n("proto type") > 0
            case "csv":
                return any(unquoted_count(x, d) for x in rows[:10] for d in DELIMITERS)
        return False


def sniff_text(sample: str, ext: str) -> str | None:
    """The text format of a sample, by name or content."""
    s = _Sample(sample)
    if not s.rows:
        return None
    return next((kind for kind in TEXT_ORDER if ext in TEXT_EXTENSIONS[kind] or s.looks(kind)), None)


def office_of_zip(content: bytes) -> str | None:
    """The office format whose entries a ZIP has."""
    try:
        names = zipfile.ZipFile(io.BytesIO(content)).namelist()
    except (zipfile.BadZipFile, ValueError):
        return None
    for prefix, kind in (("word/", "word"), ("xl/", "excel"), ("ppt/", "ppt")):
        if any(n.startswith(prefix) for n in names):
            return kind
    hwpx = any(re.match(r"(?i)^Contents/section\d+\.xml$", n) or n in ("Contents/content.hpf", "version.xml") for n in names)
    return "hwp" if hwpx else None


@F.pandas_udf(T.StringType())
def _sniffed(sample: pd.Series, ext: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else sniff_text(bytes(s).decode("utf-8", "replace"), e) for s, e in zip(sample, ext)])


@F.pandas_udf(T.StringType())
def _zipped(content: pd.Series) -> pd.Series:
    return content.map(lambda c: None if c is None else office_of_zip(bytes(c)))


def detect_contents(files: DataFrame, fallback: str | None = None, *, compat: bool = False) -> DataFrame:
    """(file, format, reason, by_signature) of (file, length, content).

    Signatures are tested in codegen on the first bytes; only files that none
    matches are sniffed as text in Python, only ZIPs are opened.
    """
    ext = extension(F.col("file"))
    df = files.select("file", "length", "content", ext.alias("ext"), F.substring("content", 1, HEAD_BYTES).alias("head"), F.hex(F.substring("content", -4, 4)).alias("tail"))
    head, e = F.col("head"), F.col("ext")
    rules = signature_rules(head, e, F.col("length"), compat)
    found = F.coalesce(*[F.when(c, F.struct(F.lit(f).alias("format"), F.concat(F.lit("Matched "), F.lit(r)).alias("reason"), F.lit(True).alias("by_signature"))) for f, c, r in rules])
    result = lambda f, r, s: F.struct(f.alias("format"), F.lit(r).alias("reason"), F.lit(s).alias("by_signature"))
    office = F.create_map(*[F.lit(x) for p in OFFICE.items() for x in p])
    preferred = F.try_element_at(office, e)
    latin = F.decode(head, "ISO-8859-1")
    has = lambda t: F.contains(latin, F.lit(t))
    compound = F.coalesce(preferred, F.when(has("WordDocument"), "word").when(has("Workbook"), "excel").when(has("PowerPoint Document"), "ppt").when(has("FileHeader") | has("HwpSummaryInformation"), "hwp"))
    is_zip = _at(head, "504B0304")
    zipped = F.coalesce(preferred, _zipped(F.when(is_zip & preferred.isNull(), F.col("content"))), F.lit("archive"))
    steps = [
        found,
        F.when(e.isin(".pcap", ".pcapng"), result(F.substring(e, F.lit(2), F.length(e)), "Used the extension", False)),
        F.when(_at(head, "D0CF11E0A1B11AE1") & compound.isNotNull(), result(compound, "Matched a compound file", True)),
        F.when(is_zip, result(zipped, "Matched a ZIP container", True)),
        *[F.when(_at(head, s, o), result(F.lit(f), "Matched an archive signature", True)) for f, s, o in ARCHIVES],
        F.when(e.isin(*RAW_AUDIO), result(F.lit("audio"), "Used the extension", False)),
        F.when(e.isin(".mat", ".safetensors", ".shp"), result(F.substring(e, F.lit(2), F.length(e)), "Used the extension", False)),
    ]
    empty = F.when(F.col("length") == 0, result(F.lit(fallback).cast("string"), "The file is empty", False))
    first = df.withColumn("r", F.coalesce(empty, *steps))
    rest = F.when(F.col("r").isNull(), F.substring("content", 1, TEXT_BYTES))
    text = first.withColumn("t", _sniffed(rest, e))
    named = F.when(reduce(lambda a, b: a | b, [F.lower("file").endswith(x) for x in ARCHIVE_NAMES]), result(F.lit("archive"), "Used the extension", False))
    last = F.coalesce("r", F.when(F.col("t").isNotNull(), result(F.col("t"), "Matched text content or its extension", False)), named, result(F.lit(fallback).cast("string"), "Nothing matched", False))
    return text.select("file", last.alias("d")).select("file", "d.format", "d.reason", "d.by_signature")


def detect(spark: SparkSession, path: str | list[str], fallback: str | None = None, *, compat: bool = False) -> DataFrame:
    """The format of each file under a path. Spark reads no row of an empty file, so
    the listing is the left side."""
    found = detect_contents(binaries(spark, path), fallback, compat=compat)
    listed = spark.createDataFrame([(re.sub("^file:/+", "file:/", f),) for f in spark.read.format("binaryFile").load(path).inputFiles()], "file string")
    empty = F.col("by_signature").isNull()
    joined = listed.join(found, "file", "left")
    return joined.select("file", F.when(empty, F.lit(fallback).cast("string")).otherwise(F.col("format")).alias("format"), F.when(empty, "The file is empty").otherwise(F.col("reason")).alias("reason"), F.coalesce("by_signature", F.lit(False)).alias("by_signature"))
