"""Line and tag catalogs of vehicle, requirements and product data, as DataFrames of regular expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import decode_xml
from ..model import Report, summary_of
from .files import capped, lines, text_lines, texts

#: The elements with names that an AUTOSAR catalog lists, and the A2L blocks of interest.
ARXML_ELEMENTS = ("CAN-CLUSTER", "CAN-PHYSICAL-CHANNEL", "CAN-FRAME-TRIGGERING", "FRAME", "I-SIGNAL", "I-PDU", "SIGNAL-I-PDU", "ECU-INSTANCE")
A2L_FOCUS = ("PROJECT", "MODULE", "IF_DATA", "MEASUREMENT", "CHARACTERISTIC", "COMPU_METHOD", "RECORD_LAYOUT", "EVENT")
STEP_HEADER = ("name", "timestamp", "author", "organization", "preprocessor", "originating_system", "authorization")
#: Line and tag patterns of the formats.
DBC_MESSAGE = r"^BO_\s+(\d+)\s+([A-Za-z_][\w.]*)\s*:\s*(\d+)\s+(\S+)"
DBC_SIGNAL = r'^SG_\s+([A-Za-z_][\w.]*)\s*(M|m\d+M?)?\s*:\s*(\d+)\|(\d+)@([01])([+-])\s*\(([^,]+),([^)]+)\)\s*\[([^|]*)\|([^\]]*)\]\s*"([^"]*)"\s*(.*)$'
DBC_COMMENT = r'^CM_\s+(?:(BO_|SG_)\s+(\d+)\s+(?:([A-Za-z_][\w.]*)\s+)?|(BU_)\s+(\S+)\s+)?"(.*)"\s*;?$'
DBC_VALUES = r"^VAL_\s+(\d+)\s+([A-Za-z_][\w.]*)\s+(.*?);?$"
A2L_BLOCK = r'^\s*/begin\s+([A-Za-z0-9_]+)(?:\s+("[^"]+"|\S+))?'
ASC_EVENT = r"^\d+(?:\.\d+)?\s+"
ASC_CLASSIC = r"^(\d+(?:\.\d+)?)\s+(\d+)\s+([0-9A-Fa-f]+x?)\s+(Rx|Tx)\s+d\s+(\d+)\s*(.*)$"
STEP_ENTITY = r"(?i)^\s*#(\d+)\s*=\s*([A-Z0-9_]+)\s*\("
PREVIEW_ROWS, PREVIEW_EVENTS, PREVIEW_HEADERS = 1000, 5000, 20


def _all(text: Column, pattern: str, *groups: int) -> Column:
    """array<struct(g1, g2..)> of a pattern's groups at each match."""
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in groups]
    return F.arrays_zip(*[p.alias(f"g{i}") for i, p in enumerate(parts)])


def _exploded(docs: DataFrame, found: Column, **columns: Column) -> DataFrame:
    return docs.select("file", F.posexplode(found).alias("_at", "m")).select("file", (F.col("_at") + 1).cast("long").alias("no"), *[c.alias(k) for k, c in columns.items()])


def _attribute(attributes: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(attributes, rf'(?i)\b{name}="([^"]*)"', 1), F.lit(""))


# --- CAN databases


def read_dbc(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """messages (with nested signals), signals, comments, values, nodes, stats and warnings of DBC files.

    A signal belongs to the last message line before it; comments and value tables
    are joined by id and name, the last of several comments counts. Comments on
    nodes and on the whole file are in ``comments`` only.
    """
    all_lines = text_lines(texts(spark, path)).withColumn("t", F.trim("text")).filter("t <> ''")
    message = DBC_MESSAGE
    get = lambda p, g: F.regexp_extract("t", p, g)
    owned = all_lines.filter(F.col("t").rlike(r"^(BO_|SG_)\s")).withColumn("message_id", F.last(F.when(F.col("t").rlike(message), get(message, 1).cast("long")), ignorenulls=True).over(Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    messages = all_lines.filter(F.col("t").rlike(message)).select("file", "line", get(message, 1).cast("long").alias("message_id"), get(message, 2).alias("name"), get(message, 3).cast("int").alias("dlc"), get(message, 4).alias("transmitter"))
    signal = DBC_SIGNAL
    signals = owned.filter(F.col("t").rlike(signal) & F.col("message_id").isNotNull()).select(
        "file", "line", "message_id", get(signal, 1).alias("signal"), F.nullif(get(signal, 2), F.lit("")).alias("multiplexer"), get(signal, 3).cast("int").alias("start"), get(signal, 4).cast("int").alias("length"),
        F.when(get(signal, 5) == "1", "Intel").otherwise("Motorola").alias("byte_order"), (get(signal, 6) == "-").alias("signed"), F.trim(get(signal, 7)).try_cast("double").alias("factor"), F.trim(get(signal, 8)).try_cast("double").alias("offset"),
        F.trim(get(signal, 9)).try_cast("double").alias("minimum"), F.trim(get(signal, 10)).try_cast("double").alias("maximum"), get(signal, 11).alias("unit"), F.filter(F.split(F.trim(get(signal, 12)), r"[,\s]+"), lambda x: x != "").alias("receivers"),
    )
    comment = DBC_COMMENT
    target = F.when(get(comment, 1) == "BO_", "message").when(get(comment, 1) == "SG_", "signal").when(get(comment, 4) == "BU_", "node").otherwise("network")
    comments = all_lines.filter(F.col("t").rlike(comment)).select("file", "line", target.alias("target"), get(comment, 2).try_cast("long").alias("message_id"), F.when(get(comment, 1) == "SG_", get(comment, 3)).alias("signal"), F.nullif(get(comment, 5), F.lit("")).alias("node"), get(comment, 6).alias("comment"))
    value = DBC_VALUES
    pairs = F.transform(_all(get(value, 3), r'(-?\d+)\s+"([^"]*)"', 1, 2), lambda x: F.struct(x["g0"].cast("long").alias("value"), x["g1"].alias("label")))
    values = all_lines.filter(F.col("t").rlike(value)).select("file", "line", get(value, 1).cast("long").alias("message_id"), get(value, 2).alias("signal"), pairs.alias("values"))
    nodes = all_lines.filter(F.col("t").rlike(r"^BU_\s*:")).select("file", F.explode(F.split(F.trim(F.regexp_replace("t", r"^BU_\s*:\s*", "")), r"\s+")).alias("node")).filter("node <> ''")

    last_comment = lambda df, by: df.groupBy("file", *by).agg(F.max_by("comment", "line").alias("comment"), F.max("line").alias("comment_line"))
    full = signals.join(last_comment(comments.filter("signal IS NOT NULL"), ["message_id", "signal"]), ["file", "message_id", "signal"], "left")
    full = full.join(values.groupBy("file", "message_id", "signal").agg(F.max_by("values", "line").alias("values")), ["file", "message_id", "signal"], "left")
    nested = full.groupBy("file", "message_id").agg(F.array_sort(F.collect_list(F.struct("line", "signal", "multiplexer", "start", "length", "byte_order", "signed", "factor", "offset", "minimum", "maximum", "unit", "receivers", "values", "comment"))).alias("signals"))
    noted = messages.join(last_comment(comments.filter("target = 'message'"), ["message_id"]), ["file", "message_id"], "left").withColumn("comment", F.when(F.col("comment_line") > F.col("line"), F.col("comment"))).drop("comment_line")
    complete = noted.join(nested, ["file", "message_id"], "left").select("file", "line", "message_id", F.concat(F.lit("0x"), F.hex("message_id")).alias("id_hex"), "name", "dlc", "transmitter", "comment", F.coalesce("signals", F.array().cast(nested.schema["signals"].dataType)).alias("signals"))
    size = F.size("signals")
    stats = complete.groupBy("file").agg(F.count("*").alias("messages"), F.sum(size).alias("signals"), F.sum(F.aggregate("signals", F.lit(0), lambda a, s: a + F.coalesce(F.when(s["values"].isNotNull(), F.size(s["values"])), F.lit(0)))).alias("values"), F.count_if(F.col("message_id") > 0x7FF).alias("extended"), F.coalesce(F.max("dlc"), F.lit(0)).alias("max_dlc"))
    lost = values.join(signals, ["file", "message_id", "signal"], "left_anti")
    warnings = lost.select("file", F.concat(F.lit("Values without a signal: "), F.col("message_id").cast("string"), F.lit(" "), "signal").alias("message"))
    return {"messages": complete, "signals": full, "comments": comments, "values": values, "nodes": nodes, "stats": stats, "warnings": warnings}


def dbc_filter(messages: DataFrame, node: str | None = None, text: str = "") -> DataFrame:
    """Messages that a node sends or receives, with a text in any of their names or comments."""
    keep = F.lit(True)
    if node:
        keep = (F.col("transmitter") == node) | F.exists("signals", lambda s: F.array_contains(s["receivers"], node))
    if text.strip():
        hay = F.concat_ws(" ", "name", F.col("message_id").cast("string"), "id_hex", "transmitter", "comment", F.array_join(F.transform("signals", lambda s: F.concat_ws(" ", s["signal"], s["unit"], s["comment"], F.array_join(s["receivers"], " "))), " "))
        keep = keep & F.contains(F.lower(hay), F.lit(text.strip().lower()))
    return messages.filter(keep)


# --- AUTOSAR XML


def read_arxml(spark: SparkSession, path: str, preview: bool = False) -> Report:
    docs = texts(spark, path)
    t = F.col("text")
    name = lambda body: decode_xml(F.trim(F.regexp_extract(body, r"(?s)<SHORT-NAME\b[^>]*>(.*?)</SHORT-NAME>", 1)))
    has_name = F.col("m").rlike(r"(?s)<SHORT-NAME\b[^>]*>.*?</SHORT-NAME>")
    bodies = docs.select("file", F.posexplode(F.regexp_extract_all(t, F.lit(r"(?s)<AR-PACKAGE\b[^>]*>(.*?)</AR-PACKAGE>"), F.lit(1))).alias("at", "m")).filter(has_name)
    packages = bodies.select("file", F.row_number().over(Window.partitionBy("file").orderBy("at")).cast("long").alias("no"), name(F.col("m")).alias("name"))
    kinds = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(tag).alias("type"), F.regexp_extract_all(t, F.lit(rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1)).alias("found")) for i, tag in enumerate(ARXML_ELEMENTS)])
    elements = docs.select("file", F.inline(kinds)).select("file", "k", "type", F.posexplode("found").alias("at", "m")).filter(has_name).select("file", "k", "at", "type", name(F.col("m")).alias("name"))
    # Java's patterns have back-references, as needed for the end tag
    refs = _exploded(docs, _all(t, r"(?s)<([A-Z0-9-]*REF)\b([^>]*)>(.*?)</\1>", 1, 2, 3), tag=F.col("m.g0"), dest=_attribute(F.col("m.g1"), "DEST"), target=decode_xml(F.trim(F.col("m.g2"))))
    counts = docs.select("file", F.nullif(F.regexp_extract(t, r'<AUTOSAR\b[^>]*\sxmlns="([^"]+)"', 1), F.lit("")).alias("namespace"))
    total = packages.agg(F.count("*").alias("packages")).crossJoin(elements.agg(F.count("*").alias("elements"))).crossJoin(refs.agg(F.count("*").alias("references"))).crossJoin(counts.agg(F.first("namespace", ignorenulls=True).alias("namespace")))
    summary = summary_of(total, {"packages": "Packages", "elements": "Named elements", "references": "References", "namespace": "XML namespace"})
    elements = elements.withColumn("order", F.struct("k", "at"))
    return Report(summary, {"packages": packages, "elements": capped(elements, PREVIEW_ROWS, "file", "order", preview).select("file", "type", "name"), "references": capped(refs, PREVIEW_ROWS, "file", "no", preview).select("file", "tag", "dest", "target")})


# --- ASAP2


def read_a2l(spark: SparkSession, path: str, preview: bool = False) -> Report:
    pattern = A2L_BLOCK
    blocks = lines(spark, path).filter(F.col("text").rlike(pattern)).select("file", F.upper(F.regexp_extract("text", pattern, 1)).alias("type"), F.nullif(F.regexp_replace(F.regexp_extract("text", pattern, 2), '^"|"$', ""), F.lit("")).alias("name"), "line")
    counts = blocks.groupBy("type").agg(F.count("*").alias("count"), F.min("line").alias("first_line"))
    of = lambda kind: F.count_if(F.col("type") == kind)
    summary = summary_of(blocks.agg(F.count("*").alias("blocks"), of("MEASUREMENT").alias("m"), of("CHARACTERISTIC").alias("c"), of("IF_DATA").alias("i")), {"blocks": "Blocks", "m": "Measurements", "c": "Characteristics", "i": "IF_DATA"})
    return Report(summary, {"blocks": blocks, "important": capped(blocks.filter(F.col("type").isin(*A2L_FOCUS)), PREVIEW_ROWS, "file", "line", preview), "counts": counts})


# --- CAN logs


def read_asc(spark: SparkSession, path: str, preview: bool = False) -> Report:
    """Events of ASCII CAN logs. Lines are read in splits, so a log of any size is spread over tasks."""
    numbered = lines(spark, path).withColumn("t", F.trim("text")).filter("t <> ''")
    is_event = F.col("t").rlike(ASC_EVENT)
    headers = numbered.filter(~is_event).select("file", "line", F.col("t").alias("header"))
    parts = numbered.filter(is_event).withColumn("p", F.split("t", r"\s+")).filter(F.size("p") >= 5)
    hexed = F.array_position(F.transform("p", lambda x: x.rlike("^[0-9A-Fa-f]+x?$") & (x != F.get("p", F.lit(2)))), True).cast("int")
    at = F.col("at")
    fd = parts.filter(F.get("p", F.lit(1)) == "CANFD").withColumn("at", hexed - 1)
    part = lambda i: F.get("p", i)
    fd = fd.select("file", part(F.lit(0)).alias("time"), F.lit("CANFD").alias("type"), part(F.lit(2)).alias("channel"), part(F.lit(3)).alias("direction"), F.when(at >= 0, part(at)).alias("id"), F.when(at >= 2, part(at + 1)).alias("dlc"), F.when(at >= 0, F.array_join(F.slice("p", at + 6, F.size("p")), " ")).otherwise("").alias("data"), "line")
    classic = ASC_CLASSIC
    get = lambda g: F.regexp_extract("t", classic, g)
    can = parts.filter((F.get("p", F.lit(1)) != "CANFD") & F.col("t").rlike(classic)).select("file", get(1).alias("time"), F.lit("CAN").alias("type"), get(2).alias("channel"), get(4).alias("direction"), get(3).alias("id"), get(5).alias("dlc"), F.trim(get(6)).alias("data"), "line")
    events = fd.unionByName(can)
    summary = summary_of(events.agg(F.count("*").alias("n"), F.count_if(F.col("type") == "CANFD").alias("fd"), F.count_if(F.col("type") == "CAN").alias("can")), {"n": "Parsed events", "fd": "CAN FD events", "can": "Classic CAN events"})
    return Report(summary, {"headers": capped(headers, PREVIEW_HEADERS, "file", "line", preview), "events": capped(events, PREVIEW_EVENTS, "file", "line", preview)})


# --- STEP


def split_step_arguments(value: str | None) -> list[str]:
    """Arguments at the outermost level, without quotes and brackets."""
    out, now, quoted, depth = [], "", False, 0
    clean = lambda x: x.strip().removeprefix("$").strip()
    for c in value or "":
        if c == "'":
            quoted = not quoted
        elif not quoted and c == "(":
            depth += 1
        elif not quoted and c == ")":
            depth = max(0, depth - 1)
        elif not quoted and depth == 0 and c == ",":
            out.append(clean(now))
            now = ""
        else:
            now += c
    return out + [clean(now)] if now.strip() else out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _split_arguments(values: pd.Series) -> pd.Series:
    return values.map(split_step_arguments)


def read_step(spark: SparkSession, path: str, preview: bool = False) -> Report:
    pattern = STEP_ENTITY
    entities = lines(spark, path).filter(F.col("text").rlike(pattern)).select("file", F.concat(F.lit("#"), F.regexp_extract("text", pattern, 1)).alias("id"), F.upper(F.regexp_extract("text", pattern, 2)).alias("type"), "line")
    section = lambda k: _split_arguments(F.regexp_extract("text", rf"(?is){k}\s*\(([^;]*)\);", 1))
    heads = texts(spark, path).select("file", section("FILE_NAME").alias("names"), section("FILE_SCHEMA").alias("schemas"))
    fields = [F.struct(F.lit(k).alias("field"), F.nullif(F.get("names", F.lit(i)), F.lit("")).alias("value")) for i, k in enumerate(STEP_HEADER)]
    header = heads.select("file", F.inline(F.array(*fields, F.struct(F.lit("schema").alias("field"), F.nullif(F.array_join("schemas", ", "), F.lit("")).alias("value")))))
    counts = entities.groupBy("type").agg(F.count("*").alias("count"), F.min("line").alias("first_line"))
    top = counts.orderBy(F.desc("count"), "first_line").limit(100)
    summary = summary_of(entities.agg(F.count("*").alias("n"), F.countDistinct("type").alias("k")), {"n": "Entity lines", "k": "Entity types"})
    return Report(summary, {"header": header, "top_types": top, "entities": capped(entities, PREVIEW_ROWS, "file", "line", preview)})


# --- requirements


def read_reqif(spark: SparkSession, path: str, preview: bool = False) -> Report:
    docs = texts(spark, path)
    t = F.col("text")
    inside = F.regexp_extract(t, r"(?is)<REQ-IF-HEADER\b[^>]*>(.*?)</REQ-IF-HEADER>", 1)
    tag = lambda name: F.nullif(decode_xml(F.trim(F.regexp_extract(inside, rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1))), F.lit(""))
    fields = {"title": tag("TITLE"), "identifier": _attribute(F.regexp_extract(t, r"(?is)<REQ-IF-HEADER\b[^>]*>", 0), "IDENTIFIER"), "source_tool_id": tag("SOURCE-TOOL-ID"), "reqif_tool_id": tag("REQ-IF-TOOL-ID"), "creation_time": tag("CREATION-TIME"), "comment": tag("COMMENT")}
    header = docs.select("file", F.inline(F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in fields.items()])))

    def items(pattern: str) -> DataFrame:
        return _exploded(docs, _all(t, rf"(?i)<({pattern})(?!-)\b([^>]*)>", 1, 2), kind=F.upper(F.col("m.g0")), identifier=_attribute(F.col("m.g1"), "IDENTIFIER"), long_name=decode_xml(_attribute(F.col("m.g1"), "LONG-NAME")))

    tables = {"specifications": items("SPECIFICATION"), "objects": items("SPEC-OBJECT"), "relations": items("SPEC-RELATION")}
    definitions = items("DATATYPE-DEFINITION-[A-Z-]+").unionByName(items("SPEC-[A-Z-]*TYPE"))
    total = tables["objects"].agg(F.count("*").alias("o")).crossJoin(tables["specifications"].agg(F.count("*").alias("s"))).crossJoin(tables["relations"].agg(F.count("*").alias("r")))
    summary = summary_of(total, {"o": "Spec objects", "s": "Specifications", "r": "Spec relations"})
    return Report(summary, {"header": header, **{k: capped(v, PREVIEW_ROWS, "file", "no", preview) for k, v in tables.items()}, "definitions": definitions})
