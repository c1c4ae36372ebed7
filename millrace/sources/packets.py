"""Packet captures: framing by ranges of a file, dissection as a function over packets."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.net import dissected, link_name
from ..model import Report, summary_of
from .files import capped, parsed
from .ranges import CHUNK, RANGE_BYTES, Bytes, heads, indexed, mapped

#: Magic numbers (byte order, fraction digits) and block types.
MAGICS = {b"\xd4\xc3\xb2\xa1": ("<", 6), b"\xa1\xb2\xc3\xd4": (">", 6), b"\x4d\x3c\xb2\xa1": ("<", 9), b"\xa1\xb2\x3c\x4d": (">", 9)}
BLOCKS = {0x0A0D0D0A: "Section Header", 1: "Interface Description", 2: "Packet", 3: "Simple Packet", 4: "Name Resolution", 5: "Interface Statistics", 6: "Enhanced Packet", 10: "Decryption Secrets"}
PREVIEW_PACKETS = 5000

_FRAME = "file string, no long, ts_sec long, ts_frac long, digits int, captured long, original long, offset long, link_type int, payload binary, problem string"
#: Headers in a row that have to look right where a range guesses its first record, and the longest packet such a header may announce.
CHAIN, PLAUSIBLE = 6, 1 << 18


def _pcap_kind(data: Bytes) -> tuple[str, int] | None:
    head = data.get(0, 24)
    return MAGICS[head[:4]] if len(head) == 24 and head[:4] in MAGICS else None


def _pcap_walk(data: Bytes, start: int, high: int, state: str) -> tuple[int, str, list[int], bool]:
    """Over the record headers from ``start`` to the first one at ``high`` or after."""
    kind = _pcap_kind(data)
    at, met = start, 0
    while kind and at < high and at + 16 <= data.length:
        (captured,) = struct.unpack_from(kind[0] + "I", data.get(at, 16), 8)
        if captured > data.length - at - 16:
            break
        at, met = at + 16 + captured, met + 1
    return at, state, [met], not kind or at < high


def _pcap_chain(data: Bytes, at: int, order: str, digits: int, snap: int) -> bool:
    for _ in range(CHAIN):
        if at == data.length:
            return True
        head = data.get(at, 16)
        if len(head) < 16:
            return False
        _, frac, captured, original = struct.unpack(order + "4I", head)
        if frac >= 10**digits or captured > min(original, snap) or at + 16 + captured > data.length:
            return False
        at += 16 + captured
    return True


def _pcap_guess(data: Bytes, low: int, high: int) -> tuple[int, str] | None:
    if low == 0:
        return 24, ""
    kind = _pcap_kind(data)
    if kind is None:
        return None
    order, digits = kind
    (snap,) = struct.unpack_from(order + "I", data.get(0, 24), 16)
    most = min(snap or PLAUSIBLE, PLAUSIBLE)
    for base in range(low, high, CHUNK // 4):
        part = data.get(base, min(CHUNK // 4, high - base) + 16)
        for at in _plausible(part, order, digits, most, min(CHUNK // 4, high - base)):
            if _pcap_chain(data, base + at, order, digits, most):
                return base + at, ""
    return None


def _plausible(part: bytes, order: str, digits: int, most: int, n: int) -> list[int]:
    """Places in some bytes where the four numbers could be a record's header."""
    out = []
    for shift in range(4):
        words = np.frombuffer(part[shift : len(part) - (len(part) - shift) % 4], order + "u4")
        if len(words) > 3:
            good = (words[1:-2] < 10**digits) & (words[2:-1] <= words[3:]) & (words[2:-1] <= most) & (words[3:] > 0)
            out.append(np.flatnonzero(good) * 4 + shift)
    found = np.sort(np.concatenate(out)) if out else np.zeros(0, int)
    return found[found < n].tolist()


def _frames(row: dict) -> Iterator[tuple]:
    """A row for each record of a range; the last says where reading stopped, if before the file's end."""
    file, no = row["file"], row["before"][0]
    with Bytes(file) as data:
        kind = _pcap_kind(data)
        if kind is None:
            if row["part"] == 0:
                yield file, 0, None, None, None, None, None, 0, None, None, "The file does not start with a supported PCAP magic value."
            return
        if row["start"] is None:
            return
        order, digits = kind
        link = struct.unpack_from(order + "I", data.get(0, 24), 20)[0] & 0xFFFF
        at = row["start"]
        while at < row["stop"]:
            sec, frac, captured, original = struct.unpack(order + "4I", data.get(at, 16))
            no += 1
            yield file, no, sec, frac, digits, captured, original, at, link, data.get(at + 16, captured), None
            at += 16 + captured
        if row["dead"] and at != data.length:
            yield file, 0, None, None, None, None, None, at, None, None, f"Packet parsing stopped near offset 0x{at:x} because a record was truncated or invalid."


def _packets(frames: DataFrame, timestamp) -> DataFrame:
    named = frames.filter("no > 0").withColumn("d", dissected("payload", "link_type"))
    return named.select("file", "no", timestamp.alias("timestamp"), "d.protocol", "d.source", "d.destination", "captured", "original", F.concat(F.lit("0x"), F.lower(F.hex("offset"))).alias("offset"), "d.info")


def read_pcap(spark: SparkSession, path: str, preview: bool = False, range_bytes: int = RANGE_BYTES) -> Report:
    """packets: no, timestamp, protocol, source, destination, captured, original, offset, info.

    Captures are read in ranges of ``range_bytes``, each one task's work, whatever a file's size.
    """
    index = indexed(spark, path, _pcap_guess, _pcap_walk, 1, range_bytes)
    frames = mapped(index, _frames, _FRAME)
    stamp = F.concat(F.col("ts_sec").cast("string"), F.lit("."), F.lpad(F.col("ts_frac").cast("string"), F.greatest(F.col("digits"), F.length(F.col("ts_frac").cast("string"))), F.lit("0")))
    kept = frames.filter(F.col("no") <= PREVIEW_PACKETS) if preview else frames
    head = parsed(heads(spark, path, 24), "content", _global_header, "field string, value string")
    counts = index.agg(F.coalesce(F.sum(F.col("met")[0]), F.lit(0)).alias("n"), F.countDistinct("file").alias("files"))
    return Report(summary_of(counts, {"files": "Files", "n": "Packets parsed"}), {"header": head, "packets": _packets(kept, stamp)}, frames.filter("problem IS NOT NULL").select(F.col("problem").alias("message")))


def _global_header(data: bytes) -> Iterator[tuple]:
    if data[:4] not in MAGICS or len(data) < 24:
        return
    order, digits = MAGICS[data[:4]]
    major, minor, zone, figures, snap, link = struct.unpack_from(order + "2HiIII", data, 4)
    yield "Byte order", "little endian" if order == "<" else "big endian"
    yield "Version", f"{major}.{minor}"
    yield "Timestamp resolution", "microseconds" if digits == 6 else "nanoseconds"
    yield "Timezone offset", str(zone)
    yield "Timestamp accuracy", str(figures)
    yield "Snapshot length", str(snap)
    yield "Link type", link_name(link)


_BLOCK = "file string, no long, section int, type string, length long, captured long, original long, offset long, ticks string, interface_id int, payload binary, link_type int, snap_length long, name string, description string, resolution string, little_endian boolean, version string, section_length long, problem string"


def _options(data: bytes, at: int, end: int, order: str) -> dict[int, str]:
    out = {}
    while at + 4 <= end:
        code, n = struct.unpack_from(order + "2H", data, at)
        at += 4
        if code == 0 or at + n > end:
            break
        value = data[at : at + n]
        if code == 9 and n:
            out[code] = f"2^-{value[0] & 127}" if value[0] & 128 else f"10^-{value[0]}"
        else:
            out[code] = value.decode("utf-8") if all(32 <= b < 127 or b == 9 for b in value) else value.hex()
        at += n + -n % 4
    return out


SECTION = b"\x0a\x0d\x0d\x0a"


def _block_at(data: Bytes, at: int, order: str) -> tuple[int, int, str] | None:
    """(kind, length, byte order) of the block at an offset; none if it doesn't fit the file."""
    head = data.get(at, 12)
    if len(head) < 12:
        return None
    if head[:4] == SECTION:
        if at + 28 > data.length:
            return None
        order = ">" if head[8:12] == b"\x1a\x2b\x3c\x4d" else "<"
    kind, length = struct.unpack_from(order + "2I", head)
    return None if length < 12 or at + length > data.length else (kind, length, order)


def _block_walk(data: Bytes, start: int, high: int, order: str) -> tuple[int, str, list[int], bool]:
    """As ``_pcap_walk``; numbers met are blocks and sections, the state is the byte order."""
    at, blocks, sections = start, 0, 0
    while at < high and (block := _block_at(data, at, order)):
        kind, length, order = block
        at, blocks, sections = at + length, blocks + 1, sections + (kind == 0x0A0D0D0A)
    return at, order, [blocks, sections], at < high


def _block_guess(data: Bytes, low: int, high: int) -> tuple[int, str] | None:
    """The first place where a chain of blocks has the same length at both ends."""
    if low == 0:
        return 0, "<"
    first = _block_at(data, 0, "<")
    orders = ["<", ">"] if first is None or first[2] == "<" else [">", "<"]
    for order in orders:
        for base in range(low, high, CHUNK // 4):
            n = min(CHUNK // 4, high - base)
            part = data.get(base, n + 8)
            found = []
            for shift in range(4):
                words = np.frombuffer(part[shift : len(part) - (len(part) - shift) % 4], order + "u4")
                if len(words) > 1:
                    good = (words[1:] >= 12) & (words[1:] % 4 == 0) & (words[1:] <= PLAUSIBLE) & ((words[:-1] < 0x10000) | (words[:-1] == 0x0A0D0D0A))
                    found.append(np.flatnonzero(good) * 4 + shift)
            places = np.sort(np.concatenate(found)) if found else np.zeros(0, int)
            for at in places[places < n].tolist():
                if _block_chain(data, base + at, order):
                    return base + at, order
    return None


def _block_chain(data: Bytes, at: int, order: str) -> bool:
    for _ in range(CHAIN):
        if at == data.length:
            return True
        block = _block_at(data, at, order)
        if block is None or data.get(at + block[1] - 4, 4) != struct.pack(block[2] + "I", block[1]):
            return False
        at, order = at + block[1], block[2]
    return True


def _blocks(row: dict) -> Iterator[tuple]:
    """A row for each block of a range, numbered over the file, with the number of its section."""
    none = (None,) * 19
    file, (no, section) = row["file"], row["before"]
    with Bytes(file) as data:
        if row["part"] == 0 and data.get(0, 4) != SECTION:
            yield (file, 0, 0) + none[2:18] + ("The file does not start with the expected PCAPNG Section Header Block.",)
        if row["start"] is None:
            return
        at, order = row["start"], row["begin"]
        while at < row["stop"]:
            kind, length, order = _block_at(data, at, order)
            no += 1
            section += kind == 0x0A0D0D0A
            yield (file, *_block_row(data.get(at, length), kind, length, order, at, no, section))
            at += length
        if row["dead"] and at != data.length:
            yield (file, 0, section) + none[2:6] + (at,) + none[7:18] + (f"Block parsing stopped near offset 0x{at:x} because a block was truncated or invalid.",)


def _block_row(block: bytes, kind: int, length: int, order: str, at: int, no: int, section: int) -> tuple:
    row = dict.fromkeys(("captured", "original", "ticks", "interface_id", "payload", "link_type", "snap", "name", "description", "resolution", "little", "version", "section_length"))
    if kind == 0x0A0D0D0A and length >= 24:
        major, minor = struct.unpack_from(order + "2H", block, 12)
        row |= {"little": order == "<", "version": f"{major}.{minor}", "section_length": struct.unpack_from(order + "q", block, 16)[0]}
    elif kind == 1 and length >= 20:
        options = _options(block, 16, length - 4, order)
        row |= {"link_type": struct.unpack_from(order + "H", block, 8)[0], "snap": struct.unpack_from(order + "I", block, 12)[0], "name": options.get(2), "description": options.get(3), "resolution": options.get(9, "microseconds")}
    elif kind == 6 and length >= 32:
        interface, high, low, captured, original = struct.unpack_from(order + "5I", block, 8)
        row |= {"captured": captured, "original": original, "ticks": str(high << 32 | low), "interface_id": interface, "payload": block[28 : 28 + captured]}
    elif kind == 3 and length >= 16:
        (captured,) = struct.unpack_from(order + "I", block, 8)
        row |= {"captured": captured, "original": captured, "interface_id": 0, "payload": block[12 : 12 + captured]}
    r = row
    return no, section, BLOCKS.get(kind, f"Unknown 0x{kind:08x}"), length, r["captured"], r["original"], at, r["ticks"], r["interface_id"], r["payload"], r["link_type"], r["snap"], r["name"], r["description"], r["resolution"], r["little"], r["version"], r["section_length"], None


def read_pcapng(spark: SparkSession, path: str, preview: bool = False, range_bytes: int = RANGE_BYTES) -> Report:
    """sections, interfaces, blocks, block_counts (of all blocks) and packets, read in ranges of ``range_bytes``.

    A packet's link type is its interface's, numbered in its section; Ethernet without one.
    """
    blocks = mapped(indexed(spark, path, _block_guess, _block_walk, 2, range_bytes), _blocks, _BLOCK)
    real = blocks.filter("no > 0")
    offset = F.concat(F.lit("0x"), F.lower(F.hex("offset"))).alias("offset")
    interfaces = real.filter(F.col("type") == "Interface Description").withColumn("interface_id", (F.row_number().over(Window.partitionBy("file", "section").orderBy("no")) - 1).cast("int"))
    links = interfaces.select("file", "section", "interface_id", F.col("link_type").alias("own_link"))
    with_link = capped(real.filter("payload IS NOT NULL"), PREVIEW_PACKETS, "file", "no", preview).join(links, ["file", "section", "interface_id"], "left").withColumn("link_type", F.coalesce("own_link", F.lit(1)))
    numbered = with_link.withColumn("no", F.row_number().over(Window.partitionBy("file").orderBy("no")).cast("long"))
    summary = summary_of(real.agg(F.count_if(F.col("type") == "Section Header").alias("s"), F.count_if(F.col("type") == "Interface Description").alias("i"), F.count_if(F.col("type") == "Enhanced Packet").alias("p")), {"s": "Sections", "i": "Interfaces", "p": "Enhanced packets"})
    tables = {
        "sections": real.filter("version IS NOT NULL").select("file", "section", "little_endian", "version", "section_length", offset),
        "interfaces": interfaces.select("file", "section", "interface_id", "link_type", "snap_length", "name", "description", "resolution"),
        "blocks": capped(real, PREVIEW_PACKETS, "file", "no", preview).select("file", "no", "type", "length", "captured", "original", offset),
        "block_counts": real.groupBy("type").agg(F.count("*").alias("count")),
        "packets": _packets(numbered, F.col("ticks")),
    }
    return Report(summary, tables, blocks.filter("problem IS NOT NULL").select(F.col("problem").alias("message")))
