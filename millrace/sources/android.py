"""Android's compiled XML as text."""

from __future__ import annotations

import struct
from xml.sax.saxutils import escape, quoteattr

DIMENSIONS = ("px", "dp", "sp", "pt", "in", "mm")
RADIX = (1 / (1 << 8), 1 / (1 << 15), 1 / (1 << 23), 1 / (1 << 31))


def _strings(data: bytes, at: int) -> list[str]:
    count, _, flags, start, _ = struct.unpack_from("<5I", data, at + 8)
    out = []
    for i in range(count):
        p = at + start + struct.unpack_from("<I", data, at + 28 + 4 * i)[0]
        if flags & 0x100:
            p += 2 if data[p] & 0x80 else 1
            n = data[p]
            p += 1
            if n & 0x80:
                n, p = (n & 0x7F) << 8 | data[p], p + 1
            out.append(data[p : p + n].decode("utf-8", "replace"))
        else:
            (n,) = struct.unpack_from("<H", data, p)
            p += 2
            if n & 0x8000:
                n, p = (n & 0x7FFF) << 16 | struct.unpack_from("<H", data, p)[0], p + 2
            out.append(data[p : p + 2 * n].decode("utf-16-le", "replace"))
    return out


def typed_value(kind: int, value: int, strings: list[str]) -> str:
    """An attribute's value by its type."""
    if kind == 0x03:
        return strings[value] if value < len(strings) else ""
    if kind in (0x01, 0x02):
        return f"{'@' if kind == 1 else '?'}0x{value:08x}"
    if kind == 0x04:
        return f"{struct.unpack('<f', struct.pack('<I', value))[0]:g}"
    if kind in (0x05, 0x06):
        mantissa = struct.unpack("<i", struct.pack("<I", value & 0xFFFFFF00))[0]
        number = mantissa * RADIX[value >> 4 & 3]
        unit = value & 0xF
        return f"{number:g}{DIMENSIONS[unit] if unit < len(DIMENSIONS) else ''}" if kind == 5 else f"{number * 100:g}%{'p' if unit else ''}"
    if kind == 0x11:
        return f"0x{value:x}"
    if kind == 0x12:
        return "true" if value else "false"
    if 0x1C <= kind <= 0x1F:
        return f"#{value:08x}"
    return str(struct.unpack("<i", struct.pack("<I", value))[0])


def decode_binary_xml(data: bytes) -> str:
    """Elements, attributes and texts, indented by two."""
    at, strings, spaces, depth = 8, [], {}, 0
    out = ['<?xml version="1.0" encoding="utf-8"?>']
    name = lambda i: strings[i] if 0 <= i < len(strings) else ""
    while at + 8 <= len(data):
        kind, _, size = struct.unpack_from("<HHI", data, at)
        if size < 8:
            break
        if kind == 0x0001:
            strings = _strings(data, at)
        elif kind == 0x0100:
            prefix, uri = struct.unpack_from("<2i", data, at + 16)
            spaces[uri] = name(prefix)
        elif kind == 0x0102:
            _, tag = struct.unpack_from("<2i", data, at + 16)
            start, width, count = struct.unpack_from("<3H", data, at + 24)
            parts = [name(tag)]
            if depth == 0:
                parts += [f"xmlns:{p}={quoteattr(name(u))}" for u, p in spaces.items()]
            for i in range(count):
                ns, key, raw, _, _, value_kind, value = struct.unpack_from("<3iHBBI", data, at + 16 + start + width * i)
                shown = name(raw) if raw >= 0 else typed_value(value_kind, value, strings)
                parts.append(f"{spaces[ns] + ':' if ns in spaces else ''}{name(key)}={quoteattr(shown)}")
            out.append("  " * depth + "<" + " ".join(parts) + ">")
            depth += 1
        elif kind == 0x0103:
            depth -= 1
            out.append("  " * depth + f"</{name(struct.unpack_from('<i', data, at + 20)[0])}>")
        elif kind == 0x0104:
            out.append("  " * depth + escape(name(struct.unpack_from("<i", data, at + 16)[0])))
        at += size
    return "\n".join(out)
