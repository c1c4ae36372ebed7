"""Catalogs of array files: MAT and HDF5."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .files import binaries, parsed

#: The format's storage types (struct code, name) and array classes.
MI = {1: ("b", "miINT8"), 2: ("B", "miUINT8"), 3: ("h", "miINT16"), 4: ("H", "miUINT16"), 5: ("i", "miINT32"), 6: ("I", "miUINT32"), 7: ("f", "miSINGLE"), 9: ("d", "miDOUBLE"), 12: ("q", "miINT64"), 13: ("Q", "miUINT64"), 14: ("", "miMATRIX"), 15: ("", "miCOMPRESSED"), 16: ("B", "miUTF8"), 17: ("H", "miUTF16"), 18: ("I", "miUTF32")}
MX = {1: "cell", 2: "struct", 3: "object", 4: "char", 5: "sparse", 6: "double", 7: "single", 8: "int8", 9: "uint8", 10: "int16", 11: "uint16", 12: "int32", 13: "uint32", 14: "int64", 15: "uint64"}
V4 = {0: "d", 1: "f", 2: "i", 3: "h", 4: "H", 5: "B"}
HDF5_MAGIC = b"\x89HDF\r\n\x1a\n"
HDF5_CLASSES = ("Integer", "Float", "Time", "String", "Bitfield", "Opaque", "Compound", "Reference", "Enum", "VarLen", "Array")
PREVIEW_VALUES = 24
MAX_DEPTH = 64

_MAT = "name string, class string, size string, storage string, n_bytes long, attributes string, preview string"


def significant(x: float) -> str:
    """A number with eight significant digits at most."""
    return str(int(x)) if float(x).is_integer() and abs(x) < 1e15 else f"{x:.8g}"


def _tag(data: bytes, at: int, e: str) -> tuple[int, int, int, int]:
    """(type, bytes, start of data, next tag)."""
    kind, n = struct.unpack_from(e + "2I", data, at)
    if kind >> 16:
        return kind & 0xFFFF, kind >> 16, at + 4, at + 8
    return kind, n, at + 8, at + 8 + n + (-n % 8 if kind != 15 else 0)


def _values(raw: bytes, code: str, e: str) -> list:
    width = struct.calcsize(code)
    n = min(len(raw) // width, PREVIEW_VALUES)
    return list(struct.unpack_from(f"{e}{n}{code}", raw)) if n else []


def _matrix(data: bytes, e: str, size: int) -> tuple:
    at, parts = 0, []
    while at + 8 <= len(data) and len(parts) < 4:
        kind, n, start, at = _tag(data, at, e)
        parts.append((kind, data[start : start + n]))
    flags = struct.unpack_from(e + "I", parts[0][1])[0]
    name_at = 2
    shape = struct.unpack(f"{e}{len(parts[1][1]) // 4}i", parts[1][1])
    name = parts[name_at][1].decode("latin-1")
    kind = MX.get(flags & 0xFF, "unknown")
    attributes = [label for bit, label in ((0x800, "complex"), (0x400, "global"), (0x200, "logical")) if flags & bit]
    storage, preview = None, None
    if len(parts) > 3 and kind not in ("cell", "struct", "object", "sparse"):
        mi, raw = parts[3]
        code, storage = MI.get(mi, ("", None))
        if kind == "char" and code:
            preview = '"' + "".join(map(chr, _values(raw, code, e))) + '"'
        elif code:
            preview = ", ".join(significant(v) for v in _values(raw, code, e))
    return name, kind, " x ".join(map(str, shape)), storage, size, ", ".join(attributes) or None, preview


def _mat5(data: bytes) -> Iterator[tuple]:
    e = "<" if data[126:128] == b"IM" else ">"
    at = 128
    while at + 8 <= len(data):
        kind, n, start, after = _tag(data, at, e)
        body = data[start : start + n]
        if kind == 15:
            body = zlib.decompress(body)
            kind, m, inner, _ = _tag(body, 0, e)
            body = body[inner : inner + m]
        if kind == 14:
            yield _matrix(body, e, n)
        at = after


def _mat4(data: bytes) -> Iterator[tuple]:
    def read(e: str) -> list[tuple]:
        at, rows = 0, []
        while at + 20 <= len(data):
            mopt, m, n, imaginary, length = struct.unpack_from(e + "5i", data, at)
            precision, text = mopt // 10 % 10, mopt % 10
            if not (0 <= mopt <= 4052 and precision in V4 and 0 < length <= 1024 and m >= 0 and n >= 0):
                break
            width = struct.calcsize(V4[precision]) * m * n * (2 if imaginary else 1)
            start = at + 20 + length
            if start + width > len(data):
                break
            values = _values(data[start : start + width // (2 if imaginary else 1)], V4[precision], e)
            shown = '"' + "".join(chr(int(v)) for v in values) + '"' if text == 1 else ", ".join(significant(v) for v in values)
            rows.append((data[at + 20 : start].rstrip(b"\0").decode("latin-1"), "char" if text == 1 else "sparse" if text == 2 else "numeric", f"{m} x {n}", f"MOPT {mopt}", width, "complex" if imaginary else None, shown))
            at = start + width
        return rows

    yield from max((read("<"), read(">")), key=len)


def _mat(data: bytes) -> Iterator[tuple]:
    if data[:8] == HDF5_MAGIC or data[512:520] == HDF5_MAGIC:
        for path, kind, shape, dtype, width in hdf5_entries(data):
            if kind == "dataset":
                yield path.lstrip("/"), "hdf5", " x ".join(map(str, shape)), dtype, width, None, None
    elif data[126:128] in (b"IM", b"MI"):
        yield from _mat5(data)
    else:
        yield from _mat4(data)


def read_mat(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, class, size, storage, n_bytes, attributes, preview) of the variables."""
    return parsed(binaries(spark, path), "content", _mat, _MAT)


class Hdf5:
    """Groups and datasets of a file by its object headers; contents are not read."""

    def __init__(self, data: bytes):
        self.data = data
        self.base = next((at for at in (0, 512, 1024, 2048) if data[at : at + 8] == HDF5_MAGIC), -1)
        if self.base < 0:
            raise ValueError("no HDF5 signature")
        version = data[self.base + 8]
        self.version = version
        if version < 2:
            self.offsets, self.lengths = data[self.base + 13], data[self.base + 14]
            at = self.base + (24 if version == 0 else 28) + 4 * self.offsets
            self.root = self._number(at + self.offsets, self.offsets)
        else:
            self.offsets, self.lengths = data[self.base + 9], data[self.base + 10]
            self.root = self._number(self.base + 12 + 3 * self.offsets, self.offsets)

    def _number(self, at: int, width: int) -> int:
        return int.from_bytes(self.data[at : at + width], "little")

    def messages(self, address: int) -> Iterator[tuple[int, int, int]]:
        """(type, start, bytes) of an object header's messages, continuations included."""
        d, at = self.data, self.base + address
        if d[at : at + 4] == b"OHDR":
            flags = d[at + 5]
            at += 6 + (16 if flags & 0x20 else 0) + (4 if flags & 0x10 else 0)
            width = 1 << (flags & 3)
            size, at = self._number(at, width), at + width
            blocks, head = [(at, at + size)], 6 if flags & 4 else 4
            while blocks:
                at, end = blocks.pop(0)
                while at + head <= end:
                    kind, n = d[at], self._number(at + 1, 2)
                    if kind == 16:
                        start, size = self.base + self._number(at + head, self.offsets), self._number(at + head + self.offsets, self.lengths)
                        blocks.append((start + 4, start + size - 4))
                    elif kind:
                        yield kind, at + head, n
                    at += head + n
            return
        if d[at] != 1:
            return
        blocks = [(at + 16, at + 16 + self._number(at + 8, 4))]
        while blocks:
            at, end = blocks.pop(0)
            while at + 8 <= end:
                kind, n = self._number(at, 2), self._number(at + 2, 2)
                if kind == 16:
                    start = self.base + self._number(at + 8, self.offsets)
                    blocks.append((start, start + self._number(at + 8 + self.offsets, self.lengths)))
                elif kind:
                    yield kind, at + 8, n
                at += 8 + n

    def _symbols(self, tree: int, heap: int) -> Iterator[tuple[str, int]]:
        d = self.data
        text = self.base + self._number(self.base + heap + 8 + 2 * self.lengths, self.offsets)
        todo = [tree]
        while todo:
            at = self.base + todo.pop(0)
            if d[at : at + 4] == b"TREE":
                n = self._number(at + 6, 2)
                first = at + 8 + 2 * self.offsets + self.lengths
                todo += [self._number(first + i * (self.offsets + self.lengths), self.offsets) for i in range(n)]
            elif d[at : at + 4] == b"SNOD":
                size = 2 * self.offsets + 24
                for i in range(self._number(at + 6, 2)):
                    entry = at + 8 + i * size
                    start = text + self._number(entry, self.offsets)
                    yield d[start : d.index(b"\0", start)].decode("utf-8", "replace"), self._number(entry + self.offsets, self.offsets)

    def _link(self, at: int) -> tuple[str, int] | None:
        d, flags = self.data, self.data[at + 1]
        at += 2
        kind = 0
        if flags & 8:
            kind, at = d[at], at + 1
        at += (8 if flags & 4 else 0) + (1 if flags & 16 else 0)
        width = 1 << (flags & 3)
        n, at = self._number(at, width), at + width
        name = d[at : at + n].decode("utf-8", "replace")
        return (name, self._number(at + n, self.offsets)) if kind == 0 else None

    def _type(self, at: int) -> tuple[str, int]:
        kind, width = self.data[at] & 15, self._number(at + 4, 4)
        name = HDF5_CLASSES[kind] if kind < len(HDF5_CLASSES) else "Unknown"
        return f"{name}{8 * width}" if kind < 2 else name, width

    def _shape(self, at: int) -> list[int]:
        version, rank = self.data[at], self.data[at + 1]
        first = at + (8 if version == 1 else 4)
        return [self._number(first + i * self.lengths, self.lengths) for i in range(rank)]

    def entries(self) -> Iterator[tuple]:
        """(path, kind, shape, type, element bytes), depth first; an object inside itself is left out."""
        stack = [("/", self.root, ())]
        while stack:
            path, address, above = stack.pop()
            if address in above or len(above) > MAX_DEPTH:
                continue
            shape, dtype, width, children, group = [], None, None, [], False
            for kind, at, _ in self.messages(address):
                if kind == 1:
                    shape = self._shape(at)
                elif kind == 3:
                    dtype, width = self._type(at)
                elif kind == 17:
                    group = True
                    children += self._symbols(self._number(at, self.offsets), self._number(at + self.offsets, self.offsets))
                elif kind == 6 and (link := self._link(at)):
                    group = True
                    children.append(link)
                elif kind in (2, 10):
                    group = True
            yield path, "dataset" if dtype and not group else "group", shape, dtype, width
            for name, to in sorted(children, reverse=True):
                stack.append((f"{path.rstrip('/')}/{name}", to, (*above, address)))


def hdf5_entries(data: bytes) -> Iterator[tuple]:
    yield from Hdf5(data).entries()


def read_hdf5(spark: SparkSession, path: str) -> DataFrame:
    """(file, path, kind, shape, dtype, element_bytes) of groups and datasets."""
    return parsed(binaries(spark, path), "content", hdf5_entries, "path string, kind string, shape array<long>, dtype string, element_bytes int")
