"""Files read in ranges: the same rows for every cut, whatever the guesses of a range."""

import random
import struct

import pytest

from millrace.sources import packets, ranges


def pcap(frames, order="<", digits=6, tail=b""):
    magic = 0xA1B2C3D4 if digits == 6 else 0xA1B23C4D
    head = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    return head + b"".join(struct.pack(order + "4I", 1000 + i, i, len(f), len(f) + i % 3) + f for i, f in enumerate(frames)) + tail


def block(kind, body, order="<"):
    body += bytes(-len(body) % 4)
    return struct.pack(order + "2I", kind, 12 + len(body)) + body + struct.pack(order + "I", 12 + len(body))


def section(frames, order, links):
    out = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1), order)
    out += b"".join(block(1, struct.pack(order + "HHI", link, 0, 65535), order) for link in links)
    for i, f in enumerate(frames):
        out += block(6, struct.pack(order + "5I", i % len(links), 0, i, len(f), len(f)) + f, order) if i % 4 else block(3, struct.pack(order + "I", len(f)) + f, order)
    return out


def payloads():
    """Noise, zeros, whole captures as payloads, and one packet that is longer than many ranges."""
    rng = random.Random(6)
    some = [rng.randbytes(rng.randrange(0, 60)) for _ in range(40)]
    inner = pcap([b"x" * 20] * 12)
    return some[:20] + [bytes(300), inner, inner[24:], section([b"y" * 9] * 12, "<", [1]), rng.randbytes(2500)] + some[20:] + [b""]


def plain_pcap(data, order):
    at, out = 24, []
    while at + 16 <= len(data):
        sec, frac, captured, original = struct.unpack_from(order + "4I", data, at)
        if captured > len(data) - at - 16:
            break
        out.append((len(out) + 1, sec, captured, at, data[at + 16 : at + 16 + captured]))
        at += 16 + captured
    return out, None if at == len(data) else at


def plain_blocks(data):
    at, order, out, sections = 0, "<", [], 0
    while at + 12 <= len(data):
        if data[at : at + 4] == b"\n\r\r\n":
            if at + 28 > len(data):
                break
            order = ">" if data[at + 8 : at + 12] == b"\x1a\x2b\x3c\x4d" else "<"
        kind, length = struct.unpack_from(order + "2I", data, at)
        if length < 12 or at + length > len(data):
            break
        sections += kind == 0x0A0D0D0A
        out.append((len(out) + 1, sections, packets.BLOCKS.get(kind, f"Unknown 0x{kind:08x}"), length, at))
        at += length
    return out, None if at == len(data) else at


def by_ranges(path, data, size, guess, walk, kinds, rows_of):
    """What the Spark jobs do, without Spark."""
    cuts = [(str(path), len(data), i, low, min(low + size, max(len(data), 1))) for i, low in enumerate(range(0, max(len(data), 1), size))]
    names = [c.split()[0] for c in ranges.INDEX.split(", ")]
    walked = [ranges.walked(dict(zip(names, c)), guess, walk, kinds) for c in cuts]
    index = [dict(zip(names, r)) for r in ranges.stitched(walked, walk, kinds)]
    return [row for r in index for row in rows_of(r)], walked, index


PCAPS = [("<", 6, b""), (">", 9, b""), ("<", 6, b"\1\2\3"), ("<", 6, struct.pack("<4I", 1, 1, 10_000, 10_000) + bytes(700))]


@pytest.mark.parametrize("order, digits, tail", PCAPS)
def test_captures_are_the_same_for_every_cut(tmp_path, order, digits, tail):
    data = pcap(payloads(), order, digits, tail)
    path = tmp_path / "a.pcap"
    path.write_bytes(data)
    want, stopped = plain_pcap(data, order)
    sizes = [*range(20, 400, 7), 401, 1000, 2999, len(data) - 1, len(data), len(data) + 1, 1 << 20]
    for size in sizes:
        got, _, _ = by_ranges(path, data, size, packets._pcap_guess, packets._pcap_walk, 1, packets._frames)
        rows = [(r[1], r[2], r[5], r[7], r[9]) for r in got if r[1]]
        assert rows == want, size
        problems = [r[7] for r in got if not r[1]]
        assert problems == ([] if stopped is None else [stopped]), size


def test_blocks_are_the_same_for_every_cut(tmp_path):
    some = payloads()
    for name, data in {
        "a": section(some, "<", [1, 101]) + section(some[::-1], ">", [113]) + section(some[:5], "<", [1]),
        "b": section(some, ">", [1]) + b"\0\0\0\0\1\0\0\0rest",
        "c": b"not a capture at all, but long enough for some ranges",
        "d": b"",
    }.items():
        path = tmp_path / f"{name}.pcapng"
        path.write_bytes(data)
        want, stopped = plain_blocks(data)
        for size in [*range(30, 300, 11), 1000, 2999, len(data) + 1]:
            got, _, _ = by_ranges(path, data, size, packets._block_guess, packets._block_walk, 2, packets._blocks)
            assert [(r[1], r[2], r[3], r[4], r[7]) for r in got if r[1]] == want, (name, size)
            assert [r[7] for r in got if not r[1] and r[7] is not None] == ([] if stopped is None else [stopped])


def test_most_guesses_are_right(tmp_path):
    """Of an ordinary capture no range is walked twice, and the walk reads each byte about once."""
    rng = random.Random(1)
    data = pcap([rng.randbytes(rng.randrange(40, 1400)) for _ in range(3000)])
    path = tmp_path / "a.pcap"
    path.write_bytes(data)
    _, walked, index = by_ranges(path, data, 50_000, packets._pcap_guess, packets._pcap_walk, 1, packets._frames)
    assert len(index) > 40 and all(w[5] == i["start"] for w, i in zip(walked, index))


def test_read_in_ranges(spark, tmp_path):
    some = [bytes(12) + b"\x08\x00" + p for p in payloads()]
    (tmp_path / "p").mkdir()
    (tmp_path / "n").mkdir()
    for i in range(2):
        (tmp_path / "p" / f"{i} x.pcap").write_bytes(pcap(some[i:]))
        (tmp_path / "n" / f"{i}.pcapng").write_bytes(section(some, "<", [1, 101]) + section(some[::-1], ">", [113]))
    (tmp_path / "p" / "other.pcap").write_bytes(b"no capture")
    tables = lambda r: {k: sorted(map(str, t.collect())) for k, t in {**r.tables, "summary": r.summary, "warnings": r.warnings}.items()}
    whole = tables(packets.read_pcap(spark, str(tmp_path / "p")))
    assert len(whole["packets"]) == 2 * len(some) - 1 and len(whole["warnings"]) == 1
    assert tables(packets.read_pcap(spark, str(tmp_path / "p"), range_bytes=700)) == whole
    whole = tables(packets.read_pcapng(spark, str(tmp_path / "n")))
    assert len(whole["interfaces"]) == 6 and len(whole["packets"]) == 4 * len(some)
    assert tables(packets.read_pcapng(spark, str(tmp_path / "n"), range_bytes=900)) == whole
    got = packets.read_pcapng(spark, str(tmp_path / "n"), range_bytes=900)
    assert got.tables["packets"].filter("protocol = 'Ethernet'").count() == packets.read_pcapng(spark, str(tmp_path / "n")).tables["packets"].filter("protocol = 'Ethernet'").count()
