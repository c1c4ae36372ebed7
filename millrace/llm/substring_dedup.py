"""Removal of long byte strings that occur more than once, with suffix arrays.

Every string of ``window`` bytes picks one of its grams, that with the least
hash; equal strings pick equal grams, so occurrences of a repeated string always
meet under the gram's hash. A run of neighbouring strings with the same pick is
one segment. Segments whose gram occurs once are done with; the others, each
distinct content once with its number of occurrences, are put together in
shards by gram, and a shard's suffix array and permuted common prefixes tell
exactly which strings of ``window`` bytes occur again. A gram with more segments
than a group may hold has them cut by the place that the gram has in a string:
strings of one range of places share more bytes than the gram, and are grouped
by those. The ranges are halved until every group is small.

In a periodic stretch (one letter, a ruler, zeros in base64) each string occurs
again a period further on, and its picks change with every period: such a stretch
is marked at once, and only the strings of its first period become segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, shuffle_partitions
from .suffix_array import permuted_lcp, suffix_array

WINDOW = 400
GRAM = 160
#: Bytes of a shard, and of the segments that are compared as one group, at most.
SHARD_BYTES = 1 << 20
GROUP_BYTES = 1 << 18
#: Longest stretch whose picks are made at once, and bytes of shorter texts that are hashed together.
STRETCH, TOGETHER = 4 << 20, 1 << 18

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("p", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("p", _P), ("q", _P_INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["p"][:n], _POWERS["q"][:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each position on (polynomial, modulo 2^64, then mixed)."""
    p, q = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p, out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * q[: len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(rows, axis=1).ravel()
    return np.minimum(ahead[: n - width + 1], behind[width - 1 : n])


def _periodic(raw: np.ndarray, h: np.ndarray, first: np.ndarray, last: np.ndarray, place: np.ndarray, window: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which segments to keep, and (first, last) start of periodic stretches whose strings all occur again.

    Where equal grams are picked at equal distances the bytes repeat with that
    period, if comparing them says so. A stretch has two periods of starts at least;
    the strings of its first period stand for all of them.
    """
    step = np.diff(place)
    same = np.flatnonzero((h[1:] == h[:-1]) & (step > 0))
    keep, found = np.ones(len(h), bool), []
    if not len(same):
        return keep, found
    fresh = np.r_[True, (np.diff(same) > 1) | (step[same][1:] != step[same][:-1])]
    begins = np.flatnonzero(fresh)
    for i, j in zip(begins, np.r_[begins[1:], len(same)] - 1):
        p, x, y = int(step[same[i]]), int(same[i]), int(same[j]) + 1
        a, b = int(first[x]), int(last[y])
        if b - a + 1 < 3 * p or not np.array_equal(raw[a : b + window - p], raw[a + p : b + window]):
            continue
        found.append((a, b))
        keep[x : y + 1] &= first[x : y + 1] < a + p
    return keep, found


def segments(data: bytes, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(gram hash, first start, last start, place of the gram) of the runs of strings with the same pick.

    A place of -1 says that all strings of the run are known to occur again.
    """
    n = len(data)
    if n < window:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    raw, parts = np.frombuffer(data, np.uint8), []
    for start in range(0, n - window + 1, STRETCH):
        h = gram_hashes(raw[start : start + STRETCH + window - 1], gram)
        at = np.arange(len(h), dtype=np.uint64)
        picked = _sliding_min((h >> np.uint64(23) << np.uint64(23)) | at, window - gram + 1) & np.uint64((1 << 23) - 1)
        cut = np.flatnonzero(np.diff(picked)) + 1
        first, last = np.r_[0, cut], np.r_[cut, len(picked)] - 1
        place = picked[first].astype(np.int64)
        keep, known = _periodic(raw[start:], h[place], first, last, place, window)
        parts.append((h[place[keep]], first[keep] + start, last[keep] + start, place[keep] + start))
        if known:
            a, b = np.array(known, np.int64).T
            parts.append((np.zeros(len(a), np.uint64), a + start, b + start, np.full(len(a), -1, np.int64)))
    return tuple(np.concatenate(x) for x in zip(*parts))


def segments_of(texts: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(number of the text, *``segments``) of texts that are hashed as one; of a string over a text's end nothing is kept."""
    none = (np.empty(0, np.int64), *segments(b"", window, gram))
    ends = np.cumsum([len(x) for x in texts], dtype=np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    if len(raw) < window:
        return none
    h = gram_hashes(raw, gram)
    picked = _sliding_min((h >> np.uint64(23) << np.uint64(23)) | np.arange(len(h), dtype=np.uint64), window - gram + 1) & np.uint64((1 << 23) - 1)
    inside = np.ones(len(picked), bool)
    for end in ends.tolist():
        inside[max(0, end - window + 1) : end] = False
    valid = np.flatnonzero(inside)
    if not len(valid):
        return none
    own = picked[valid].astype(np.int64)
    cut = np.flatnonzero(np.diff(own)) + 1
    first, last, place = valid[np.r_[0, cut]], valid[np.r_[cut, len(valid)] - 1], own[np.r_[0, cut]]
    of, keys = np.searchsorted(ends, first, "right"), h[place]
    base = np.r_[0, ends][of]
    found = [of, keys, first - base, last - base, place - base]
    # equal grams in a row may be a period, which is looked at text by text
    again = np.unique(of[1:][(keys[1:] == keys[:-1]) & (of[1:] == of[:-1])])
    if len(again):
        rest = ~np.isin(of, again)
        alone = [(np.full(len(x[0]), i, np.int64), *x) for i in again.tolist() for x in [segments(texts[i], window, gram)]]
        found = [np.concatenate([x[rest], *y]) for x, y in zip(found, zip(*alone))]
    return tuple(found)


def _anchors(window: int, gram: int):
    def rows(uids: list[int], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        of, h, lo, hi, at = segments_of(texts, window, gram) if len(texts) > 1 else (None, *segments(texts[0], window, gram))
        if len(h):
            uid = np.array(uids, np.int64)[of] if of is not None else np.full(len(h), uids[0], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(h.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (lo, hi, at))], ["uid", "h", "lo", "hi", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids: list[int] = []
            texts: list[bytes] = []
            size = 0
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = text.as_py() or b""
                if texts and size + len(data) > TOGETHER:
                    yield from rows(uids, texts)
                    uids, texts, size = [], [], 0
                uids.append(uid)
                texts.append(data)
                size += len(data)
            if texts:
                yield from rows(uids, texts)

    return run


def _cut_out(window: int, memory: int = 500_000):
    """References of segments and, for the first of equal ones in a task, their content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for uid, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data = text.as_py()
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for x in found:
                    content = data[x["lo"] : x["hi"] + window]
                    key = hashlib.blake2b(content, digest_size=16).digest()
                    rows = [("ref", uid, x["lo"], key, None, None)]
                    if key not in seen:
                        if len(seen) > memory:
                            seen.clear()
                        seen.add(key)
                        rows.append(("segment", x["h"], x["at"] - x["lo"], key, len(content), content))
                    for row in rows:
                        for column, value in zip(out, row):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary()))], ["kind", "a", "at", "key", "bytes", "content"])

    return run


def _cut_by_place(window: int, gram: int, width: int):
    """Parts of segments (key, n, at, content) whose strings have the gram in one range of ``width`` places.

    h is the hash of what all strings of that range have in common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        for batch in batches:
            out: tuple[list, ...] = tuple([] for _ in types)
            for owner, n, at, content in zip(*(c.to_pylist() for c in batch.columns)):
                start, last = 0, len(content) - window
                while start <= last:
                    least = (at - start) // width * width
                    most = min(least + width - 1, window - gram)
                    stop = min(last, at - least)
                    common = hashlib.blake2b(content[at - least : at - most + window], digest_size=8, salt=least.to_bytes(8, "big")).digest()
                    part = content[start : stop + window]
                    row = (owner, start, int.from_bytes(common, "big", signed=True), hashlib.blake2b(part, digest_size=16).digest(), n, at - start, len(part), part)
                    for column, value in zip(out, row):
                        column.append(value)
                    start = stop + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["owner", "shift", "h", "key", "n", "at", "bytes", "content"])

    return run


def repeated_starts(contents: list[bytes], counts: list[int], window: int = WINDOW) -> list[np.ndarray]:
    """For each of some distinct strings: where strings of ``window`` bytes start that occur again
    among them, each taken ``counts`` times."""
    lengths = np.array([len(c) for c in contents], np.int64)
    starts = np.r_[0, np.cumsum(lengths + 1)]
    t = np.zeros(starts[-1] + 1, np.uint8)
    rest = np.zeros(len(t), np.int64)
    for c, a, n in zip(contents, starts, lengths):
        t[a : a + n] = np.frombuffer(c, np.uint8) + np.uint8(2)  # UTF-8 has no byte above 0xF4
        t[a + n] = 1
        rest[a : a + n] = np.arange(n, 0, -1)
    sa = suffix_array(t)
    lcp = permuted_lcp(t, sa)
    twice = np.zeros(len(t), bool)
    long = np.flatnonzero(lcp >= window)
    place = np.empty(len(t), np.int64)
    place[sa] = np.arange(len(sa))
    twice[long] = True
    twice[sa[place[long] - 1]] = True
    twice &= rest >= window
    return [np.flatnonzero(twice[a : a + n]) if k < 2 else np.arange(n - window + 1) for a, n, k in zip(starts, lengths, counts)]


def _ranges(at: np.ndarray) -> list[dict]:
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 1) + 1
    return [{"a": int(at[x]), "b": int(at[y - 1])} for x, y in zip(np.r_[0, cut], np.r_[cut, len(at)])]


_RANGES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _shards(window: int, shard_bytes: int):
    """Rows (h, key, n, content) sorted by h, with groups of bounded size. Marks of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple[bytes, int, bytes]] = []
        size = 0

        def emit(keys, marks):
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(marks, _RANGES)], ["key", "marks"])

        def solve():
            if shard:
                found = repeated_starts([c for *_, c in shard], [n for _, n, _ in shard], window)
                some = [(k, x) for (k, *_), x in zip(shard, found) if len(x)]
                yield emit([k for k, _ in some], [_ranges(x) for _, x in some])

        def close(group):
            nonlocal shard, size
            if len(group) == 1:  # nothing to compare with
                key, n, content = group[0]
                if n > 1:
                    yield emit([key], [[{"a": 0, "b": len(content) - window}]])
                return
            shard += group
            size += sum(len(c) for *_, c in group)
            if size >= shard_bytes:
                yield from solve()
                shard, size = [], 0

        group: list[tuple[bytes, int, bytes]] = []
        now = None
        for batch in batches:
            for h, key, n, content in zip(*(c.to_pylist() for c in batch.columns)):
                if h != now:
                    if group:
                        yield from close(group)
                    group, now = [], h
                group.append((key, n, content))
        if group:
            yield from close(group)
        yield from solve()

    return run


def _shifted(marks: str, by: str) -> Column:
    return F.transform(marks, lambda m: F.struct((m["a"] + F.col(by)).alias("a"), (m["b"] + F.col(by)).alias("b"))).alias("marks")


def _marks(found: DataFrame, sizes: DataFrame, work: Workspace, window: int, gram: int, shard_bytes: int, group_bytes: int, width: int) -> DataFrame:
    """(key, marks) of distinct segments ``found`` (h, key, n, at, content), ``sizes`` having (h, bytes) of each.

    Grams whose segments have over ``group_bytes`` are never dealt to one task: they
    are cut into ranges of ``width`` places. Of one place all strings of a group are
    equal, which makes a single segment, so that the halving ends.
    """
    parts = shuffle_partitions(found.sparkSession)
    sums = sizes.groupBy("h").agg(F.sum("bytes").alias("total"), F.count("*").alias("rows"))
    hot = work.put(sums.filter((F.col("total") > group_bytes) & (F.col("rows") > 1)).select("h"), f"hot{width}")
    any_hot = width > 0 and bool(hot.limit(1).count())
    dealt = (found.join(hot, "h", "left_anti") if any_hot else found).select("h", "key", "n", "content").repartition(parts, "h").sortWithinPartitions("h", "key")
    marks = work.put(dealt.mapInArrow(_shards(window, shard_bytes), "key binary, marks array<struct<a:int,b:int>>"), f"solved{width}")
    if not any_hot:
        return marks
    cut = found.join(hot, "h", "left_semi").select("key", "n", "at", "content").mapInArrow(_cut_by_place(window, gram, width), "owner binary, shift int, h long, key binary, n long, at int, bytes int, content binary")
    cut = work.put(cut, f"cut{width}")
    inner = cut.groupBy("key").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("h", "at", "bytes", "content")])
    inner = work.put(inner, f"inner{width}")
    below = _marks(inner, inner.select("h", "bytes"), work, window, gram, shard_bytes, group_bytes, -(-width // 2) if width > 1 else 0)
    return marks.unionByName(cut.select("owner", "shift", "key").join(below, "key").select(F.col("owner").alias("key"), _shifted("marks", "shift")))


def _remaining(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_removed, n_spans, digests = [], [], []
            for text, marks in zip(batch.column(1), batch.column(2).to_pylist()):
                data = text.as_py()
                kept, at, removed, spans = hashlib.sha256(), 0, 0, 0
                end = -1
                for a, b in sorted((m["a"], m["b"] + window) for m in marks):
                    if a > end:
                        spans += 1
                        kept.update(data[at:a])
                        end = at = a
                    if b > end:
                        removed += b - end
                        end = at = b
                kept.update(data[at:])
                n_removed.append(removed)
                n_spans.append(spans)
                digests.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())], ["uid", "n_removed", "n_spans", "kept_sha256"])

    return run


def repeated_spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", *, window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows (uid, id, content, n_bytes, sha), spans (uid, marks: starts of repeated strings)."""
    spark = docs.sparkSession
    work = Workspace(spark, "substrings")
    parts = shuffle_partitions(spark)
    content = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    rows = work.put(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").alias("id"), content.alias("content")).select("*", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha")), "rows")
    long = rows.filter(F.col("n_bytes") >= window)
    anchors = work.put(long.select("uid", "content").mapInArrow(_anchors(window, gram), "uid long, h long, lo int, hi int, at int"), "anchors")
    known = work.put(anchors.filter("at < 0").select("uid", "lo", "hi"), "known")
    anchors = anchors.filter("at >= 0")
    # written, so that the join has two plain sides and a hot gram's rows can be split
    again = work.put(anchors.groupBy("h").count().filter(F.col("count") > 1).select("h"), "again")
    candidates = anchors.join(again, "h").groupBy("uid").agg(F.collect_list(F.struct("h", "lo", "hi", "at")).alias("found"))
    pieces = work.put(long.join(candidates, "uid").select("uid", "content", "found").mapInArrow(_cut_out(window), "kind string, a long, at int, key binary, bytes int, content binary"), "pieces", "kind")
    work.drop("anchors")
    refs = pieces.filter("kind = 'ref'").select(F.col("a").alias("uid"), F.col("at").alias("lo"), "key")
    counts = refs.groupBy("key").agg(F.count("*").alias("n"))
    cut = pieces.filter("kind = 'segment'")
    distinct = cut.groupBy("key").agg(F.first("a").alias("h"), F.first("at").alias("at"), F.first("content").alias("content"))
    sizes = cut.select(F.col("a").alias("h"), "key", "bytes").distinct()
    marks = _marks(distinct.join(counts, "key"), sizes, work, window, gram, shard_bytes, group_bytes, -(-(window - gram + 1) // 2))
    placed = refs.join(marks, "key").select("uid", _shifted("marks", "lo"))
    placed = placed.unionByName(known.select("uid", F.array(F.struct(F.col("lo").alias("a"), F.col("hi").alias("b"))).alias("marks")))
    spans = work.put(placed.groupBy("uid").agg(F.flatten(F.collect_list("marks")).alias("marks")), "spans")
    work.drop_all_but("rows", "spans")
    return rows, spans


def substring_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", *, window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per input row: ``id_col, n_bytes, n_removed, n_spans, kept_sha256``.

    Removed is each byte covered by a string of ``window`` bytes that starts
    anywhere else too, in the same text or another, as the input has them;
    overlaps count. Null texts are empty; repeated rows are occurrences of their
    own; null ids are returned as such; texts of any length are read whole, periodic
    ones included; an empty table gives no rows; other columns are ignored.
    """
    rows, spans = repeated_spans(docs, text_col, id_col, window=window, gram=gram, shard_bytes=shard_bytes, group_bytes=group_bytes)
    work = Workspace(docs.sparkSession, "substrings-out")
    cut = rows.select("uid", "content").join(spans, "uid").select("uid", "content", "marks").mapInArrow(_remaining(window), "uid long, n_removed long, n_spans long, kept_sha256 string")
    cut = work.put(cut, "cut").select(F.col("uid").alias("cut_uid"), "n_removed", "n_spans", "kept_sha256")
    zero = F.lit(0).cast("long")
    return rows.select("uid", "id", "n_bytes", "sha").join(cut, F.col("uid") == F.col("cut_uid"), "left").select(F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
