"""SimHash near-duplicates, with pigeonring filtering of candidates.

The 64 bits form a ring of ``SEGMENTS`` segments. If two fingerprints differ in
at most ``tau`` bits, then from some segment on every chain of l consecutive
segments has at most l * tau / SEGMENTS differences. The leading segments whose
budget is below one must be equal, so they are the candidates' key; the longer
chains are tested on each candidate pair before the full Hamming distance.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .shared import Workspace, shuffle_partitions, unused

SEGMENTS = 7
SHINGLE_WORDS = 3
MAX_BITS = 2
#: Fingerprints of one key that are compared pair by pair; more go by ``_balls``.
KEY_CAP = 1024

#: Links by similarity: words of a shingle, the least Jaccard similarity, and the bits of
#: 128 in which the SimHashes of two such sets may differ: at 0.8 they differ in 19.4 on
#: average, with a deviation of 4.1; those of unlike sets in 64, with one of 5.7. The bits
#: of sets of few shingles say less and aren't asked.
SET_WORDS = 5
SIMILARITY = 0.8
SET_BITS = 40
SET_SEGMENTS = 4
SMALL_SET = 16
#: Longs that say for each of 64 classes of hashes a long whether a set has an odd number of that class.
ODDS = [f"odd{k}" for k in range(8)]
#: Sets that share a hash from which on it goes behind all others; how many such hashes have bits, and of how many bits.
HOT_KEY, HOT_KEYS, HOT_BITS = 64, 1 << 20, 1 << 25
#: Hashes counted at once, groups of how many times ``HOT_KEY`` sets call for another order, and orders made at most.
COUNTED, HOT_GROUP, HOT_TURNS = 1 << 21, 16, 3
#: Sets of a block, of which a group's are compared two at a time; rows that are walked at once, and pairs held.
BLOCK, GROUP_ROWS, PAIR_ROWS = 4096, 1 << 16, 1 << 20
#: Rows of a few numbers each (tens of bytes) that are broadcast; more are joined by key.
BROADCAST_ROWS = 500_000
#: Rows of numbers that a set to be made weighs, and a pair of sets to be compared.
SET_WEIGHT, PAIR_WEIGHT = 40, 4

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The SimHash of a whole text as an unsigned 64-bit number; no words: 0."""
    found = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    n = len(found)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    if n <= words:
        return digest(b" ".join(found), 42)
    joined = b" ".join(found)
    starts = np.zeros(n + 1, np.int64)
    np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1, out=starts[1:])
    ends = (starts[words:] - 1).tolist()
    total, votes, at = n - words + 1, np.zeros(64, np.int64), starts.tolist()
    for block in range(0, total, 65536):
        stop = min(total, block + 65536)
        hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(at[block:stop], ends[block:stop])), np.uint64, stop - block)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(x.as_py(), words) for x in batch.column(1)]
            signed = np.array(prints, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed), *batch.columns[2:]], ["id", "fp", *batch.schema.names[2:]])

    return run


def segment_bounds(segments: int = SEGMENTS, bits: int = 64) -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    edges = [bits * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def chain_masks(start: int, tau: int, segments: int = SEGMENTS, bits: int = 64) -> list[tuple[int, int]]:
    """(mask, budget) of the chains from segment ``start``, those first whose budget changes."""
    bounds, mask, out = segment_bounds(segments, bits), 0, []
    for length in range(1, segments + 1):
        first, width = bounds[(start + length - 1) % segments]
        mask |= ((1 << width) - 1) << first
        out.append((mask, length * tau // segments))
    # of chains with the same budget the longest implies the others
    return [x for x, after in zip(out, [*out[1:], (0, -1)]) if x[1] != after[1]]


def _key_masks(tau: int, segments: int) -> list[int]:
    return [chain_masks(i, tau, segments)[0][0] for i in range(segments)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def linked(prints: np.ndarray, start: int, tau: int = MAX_BITS, segments: int = SEGMENTS) -> np.ndarray:
    """For fingerprints that agree on a key: which pairs pass all chains and the full distance."""
    x = prints[:, None] ^ prints[None, :]
    ok = np.ones(x.shape, bool)
    for mask, budget in chain_masks(start, tau, segments):
        ok &= np.bitwise_count(x & np.uint64(mask)) <= budget
    return ok & (np.bitwise_count(x) <= tau)


def _star_edges(prints: np.ndarray, start: int, tau: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each print to the smallest one that links reach inside the key's group."""
    ok = linked(prints, start, tau, segments)
    label = np.arange(len(prints))
    while True:
        new = np.where(ok, label[None, :], len(prints)).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(prints))
    return prints[own], prints[label[own]]


def _groups(tau: int, segments: int):
    """Rows sorted by (part, key, fp): stream the groups of a key, emit their links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = key = fp = np.empty(0, np.int64)

        def links(part, key, fp):
            cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(part) != 0)) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, len(key)]
            us, vs = [], []
            for i in np.flatnonzero(ends - starts > 1):
                a, b = starts[i], ends[i]
                u, v = _star_edges(fp[a:b].view(np.uint64), int(part[a]), tau, segments)
                if len(u):
                    us.append(u.view(np.int64))
                    vs.append(v.view(np.int64))
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

        for batch in batches:
            part, key, fp = (np.concatenate([old, np.asarray(new).astype(np.int64)]) for old, new in zip((part, key, fp), batch.columns))
            if not len(key):
                continue
            last = np.flatnonzero((key != key[-1]) | (part != part[-1]))
            end = last[-1] + 1 if len(last) else 0
            if end:
                yield from links(part[:end], key[:end], fp[:end])
                part, key, fp = part[end:], key[end:], fp[end:]
        if len(key):
            yield from links(part, key, fp)

    return run


def _balls(prints: DataFrame) -> DataFrame:
    """Links among any number of fingerprints: two differ in at most 2 bits if and
    only if some 64-bit value is within 1 bit of both; a value has 65 such
    neighbours at most, so no group here is large."""
    flips = [F.lit(0).cast("long"), *[F.lit(_signed(1 << i)).cast("long") for i in range(64)]]
    near = prints.select("fp", F.explode(F.array(*flips)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"))
    least = near.groupBy("centre").agg(F.min("fp").alias("v"), F.count("*").alias("n")).filter("n > 1")
    return near.join(least, "centre").filter("fp <> v").select(F.col("fp").alias("u"), "v")


def hamming_links(prints: DataFrame, work: Workspace, *, tau: int = MAX_BITS, segments: int = SEGMENTS, key_cap: int = KEY_CAP) -> DataFrame:
    """Edges (u, v) among distinct fingerprints (column fp) that connect whatever
    links of at most ``tau`` bits connect."""
    spark = prints.sparkSession
    keyed = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key")) for i, m in enumerate(_key_masks(tau, segments))]))
    keys = prints.select("fp", keyed.alias("k")).select("k.part", "k.key", "fp")
    hot = work.put(keys.groupBy("part", "key").count().filter(F.col("count") > key_cap).select("part", "key"), "hot_keys")
    any_hot = bool(hot.limit(1).count())
    cold = keys.join(hot, ["part", "key"], "left_anti") if any_hot else keys
    dealt = cold.repartition(shuffle_partitions(spark), "part", "key").sortWithinPartitions("part", "key", "fp")
    edges = dealt.mapInArrow(_groups(tau, segments), "u long, v long")
    if any_hot:
        if tau > 2:
            raise ValueError(f"a key has over {key_cap} fingerprints; raise key_cap for tau over 2")
        edges = edges.unionByName(_balls(keys.join(hot, ["part", "key"], "left_semi").select("fp").distinct()))
    return edges


def _hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _resolved(docs: DataFrame, text_col: str, id_col: str, mark: Column | None, words: int, tau: int, segments: int, key_cap: int) -> tuple[DataFrame, DataFrame, Workspace]:
    """rows (id, fp, mark) and, by fingerprint, (class_fp, root, component_id)."""
    work = Workspace(docs.sparkSession, "simhash")
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), (mark if mark is not None else F.lit(0)).alias("mark"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType()), base.schema["mark"]])
    rows = work.put(base.mapInArrow(_fingerprints(words), schema), "prints")
    classes = work.put(rows.groupBy("fp").agg(F.min("id").alias("first_id")), "classes")
    edges = hamming_links(classes.select("fp"), work, tau=tau, segments=segments, key_cap=key_cap)
    roots = work.put(connected_components(edges, work), "roots")
    with_root = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id", F.col("root").isNotNull().alias("linked"))
    named = with_root.filter("linked").groupBy(F.col("root").alias("r")).agg(F.min("first_id").alias("linked_id"))
    final = with_root.join(named, with_root["root"] == named["r"], "left").select(F.col("fp").alias("class_fp"), "root", F.coalesce("linked_id", "first_id").alias("component_id"))
    return rows, work.put(final, "components"), work


def simhash_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", *, words: int = SHINGLE_WORDS, tau: int = MAX_BITS, segments: int = SEGMENTS, key_cap: int = KEY_CAP) -> DataFrame:
    """One row per input row: ``id_col, fingerprint, component_id``.

    Fingerprints link at ``tau`` or fewer differing bits; component_id is the
    smallest id reachable over links, the row's own included. Null and wordless
    texts have fingerprint zero and link like others. Null ids are passed over
    by the minimum (null if the component has no other); repeated rows are each
    returned; other columns are ignored.
    """
    rows, final, _ = _resolved(docs, text_col, id_col, None, words, tau, segments, key_cap)
    return rows.join(final, rows["fp"] == final["class_fp"], "left").select(F.col("id").alias(id_col), _hex(F.col("fp")).alias("fingerprint"), "component_id")


# --- links by the similarity of shingle sets


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Hashes of the distinct shingles, sorted; fewer words: of the whole sequence; none: empty."""
    found = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    digest, n = xxhash.xxh64_intdigest, max(1, len(found) - words + 1)
    return np.unique(np.fromiter((digest(b" ".join(found[i : i + words]), 42) for i in range(n)), np.uint64, n)) if found else np.empty(0, np.uint64)


def _set_print(hashes: np.ndarray) -> np.ndarray:
    """SimHash of 128 bits, as two longs: of the hashes, and of the hashes mixed once more."""
    other = (hashes ^ hashes >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    other = (other ^ other >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    both = np.stack([hashes, other ^ other >> np.uint64(31)], axis=1)
    votes = np.unpackbits(both.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.int64)


def odd_classes(hashes: np.ndarray) -> np.ndarray:
    """For each class of hashes (by the highest bits) whether there is an odd number of them, as longs of bits.

    Two sets differ in at least one hash of each class in which these bits differ.
    """
    places = 64 * len(ODDS)
    counts = np.bincount((hashes >> np.uint64(64 - (places - 1).bit_length())).astype(np.int64), minlength=places)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64)


def share(similarity: float) -> float:
    """The least overlap of two sets of this Jaccard similarity, as a share of the sum of their sizes."""
    return similarity / (1 + similarity)


def least_overlap(n: int, similarity: float) -> int:
    return math.ceil(similarity * n - 1e-9)


def _behind(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each hash has its bit set."""
    at = (hashes & np.uint64(HOT_BITS - 1)).astype(np.int64)
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1


def _sketches(words: int, similarity: float, bits=None, names: Sequence[str] = ("id", "mark", "node", "n", "fp", "fp2", "prefix")):
    """The columns ``names`` of id, mark, node, n, fp, fp2, prefix and ``ODDS``: a set's hash, size, SimHash, first hashes and odd classes.

    Two sets of Jaccard similarity s have a hash in common among the first
    n - ceil(s n) + 1 of each, in any order that all sets share: here those without
    their bit in ``bits`` (a broadcast) come first, then by value.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py(), words) for x in batch.column(1)]
            ordered = sets if bits is None else [x[np.argsort(_behind(x, bits.value), kind="stable")] for x in sets]
            heads = [x[: len(x) - least_overlap(len(x), similarity) + 1] for x in ordered]
            ends = np.r_[0, np.cumsum([len(x) for x in heads])].astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(heads).view(np.int64)))
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            prints = np.array([_set_print(s) for s in sets], np.int64).reshape(-1, 2)
            columns = {"id": batch.column(0), "mark": batch.column(2), "node": pa.array(node), "n": pa.array([len(s) for s in sets], pa.int32()), "fp": pa.array(prints[:, 0]), "fp2": pa.array(prints[:, 1]), "prefix": prefix}
            if ODDS[0] in names:
                odds = np.array([odd_classes(s) for s in sets], np.int64).reshape(-1, len(ODDS))
                columns |= {c: pa.array(odds[:, k]) for k, c in enumerate(ODDS)}
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], list(names))

    return run


def _repeated(words: int):
    """(key, n) of the hashes that some thousand sets have more than once, of all texts in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], ["key", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.append(shingle_set(text.as_py(), words))
                size += len(held[-1])
                if size > COUNTED:
                    yield out()
                    held, size = [], 0
        yield out()

    return run


def passes_chains(a: tuple[Column, Column], b: tuple[Column, Column], tau: int, segments: int = SET_SEGMENTS) -> Column:
    """Whether, of 128 bits, from some segment on all chains are within their budgets, and all bits within ``tau``."""
    low, high = a[0].bitwiseXOR(b[0]), a[1].bitwiseXOR(b[1])

    def within(mask: int, budget: int) -> Column:
        parts = [F.bit_count(x.bitwiseAND(F.lit(_signed(m)))) for x, m in ((low, mask & (1 << 64) - 1), (high, mask >> 64)) if m]
        return reduce(lambda p, q: p + q, parts) <= budget

    starts = [reduce(lambda p, q: p & q, [within(m, k) for m, k in chain_masks(i, tau, segments, 128)]) for i in range(segments)]
    return reduce(lambda p, q: p | q, starts) & (F.bit_count(low) + F.bit_count(high) <= tau)


def _jaccard(similarity: float):
    """Pairs (u, v, a, b) of packed sets that reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def _packed(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(x.as_py(), words).tobytes() for x in batch.column(1)], pa.binary())], ["node", "content"])

    return run


def _few(table: DataFrame) -> DataFrame:
    """A written table of numbers, to be broadcast if its rows are few."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _owned_texts(base: DataFrame, owners: DataFrame) -> DataFrame:
    """(node, text) of the rows that stand for their sets: ``owners`` has node, own_id, own_mark."""
    return base.join(_few(owners), F.col("id").eqNullSafe(F.col("own_id")) & (F.col("mark") == F.col("own_mark"))).dropDuplicates(["node"]).select("node", "text")


def _members(base: DataFrame, schema: T.StructType, work: Workspace, words: int, similarity: float, hot_key: int) -> tuple[DataFrame, DataFrame]:
    """(rows, members): the sketches, and (key, node, rest) of the first hashes that more than one set has.

    By least hash alone a common passage brings all texts that have it together. So
    hashes that over ``hot_key`` sets have go to the end of the order. They are
    counted where a few thousand texts have them more than once, and exactly where
    groups are still large after that, and known by a bit each in a table of fixed
    size: what it takes for one of them by chance stands at the end, too, which does no
    harm, since all sets go by the same table. At most ``HOT_KEYS``, the most frequent, have bits.

    ``rest`` is how many hashes a set has from the key on. The first key that two sets
    share has all of their overlap behind it, so a member whose rest can't hold the
    overlap with the group's smallest set isn't needed there: such pairs meet at a key before.
    """
    spark = work.spark
    counted = base.select("text").mapInArrow(_repeated(words), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > hot_key)
    bits = np.zeros(HOT_BITS // 8, np.uint8)

    def mark(keys: DataFrame) -> int:
        """Set the bits of the most frequent keys; how many were new."""
        found = np.array([r[0] for r in keys.orderBy(F.desc("n"), "key").limit(HOT_KEYS).select("key").toLocalIterator()], np.int64).view(np.uint64)
        new = found[_behind(found, bits) == 0]
        at = (new & np.uint64(HOT_BITS - 1)).astype(np.int64)
        np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        return len(new)

    mark(counted)
    for turn in range(HOT_TURNS):
        rows = work.put(base.mapInArrow(_sketches(words, similarity, spark.sparkContext.broadcast(bits.copy()), schema.names), schema), f"sketches{turn}")
        keys = rows.select(F.posexplode("prefix").alias("at", "key"), "node", F.col("n").alias("size"))
        shared = work.put(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("size").alias("least")).filter("n > 1"), f"shared{turn}")
        if turn + 1 == HOT_TURNS or not mark(shared.filter(F.col("n") > HOT_GROUP * hot_key)):
            break
        work.drop(f"sketches{turn}")
    rest = F.col("size") - F.col("at")
    kept = keys.join(_few(shared.select("key", "least")), "key").filter(rest >= (F.col("size") + F.col("least")) * share(similarity) - 1e-6)
    return rows, work.put(kept.select("key", "node", rest.alias("rest")).distinct(), "members")


def _pairs_in_groups(similarity: float, tau: int, small: int, best: int | None):
    """Pairs (u, v) of sets with different roots in a group that may be similar by sizes, places, odd classes and SimHashes.

    Rows (key, i, j, block, node, n, fp, fp2, root, rest, ``ODDS``) sorted by the first three, which
    make a group of at most two blocks; of two blocks only pairs across them count.
    Sizes, places and odd classes are bounds that no similar pair passes, so what
    comes out is little more than the similar pairs.
    ``best``: of each set only so many pairs, the nearest, so that they are no more than the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def solve(c: np.ndarray) -> Iterator[pa.RecordBatch]:
            key, i, j, block, node, n, root, rest = (c[:, k] for k in (0, 1, 2, 3, 4, 5, 8, 9))
            fp, odd = c[:, 6:8].view(np.uint64), np.ascontiguousarray(c[:, 10:]).view(np.uint64)
            cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            group = np.repeat(np.arange(len(cut)), np.diff(np.r_[cut, len(c)]))
            found: list[np.ndarray] = []

            def taken() -> np.ndarray:
                every = np.concatenate(found) if found else np.empty((0, 3), np.int64)
                # a pair of several groups counts once
                every = every[np.lexsort((every[:, 1], every[:, 0]))]
                every = every[np.r_[True, (every[1:, :2] != every[:-1, :2]).any(axis=1)][: len(every)]]
                if best is None:
                    return every
                # each set's nearest, from both sides of a pair
                own, far, pair = np.r_[every[:, 0], every[:, 1]], np.tile(every[:, 2], 2), np.tile(np.arange(len(every)), 2)
                rank = np.lexsort((far, own))
                first = np.maximum.accumulate(np.where(np.r_[True, np.diff(own[rank]) != 0][: len(rank)], np.arange(len(rank)), 0))
                return every[np.unique(pair[rank[np.arange(len(rank)) - first < best]])]

            size = 0
            for d in range(1, len(c)):
                x = np.flatnonzero(group[d:] == group[:-d])
                if not len(x):
                    break
                y = x + d
                ok = (root[x] != root[y]) & ((i[x] == j[x]) | (block[x] != block[y])) & (np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-9)
                ok &= np.minimum(rest[x], rest[y]) >= share(similarity) * (n[x] + n[y]) - 1e-6
                x, y = x[ok], y[ok]
                far = np.bitwise_count(fp[x] ^ fp[y]).sum(axis=1, dtype=np.int64)
                ok = (far <= tau) | (np.maximum(n[x], n[y]) <= small)
                x, y, far = x[ok], y[ok], far[ok]
                apart = np.bitwise_count(odd[x] ^ odd[y]).sum(axis=1, dtype=np.int64)
                ok = apart <= (1 - 2 * share(similarity)) * (n[x] + n[y]) + 1e-6
                if ok.any():
                    x, y = x[ok], y[ok]
                    found.append(np.column_stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y]), far[ok]]))
                    size += len(x)
                    if size > PAIR_ROWS:
                        kept = taken()
                        if best is None:
                            yield emit(kept)
                            found, size = [], 0
                        else:
                            found, size = [kept], 0
            yield emit(taken())

        def emit(pairs: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

        for batch in batches:
            held.append(np.column_stack([x.to_numpy(zero_copy_only=False).astype(np.int64) for x in batch.columns]))
            if sum(map(len, held)) >= GROUP_ROWS:
                c = np.concatenate(held)
                last = int(np.flatnonzero((c[:, :3] != c[-1, :3]).any(axis=1))[-1]) + 1 if (c[:, :3] != c[-1, :3]).any() else 0
                if last:
                    yield from solve(c[:last])
                held = [c[last:]]
        c = np.concatenate(held) if held else np.empty((0, 10 + len(ODDS)), np.int64)
        if len(c):
            yield from solve(c)

    return run


def similar_components(docs: DataFrame, text_col: str, id_col: str, work: Workspace, *, words: int, similarity: float, tau: int, small: int, hot_key: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(rows, roots): rows (id, mark, node), and (node, root) of the sets that links connect.

    Sets that share one of their first hashes are a group. First each set of a group
    is compared with one leader, which connects most copies; then, in the groups
    that are still of several roots, every pair of sets with different roots whose
    sizes and SimHashes allow it: each set's nearest first, twice, and at last all others.
    So no pair of different roots is left out but those whose SimHashes differ in
    over ``tau`` of 128 bits (sets of up to ``small`` shingles are never judged by them).
    Groups are walked in blocks of ``block`` sets, two at a time.
    """
    mark = F.xxhash64(F.col(f"`{text_col}`"))
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), mark.alias("mark"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("mark", T.LongType()), T.StructField("node", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("fp2", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType())), *[T.StructField(c, T.LongType()) for c in ODDS]])
    rows, members = _members(base, schema, work, words, similarity, hot_key)
    nodes, shared = members.select("node").distinct(), members.count()
    # of a set's rows one stands for it; these are the texts that may have to be compared
    owners = rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("id", "mark")).alias("who"), *[F.first(c).alias(c) for c in ("n", "fp", "fp2", *ODDS)])
    owners = work.put(owners.select("node", "n", "fp", "fp2", *ODDS, F.col("who.id").alias("own_id"), F.col("who.mark").alias("own_mark")), "owners", rows=shared)
    prints = owners.select("node", "n", "fp", "fp2")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        many = pairs.count()
        wanted = work.put(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), f"{name}-nodes", rows=2 * many)
        texts = _owned_texts(base, owners.select("node", "own_id", "own_mark").join(_few(wanted), "node", "left_semi"))
        sets = work.put(texts.mapInArrow(_packed(words), "node long, content binary"), f"{name}-sets", rows=SET_WEIGHT * wanted.count())
        both = pairs.join(sets.select(F.col("node").alias("u"), F.col("content").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("content").alias("b")), "v")
        found = work.put(both.select("u", "v", "a", "b").mapInArrow(_jaccard(similarity), "u long, v long"), f"{name}-links", rows=PAIR_WEIGHT * many)
        work.drop(f"{name}-sets")
        return found

    def joined(links: DataFrame, name: str) -> DataFrame:
        inner = Workspace(work.spark, "similar-components")
        out = work.put(connected_components(links, inner, many := links.count()), f"{name}-roots", rows=2 * many)
        inner.drop_all_but()
        return out

    # one leader a group, the same for all groups of near copies
    order = F.struct(F.xxhash64("node"), F.col("node"))
    leaders = members.groupBy("key").agg(F.min_by("node", order).alias("lead"))
    stars = members.join(leaders, "key").filter("node <> lead").select("node", "lead").distinct()
    at = stars.join(_few(prints), "node").join(_few(prints.select(*[F.col(c).alias(f"lead_{c}") for c in prints.columns])), F.col("lead") == F.col("lead_node"))
    sizes = F.least("n", "lead_n") >= F.greatest("n", "lead_n") * similarity - 1e-9
    near = (F.greatest("n", "lead_n") <= small) | passes_chains((F.col("fp"), F.col("fp2")), (F.col("lead_fp"), F.col("lead_fp2")), tau)
    pairs = work.put(at.filter(sizes & near).select(F.least("node", "lead").alias("u"), F.greatest("node", "lead").alias("v")).distinct(), "star-pairs", rows=shared)
    links = verified(pairs, "star")
    roots = joined(links, "star")
    tested = pairs
    for name, best in (("nearest", 2), ("further", 4), ("all", None)):
        rooted = members.join(_few(roots), "node", "left").select("key", "node", "rest", F.coalesce("root", "node").alias("root"))
        mixed = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("sets")).filter("a < b")
        mixed = work.put(mixed.select("key", F.ceil(F.col("sets") / block).cast("int").alias("blocks")), f"{name}-mixed", rows=shared)
        if mixed.isEmpty():
            break
        # rows this wide aren't broadcast: the driver would hold them
        dealt = rooted.join(_few(mixed), "key").join(owners.select("node", "n", "fp", "fp2", *ODDS), "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        other = F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")
        dealt = dealt.select("*", other).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "fp", "fp2", "root", "rest", *ODDS)
        dealt = dealt.repartition(shuffle_partitions(work.spark), "key", "i", "j").sortWithinPartitions("key", "i", "j")
        pairs = dealt.mapInArrow(_pairs_in_groups(similarity, tau, small, best), "u long, v long").distinct()
        pairs = work.put(pairs.join(tested, ["u", "v"], "left_anti"), f"{name}-pairs", rows=best and best * shared)
        tested = tested.unionByName(pairs)
        found = verified(pairs, name)
        if not found.isEmpty():
            links = links.unionByName(found)
            roots = joined(links, name)
    work.drop_all_but(*(name for name in work.names if name.startswith("sketches") or name.endswith("-roots")))
    return rows.select("id", "mark", "node"), roots


def keep_similar_representatives(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", *, words: int = SET_WORDS, similarity: float = SIMILARITY, tau: int = SET_BITS, small: int = SMALL_SET, hot_key: int = HOT_KEY, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, all columns, less all of a component but its smallest id.

    Documents link where the Jaccard similarity of their sets of ``words``-word
    shingles is ``similarity`` or more. Null and wordless texts have the empty set
    and are one document; so are rows equal in id and text, all of which stay or
    go; a null id gives way to others; of equal ids with different texts the one
    with the least hash stays. Texts of any length are read whole, columns of any
    name are kept, and an empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "similar")
    rows, roots = similar_components(docs, text_col, id_col, work, words=words, similarity=similarity, tau=tau, small=small, hot_key=hot_key, block=block)
    placed = rows.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), F.struct(F.col("id").isNull().alias("none"), "id", "mark").alias("who"))
    return _without_copies(docs, text_col, id_col, placed, work)


def _without_copies(docs: DataFrame, text_col: str, id_col: str, placed: DataFrame, work: Workspace) -> DataFrame:
    """``docs`` without the rows of ``placed`` (root, who: none, id, mark) that aren't their root's first."""
    mark = F.xxhash64(F.col(f"`{text_col}`"))
    groups = placed.groupBy(F.col("root").alias("r")).agg(F.min("who").alias("first"), F.max("who").alias("last")).filter(~F.col("first").eqNullSafe(F.col("last"))).select("r", "first")
    gone = placed.join(groups, placed["root"] == groups["r"]).filter(~F.col("who").eqNullSafe(F.col("first")))
    gone_id, gone_mark = unused(docs.columns, "_gone_id", "_gone_mark")
    gone = work.put(gone.select(F.col("who.id").alias(gone_id), F.col("who.mark").alias(gone_mark)).distinct(), "gone")
    return docs.join(gone, docs[f"`{id_col}`"].eqNullSafe(gone[gone_id]) & (mark == gone[gone_mark]), "left_anti")


def keep_representatives(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", *, words: int = SHINGLE_WORDS, tau: int = MAX_BITS, segments: int = SEGMENTS, key_cap: int = KEY_CAP) -> DataFrame:
    """The rows of ``docs``, all columns, less all of a component but its smallest id.

    Rows equal in id and text count as one document; a null id gives way to others.
    """
    mark = F.xxhash64(F.col(f"`{text_col}`"))
    rows, final, work = _resolved(docs, text_col, id_col, mark, words, tau, segments, key_cap)
    placed = rows.join(final, rows["fp"] == final["class_fp"]).select("root", F.struct(F.col("id").isNull().alias("none"), "id", "mark").alias("who"))
    return _without_copies(docs, text_col, id_col, placed, work)
