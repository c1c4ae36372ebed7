"""WARC archives of captured pages, and their globally ordered capture index.

Records are put together as text in DataFrame functions and written by Spark's
text writer, whose line separator is the record's end. Each archive file, read
back, gives a run of captures sorted by URL key and time. The runs are dealt out
by ranges of (URL key, time, page), and within a range a loser tree merges them.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_plus, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, shuffle_partitions

#: Bytes of an archive file's records, about; a file is one task's to read.
FILE_BYTES = 32 << 20
#: Index entries that one merging task holds, about.
RANGE_ROWS = 200_000
MIN_REVISIT_BYTES = 0
NO_PAGE = "<urn:page>"

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = b"\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 8 times 20 bits, 4 letters each."""
    hexed = F.sha1(payload)
    letters = []
    for k in range(8):
        bits = F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(_ALPHABET), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*letters)


def _line(name: str, value: Column) -> Column:
    """A header line; none for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]+", "%0A"), F.lit("\r\n")), F.lit(""))


def archive_records(pages: DataFrame, work: Workspace, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date_col: str | None = None, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(record): a WARC record per row, less its end. Of equal payloads the largest id's is the
    response (several, if rows repeat that id); the others refer to it and have no payload."""
    when = F.col(f"`{date_col}`").cast("timestamp_ntz") if date_col else F.timestamp_add("SECOND", F.coalesce(F.pmod(F.xxhash64(f"`{id_col}`"), F.lit(600_000_000)), F.lit(0)), F.lit("2005-01-01 00:00:00").cast("timestamp_ntz"))
    base = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("payload"), F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"))
    # 256 bits and the length say that payloads are equal
    base = base.select("*", F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("same"))
    groups = base.filter(F.col("n") >= min_revisit_bytes).groupBy(F.col("same").alias("g"), F.col("n").alias("g_n")).agg(F.max("id").alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    groups = work.put(groups.select("g", "g_n", "first"), "equal")
    joined = base.join(groups, (F.col("same") == F.col("g")) & (F.col("n") == F.col("g_n")), "left")
    revisit = F.col("g").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    # ids of any characters; a null one has a name that no id has
    urn = lambda c: F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(c.cast("string")), F.lit(">")), F.lit(NO_PAGE))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        F.when(revisit, F.lit("WARC-Type: revisit\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(F.lit("WARC-Type: response\r\n")),
        _line("WARC-Record-ID", urn(F.col("id"))),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Date", F.col("date")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("payload").cast("binary")))),
        _line("WARC-Refers-To", F.when(revisit, urn(F.col("first")))),
        _line("Payload-Length", F.col("n")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        F.lit("Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return joined.select(F.concat(head, block).alias("record"))


def write_archives(records: DataFrame, path: str, *, mean_bytes: float, file_bytes: int = FILE_BYTES) -> None:
    """Archive files of about ``file_bytes`` under ``path``, compressed with gzip as a whole."""
    per_file = max(1, int(file_bytes / max(1.0, mean_bytes)))
    records.write.option("lineSep", _END.decode()).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record; lengths say where records end, not their content."""
    at = 0
    while at < len(data):
        head = data.index(_END, at)
        lines = data[at:head].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        start = head + len(_END)
        end = start + int(headers["Content-Length"])
        if data[end : end + len(_END)] != _END:
            raise ValueError(f"the record at byte {at} does not end with its length")
        yield at, headers, data[start:end]
        at = end + len(_END)


def url_key(url: str | None) -> str:
    """Sort key of a URL: the host's labels from the last on, then path and query."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return (url or "").strip().lower()
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return (",".join(reversed(host.split("."))) + port + ")" + tail).lower()


def _plain(content: bytes) -> bytes:
    return zlib.decompress(content, 47) if content[:2] == b"\x1f\x8b" else content


_RUN = "run string, offset long, url_key string, capture_time string, page string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string"
_RUN_TYPES = [("run", pa.string()), ("offset", pa.int64()), ("url_key", pa.string()), ("capture_time", pa.string()), ("page", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string())]


def _page_of(urn: str | None) -> str | None:
    return unquote_plus(urn[len("<urn:page:") : -1]) if urn and urn != NO_PAGE else None


def _order(row: tuple) -> tuple:
    """URL key, time, then page: numbers by value, no page first, others as text."""
    page = row[4]
    number = page is not None and page.lstrip("-").isdigit()
    return row[2], row[3], (0, 0, "") if page is None else (1, int(page), "") if number else (2, 0, page), row[0], row[1]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted run of captures for each archive file; payloads are held against their digests."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows = []
            for offset, h, block in parse_records(_plain(content.as_py())):
                payload = block[block.index(_END) + len(_END) :]
                digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["Payload-Length"])
                if h["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                    raise ValueError(f"{path}: the payload at byte {offset} is not what its record says")
                url = h.get("WARC-Target-URI")
                rows.append((path, offset, url_key(url), h["WARC-Date"], _page_of(h["WARC-Record-ID"]), url, h["WARC-Type"], digest, size, _page_of(h.get("WARC-Refers-To"))))
            rows.sort(key=_order)
            for start in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows[start : start + 10_000]), _RUN_TYPES)], [n for n, _ in _RUN_TYPES])


class LoserTree:
    """k sorted runs as one: each inner node keeps the loser of its match, so the next
    least row takes one match on each level."""

    def __init__(self, runs: list[Iterator], key):
        self._runs, self._key = runs, key
        self._heads = [next(r, None) for r in runs]
        self._keys = [None if h is None else key(h) for h in self._heads]
        k = len(runs)
        self._tree = [-1] * max(1, k)
        for leaf in range(k):
            self._play(leaf, build=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._keys[a], self._keys[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, leaf: int, build: bool = False) -> None:
        winner, node = leaf, (leaf + len(self._runs)) // 2
        while node > 0:
            other = self._tree[node]
            if other < 0:
                self._tree[node] = winner
                if build:
                    return
            elif self._beats(other, winner):
                self._tree[node], winner = winner, other
            node //= 2
        self._tree[0] = winner

    def __iter__(self) -> Iterator:
        while self._runs and self._keys[winner := self._tree[0]] is not None:
            yield self._heads[winner]
            self._heads[winner] = head = next(self._runs[winner], None)
            self._keys[winner] = None if head is None else self._key(head)
            self._play(winner)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range, run by run and in the runs' order: merged into one history."""
    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            runs.setdefault(row[0], []).append(row)
    out: list[tuple] = []
    tree = LoserTree([iter(r) for _, r in sorted(runs.items())], _order)

    def made():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), _RUN_TYPES)], [n for n, _ in _RUN_TYPES])

    for row in tree:
        out.append(row)
        if len(out) == 10_000:
            yield made()
            out.clear()
    if out:
        yield made()


def capture_index(spark: SparkSession, path: str, *, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The captures of all archives under ``path`` in global order: by URL key, time, page.

    Partitions hold ascending ranges, each merged from the files' runs; captures
    of one URL may span several, so that a URL of many captures is no hot spot.
    """
    work = Workspace(spark, "index")
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    runs = work.put(files.mapInArrow(_runs, _RUN), "runs")
    n = max(1, -(-runs.count() // range_rows), shuffle_partitions(spark))
    number = F.expr("try_cast(page AS DECIMAL(38,0))")
    dealt = runs.repartitionByRange(n, "url_key", "capture_time", F.col("page").isNotNull(), number.isNull(), number, "page")
    dealt = dealt.sortWithinPartitions("run", "url_key", "capture_time", F.col("page").isNotNull(), number.isNull(), number, "page", "offset")
    return dealt.mapInArrow(_merged, _RUN)


def archive(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date_col: str | None = None, min_revisit_bytes: int = MIN_REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the pages' archives under ``path``, read them back and return their index.

    Columns: page_id (the id's type), url, url_key, capture_time, record_type,
    payload_digest, payload_bytes, refers_to, run, offset. A null html is an
    empty payload, a null url has an empty key, a null id is kept as null; an
    empty table gives an empty index; pages of any length are one record each, and
    repeated rows are captures of their own. Times are those of ``date_col`` or, without
    one, made from the id.
    """
    spark = pages.sparkSession
    work = Workspace(spark, "warc")
    records = archive_records(pages, work, id_col=id_col, url_col=url_col, html_col=html_col, date_col=date_col, min_revisit_bytes=min_revisit_bytes)
    mean = pages.agg(F.avg(F.octet_length(F.coalesce(F.col(f"`{html_col}`"), F.lit(""))))).first()[0] or 0.0
    write_archives(records, path, mean_bytes=mean + 500, file_bytes=file_bytes)
    kind = pages.schema[id_col].dataType
    index = capture_index(spark, path)
    return index.select(F.col("page").cast(kind).alias("page_id"), "url", "url_key", "capture_time", "record_type", "payload_digest", "payload_bytes", F.col("refers_to").cast(kind).alias("refers_to"), "run", "offset")
