"""WARC archives and their capture index.

Archives are WARC/1.1 files of bounded size with a gzip member for each record, so a capture's offset can be sought. Spark's text
writer writes them (so to any store that Spark reaches): a member's last byte, the top byte of its length, is 0 and stands as the line
separator. Reading parses members and headers and checks digests. Each archive yields a sorted run of captures; runs are merged FAN
at a time with loser trees, cut at common bounds of (URL key, timestamp, record), and each range merges its runs in the same way, so
that range after range the capture histories are in global order.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, broadcast_if_small, keyed_join, materialize, new_path

#: Payload bytes of one archive file, captures in one range of the merged index, and ranges at most (their bounds are all that the driver
#: holds; with more than four billion captures ranges are longer, and a task still merges them as a stream).
ARCHIVE_BYTES, RANGE, MAX_RANGES = 12_000_000, 20_000, 200_000
#: Runs that one loser tree merges.
FAN = 32
INDEX = "url_key string, timestamp string, page_id long, record long, record_type string, refers_to long, payload_digest string, payload_bytes long, archive string, offset long"
#: Pages carry no time: record n is dated n seconds after this.
EPOCH = datetime(2000, 1, 1)
_FIELDS = [x.split() for x in INDEX.split(", ")]
_KINDS = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in _FIELDS])


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, lower case, without scheme, www and fragment."""
    m = re.match(r"(?:[^:/?#]*://)?([^/?#]*)([^#]*)", url or "")
    host = re.sub(r"^www\d*\.", "", m[1].lower()).rpartition("@")[2]
    return ",".join(reversed(host.split("."))) + ")" + (m[2] or "/")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def planned(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, payload_sha1 (hex), payload_bytes, record_type and refers_to of pages (page_id, url, html).

    Among payloads that are equal and have at least `least` bytes, rows with the smallest page_id are responses (repeated rows too) and
    the others revisit it. Rows with a null page_id are responses and never referred to. Null html is an empty payload. Extra columns
    are left out, payloads of any length are taken whole, and an empty table gives an empty one.
    """
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"payload_sha1": F.sha1("html"), "payload_bytes": F.octet_length("html").cast("long")})
    firsts = rows.where(F.col("payload_bytes") >= least).groupBy("payload_sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = materialize(firsts, "warc-firsts")
    copies = firsts.agg(F.sum("n")).first()[0] or 0
    rows = keyed_join(rows, firsts, "payload_sha1", "n", copies, "left")
    revisit = F.coalesce(F.col("first") < F.col("page_id"), F.lit(False))
    return rows.select("page_id", "url", "html", "payload_sha1", "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def _record(page_id, url, html: bytes, sha1: str, size: int, kind: str, refers) -> bytes:
    """A record with its closing blank lines. Line ends in a URL become %0D and %0A."""
    stamp = (EPOCH + timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = b"" if kind == "revisit" else html
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {stamp}",
        "" if url is None else "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
        f"X-Payload-Length: {size}",
        f"WARC-Refers-To: <urn:page:{refers}>" if kind == "revisit" else "",
        "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if kind == "revisit" else "",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(x for x in head if x).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """record as a gzip member whose last byte is 0 (an empty member follows where the length's top byte is not)."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = pack.compress(record) + pack.flush()
    return out if out[-1] == 0 else out + member(b"")


def write_archives(pages: DataFrame, path: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes pages as WARC files (gzip members) of about archive_bytes of payload each into the folder path. Cases as in planned()."""
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        cols = [c.to_pylist() for c in b.columns]
        return pa.RecordBatch.from_arrays([pa.array([member(_record(*x))[:-1] for x in zip(*cols, strict=True)], pa.binary())], names=["value"])

    parts = max(1, -(-total // archive_bytes))
    rows = planned(pages, least).repartition(parts, F.xxhash64("page_id", "url", "payload_sha1"))
    arrow_map(rows, f, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member."""
    at, view, step = 0, memoryview(data), 1 << 15
    while at < len(data):
        unpack, parts, end = zlib.decompressobj(31), [], at
        while not unpack.eof:
            if end >= len(data):
                raise ValueError(f"gzip member at {at} is cut off")
            parts.append(unpack.decompress(view[end : end + step]))
            end += step
        yield at, b"".join(parts)
        at = min(end, len(data)) - len(unpack.unused_data)


def parse_archive(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset of its member, headers, block) of each record."""
    for at, record in members(data):
        if not record:
            continue
        end = record.index(b"\r\n\r\n")
        lines = record[:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        if len(record) != end + 4 + size + 4:
            raise ValueError(f"record at {at} has another length")
        yield at, head, record[end + 4 : end + 4 + size]


def _id(urn: str | None) -> int | None:
    return int(urn[10:-1]) if urn and urn[10:-1] else None


def runs(spark, path: str) -> DataFrame:
    """One row per archive: its captures as a sorted run (Arrow bytes)."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            rows = []
            for k, (at, head, block) in enumerate(parse_archive(data)):
                kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"][5:]
                if kind == "response" and base32_sha1(block) != digest:
                    raise ValueError(f"{name}: payload at {at} has another digest")
                size = len(block) if kind == "response" else int(head["X-Payload-Length"])
                stamp = re.sub(r"\D", "", head["WARC-Date"])
                rows.append((url_key(head.get("WARC-Target-URI")), stamp, _id(head["WARC-Record-ID"]), k, kind, _id(head.get("WARC-Refers-To")), digest, size, name, at))
            rows.sort(key=_order)
            out.append(_to_bytes(rows))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["archive", "run"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
    return arrow_map(files, f, "archive string, run binary")


def _order(x: tuple) -> tuple:
    return (x[0], x[1], -1 if x[2] is None else x[2], x[8], x[3])


def _to_bytes(rows: list[tuple]) -> bytes:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(_FIELDS)
    t = pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS.types, strict=True)], schema=_KINDS)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _KINDS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def _from_bytes(data: bytes) -> Iterator[tuple]:
    with pa.ipc.open_stream(data) as r:
        for b in r:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


class LoserTree:
    """Merges k sorted iterators: each inner node keeps the loser of its match, so the next smallest costs log2(k) comparisons."""

    def __init__(self, sources: list[Iterator[tuple]]):
        self.k = k = len(sources)
        self.sources = sources
        self.heads = [next(s, None) for s in sources]
        self.keys = [None if h is None else _order(h) for h in self.heads]
        self.losers = [-1] * k
        for i in range(k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and self.keys[a] is not None
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            if self.losers[node] < 0:  # its other side has not come yet
                self.losers[node] = winner
                return
            if self._less(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (head := self.heads[w := self.losers[0]]) is not None:
            yield head
            self.heads[w] = nxt = next(self.sources[w], None)
            self.keys[w] = None if nxt is None else _order(nxt)
            self._play(w)


def merged(sources: list[Iterator[tuple]], fan: int = FAN) -> Iterator[tuple]:
    """All sources in order, by loser trees of at most fan sources each, in levels."""
    while len(sources) > fan:
        sources = [iter(LoserTree(sources[k : k + fan])) for k in range(0, len(sources), fan)]
    return iter(LoserTree(sources))


def merged_index(runs_: DataFrame, in_range: int = RANGE) -> DataFrame:
    """The captures of all runs (materialized) in global order: range, place in it, history (place among those of its URL key in the range), and the fields of INDEX.

    Bounds between ranges come from a sample of every run that grows with the number of captures: one key in about in_range / 100.
    """

    def sample(b: pa.RecordBatch) -> pa.RecordBatch:
        keys = [_order(x) for data in b.column(1).to_pylist() for x in _every(_from_bytes(data), max(1, in_range // 100))]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in keys], pa.string()), pa.array([x[1] for x in keys], pa.string()), pa.array([x[2] for x in keys], pa.int64())], names=["k", "t", "p"])

    spark = runs_.sparkSession
    drawn = materialize(arrow_map(runs_, sample, "k string, t string, p long"), "warc-sample")
    n = drawn.count()
    parts = max(1, -(-n * max(1, in_range // 100) // in_range))
    bounds = []
    if parts > 1:
        ranked = drawn.repartitionByRange(min(parts, MAX_RANGES), "k", "t", "p").sortWithinPartitions("k", "t", "p")
        bounds = sorted((r.k, r.t, r.p) for r in arrow_map(ranked, lambda b: b.slice(b.num_rows - 1, 1), "k string, t string, p long").collect())[:-1]
    shared = spark.sparkContext.broadcast(bounds)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for b in batches:
            for data in b.column(1).to_pylist():
                held.append(data)
                if len(held) == FAN:
                    yield _pieces(merged([_from_bytes(d) for d in held]), shared.value)
                    held = []
        if held:
            yield _pieces(merged([_from_bytes(d) for d in held]), shared.value)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, list[bytes]] = {}
        for b in batches:
            for r, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                groups.setdefault(r, []).append(data)
        for r in sorted(groups):
            rows, place, key, seen = [], 0, None, 0
            for x in merged([_from_bytes(d) for d in groups[r]]):
                key, seen = x[0], seen + 1 if x[0] == key else 0
                rows.append((r, place, seen, *x))
                place += 1
                if len(rows) == 5000:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)

    dealt = runs_.mapInArrow(cut, "range long, run binary").repartitionById(len(bounds) + 1, F.col("range").cast("int"))
    return dealt.mapInArrow(merge, f"range long, place long, history long, {INDEX}")


def _pieces(captures: Iterator[tuple], limits: list[tuple]) -> pa.RecordBatch:
    """A sorted run, cut at limits: (range, run)."""
    out: list[tuple[int, bytes]] = []
    own: list[tuple] = []
    r = 0
    for x in captures:
        while r < len(limits) and _order(x)[:3] > limits[r]:
            if own:
                out.append((r, _to_bytes(own)))
            own, r = [], r + 1
        own.append(x)
    if own:
        out.append((r, _to_bytes(own)))
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["range", "run"])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), *_KINDS.types]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["range", "place", "history", *_KINDS.names])


def _every(rows: Iterator[tuple], step: int) -> Iterator[tuple]:
    for k, x in enumerate(rows):
        if k % step == 0:
            yield x


def with_history(index: DataFrame) -> DataFrame:
    """index (materialized) with history: the capture's place (from 0) among those of its url_key, over all ranges.

    Ranges count their own keys in order; a key that goes on from range to range is carried over by one row per range.
    """
    ends = index.groupBy("range").agg(F.min("url_key").alias("first"), F.max("url_key").alias("last"))
    sizes = index.groupBy("range", "url_key").agg(F.count("*").alias("n"))
    ends = materialize(ends.join(sizes, "range").where("url_key = last").select("range", "first", "last", "n"), "warc-ends")
    # Ranges before this one that end with the key: all of its captures there stand before those here.
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    told = ends.select("range", F.col("last").alias("key"), "n").union(ends.select("range", F.col("first").alias("key"), F.lit(0).cast("long").alias("n")))
    told = told.groupBy("range", "key").agg(F.max("n").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where("before > 0")
    told = materialize(told.select(F.col("range").alias("r"), F.col("key").alias("u"), "before"), "warc-carried")
    out = index.join(broadcast_if_small(told), (F.col("range") == F.col("r")) & (F.col("url_key") == F.col("u")), "left")
    return out.select(*index.columns[:2], (F.col("history") + F.coalesce("before", F.lit(0))).alias("history"), *index.columns[3:])


def op10_warc(spark, sf_dir):
    path = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    index = with_history(materialize(merged_index(materialize(runs(spark, path), "warc-runs")), "warc-index"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp", "history")


OP10_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') h, sha1(coalesce(html, '')) s FROM pages),
k AS (SELECT *, regexp_extract(coalesce(url, ''), '^(?:[^:/?#]*://)?([^/?#]*)([^#]*)', ['host', 'rest']) u FROM p),
f AS (SELECT *, list_reverse(string_split(regexp_extract(regexp_replace(lower(u.host), '^www\d*\.', ''), '([^@]*)$', 1), '.')) labels,
 min(page_id) OVER (PARTITION BY s) AS least FROM k),
r AS (SELECT *, array_to_string(labels, ',') || ')' || CASE WHEN u.rest = '' THEN '/' ELSE u.rest END url_key FROM f)
SELECT page_id::BIGINT page_id, strlen(h)::BIGINT payload_bytes,
 array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(s, (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') payload_digest,
 CASE WHEN least < page_id THEN 'revisit' ELSE 'response' END record_type, CASE WHEN least < page_id THEN least END::BIGINT refers_to, url_key,
 strftime(TIMESTAMP '2000-01-01' + to_seconds(page_id % 1000000000), '%Y%m%d%H%M%S') AS "timestamp",
 (row_number() OVER (PARTITION BY url_key ORDER BY page_id % 1000000000, page_id) - 1)::BIGINT history FROM r
"""

