"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of WINDOW item words (an item with fewer words is one shorter window). Patterns of one length share
their tables: SHIFT by a block of two words (one for single-word patterns) tells how many positions can be skipped, the
block that ends a pattern selects its bucket, the block that starts it those patterns of the bucket that are compared, word by
word, to confirm. Tables hold benchmark data only; a benchmark beyond TABLE_WORDS words is searched in several passes of
items, each a written table, so that a worker holds the tables of one pass.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, binary, materialize

WINDOW = 8
#: Benchmark words in the tables of one pass (about 100 bytes each in a worker).
TABLE_WORDS = 1_000_000
#: Word bytes: 0-9, a-z after lower-casing, and all of multi-byte characters; all others become spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class WuManber:
    """Search for patterns (tuples of words) of one length in a list of words."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[int]]):
        self.m = m = len(next(iter(patterns)))
        self.block = min(2, m)
        self.skip = m - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = defaultdict(dict)
        for p in patterns:
            for end in range(self.block, m + 1):
                key = p[0] if self.block == 1 else (p[end - 2], p[end - 1])
                self.shift[key] = min(self.shift.get(key, self.skip), m - end)
            self.bucket[key].setdefault(p[: self.block], []).append(p)
        self.items = patterns

    def find(self, w: list[bytes]) -> list[tuple[int, tuple[bytes, ...]]]:
        """(first word, pattern) of every occurrence."""
        found, m, skip, shift, n = [], self.m, self.skip, self.shift.get, len(w)
        i = m - 1
        if self.block == 1:
            return [(i, (x,)) for i, x in enumerate(w) if x in self.shift]
        while i < n:
            s = shift((w[i - 1], w[i]), skip)
            if s:
                i += s
                continue
            here = tuple(w[i - m + 1 : i + 1])
            for p in self.bucket[(w[i - 1], w[i])].get(here[: self.block], ()):
                if p == here:
                    found.append((i - m + 1, p))
            i += 1
        return found


def tables(items: list[tuple[int, bytes | None]], window: int = WINDOW) -> list[WuManber]:
    """One matcher per pattern length."""
    by: dict[int, dict[tuple[bytes, ...], list[int]]] = defaultdict(dict)
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1) if w else ():
            owners = by[size].setdefault(tuple(w[i : i + size]), [])
            if item not in owners[-1:]:
                owners.append(item)
    return [WuManber(p) for _, p in sorted(by.items())]


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema=None) -> DataFrame:
    """docs plus (or with other) hits (one byte per word: 1 inside an occurrence), items (sorted ids of items that occur) and n_words.

    Null or wordless texts: no words, no items. Items that are null, wordless or have a null id match nothing; repeated items count once,
    and with an empty benchmark nothing is hit. Repeated rows of docs are searched each, texts of any length whole; columns of docs with
    these three names are replaced, all others kept. then: what becomes of each batch of the result (of that schema), in the same worker.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), binary().alias("body")).where("item_id is not null")
    total = bench.agg(F.sum(F.size(F.split(F.col("body").cast("string"), "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+")))).first()[0] or 0
    passes = max(1, -(-total // TABLE_WORDS))
    keep = [c for c in docs.columns if c not in ("hits", "items", "n_words")]
    docs_ = docs.select(*keep).withColumn("hits", F.lit(None).cast("binary")).withColumn("items", F.array().cast("array<long>")).withColumn("n_words", F.lit(0).cast("long"))
    for part in range(passes):
        own = sorted((r.item_id, bytes(r.body)) for r in bench.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == part).collect())
        shared = spark.sparkContext.broadcast(own)
        if part < passes - 1:
            docs_ = materialize(_one_pass(docs_, shared, window, keep), "decontamination")
        else:
            docs_ = _one_pass(docs_, shared, window, keep, then, schema)
    return docs_


_TABLES: dict = {}


def _one_pass(docs: DataFrame, shared, window: int, keep: list[str], then=None, schema=None) -> DataFrame:
    body = docs.columns.index("text")
    at = {c: docs.columns.index(c) for c in ("hits", "items")}
    key = uuid.uuid4().hex

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        if key not in _TABLES:
            _TABLES.clear()
            _TABLES[key] = tables(shared.value, window)
        matchers = _TABLES[key]
        hits, items, counts = [], [], []
        for text, had, were in zip(b.column(body).cast(pa.binary()).to_pylist(), b.column(at["hits"]).to_pylist(), b.column(at["items"]).to_pylist(), strict=True):
            w = words(text)
            mark, own = np.zeros(len(w), np.uint8) if had is None else np.frombuffer(had, np.uint8).copy(), set(were)
            for m in matchers:
                for i, p in m.find(w):
                    mark[i : i + m.m] = 1
                    own.update(m.items[p])
            hits.append(mark.tobytes())
            items.append(sorted(own))
            counts.append(len(w))
        cols = [b.column(i) for i in range(len(keep))] + [pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.int64())), pa.array(counts, pa.int64())]
        out = pa.RecordBatch.from_arrays(cols, names=[*keep, "hits", "items", "n_words"])
        return out if then is None else then(out)

    return arrow_map(docs, f, docs.schema if then is None else schema)


def remove_hits(text: str, hits: bytes) -> str:
    """text without the words marked in hits; what stands between two of them goes too."""
    raw = text.encode()
    folded = raw.translate(_FOLD)
    at, spans = 0, []
    for k, w in enumerate(folded.split()):
        i = folded.index(w, at)
        at = i + len(w)
        if hits[k]:
            if spans and spans[-1][2] == k - 1:
                spans[-1][1:] = [at, k]
            else:
                spans.append([i, at, k])
    out, last = [], 0
    for i, j, _ in spans:
        out.append(raw[last:i])
        last = j
    return b"".join([*out, raw[last:]]).decode()


DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def digest(found: pa.RecordBatch, limit: int = 2) -> pa.RecordBatch:
    """DIGEST of a batch of search()."""
    items, hits = found.column("items").to_pylist(), found.column("hits").to_pylist()
    sha = [hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for x in items]
    n = [len(x) for x in items]
    cols = [found.column("doc_id").cast(pa.int64()), found.column("n_words"), pa.array([x.count(1) for x in hits], pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array([x >= limit for x in n], pa.bool_())]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in DIGEST.split(", ")])


def op2_decontamination(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(docs.select("doc_id", "text"), bench, then=digest, schema=DIGEST)


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT item_id, least(8, len(w)) k, unnest(range(1, len(w) - least(8, len(w)) + 2)) i, w FROM b WHERE len(w) > 0),
pat AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') s FROM bw),
lens AS (SELECT DISTINCT k FROM pat),
dw AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) i, w FROM d, lens WHERE len(w) >= k),
occ AS (SELECT dw.doc_id, dw.i, dw.k, item_id FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') s FROM dw) dw JOIN pat USING (k, s)),
hit AS (SELECT doc_id, count(*) n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) p FROM (SELECT DISTINCT doc_id, i, k FROM occ)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) n_items, string_agg(x, ',' ORDER BY x) ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR x FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_items, 0) >= 2 contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
