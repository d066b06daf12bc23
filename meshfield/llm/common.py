"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few dozen bytes that may be broadcast: at most about 20 MB.
BROADCAST_ROWS = 200_000


def own_names(df: DataFrame, *names: str) -> list[str]:
    """names, each with as many _ before it as keep it apart from df's columns (upper and lower case are one)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a folder of our own where that is unset (tests)."""
    sc = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) is None and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: no folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="meshfield-"))
    inner = sc._jsc.sc().getCheckpointDir()
    return (inner.get() if inner.isDefined() else spark.conf.get("spark.checkpoint.dir")).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df must be materialized. Marked for broadcast only if it has at most that many rows; else Spark shuffles both sides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def binary(col: str = "text") -> F.Column:
    """A string column's UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))


#: Bytes of a batch that arrow_map hands over at once (a longer row comes alone): keeps a worker's Python objects small.
SLICE = 2_000_000


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        step = max(1, int(b.num_rows * SLICE / max(b.nbytes, SLICE)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)
        give_back()


def give_back() -> None:
    """Returns what a worker has freed to the system: workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim is not None:
        trim(0)


def tidy(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """f for groups of rows; what it has used goes back to the system."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return f(table)
        finally:
            give_back()

    return run


#: Rows of texts that Spark hands to a worker at once, at most (its own default is 10,000: tens of MB outside the heap for each task).
BATCH_ROWS = 2_000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of rows in a batch where it is higher."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if (out := f(b)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of 64-bit hashes."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Bytes hashed at once (more than LONG_WORD), bytes of a word from which it is hashed on its own, and an odd base with its inverse modulo 2**64.
HASHED, LONG_WORD, BASE = 1 << 20, 256, 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []
_SPACE = re.compile(rb"[\x20\x09-\x0D]").search


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)))) for x in (BASE, pow(BASE, -1, 1 << 64))]
    return _POWERS


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts in order, words of each text): A-Z count as a-z, and \\x20 and \\x09-\\x0D separate words.

    A word's hash is a polynomial of its bytes modulo 2**64 (from sums over prefixes of the whole buffer), mixed with its length; longer words
    than LONG_WORD, for which such polynomials can be made to agree, have xxHash.
    """
    data = b"\n".join(texts).lower() + b"\n"
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    hashes, starts, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(data):
        stop = min(at + HASHED, len(data))
        if stop < len(data):  # a word is never cut
            cut = max(data.rfind(c, at, stop) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f"))
            if cut < at:  # one word beyond all that is hashed at once
                cut = _SPACE(data, stop).start()
                hashes.append(np.array([xxhash.xxh64_intdigest(data[at:cut])], np.uint64))
                starts.append(np.array([at]))
                at = cut + 1
                continue
            stop = cut + 1
        buf = np.frombuffer(data, np.uint8, stop - at, at)
        space = (buf == 32) | ((buf >= 9) & (buf <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
        first, last = edge[::2], edge[1::2]
        power, inverse = _powers(max(HASHED, len(buf)) + 1)
        upto = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=upto[1:])
        size = last - first
        h = mixed((upto[last] - upto[first]) * inverse[first] + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        for k in np.flatnonzero(size > LONG_WORD):
            h[k] = xxhash.xxh64_intdigest(buf[first[k] : last[k]].tobytes())
        hashes.append(h)
        starts.append(first + at)
        at = stop
    counts = np.diff(np.concatenate(([0], np.searchsorted(np.concatenate(starts), ends))))
    return np.concatenate(hashes), counts


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k word hashes, in order."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    out = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return out


def distinct_sorted(x: np.ndarray) -> np.ndarray:
    s = np.sort(x)
    return s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s


#: Keys of which a join broadcasts the rows at most (those with the most rows on the other side).
HOT_KEYS = 100_000


def keyed_join(rows: DataFrame, keyed: DataFrame, key: str, weight: str, total: int, how: str = "inner", *flags: F.Column) -> DataFrame:
    """rows joined with keyed (materialized; one row per key, weight: how many of the total rows have the key), without weight, with flags.

    Small tables are joined by broadcast. Of others, keys with more rows than total / HOT_KEYS (2,000 at least) are, so that no task holds
    all rows of a hot key, and the rest is shuffled; there cannot be more than HOT_KEYS such keys.
    """
    keyed = keyed.select("*", *flags)
    rest = keyed.drop(weight)
    if keyed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(rest), key, how)
    hot = max(2_000, total // HOT_KEYS)
    some = keyed.where(F.col(weight) > hot)
    if some.isEmpty():
        return rows.join(rest, key, how)
    one = rows.join(F.broadcast(some.drop(weight)), key)
    other = rows.join(F.broadcast(some.select(key)), key, "left_anti").join(keyed.where(F.col(weight) <= hot).drop(weight), key, how)
    return one.unionByName(other)


#: Edges of a forest that one task may finish; more go through rounds.
FEW_EDGES = 10_000


def connected_components(edges: DataFrame, name: str = "cc", rounds: int = 40) -> DataFrame:
    """edges (u long, v long), any direction -> (node, label): the smallest node of each component, for nodes that have an edge.

    Alternating large-star and small-star steps. Each worker first contracts its own share to a spanning forest. Every round is a
    written table; the edges of a hub are joined with its one row by broadcast, so they stay where they are.
    """
    e = materialize(contract(edges.select("u", "v").where("u <> v")), name)
    if e.limit(FEW_EDGES + 1).count() <= FEW_EDGES:
        return e.coalesce(1).mapInArrow(_labels, "node long, label long")
    last = None
    for _ in range(rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, name, F.least("u", "m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = materialize(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), name)
        small = _with_least(down, name, F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        own = down.groupBy("u").agg(F.min("v").alias("v"))
        e = materialize(small.union(own).distinct(), name)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not converge")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots.select("node", F.col("node").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))


def _with_least(edges: DataFrame, name: str, least: F.Column) -> DataFrame:
    """edges (u, v) plus m: by least, from the smallest v (as m) of each u."""
    own = materialize(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", least.alias("m"), "n"), name)
    total = own.agg(F.sum("n")).first()[0] or 0
    return keyed_join(edges, own, "u", "n", total)


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, smallest node of its component) of all edges of one task."""
    parts = [[b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)] for b in batches if b.num_rows]
    if parts:
        u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = components(len(nodes), at[: len(u)], at[len(u) :])
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[label], pa.int64())], names=["node", "label"])


def contract(edges: DataFrame) -> DataFrame:
    """Each batch of edges becomes (node, smallest node of its tree in the batch): a spanning forest with no more rows than nodes."""

    def forest(b: pa.RecordBatch) -> pa.RecordBatch:
        u, v = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = components(len(nodes), at[: len(u)], at[len(u) :])
        keep = label != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep], pa.int64()), pa.array(nodes[label[keep]], pa.int64())], names=["u", "v"])

    return arrow_map(edges, forest, "u long, v long")


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each node's component."""
    label = np.arange(n)
    while len(a):
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        while (label[label] != label).any():
            label = label[label]
        a, b = label[a], label[b]
        a, b = a[a != b], b[a != b]
    return label
