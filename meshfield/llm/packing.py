"""Best-fit packing with certified repacking.

Documents become token pieces of at most CAPACITY; pieces are dealt to partitions and each partition is packed by
best-fit decreasing. A lower bound from dual-feasible functions certifies its number of bins: where they all but agree the
partition is done. The others put the documents of their emptier bins (those with more room than their
partition's mean) together, deal them anew and run again; a round counts only if it saves bins.
"""

from __future__ import annotations

import base64
import math
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize

CAPACITY, END = 2048, 0
#: Pieces that one task packs.
SHARE = 150_000
ROUNDS = 3
#: Bins above its bound from which a partition joins an exchange (a fraction: bins that are half empty in several partitions can be one).
GAP = 0.25


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Tokens:
    """Byte-level BPE ids as little-endian uint32 bytes. Nothing in a text is a special token.

    White space of LONG_RUN characters and more is handed over as the piece that the pattern makes of it (all but its last character where
    more text follows), since the pattern's own search runs out of stack there.
    """

    LONG_RUN = 1000

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        # The characters that are white space to the pattern.
        space = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        self.runs = re.compile(f"[{space}]{{{self.LONG_RUN},}}").finditer

    def encode(self, text: str) -> bytes:
        ids, at = array("I"), 0
        for run in self.runs(text):
            end = run.end() - (run.end() < len(text))
            ids.extend(self.encoding.encode_ordinary(text[at : run.start()]))
            ids.extend(self.encoding._encode_single_piece(text[run.start() : end]))
            at = end
        ids.extend(self.encoding.encode_ordinary(text[at:] if at else text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


_TOKENS: dict[str, Tokens] = {}


def tokens(vocabulary: str) -> Tokens:
    if vocabulary not in _TOKENS:
        _TOKENS[vocabulary] = Tokens(vocabulary)
    return _TOKENS[vocabulary]


def cut_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of n tokens: all full but the first."""
    full, rest = divmod(n, capacity)
    return [rest] * bool(rest) + [capacity] * full


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian uint32) of every document, its end id included. Null text: empty, so one piece with the end id."""
    vocabulary = vocabulary or default_vocabulary()
    last = np.array([end], "<u4").tobytes()

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        enc = tokens(vocabulary)
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids = enc.encode(text or "") + last
            at = 0
            for k, n in enumerate(cut_lengths(len(ids) // 4, capacity)):
                for col, v in zip(out, (doc, k, at, n, ids[4 * at : 4 * (at + n)]), strict=True):
                    col.append(v)
                at += n
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), f, "doc_id long, piece int, start long, length long, ids binary")


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset, number of bins): each piece, longest first, goes to the fullest bin that has room."""
    order = np.argsort(-lengths, kind="stable")
    bins, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room
    rooms, n = 0, 0  # bit r of rooms: some bin has room r
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        bins[i], offset[i] = b, capacity - room
        left = room - size
        if left:
            stacks[left].append(b)
            rooms |= 1 << left
    return bins, offset, n


def bound(lengths: np.ndarray, capacity: int = CAPACITY) -> float:
    """No packing has fewer bins: the largest sum of several dual-feasible functions of the lengths (fractions of a bin count)."""
    count = np.bincount(lengths, minlength=capacity + 1)
    if not count.sum():
        return 0.0
    x = np.arange(capacity + 1)
    num, mass = np.concatenate(([0], np.cumsum(count))), np.concatenate(([0], np.cumsum(count * x)))  # of lengths below
    best = mass[-1] / capacity
    k = np.arange(1, capacity // 2 + 1)  # lengths over capacity - k count whole, those under k not at all
    best = max(best, (num[-1] - num[capacity - k + 1] + (mass[capacity - k + 1] - mass[k]) / capacity).max())
    for t in range(2, 33):  # x stays where (t + 1) * x / capacity is whole, else it becomes its floor / t
        whole = (t + 1) * x % capacity == 0
        best = max(best, (count * np.where(whole, x / capacity, (t + 1) * x // capacity / t)).sum())
    return float(best)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    return math.ceil(bound(lengths, capacity) - 1e-9)


def pack(sized: DataFrame, capacity: int = CAPACITY, share: int = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """sized (key long, length long; keys distinct, under 2**58, written before) -> key, sequence_id, offset.

    Full pieces are sequences of their own. Lengths are 1 to capacity.
    """
    spark = sized.sparkSession
    loose = sized.where(F.col("length") < capacity)
    out = sized.where(F.col("length") == capacity).select("key", F.col("key").alias("seq"), F.lit(0).cast("long").alias("offset"))
    todo = loose.select("key", "length")
    best, kept = None, None
    for r in range(rounds):
        parts = max(1, -(-todo.count() // share))
        dealt = todo.withColumn("part", F.pmod(F.xxhash64("key", F.lit(r)), F.lit(parts)))

        def run(t: pa.Table) -> pa.Table:
            length = t.column("length").to_numpy()
            order = np.argsort(t.column("key").to_numpy())
            b, off, n = best_fit_decreasing(length[order], capacity)
            fill = np.bincount(b, weights=length[order], minlength=n).astype(np.int64)
            gap = n - bound(length, capacity) >= GAP
            loose = fill * n <= fill.sum()
            part = t.column("part")[0].as_py()
            return pa.table({"key": pa.array(t.column("key").to_numpy()[order], pa.int64()), "length": pa.array(length[order], pa.int64()), "part": pa.array(np.full(len(b), part), pa.int64()), "bin": pa.array(b, pa.int64()), "offset": pa.array(off, pa.int64()), "free": pa.array(gap & loose[b], pa.bool_())})

        now = materialize(dealt.groupBy("part").applyInArrow(run, "key long, length long, part long, bin long, offset long, free boolean"), "packed")
        named = now.select("key", (F.lit((r + 1) << 58) + F.shiftleft("part", 33) + F.col("bin")).alias("seq"), "offset", "length", "free")
        stats = now.where(F.col("offset") == 0).agg(F.count("*"), F.sum(F.col("free").cast("long")), F.count_distinct("part")).first()
        n_all, n_free, n_parts = stats[0] or 0, stats[1] or 0, stats[2] or 0
        if best is not None and n_all >= best:
            break  # the exchange saves nothing: what was there stays
        out = out.union(kept.select("key", "seq", "offset").where("not free")) if kept is not None else out
        kept, best = named, n_free
        todo = named.where("free").select("key", "length")
        if not n_free or n_parts < 2:
            break
    if kept is not None:
        out = out.union(kept.select("key", "seq", "offset"))
    return out.select("key", F.col("seq").alias("sequence_id"), F.col("offset").cast("long"))


def packed(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    Repeated rows are packed each; null ids stay null; null and empty texts are one piece with the end id; long texts are cut in pieces, of
    which the first may be shorter. Extra columns are ignored, and an empty table gives an empty one.
    """
    cut = pieces(docs, vocabulary, capacity).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    cut = materialize(cut.withColumn("key", F.monotonically_increasing_id()), "pieces")
    placed = pack(cut.select("key", "length"), capacity)
    return cut.join(placed, "key").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (little-endian uint32), pieces (doc_id, piece, offset, length)."""
    cut = materialize(pieces(docs, vocabulary, capacity).withColumn("key", F.monotonically_increasing_id()), "pieces")
    placed = cut.join(pack(cut.select("key", "length"), capacity), "key")

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda x: x["offset"])
        own = [{c: x[c] for c in ("doc_id", "piece", "offset", "length")} for x in rows]
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
        return pa.table({"sequence_id": pa.array([rows[0]["sequence_id"]], pa.int64()), "ids": pa.array([b"".join(x["ids"] for x in rows)], pa.binary()), "pieces": pa.array([own], kind)})

    cols = placed.select("sequence_id", "doc_id", "piece", "offset", "length", "ids")
    return cols.groupBy("sequence_id").applyInArrow(run, "sequence_id long, ids binary, pieces array<struct<doc_id:long,piece:int,offset:long,length:long>>")


def op5_best_fit_packing(spark, sf_dir):
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
