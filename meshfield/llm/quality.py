"""Quality classifier: naive Bayes support vectors on hashed n-gram indicators.

Indicators: character trigrams, and n-grams (1 to 3) of word shapes (case, closing punctuation, repetition of the word
before) and of line symbols (new, or equal to an earlier line). Each is scaled by its log-count ratio between the classes;
a linear hinge-loss model is fitted to them by dual coordinate descent, and out-of-fold margins give the probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, binary, materialize, mixed

#: Bits of the index space; labelled rows in the sample that is fitted (those with the smallest hash of their id), and bytes of their
#: indices at most (4 for an indicator; a text has 2**18 at most): the sample ends where they are reached.
BITS, MAX_TRAIN, TRAIN_BYTES = 18, 5000, 200_000_000
THRESHOLD = 0.7
_CLOSING = b".,;:!?)\"'"
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


class Shapes(dict):
    """word -> 8 bytes: 7 of its hash and its shape."""

    LIMIT = 80_000

    def __missing__(self, w: bytes) -> bytes:
        core = w.rstrip(_MARKS)
        tail = w[len(core) :]
        end = 0 if not tail else 1 if tail in (b".", b",") else 2 if all(c in _CLOSING for c in tail) else 3
        end += 3 * (len(tail) > 1)
        case = 0 if core.islower() else 1 if core.istitle() else 2 if core.isupper() and len(core) > 1 else 3 if core.isdigit() else 4 if not core else 5
        v = self[w] = xxhash.xxh64_digest(w)[:7] + bytes([case * 8 + end])
        return v


_SHAPES = Shapes()
_HIT = np.zeros(1 << BITS, bool)


def features(text: bytes | None) -> np.ndarray:
    """Sorted distinct indices of a text's indicators."""
    text = text or b""
    parts = [np.zeros(1, np.uint64)]
    if len(text) >= 3:
        b = np.frombuffer(text, np.uint8).astype(np.uint64)
        parts.append((b[:-2] << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | b[2:])
    words = text.split()
    if words:
        if len(_SHAPES) > Shapes.LIMIT:
            _SHAPES.clear()
        h = np.frombuffer(b"".join(map(_SHAPES.__getitem__, words)), "<u8")
        s = (h >> np.uint64(56)) * np.uint64(2) + np.uint64(1)
        s[1:] += h[1:] == h[:-1]
        parts += _grams(s, 1 << 32)
    lines = [x for x in text.split(b"\n") if x.strip()]
    if lines:
        seen: set[bytes] = set()
        old = np.array([x in seen or bool(seen.add(x)) for x in lines])
        parts += _grams(old.astype(np.uint64) + np.uint64(1), 1 << 40)
    x = mixed(np.concatenate(parts)) >> np.uint64(64 - BITS)
    _HIT[x] = True
    out = np.flatnonzero(_HIT)
    _HIT[out] = False
    return out.astype(np.int32)


def _grams(s: np.ndarray, mark: int) -> list[np.ndarray]:
    out, g = [], np.zeros(len(s), np.uint64)
    for n in range(1, 4):
        if len(s) < n:
            break
        g = g[: len(s) - n + 1] * np.uint64(257) + s[n - 1 :]
        out.append(g + np.uint64(mark * n))
    return out


class Model:
    """score(text) = sigmoid(a * margin + b)"""

    def __init__(self, weights: np.ndarray, bias: float, a: float, b: float):
        self.weights, self.bias, self.a, self.b = weights.astype(np.float32), bias, a, b

    def margin(self, x: np.ndarray) -> float:
        return float(self.weights[x].sum(dtype=np.float64)) / max(1.0, np.sqrt(len(x))) + self.bias

    def score(self, text: bytes | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * self.margin(features(text)) + self.b, -500, 500))))


def ratios(xs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log-count ratios of the indicators, smoothed by one."""
    p, q = np.ones(1 << BITS), np.ones(1 << BITS)
    for x, label in zip(xs, y, strict=True):
        (p if label else q)[x] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def hinge_by_dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2 / 2 + sum cost * hinge, by coordinate descent on the dual."""
    rng = np.random.default_rng(seed)
    w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(y))
    square = np.array([float((v * v).sum()) + 1 for _, v in rows])
    sign = np.where(y > 0, 1.0, -1.0)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            x, v = rows[i]
            g = sign[i] * (float(w[x] @ v) + bias) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                alpha[i] = new
                w[x] += step * v
                bias += step
    return w, bias


def _fit_once(xs: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float]:
    r = ratios(xs, y)
    rows = [(x, r[x] / max(1.0, np.sqrt(len(x)))) for x in xs]
    share = max(y.mean(), 1e-9), max(1 - y.mean(), 1e-9)
    w, bias = hinge_by_dual_descent(rows, y, np.where(y > 0, 0.5 / share[0], 0.5 / share[1]))
    return r * w, bias


def fit(xs: list[np.ndarray], y: np.ndarray, folds: int = 3) -> Model:
    """Model from indicator sets and labels. With one class only (or no row) it scores a constant: the smoothed share of label 1."""
    n1 = int(y.sum()) if len(y) else 0
    if min(n1, len(y) - n1) < folds:
        return Model(np.zeros(1 << BITS), 0.0, 0.0, float(np.log((n1 + 1) / (len(y) - n1 + 1))))
    fold = np.random.default_rng(5).permutation(len(y)) % folds
    margins = np.empty(len(y))
    for k in range(folds):
        train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        w, bias = _fit_once([xs[i] for i in train], y[train])
        m = Model(w, bias, 1, 0)
        margins[test] = [m.margin(xs[i]) for i in test]
    a, b = logistic(margins, y)
    return Model(*_fit_once(xs, y), a, b)


def logistic(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of the probability of label 1 (targets smoothed), by Newton's method."""
    n1 = y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    x, beta = np.stack([margin, np.ones(len(y))], 1), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (t - p) - 1e-6 * beta)
        beta += step / max(1.0, float(np.abs(step).max()) / 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN, max_bytes: int = TRAIN_BYTES) -> Model:
    """Fits to at most max_rows labelled documents, and max_bytes of indices, that are not held out (label 1 in quality: good).

    Null ids and labels are left out; of several labels of an id the highest holds, and of several texts of an id one. Without rows the model
    scores a constant.
    """
    some = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select(F.col("doc_id").alias("id"), "quality")
    own = docs.select("doc_id", binary().alias("body")).join(F.broadcast(some), F.col("doc_id") == F.col("id"))

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t).tobytes() for t in b.column(2).to_pylist()], pa.binary())], names=["doc_id", "quality", "x"])

    rows = arrow_map(own.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), "body"), f, "doc_id long, quality int, x binary")
    rows = materialize(rows.groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("least")).select("doc_id", "least.quality", "least.x"), "quality-sample")
    size, last = 0, None
    for r in rows.select("doc_id", F.xxhash64("doc_id").alias("h"), F.octet_length("x").alias("n")).orderBy("h", "doc_id").collect():
        size += r.n
        if size > max_bytes:
            break
        last = (r.h, r.doc_id)
    h = F.xxhash64("doc_id")
    within = F.lit(False) if last is None else (h < last[0]) | ((h == last[0]) & (F.col("doc_id") <= last[1]))
    got = sorted((r.doc_id, r.quality, bytes(r.x)) for r in rows.where(within).collect())
    return fit([np.frombuffer(x, np.int32) for _, _, x in got], np.array([int(q > 0) for _, q, _ in got]))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs plus the probability of label 1. Null and empty texts score as texts without any n-gram; equal texts score equally, texts of
    any length are read whole, a column of docs with that name is replaced, and an empty table gives an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != name]
    body = keep.index("text")

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        s = pa.array([m.score(t) for t in b.column(body).cast(pa.binary()).to_pylist()], pa.float64())
        return pa.RecordBatch.from_arrays([*b.columns, s], names=[*keep, name])

    source = docs.select(*keep)
    out = source.withColumn(name, F.lit(0.0).cast("double")).schema
    return arrow_map(source, f, out)


def op7_quality_classifier(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
