"""N-gram Jaccard join by vertical partitioning.

The hash order of all n-grams is cut into FRAGMENTS ranges. Within the first fragment n-grams are ordered by exact
document frequency, and a text's prefix under that order (rarest first, n - ceil(t * n) + 1 n-grams; texts with too few
there take their smallest others) finds its possible partners: two texts that reach the threshold share a prefix n-gram, at
positions and with lengths that leave room for the overlap they need. Texts that share one are near each other: each has a
home (the smallest text that shares an n-gram with it), homes are cut into blocks of bounded size, and a text goes to those
pairs of blocks alone in which it has a possible partner. Each (group of pairs of blocks, fragment) counts its partial
overlaps apart from the others; the counts are summed per pair, links are exact, and only a spanning forest of them leaves
the group. Texts with equal sets are one class throughout, so copies never multiply.

N-grams that very many texts hold come last in the first fragment and are not counted: no task gathers their texts. Lists of
texts under one n-gram are paired in chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, binary, broadcast_if_small, components, connected_components, distinct_sorted, keyed_join, materialize, mixed, shingle_hashes, slices, small_batches, tidy, word_hashes

FRAGMENTS = 4
#: N-grams counted in one bucket; texts, and n-grams of them, of one block (a longer text is a block); texts of one chunk of a list.
BUCKET, BLOCK, BLOCK_GRAMS, CHUNK = 400_000, 1024, 1_000_000, 4096
#: Lists of more texts than this are paired between blocks only; within a block all texts go together.
WIDE = 256
#: An n-gram is not counted where more texts hold it than this, and than a millionth of all n-grams (so there are a million of them at most).
FREQUENT = 5_000
#: Least count of an n-gram in a share of COUNTED n-grams of one task from which it is added up.
SEEN, COUNTED = 8, 1_000_000
#: Bytes of the table of ways that is broadcast at most.
ROUTE_BYTES = 16_000_000
LIGHT = "doc_id long, n_shingles long, cls long, n0 long"
_TOP = np.uint64(2**64 // FRAGMENTS)
#: Stands for the document frequency of what is not counted.
_MANY = 1 << 40


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text. Fewer words than k: the whole sequence is one; no word: none."""
    h, counts = word_hashes([t or b"" for t in texts])
    every, out, at = shingle_hashes(h, k), [], 0
    for n in counts.tolist():
        if n >= k:
            out.append(distinct_sorted(every[at : at + n - k + 1]))
        else:
            out.append(shingle_hashes(h[at : at + n], n) if n else h[:0])
        at += n
    return out


def class_of(s: np.ndarray) -> int:
    """Key of a set of n-grams (with its size beside it)."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), len(s))).view(np.int64))


def _texts(b: pa.RecordBatch, i: int) -> list[bytes]:
    return b.column(i).to_pylist()


def light(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """One row per document: doc_id, n_shingles, cls (key of its set), n0 (n-grams in the first fragment).

    Between them rows with n_shingles -1: an n-gram (cls) that is often a prefix candidate, and how often in a share of one task (n0).
    """

    def often(sets: list[np.ndarray]) -> pa.RecordBatch:
        tok, n = np.unique(np.concatenate(sets), return_counts=True)
        tok, n = tok[n >= SEEN], n[n >= SEEN]
        return pa.RecordBatch.from_arrays([pa.nulls(len(tok), pa.int64()), pa.array(np.full(len(tok), -1), pa.int64()), pa.array(tok.view(np.int64), pa.int64()), pa.array(n.astype(np.int64), pa.int64())], names=["doc_id", "n_shingles", "cls", "n0"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for b in slices(batches):
            sets = shingle_sets(_texts(b, 1), k)
            keys = [class_of(s) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), pa.array([_first(s) for s in sets], pa.int64())], names=["doc_id", "n_shingles", "cls", "n0"])
            for key, s in zip(keys, sets, strict=True):
                if len(s) and key not in held:
                    held[key] = s[: max(_first(s), _prefix(len(s), num, den))].copy()
                    size += len(held[key])
            if size > COUNTED:
                yield often(list(held.values()))
                held, size = {}, 0
        if held:
            yield often(list(held.values()))

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), binary()).mapInArrow(run, LIGHT)


def _first(s: np.ndarray) -> int:
    return int(np.searchsorted(s, _TOP))


def _prefix(n: int, num: int, den: int) -> int:
    """n - ceil(n * num / den) + 1"""
    return n - -(-n * num // den) + 1


def ngram_jaccard_join(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id, n_links: den * |A & B| >= num * |A | B| links two documents.

    n_links counts linked documents (copies included). Null or wordless texts: n_shingles 0, their own component, no link.
    Null ids keep their row; they never name a component unless all ids in it are null. Repeated rows are copies. Extra columns are
    ignored, an empty table gives an empty one, and texts of any length are compared whole. N-grams and whole sets are told apart by 64-bit hashes.
    """
    every = materialize(light(docs, k, num, den), "ngram-light")
    rows = every.where("n_shingles >= 0")
    classes = materialize(rows.where("n_shingles > 0").groupBy("cls").agg(F.max("n_shingles").alias("n_shingles"), F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("n0").alias("n0")), "ngram-classes")
    total, n_rows = (x or 0 for x in classes.agg(F.sum("n0"), F.sum("copies")).first())
    limit = max(FREQUENT, total // 1_000_000)
    frequent = every.where("n_shingles = -1").groupBy("cls").agg(F.sum("n0").alias("n")).where(F.col("n") > limit).select("cls").collect()
    frequent = np.sort(np.array([r.cls for r in frequent], np.int64).view(np.uint64))
    posting = materialize(_postings(docs, classes, k, num, den, max(1, -(-total // BUCKET)), frequent), "ngram-postings")
    links, counts = _links(docs, classes, posting, k, num, den)
    comp = connected_components(links, "ngram-links")
    named = classes.select("cls", "rep", "copies").join(comp, F.col("cls") == F.col("node"), "left").withColumn("label", F.coalesce("label", "cls"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "label").join(counts.select(F.col("cls").alias("c"), "others"), F.col("cls") == F.col("c"), "left")
    named = materialize(named.select("cls", "component_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies"), "ngram-named")
    return keyed_join(rows, named, "cls", "copies", n_rows, "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("n_shingles") == 0, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
    )


def _pack(*arrays: np.ndarray) -> bytes:
    return np.int64(len(arrays[0])).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(blob[:8], "<i8")[0]), 8, []
    for kind in kinds:
        size = np.dtype(kind).itemsize * n
        out.append(np.frombuffer(blob, kind, n, at))
        at += size
    return out


def _gathered(t: pa.Table, *kinds: str) -> list[np.ndarray]:
    parts = [_unpack(x, *kinds) for x in t.column("blob").to_pylist()]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0, kind) for kind in kinds]


def _within(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of x are in some (sorted)."""
    at = np.searchsorted(some, x)
    return (at < len(some)) & (some[np.minimum(at, len(some) - 1)] == x) if len(some) else np.zeros(len(x), bool)


def _runs(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of the runs that start where new is set."""
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(new)))


def _postings(docs: DataFrame, classes: DataFrame, k: int, num: int, den: int, buckets: int, frequent: np.ndarray) -> DataFrame:
    """(token, cls, n, pos): the prefix n-grams of each class that another text may share, with their place in its order."""
    shared_frequent = docs.sparkSession.sparkContext.broadcast(frequent)
    parts = max(1, buckets // 4)  # of classes

    def cut(b: pa.RecordBatch) -> pa.RecordBatch | None:
        toks, own = [], []
        for s in {class_of(s): s for s in shingle_sets(_texts(b, 0), k) if len(s)}.values():
            m = max(_first(s), _prefix(len(s), num, den))
            toks.append(s[:m])
            own.append(np.full(m, class_of(s), np.int64))
        if not toks:
            return None
        tok, cls = np.concatenate(toks), np.concatenate(own)
        # Frequent ones are not counted: they go by their text, to negative buckets.
        at = np.where(_within(tok, shared_frequent.value), -1 - cls % parts, (tok % np.uint64(buckets)).astype(np.int64))
        order = np.argsort(at, kind="stable")
        tok, cls, at = tok[order], cls[order], at[order]
        first, size = _runs(np.concatenate(([True], at[1:] != at[:-1])))
        return pa.RecordBatch.from_arrays([pa.array(at[first], pa.int64()), pa.array([_pack(tok[i : i + n], cls[i : i + n]) for i, n in zip(first, size, strict=True)], pa.binary())], names=["bucket", "blob"])

    def shared(t: pa.Table) -> pa.Table:
        tok, cls = _gathered(t, "<u8", "<i8")
        order = np.lexsort((cls, tok))
        tok, cls = tok[order], cls[order]
        new = np.concatenate(([True], (tok[1:] != tok[:-1]) | (cls[1:] != cls[:-1])))
        tok, cls = tok[new], cls[new]
        if t.column("bucket")[0].as_py() < 0:
            df = np.full(len(tok), _MANY)
        else:
            _, size = _runs(np.concatenate(([True], tok[1:] != tok[:-1])))
            df = np.repeat(size, size)
        tok, cls, df = tok[df > 1], cls[df > 1], df[df > 1].astype(np.int64)
        if not len(tok):
            return pa.table({"part": pa.array([], pa.int64()), "blob": pa.array([], pa.binary())})
        part = cls % parts
        order = np.argsort(part, kind="stable")
        tok, cls, df, part = tok[order], cls[order], df[order], part[order]
        first, size = _runs(np.concatenate(([True], part[1:] != part[:-1])))
        return pa.table({"part": pa.array(part[first], pa.int64()), "blob": pa.array([_pack(tok[i : i + n], cls[i : i + n], df[i : i + n]) for i, n in zip(first, size, strict=True)], pa.binary())})

    def prefixes(mine: pa.Table, t: pa.Table) -> pa.Table:
        keys, n, n0 = (mine.column(c).to_numpy() for c in ("cls", "n_shingles", "n0"))
        order = np.argsort(keys)
        keys, n, n0 = keys[order], n[order], n0[order]
        tok, cls, df = _gathered(t, "<u8", "<i8", "<i8")
        later = tok >= _TOP  # beyond the first fragment: last, and in their own order
        order = np.lexsort((tok, np.where(later, 0, df), later, cls))
        tok, cls, later = tok[order], cls[order], later[order]
        who = np.searchsorted(keys, cls)
        alone = n0 - np.bincount(who[~later], minlength=len(keys))  # no other text has them: first
        rank = np.arange(len(tok)) - np.searchsorted(cls, keys)[who] if len(tok) else np.empty(0, np.int64)
        pos = alone[who] + rank  # of later ones not above their place, as unshared ones before them are not there
        keep = pos < _prefix(n, num, den)[who]
        return pa.table({"token": pa.array(tok[keep].view(np.int64), pa.int64()), "cls": pa.array(cls[keep], pa.int64()), "n": pa.array(n[who[keep]], pa.int64()), "pos": pa.array(pos[keep], pa.int64())})

    blobs = arrow_map(docs.select(binary()), cut, "bucket long, blob binary")
    found = blobs.groupBy("bucket").applyInArrow(tidy(shared), "part long, blob binary")
    own = classes.select(F.pmod("cls", F.lit(parts)).alias("part"), "cls", "n_shingles", "n0")
    return own.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(prefixes, "token long, cls long, n long, pos long")


def _by_class(b: pa.RecordBatch, k: int) -> pa.RecordBatch | None:
    """One text of each class in the batch."""
    own = {class_of(s): t for s, t in zip(shingle_sets(_texts(b, 0), k), _texts(b, 0), strict=True) if len(s)}
    return pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.binary())], names=["node", "body"]) if own else None


def every_pair(first: np.ndarray, size: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), i < j, of all pairs of places within each run, some at a time."""
    end = np.repeat(first + size, size)
    i = np.repeat(first, size) + np.arange(len(end)) - np.repeat(np.cumsum(size) - size, size)
    n = end - i - 1
    i, n = i[n > 0], n[n > 0]
    upto, at = np.concatenate(([0], np.cumsum(n))), 0
    while at < len(i):
        stop = max(at + 1, int(np.searchsorted(upto, upto[at] + most, "right")) - 1)
        c = n[at:stop]
        a = np.repeat(i[at:stop], c)
        yield a, a + 1 + np.arange(len(a)) - np.repeat(upto[at:stop] - upto[at], c)
        at = stop


def _ways(posting: DataFrame, num: int, den: int) -> DataFrame:
    """(cls, label, side): the pairs of blocks in which a class has a possible partner; side -1 within a block."""
    heads = materialize(posting.groupBy("token").agg(F.min("cls").alias("head"), F.count("*").alias("size")).where("size > 1"), "ngram-heads")
    entries = heads.agg(F.sum("size")).first()[0] or 0
    listed = materialize(keyed_join(posting, heads.withColumn("many", F.col("size")), "token", "many", entries), "ngram-lists")
    homes = listed.groupBy("cls").agg(F.min("head").alias("home"), F.max("n").alias("n"))
    sizes = homes.groupBy("home").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_GRAMS)).cast("int").alias("m"))
    sizes = materialize(sizes, "ngram-homes")
    cut = sizes.where("m > 1")  # few: a home of one block needs no other key
    homes = homes.select("cls", "home").join(broadcast_if_small(cut.select(F.col("home").alias("_h"), "m"), 200_000), F.col("home") == F.col("_h"), "left")
    homes = homes.select("cls", F.when(F.col("m").isNull(), F.xxhash64("home")).otherwise(F.xxhash64("home", F.pmod(F.xxhash64("cls"), F.col("m")))).alias("block"))
    own = listed.select("token", "cls", "n", "pos", "size").join(homes, "cls")
    short = own.where(F.col("size") <= CHUNK).select("token", "cls", "n", "pos", "block", F.lit(-1).alias("side"))
    m = F.ceil(F.col("size") / CHUNK).cast("int")
    long_ = own.where(F.col("size") > CHUNK).withColumn("a", F.pmod(F.xxhash64("cls", F.lit(1)), m).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), m - 1)))
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    long_ = long_.select(F.xxhash64("token", lo, hi).alias("token"), "cls", "n", "pos", "block", F.when(lo == hi, -1).otherwise((F.col("a") == hi).cast("int")).alias("side"))

    def pairs(t: pa.Table) -> pa.Table:
        tok, cls, n, pos, block, side = (t.column(c).to_numpy() for c in ("token", "cls", "n", "pos", "block", "side"))
        order = np.lexsort((cls, block, tok))
        tok, cls, n, pos, block, side = (x[order] for x in (tok, cls, n, pos, block, side))
        classes, who = np.unique(cls, return_inverse=True)
        blocks, block = np.unique(block, return_inverse=True)
        home, count = np.empty(len(classes), np.int64), len(blocks)
        home[who] = block
        found, size = [np.empty(0, np.int64)], 0

        def add(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
            nonlocal size
            found.append(np.unique((who[x] * count + lo) * count + hi))
            size += len(found[-1])
            if size > 2_000_000:
                found[:] = [np.unique(np.concatenate(found))]
                size = len(found[0])

        first, run = _runs(np.concatenate(([True], tok[1:] != tok[:-1])))
        wide = np.repeat(run > WIDE, run)
        # In long lists all texts of one block go together, and only those of different blocks are told apart.
        _, same = _runs(np.concatenate(([True], (tok[1:] != tok[:-1]) | (block[1:] != block[:-1]))))
        some = np.flatnonzero(np.repeat(same > 1, same) & wide)
        add(some, block[some], block[some])
        for i, j in every_pair(first, run):
            ok = ((side[i] < 0) | (side[i] != side[j])) & ~(wide[i] & (block[i] == block[j]))
            i, j = i[ok], j[ok]
            need = -(-num * (n[i] + n[j]) // (den + num))
            ok = (den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j])) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need)
            i, j = i[ok], j[ok]
            lo, hi = np.minimum(block[i], block[j]), np.maximum(block[i], block[j])
            add(i, lo, hi)
            add(j, lo, hi)
        code = np.unique(np.concatenate(found))
        x, lo, hi = code // (count * count), code // count % count, code % count
        label = mixed(mixed(blocks[lo].view(np.uint64)) * np.uint64(3) + blocks[hi].view(np.uint64)).view(np.int64)
        own = np.where(lo == hi, -1, home[x] == hi).astype(np.int32)
        return pa.table({"cls": pa.array(classes[x], pa.int64()), "label": pa.array(label, pa.int64()), "side": pa.array(own, pa.int32())})

    tasks = max(1, -(-entries // BUCKET))
    dealt = short.union(long_).withColumn("g", F.pmod("token", F.lit(tasks)))
    return dealt.groupBy("g").applyInArrow(tidy(pairs), "cls long, label long, side int").distinct()


def _links(docs: DataFrame, classes: DataFrame, posting: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Spanning links (u, v) between classes, and for each linked class the number of documents in the others (cls, others)."""
    ways = materialize(_ways(posting, num, den), "ngram-ways")
    # Labels of many texts are groups of their own; the others share cells.
    wide = materialize(ways.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK // 8).select(F.col("label").alias("w")), "ngram-wide")
    ways = ways.join(broadcast_if_small(wide), F.col("label") == F.col("w"), "left")
    route = ways.groupBy("cls").agg(F.collect_list(F.struct("label", "side", F.col("w").isNotNull().alias("alone"))).alias("to"))
    route = route.withColumnRenamed("cls", "node").join(classes.select(F.col("cls").alias("node"), "n_shingles", "rep", "copies"), "node")
    route = materialize(route, "ngram-route")
    texts, places, grams = (x or 0 for x in route.agg(F.count("*"), F.sum(F.size("to")), F.sum(F.col("n_shingles") * F.size("to"))).first())
    cells = max(1, -(-places // BLOCK), -(-grams // BLOCK_GRAMS))
    body = docs.select(F.col("doc_id").cast("long").alias("rep"), binary().alias("body"))
    named = route.where("rep is not null").select("rep", "node", "copies", "to")
    text = body.join(F.broadcast(named) if 40 * texts + 20 * places <= ROUTE_BYTES else named, "rep").select("body", "node", "copies", "to")
    unnamed = route.where("rep is null")
    if not unnamed.isEmpty():  # sets of which no document has an id: by class key, one text of each
        keyed = arrow_map(body.where("rep is null").select("body"), lambda b: _by_class(b, k), "node long, body binary")
        keyed = keyed.join(unnamed.select("node"), "node", "left_semi").groupBy("node").agg(F.first("body").alias("body"))
        text = text.union(keyed.join(unnamed, "node").select("body", "node", "copies", "to"))

    def cut(b: pa.RecordBatch) -> pa.RecordBatch | None:
        out: dict[str, list] = {c: [] for c in ("g", "fragment", "cls", "label", "side", "n", "copies", "segment")}
        nodes, copies, tos = (b.column(i).to_pylist() for i in range(1, 4))
        edges = np.array([i * (2**64 // FRAGMENTS) for i in range(1, FRAGMENTS)], np.uint64)
        done = set()
        for s, node, c, to in zip(shingle_sets(_texts(b, 0), k), nodes, copies, tos, strict=True):
            if not len(s) or node in done or class_of(s) != node:  # a repeated id, with another text
                continue
            done.add(node)
            for f, seg in enumerate(np.split(s, np.searchsorted(s, edges))):
                raw = seg.tobytes()
                for x in to:
                    for key, v in (("g", x["label"] if x["alone"] else x["label"] % cells), ("fragment", f), ("cls", node), ("label", x["label"]), ("side", x["side"]), ("n", len(s)), ("copies", c), ("segment", raw)):
                        out[key].append(v)
        kinds = {"fragment": pa.int32(), "side": pa.int32(), "segment": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(key, pa.int64())) for key, v in out.items()], names=list(out)) if out["g"] else None

    segments = arrow_map(text, cut, "g long, fragment int, cls long, label long, side int, n long, copies long, segment binary")

    def overlaps(t: pa.Table) -> pa.Table:
        """Pairs of one group with their overlap within one fragment, but for those whose difference there is too large already."""
        x, segs = _group(t)
        i, j, c = pair_counts(segs, x["label"], x["side"])
        size = np.array([len(s) for s in segs], np.int64)
        ok = (size[i] + size[j] - 2 * c) * (num + den) <= (den - num) * (x["n"][i] + x["n"][j])
        i, j, c = i[ok], j[ok], c[ok]
        # Sorted by i and j: differences of their codes are small, and so is what compression leaves of them.
        code = np.diff(i * len(segs) + j, prepend=0)
        blob = _pack(x["cls"], x["label"], x["n"], x["copies"]) + _pack(code.astype("<u4"), c.astype("<u4"))
        return pa.table({"g": t.column("g").slice(0, 1), "blob": pa.array([blob], pa.binary())})

    def summed(t: pa.Table) -> pa.Table:
        """Overlaps summed over fragments; links as a spanning forest, and each class's partners."""
        parts, places = [], []
        for blob in t.column("blob").to_pylist():
            cls, label, n, copies = _unpack(blob, "<i8", "<i8", "<i8", "<i8")
            code, c = _unpack(blob[8 + 32 * len(cls) :], "<u4", "<u4")
            code = np.cumsum(code.astype(np.int64))
            places.append(np.stack([label, cls, n, copies], 1))
            parts.append((code // max(len(cls), 1), code % max(len(cls), 1), c.astype(np.int64)))
        nodes, at = np.unique(np.concatenate(places), axis=0, return_inverse=True)  # of each label, its classes
        d, at = len(nodes), np.split(at.reshape(-1), np.cumsum([len(p) for p in places])[:-1])
        code = np.concatenate([w[i] * d + w[j] for w, (i, j, _) in zip(at, parts, strict=True)])
        code, inv = np.unique(code, return_inverse=True)
        total = np.bincount(inv, weights=np.concatenate([c for *_, c in parts]), minlength=len(code)).astype(np.int64)
        a, b = code // d, code % d
        n, copies = nodes[:, 2], nodes[:, 3]
        ok = den * total >= num * (n[a] + n[b] - total)
        a, b = a[ok], b[ok]
        others = np.bincount(a, weights=copies[b], minlength=d) + np.bincount(b, weights=copies[a], minlength=d)
        keys, who = np.unique(nodes[:, 1], return_inverse=True)
        others = np.bincount(who, weights=others, minlength=len(keys))
        label = components(len(keys), who[a], who[b])
        keep = others > 0
        return pa.table({"u": pa.array(keys[keep], pa.int64()), "v": pa.array(keys[label[keep]], pa.int64()), "others": pa.array(others[keep].astype(np.int64), pa.int64())})

    found = segments.groupBy("g", "fragment").applyInArrow(tidy(overlaps), "g long, blob binary").groupBy("g").applyInArrow(tidy(summed), "u long, v long, others long")
    found = materialize(found, "ngram-found")
    return found.select("u", "v"), found.groupBy(F.col("u").alias("cls")).agg(F.sum("others").alias("others"))


def _group(t: pa.Table) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
    """Columns and segments, each class once under a label."""
    x = {c: t.column(c).to_numpy() for c in ("cls", "label", "side", "n", "copies")}
    order = np.lexsort((x["cls"], x["label"]))
    new = np.concatenate(([True], (np.diff(x["label"][order]) != 0) | (np.diff(x["cls"][order]) != 0)))
    at = order[new]
    segs = t.column("segment").to_pylist()
    return {c: v[at] for c, v in x.items()}, [np.frombuffer(segs[i], "<u8") for i in at]


def pair_counts(segs: list[np.ndarray], label: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, common n-grams), i < j, of texts with the same label and, in a pair of blocks, from different blocks. Equal labels stand together."""
    d = len(segs)
    size = np.array([len(s) for s in segs], np.int64)
    tok, own = np.concatenate(segs) if d else np.empty(0, np.uint64), np.repeat(np.arange(d), size)
    order = np.lexsort((own, tok, label[own])) if len(tok) else np.empty(0, np.int64)
    tok, own = tok[order], own[order]
    of = label[own]
    first, run = _runs(np.concatenate(([True], (tok[1:] != tok[:-1]) | (of[1:] != of[:-1])))) if len(tok) else (np.empty(0, np.int64), np.empty(0, np.int64))
    acc_code, acc_n = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(code: np.ndarray, n: np.ndarray) -> None:
        nonlocal acc_code, acc_n
        both, inv = np.unique(np.concatenate([acc_code, code]), return_inverse=True)
        acc_code, acc_n = both, np.bincount(inv, weights=np.concatenate([acc_n, n])).astype(np.int64)

    few = (run > 1) & (run < 48)
    for i, j in every_pair(first[few], run[few]):
        a, b = own[i], own[j]
        ok = (side[a] < 0) | (side[a] != side[b])
        add(*np.unique(a[ok] * d + b[ok], return_counts=True))
    hot = np.flatnonzero(run >= 48)
    for some in np.split(hot, np.flatnonzero(np.diff(of[first[hot]])) + 1) if len(hot) else ():
        # N-grams of many texts: a product of 0/1 matrices over the texts of the label (of its two blocks), some columns at a time.
        lo, hi = np.searchsorted(label, of[first[some[0]]]), np.searchsorted(label, of[first[some[0]]], "right")
        left, right = (np.flatnonzero(side[lo:hi] <= 0), np.flatnonzero(side[lo:hi] != 0))
        dense = np.zeros((len(left), len(right)), np.float32)
        for part in np.array_split(some, -(-len(some) // 1024)):
            m = np.zeros((hi - lo, len(part)), np.float32)
            for c, x in enumerate(part):
                m[own[first[x] : first[x] + run[x]] - lo, c] = 1
            dense += m[left] @ m[right].T
        i, j = np.nonzero(dense)
        n = dense[i, j]
        i, j = left[i] + lo, right[j] + lo
        ok = i != j if side[lo] >= 0 else i < j
        i, j, n = i[ok], j[ok], n[ok]
        add(np.minimum(i, j) * d + np.maximum(i, j), n)
    return acc_code // max(d, 1), acc_code % max(d, 1), acc_n


def op3_ngram_jaccard(spark, sf_dir):
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP3_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) g FROM w),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id),
c AS (SELECT doc_id, min(root) component_id FROM r GROUP BY doc_id),
k AS (SELECT a doc_id, count(*) k FROM e GROUP BY a)
SELECT d.doc_id::BIGINT doc_id, coalesce(n, 0)::BIGINT n_shingles, component_id::BIGINT component_id, coalesce(k, 0)::BIGINT n_links FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
