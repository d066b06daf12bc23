"""Sharding by extendible hashing, in DataFrame operations only.

A directory is indexed by the leading bits of a document's hash; a bucket over the byte limit splits on one more bit until it
fits (or holds one key only). The tree of splits comes from byte counts per hash prefix: first over cells of a fixed number
of bits, then, for the few cells still too large, over whole hashes. Buckets keep their own depth, so a heavy document deepens its
own branch alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, own_names

#: Bits of a hash; bytes of a shard.
BITS, SHARD_BYTES = 60, 1_000_000


def hash_of(key: Column) -> Column:
    """60 bits of the MD5 of the key's text (null: of the empty text)."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(h: str, depth: Column | str) -> Column:
    """The leading bits of h as a number."""
    return F.call_function("shiftright", F.col(h), (F.lit(BITS) - (F.col(depth) if isinstance(depth, str) else depth)).cast("int"))


def _splits(weights: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """weights (h, bytes, keys): the inner nodes (depth, prefix) with low <= depth < high, that is prefixes over the limit with more than one key."""
    at = weights.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
    sums = at.groupBy("depth", _prefix("h", "depth").alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("keys").alias("keys"))
    return sums.where((F.col("bytes") > limit) & (F.col("keys") > 1)).select("depth", "prefix")


def shard(docs: DataFrame, key: str = "doc_id", size: Column | None = None, limit: int = SHARD_BYTES) -> DataFrame:
    """docs plus shard_depth, shard_prefix (leading bits as text; '' for the only shard) and shard_bytes.

    size: bytes of a row (default: of text; null is 0). A shard is over the limit only where one key alone is: rows with equal keys
    stay together (a repeated id, and all null ids). Columns of docs with these three names are replaced, all others are kept whatever
    their names; texts of any length count with all their bytes, and an empty table stays empty.
    """
    size = F.coalesce(F.octet_length("text") if size is None else size, F.lit(0)).cast("long")
    keep = [c for c in docs.columns if c not in ("shard_depth", "shard_prefix", "shard_bytes")]
    h, own, cell, leaves, at = own_names(docs, "h", "own", "cell", "leaves", "at")
    rows = docs.select(*keep, hash_of(F.col(key)).alias(h), size.alias(own))
    light = rows.select(F.col(h).alias("h"), F.col(own).alias("bytes"))
    total = light.agg(F.sum("bytes")).first()[0] or 0
    bits = min(BITS, max(1, (total // limit).bit_length() + 3))
    cells = light.groupBy(_prefix("h", F.lit(bits)).alias("c")).agg(F.sum("bytes").alias("bytes"), F.min("h").alias("a"), F.max("h").alias("b"))
    cells = materialize(cells.select(F.call_function("shiftleft", F.col("c"), F.lit(BITS - bits)).alias("h"), "c", "bytes", F.when(F.col("a") == F.col("b"), 1).otherwise(2).alias("keys")), "shard-cells")
    upper = _splits(cells, 0, bits, limit)
    heavy = broadcast_if_small(materialize(cells.where(f"bytes > {limit} and keys > 1").select("c"), "shard-heavy"))
    single = light.join(heavy, _prefix("h", F.lit(bits)) == F.col("c"), "left_semi").groupBy("h").agg(F.sum("bytes").alias("bytes"), F.lit(1).alias("keys"))
    nodes = materialize(upper.union(_splits(single, bits, BITS, limit)), "shard-splits")
    child = nodes.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
    root = docs.sparkSession.range(1).select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"))
    found = child.union(root).join(nodes, ["depth", "prefix"], "left_anti")
    start = F.call_function("shiftleft", F.col("prefix"), (F.lit(BITS) - F.col("depth")).cast("int"))
    # A directory entry for each cell: the one leaf above it, or the leaves below it.
    cell_of_leaf = found.select("depth", start.alias("start")).withColumn("cell", F.call_function("shiftright", F.col("start"), F.lit(BITS - bits)))
    wide = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.lit(bits) - F.col("depth"), F.lit(0)).cast("int"))
    directory = cell_of_leaf.withColumn("cell", F.explode(F.sequence(F.col("cell"), F.col("cell") + wide - 1)))
    directory = directory.groupBy(F.col("cell").alias(cell)).agg(F.sort_array(F.collect_list(F.struct("start", "depth")), asc=False).alias(leaves))
    directory = materialize(directory, "shard-directory")
    entries = directory.agg(F.sum(F.size(leaves))).first()[0] or 0
    directory = F.broadcast(directory) if entries <= 400_000 else directory
    leaf = F.filter(leaves, lambda x: x["start"] <= F.col(h))[0]
    out = rows.withColumn(at, _prefix(h, F.lit(bits))).join(directory, F.col(at) == F.col(cell)).withColumn(at, leaf["depth"].cast("int"))
    prefix = F.substring(F.lpad(F.bin(F.col(h)), BITS, "0"), F.lit(1), F.col(at))
    return out.select(*keep, F.col(at).alias("shard_depth"), prefix.alias("shard_prefix"), F.col(own).alias("shard_bytes"))


def with_totals(sharded: DataFrame) -> DataFrame:
    """shard_bytes: of the row's whole shard."""
    p, total = own_names(sharded, "p", "total")
    sums = sharded.groupBy(F.col("shard_prefix").alias(p)).agg(F.sum("shard_bytes").alias(total))
    sums = broadcast_if_small(materialize(sums, "shard-sums"), 200_000)
    return sharded.join(sums, F.col("shard_prefix") == F.col(p)).drop(p, "shard_bytes").withColumnRenamed(total, "shard_bytes")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard."""
    sharded.repartition("shard_prefix").write.partitionBy("shard_prefix").parquet(path)


def op1_extendible_sharding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_totals(shard(docs)).select("doc_id", "shard_depth", "shard_prefix", "shard_bytes")


OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) b, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT h FROM documents),
x AS (SELECT doc_id, b, lpad(bin(h), {BITS}, '0') p, unnest(range(0, {BITS + 1})) depth FROM d),
n AS (SELECT depth, substr(p, 1, depth) prefix, sum(b)::BIGINT bytes FROM x GROUP BY ALL HAVING sum(b) <= {SHARD_BYTES} OR count(DISTINCT p) = 1),
m AS (SELECT doc_id, p, min(x.depth) depth FROM x JOIN n ON n.depth = x.depth AND n.prefix = substr(p, 1, x.depth) GROUP BY ALL)
SELECT doc_id, depth::INTEGER shard_depth, substr(p, 1, depth) shard_prefix, n.bytes shard_bytes FROM m JOIN n USING (depth) WHERE n.prefix = substr(p, 1, depth)
"""
