"""Corpus pipeline: quality classifier, n-gram Jaccard join, benchmark decontamination, secret scans, best-fit packing.

Each stage takes all rows that its predecessor kept. All but the last give the columns of documents and leave others out, whatever their names; an
empty table gives an empty one, and texts of any length are read whole.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshfield.llm import decontaminate, ngram_join, packing, quality, secrets
from meshfield.llm.common import arrow_map, broadcast_if_small, materialize

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of a shingle and least similarity of near copies (op3 has its own).
NEAR = {"k": 5, "num": 80, "den": 100}


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*DOCUMENTS)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of label 1 is quality.THRESHOLD or more.

    Null and empty texts score like any other; repeated rows score equally and stay or go together; null ids are scored too. Without labels all
    documents score the same, and go or stay with that score.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _columns(quality.score(_columns(docs), model, "quality_score").where(F.col("quality_score") >= quality.THRESHOLD))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows, the one with the smallest id, null ids last; one row too where ids repeat or are null, or rows are equal.

    Null texts and texts without words are linked with nothing and stay. Of rows that tie in their id the first by row number stays.
    """
    rows = materialize(_columns(docs).withColumn("row", F.monotonically_increasing_id()), "rows")
    found = ngram_join.ngram_jaccard_join(rows.select(F.col("row").alias("doc_id"), "text"), **NEAR)
    linked = found.where("n_links > 0").select(F.col("doc_id").alias("row"), "component_id")
    linked = materialize(linked.join(rows.select("row", "doc_id"), "row"), "linked")
    first = linked.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least"))
    gone = linked.join(first.select(F.col("least.row").alias("row")), "row", "left_anti")
    gone = materialize(gone.select(F.col("row").alias("gone")), "duplicates")
    return _columns(rows.join(broadcast_if_small(gone, 1_000_000), F.col("row") == F.col("gone"), "left_anti"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents (two benchmark items or more) go; elsewhere the words of an occurrence are removed.

    Null texts stay null; repeated rows are treated alike; items without words or id match nothing; with an empty benchmark nothing changes.
    """

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        keep = pa.array([len(x) < 2 for x in b.column("items").to_pylist()], pa.bool_())
        b = b.filter(keep)
        hits = b.column("hits").to_pylist()
        return _with_text(b, [decontaminate.remove_hits(t, h) if t is not None and 1 in h else t for t, h in zip(b.column("text").to_pylist(), hits, strict=True)])

    docs = _columns(docs)
    return decontaminate.search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), then=f, schema=docs.schema)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by the kind of each (overlapping ones by the first). Null texts stay null; repeated texts are one blob of the ledger."""
    found, _ = secrets.scan(_columns(docs))

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[(x["kind"], x["start"], x["end"]) for x in r] for r in b.column(5).to_pylist()]
        return _with_text(b, [secrets.redact(t, s) if s else t for t, s in zip(b.column(1).to_pylist(), spans, strict=True)])

    return arrow_map(found.select(*DOCUMENTS, "findings"), f, docs.select(*DOCUMENTS).schema)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per token piece with its sequence. Null and empty texts are a piece with the end token; repeated rows are packed each; null ids stay null."""
    return packing.packed(docs)


def _with_text(b: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
    """The columns of documents, with other texts; n_chars follows where the text has changed."""
    old, n = b.column(1).to_pylist(), b.column(4).to_pylist()
    n = [k if t == o else len(t) for t, o, k in zip(texts, old, n, strict=True)]
    cols = [b.column(0), pa.array(texts, pa.string()), b.column(2), b.column(3), pa.array(n, b.column(4).type)]
    return pa.RecordBatch.from_arrays(cols, names=list(DOCUMENTS))


STAGES = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("secret scans", redacted),
    ("best-fit packing", packed),
]
#: Trained weights and token ids are beyond SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, "pipeline")
    return docs
