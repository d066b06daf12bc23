"""Quality rules, in DataFrame operations only: per-text counts, and line frequency across the documents of a host.

Lines are normalised (A-Z lower-cased, white space collapsed, digits as 0) and hashed; per host the distinct documents that hold a line
are counted. Lines above the limit are removed, and documents that lose most of their words are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_join, materialize, own_names

#: Distinct documents of a host that may hold a line; least share (percent) of its words that a document must keep.
LINE_DOCS, LEAST_KEPT = 20, 30
_SPACE = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda x: x != "")


def repeated_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more."""

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))))

    def by_hash(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), covered))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, 0).otherwise(let(windows, by_hash))


def lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(line, _UPPER + "123456789", _LOWER + "000000000"), _SPACE, " "))


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    own = let(words(t), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r"), F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)).alias("c")))
    dup = let(lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    (name,) = own_names(docs, "own")
    out = docs.withColumn(name, own).withColumns({
        "n_words": F.col(f"{name}.n").cast("long"),
        "word_chars": F.col(f"{name}.c").cast("long"),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": dup.cast("long"),
        "n_repeat_words": F.col(f"{name}.r").cast("long"),
    })
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).drop(name)


def line_hash(host: Column, line: Column) -> Column:
    """Key of a normalised line on a host (null: one host)."""
    return F.xxhash64(F.coalesce(host.cast("string"), F.lit("")), line)


def frequent_lines(docs: DataFrame, host: str = "source", limit: int = LINE_DOCS) -> DataFrame:
    """(h, n) of the lines that more than limit distinct documents of the host hold: key and number of documents.

    A document is its doc_id; where that is null, its text.
    """
    doc = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    keys = F.transform(lines(F.coalesce(F.col("text"), F.lit(""))), lambda x: line_hash(F.col(host), normalised(x)))
    own = docs.select(doc.alias("doc"), F.explode(F.array_distinct(keys)).alias("h"))
    return own.groupBy("h").agg(F.count_distinct("doc").alias("n")).where(F.col("n") > limit)


def judge(docs: DataFrame, host: str = "source", limit: int = LINE_DOCS, least: int = LEAST_KEPT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_words: a row per row of docs.

    kept: neither base_failed nor depleted (less than least percent of the words left when frequent lines are gone; a line that exactly
    limit documents hold stays). Null texts have no words; null hosts are one host; rows that repeat an id are one document in the count of
    lines. Texts are judged whole, extra columns are ignored, and an empty table gives an empty one.
    """
    bad = materialize(frequent_lines(docs, host, limit), "rules-lines")
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = counts(docs.select("doc_id", F.col(host).alias("host"), "text").withColumn("row", F.monotonically_increasing_id()))
    keyed = lambda y: F.struct(line_hash(F.col("host"), y).alias("h"), (F.regexp_count(y, F.lit(" ")) + 1).alias("k"))
    line = F.transform(lines(F.coalesce(F.col("text"), F.lit(""))), lambda x: let(normalised(x), keyed))
    each = rows.select("row", "doc_id", *base, F.explode_outer(line).alias("line")).select("row", "doc_id", *base, "line.h", "line.k")
    each = keyed_join(each, bad, "h", "n", bad.agg(F.sum("n")).first()[0] or 0, "left", F.lit(True).alias("bad"))
    out = each.groupBy("row", "doc_id", *base).agg(F.coalesce(F.sum(F.when(F.col("bad"), F.col("k"))), F.lit(0)).alias("n_removed_words"))
    left = 100 * (F.col("n_words") - F.col("n_removed_words")) >= least * F.col("n_words")
    return out.select("doc_id", *base, (~F.col("base_failed") & left).alias("kept"), F.col("n_removed_words").cast("long"))


def clean(docs: DataFrame, host: str = "source", limit: int = LINE_DOCS) -> DataFrame:
    """docs with frequent lines removed from text; null texts stay null, and all other columns are kept whatever their names.

    Lines are joined with the frequent ones and put together again by row, so no list of frequent lines has to fit a task.
    """
    bad = materialize(frequent_lines(docs, host, limit), "rules-lines")
    row, h, n, kept = own_names(docs, "row", "h", "n", "kept")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rules-rows")
    bad = bad.select(F.col("h").alias(h), F.col("n").alias(n))
    # A line without words is nothing that is counted: no key.
    key = F.when(F.col("line").rlike(r"[^\x20\x09-\x0D]"), line_hash(F.col("host"), normalised(F.col("line"))))
    each = rows.where("text is not null").select(row, F.col(host).alias("host"), F.posexplode(F.split("text", "\n")).alias("place", "line")).withColumn(h, key)
    each = keyed_join(each, bad, h, n, bad.agg(F.sum(n)).first()[0] or 0, "left", F.lit(True).alias("bad"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n")
    texts = each.where("bad is null").groupBy(row).agg(text.alias(kept))
    out = rows.join(texts, row, "left").withColumn("text", F.when(F.col("text").isNotNull(), F.coalesce(kept, F.lit(""))))
    return out.select(*docs.columns)


def op8_quality_rules(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")).drop("n_removed_words")


OP8_SQL = rf"""
WITH d AS (SELECT row_number() OVER () r, doc_id, coalesce(doc_id::VARCHAR, 't' || text) doc, coalesce(source, '') host, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
l AS (SELECT r, doc, host, t, unnest(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) line FROM d),
ln AS (SELECT r, doc, host, line, trim(regexp_replace(translate(line, '{_UPPER}123456789', '{_LOWER}000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) y FROM l),
bad AS (SELECT host, y FROM ln GROUP BY ALL HAVING count(DISTINCT doc) > {LINE_DOCS}),
cut AS (SELECT r, sum(len(string_split(y, ' '))) removed FROM ln JOIN bad USING (host, y) GROUP BY r),
dup AS (SELECT r, count(*) - count(DISTINCT line) n FROM l GROUP BY r),
win AS (SELECT r, i, s, count(*) OVER (PARTITION BY r, s) c FROM (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) i FROM d WHERE len(w) >= 3))),
rep AS (SELECT r, count(DISTINCT p) n FROM (SELECT r, unnest([i, i + 1, i + 2]) p FROM win WHERE c > 1) GROUP BY r),
o AS (SELECT doc_id, len(w)::BIGINT n_words, len(array_to_string(w, ''))::BIGINT word_chars, (len(t) - len(translate(t, '#*$%&|<>', '')))::BIGINT n_symbols,
 coalesce(dup.n, 0)::BIGINT n_dup_lines, coalesce(rep.n, 0)::BIGINT n_repeat_words, coalesce(removed, 0) removed FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN cut USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words base_failed FROM o)
SELECT * EXCLUDE (removed), NOT base_failed AND 100 * (n_words - removed) >= {LEAST_KEPT} * n_words kept FROM f
"""
