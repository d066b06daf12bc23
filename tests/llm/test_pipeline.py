"""Each stage of the pipeline against a plain version."""

import random

import pyspark.sql.functions as F
import pytest

import corpus_pipeline as cp
from meshfield.llm import decontaminate, secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    r = random.Random(1)
    v = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(80):
        w = [r.choice(v) for _ in range(60)]
        text = " ".join(w)
        if i % 8 == 1:
            text = " ".join(f"{x.upper()}!!" for x in w)
        elif i % 8 == 2:
            text = rows[-2][1] + " tail"
        elif i % 8 == 3:
            text += " token = 'abcdefgh" + str(i) + "'"
        rows.append((i, text, "en", "s", len(text)))
    rows += [(200, "one two three four five six seven eight nine " + rows[0][1][:200], "en", None, 1), (201, None, None, None, None), (None, "free text without id", "en", "s", 20)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 8 != 1), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(0, "One two three four five six seven eight nine"), (1, rows[8][1][:300]), (2, rows[8][1][-200:])], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def kept(df):
    return sorted((r.doc_id for r in df.collect()), key=str)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bad = {i for i in range(80) if i % 8 == 1}
    one = cp.classify(spark, docs, sf).cache()
    assert one.columns == list(cp.DOCUMENTS) and not bad & set(kept(one)) and set(range(80)) - bad <= set(kept(one))
    two = cp.near_duplicates(spark, docs, sf)
    assert set(kept(docs)) - set(kept(two)) == {i for i in range(80) if i % 8 == 2}
    three = {r.doc_id: r for r in cp.decontaminated(spark, docs, sf).collect()}
    assert 8 not in three and len(decontaminate.words(three[200].text)) < len(decontaminate.words(docs.where("doc_id = 200").first().text))
    assert "seven" not in three[200].text and three[200].n_chars == len(three[200].text) and three[201].text is None
    four = {r.doc_id: r.text for r in cp.redacted(spark, docs, sf).collect()}
    for r in docs.collect():
        assert four[r.doc_id] == (r.text if r.text is None else secrets.redact(r.text, secrets.scan_text(r.text)))
    assert "<assign>" in four[3]
    five = cp.packed(spark, docs, sf)
    assert five.agg(F.sum("length")).first()[0] > 0 and five.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048
    assert five.select("doc_id").distinct().count() == docs.count()


def test_run(spark, sf):
    got = {r.doc_id for r in cp.run(spark, sf).collect()}
    first = set(kept(cp.classify(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)))
    assert got == first - {i for i in range(80) if i % 8 == 2} - {8} and len(got) > 50
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "best-fit packing"]


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0


def plain_groups(rows):
    """Row number -> smallest row number of its group: 5-word shingles, similarity 0.8."""
    w = [(t or "").split() for _, t in rows]
    sets = [{tuple(x[k : k + 5]) for k in range(max(1, len(x) - 4))} if x else set() for x in w]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = sorted((label[a], label[b]))
                label = [x if z == y else z for z in label]
    return label


def as_docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def test_near_duplicates_threshold(spark):
    """A copy that five words at 0.8 link and three words at 0.9 do not, and a corpus against brute force."""
    r = random.Random(5)
    base = [f"w{r.random()}" for _ in range(500)]
    copy = [f"x{i}" if i % 50 == 25 else w for i, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, " ".join(copy))]
    for i in range(3, 150):
        w = r.choice(rows)[1].split() if r.random() < 0.7 else [f"v{r.randrange(300)}" for _ in range(r.choice([3, 5, 20, 90]))]
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = f"v{r.randrange(300)}"
        rows.append((i, " ".join(w)))
    assert [x.n_links for x in cp.ngram_join.ngram_jaccard_join(as_docs(spark, rows[:2])).collect()] == [0, 0]
    assert kept(cp.near_duplicates(spark, as_docs(spark, rows[:2]), "")) == [1]
    label = plain_groups(rows)
    assert set(kept(cp.near_duplicates(spark, as_docs(spark, rows), ""))) == {i for k, (i, _) in enumerate(rows) if label[k] == k}


def test_near_duplicates_repeated_ids(spark):
    """One row of each group, where ids repeat with the same or another text or are null."""
    r = random.Random(6)
    a, b, c, d = (" ".join(f"w{r.random()}" for _ in range(60)) for _ in range(4))
    rows = [(7, a), (7, a), (3, b), (9, b + " tail"), (9, c), (None, d), (None, d), (None, d + " tail"), (5, a + " tail"), (None, b), (8, None), (8, None), (None, "")]
    got = sorted(((x.doc_id, x.text) for x in cp.near_duplicates(spark, as_docs(spark, rows), "").collect()), key=str)
    at_d = [x for x in got if (x[1] or "").startswith(d)]
    assert len(at_d) == 1 and at_d[0][0] is None
    assert [x for x in got if x not in at_d] == sorted([(5, a + " tail"), (3, b), (9, c), (8, None), (8, None), (None, "")], key=str)
