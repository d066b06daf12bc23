import random

import pyspark.sql.functions as F
import pytest

from meshfield.llm import common
from meshfield.llm import ngram_join as nj


def brute(rows, num=90):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    par = {i: i for i in sets}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    links = dict.fromkeys(sets, 0)
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                par[y] = x
    return {i: (len(sets[i]), find(i), links[i]) for i in ids}


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cls", F.lit(1)).withColumn("label", F.lit("x"))
    return {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in nj.ngram_jaccard_join(df).collect()}


def corpus(n, seed=1):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, base = [], []
    for i in range(n):
        if base and r.random() < 0.6:
            w = list(r.choice(base))
            for _ in range(r.randrange(3)):
                w[r.randrange(len(w))] = r.choice(vocab)
        else:
            w = [r.choice(vocab) for _ in range(r.choice([1, 2, 3, 8, 30, 120]))]
            base.append(w)
        rows.append((i, " ".join(w)))
    return rows


SETTINGS = (
    {},
    {"BLOCK": 8},
    {"BLOCK": 3, "CHUNK": 5, "WIDE": 4},
    {"BLOCK": 5, "FREQUENT": 3, "SEEN": 2, "COUNTED": 50, "BUCKET": 100},
    {"BLOCK_GRAMS": 60, "WIDE": 0, "ROUTE_BYTES": 0},
)


@pytest.mark.parametrize("few", [10_000, 0])
@pytest.mark.parametrize("setting", SETTINGS)
def test_against_brute_force(spark, monkeypatch, few, setting):
    """Components in one task or in rounds; blocks, chunks of lists, uncounted n-grams, tables that are not broadcast."""
    monkeypatch.setattr(common, "FEW_EDGES", few)
    for name, value in setting.items():
        monkeypatch.setattr(nj, name, value)
    rows = corpus(160) + [(1000, None), (1001, ""), (1002, " \n "), (1003, "Ä Ö"), (1004, "ä ö"), (1005, "A b"), (1006, "a\tB")]
    assert run(spark, rows) == brute(rows)


def test_hub(spark, monkeypatch):
    """A star and a chain of edges, with the join of a hub by broadcast."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    edges = [(0, k) for k in range(1, 6000)] + [(k, k + 1) for k in range(7000, 7300)]
    got = dict(common.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(64)).collect())
    assert got == {k: 0 for k in range(6000)} | {k: 7000 for k in range(7000, 7301)}


def test_many_variants(spark):
    """5,000 texts of one page, each with words of its own: links to a sample of texts are counted apart, and all are one component."""
    r = random.Random(8)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(5000):
        w = list(base)
        for _ in range(r.randrange(1, 4)):
            w[r.randrange(120)] = f"x{r.random()}"
        rows.append((i, " ".join(w)))
    got = run(spark, rows)
    sets = [{tuple(t.split()[k : k + 3]) for k in range(118)} for _, t in rows]
    for i in range(0, 5000, 500):
        n = sum(100 * len(sets[i] & s) >= 90 * len(sets[i] | s) for s in sets) - 1
        assert got[i][0] == len(sets[i]) and got[i][2] == n
    least = {i: min([j for j in range(5000) if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])][:1]) for i in range(0, 5000, 1000)}
    assert all(got[i][1] <= j for i, j in least.items())


def test_hot_group(spark):
    r = random.Random(3)
    base = [f"t{i}" for i in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(150)] = f"x{r.random()}"
        rows.append((i, " ".join(w)))
    assert run(spark, rows) == brute(rows)


def test_empty_and_repeated(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in nj.ngram_jaccard_join(df).collect())
    assert got == [(-1, 0, -1), (-1, 2, 1), (1, 2, 1), (1, 2, 1)]


def test_null_ids_link(spark):
    """A text whose documents all have null ids counts as a partner, and links two documents that it alone joins."""
    base = [f"t{i}" for i in range(200)]

    def changed(*at):
        return " ".join(f"x{i}" if i in at else w for i, w in enumerate(base))

    rows = [(1, changed(20, 60)), (2, changed(100, 140)), (None, changed()), (None, changed())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id, r.n_links) for r in nj.ngram_jaccard_join(df).collect())
    assert got == [(-1, 1, 3), (-1, 1, 3), (1, 1, 2), (2, 1, 2)]
    alone = spark.createDataFrame([(None, changed()), (None, changed(20))], "doc_id long, text string")
    assert [(r.component_id, r.n_links) for r in nj.ngram_jaccard_join(alone).collect()] == [(None, 1), (None, 1)]


@pytest.mark.parametrize("at_once", [1 << 20, 700, 257])
def test_word_hashes(monkeypatch, at_once):
    """Equal words, and only they, have equal hashes, wherever a buffer is cut; counts are those of split(); only A-Z change their case."""
    monkeypatch.setattr(common, "HASHED", at_once)
    r = random.Random(4)
    words = ["a", "b", "ab", "ba", "aa", "aaa", "A", "É", "é", "\x1c", "\x00", "\x00\x00", "\u00a0", "x" * 300, "x" * 301, "y" * 256, "y" * 257, "z" * 5000] + [f"w{i}" for i in range(50)]
    texts = ["", " ", "\n\t\v\f\r "] + ["".join(r.choice(words) + r.choice([" ", "\n", "  ", "\t\r", "\v"]) for _ in range(r.randrange(30))) for _ in range(40)] + ["end"]
    raw = [t.encode() for t in texts]
    h, counts = common.word_hashes(raw)
    plain = [w for t in raw for w in t.lower().split()]
    assert counts.tolist() == [len(t.split()) for t in raw] and len(h) == len(plain)
    by = {}
    for w, x in zip(plain, h.tolist(), strict=True):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)
    monkeypatch.setattr(common, "HASHED", 1 << 20)
    again = dict(zip(plain, common.word_hashes(raw)[0].tolist(), strict=True))
    assert again == by
    one, n = common.word_hashes([])
    assert len(one) == 0 and len(n) == 0
    many = [bytes(r.randrange(97, 123) for _ in range(r.randrange(1, 12))) for _ in range(200_000)]
    assert len(set(common.word_hashes([b" ".join(many)])[0].tolist())) == len(set(many))
