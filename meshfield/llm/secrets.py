"""Secret scans with an incremental blob ledger.

Every version of a document is content-addressed (SHA-256 of its text). The ledger lists the (blob, rule version) pairs
scanned before, with their findings; only unseen pairs are scanned, and findings are joined back to all paths that hold them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, broadcast_if_small, keyed_join, materialize, new_path, own_names, slices, small_batches

RULE_VERSION = "2"
#: Digests that a task remembers, so as to scan a repeated text once.
REMEMBERED = 50_000
#: Kinds in the order in which they are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "private_key", "github", "slack", "jwt", "url_password")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: (kind, text that has to be there, pattern); letters, words and spaces are those of ASCII.
_MORE = tuple(
    (kind, sign, re.compile(rule, re.A))
    for kind, sign, rule in (
        ("private_key", "-----BEGIN", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )*PRIVATE KEY-----)?"),
        ("github", "gh", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
        ("slack", "xox", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
        ("jwt", "eyJ", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
        ("url_password", "://", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,100}:[^\s/@]{3,200}@[A-Za-z0-9.-]+"),
    )
)
FINDINGS = "kind string, start long, end long"
LEDGER = f"blob string, rule_version string, findings array<struct<{FINDINGS.replace(' ', ':').replace(',:', ',')}>>"


def scan_text(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    for kind, sign, rule in _MORE:
        if sign in text:
            out += [(kind, m.start(), m.end()) for m in rule.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def joined(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def blob() -> F.Column:
    return F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)


def scan(docs: DataFrame, ledger: DataFrame | None = None, version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """docs (text, ...) -> (docs plus blob and findings, new ledger rows).

    ledger: rows of earlier runs (blob, rule_version, findings), or None. Null texts count as empty; repeated rows, and rows of any other
    path or version with the same text, are further paths of one blob. Texts are scanned whole, an empty table gives an empty one,
    and columns of docs named blob and findings are replaced, all others kept. New ledger rows are written to the shared folder;
    append them to the ledger with append_ledger(). Texts are not shuffled: only digests are, but for an update in which very many
    blobs are unseen beside very many that are known. A task scans a text that several of its rows hold once.
    """
    known = None if ledger is None else ledger.where(F.col("rule_version") == version).select("blob", "rule_version", "findings")
    body = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    paths = materialize(body.select(blob().alias("blob")).groupBy("blob").agg(F.count("*").alias("paths")), "secret-paths")
    unseen = body.select(blob().alias("blob"), "text")
    if known is not None:
        missing = materialize(paths.select("blob").join(known.select("blob"), "blob", "left_anti"), "secret-unseen")
        unseen = unseen.join(broadcast_if_small(missing), "blob", "left_semi")

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[str] = set()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in slices(batches):
            names, found = [], []
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if name not in done:
                    done.add(name)
                    names.append(name)
                    found.append([{"kind": k, "start": s, "end": e} for k, s, e in scan_text(text)])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([version] * len(names), pa.string()), pa.array(found, kind)], names=["blob", "rule_version", "findings"])
            if len(done) > REMEMBERED:
                done.clear()

    scanned = unseen.mapInArrow(run, LEDGER).groupBy("blob").agg(F.first("rule_version").alias("rule_version"), F.first("findings").alias("findings"))
    fresh = materialize(scanned, "secret-ledger")
    every = fresh if known is None else fresh.union(known)
    name, findings, n = own_names(docs, "blob", "findings", "paths")
    some = every.where(F.size("findings") > 0).dropDuplicates(["blob"]).join(paths, "blob").select(F.col("blob").alias(name), F.col("findings").alias(findings), F.col("paths").alias(n))
    some = materialize(some, "secret-findings")
    keep = [c for c in docs.columns if c not in ("blob", "findings")]
    total = paths.agg(F.sum("paths")).first()[0] or 0
    out = keyed_join(docs.withColumn(name, blob()), some, name, n, total, "left")
    none = F.array().cast(some.schema[findings].dataType)
    return out.select(*keep, F.col(name).alias("blob"), F.coalesce(findings, none).alias("findings")), fresh


def append_ledger(fresh: DataFrame, path: str) -> None:
    fresh.write.mode("append").parquet(path)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with every span (overlapping ones as one) replaced by its first kind."""
    out, at = [], 0
    merged: list[list] = []
    for k, s, e in spans:
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(e, merged[-1][2])
        else:
            merged.append([k, s, e])
    for k, s, e in merged:
        out += [text[at:s], f"<{k}>"]
        at = e
    return "".join([*out, text[at:]])


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[(x["kind"], x["start"], x["end"]) for x in r] for r in b.column(1).to_pylist()]
        cols = [pa.array([sum(x[0] == k for x in r) for r in spans], pa.int64()) for k in KINDS[:3]]
        base = [hashlib.sha256(joined([x for x in r if x[0] in KINDS[:3]]).encode()).hexdigest() for r in spans]
        return pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(base, pa.string()), pa.array([joined(r) for r in spans], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return arrow_map(found.select(F.col("doc_id").cast("long"), "findings"), f, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op9_secret_scan(spark, sf_dir):
    """Documents come in two updates of one ledger: the second scans what the first has not seen, and findings of both are joined back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ledger = new_path(spark, "ledger")
    late = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1, F.lit(True))
    append_ledger(scan(docs.where(~late))[1], ledger)
    found, fresh = scan(docs, spark.read.schema(LEDGER).parquet(ledger))
    append_ledger(fresh, ledger)
    return digest(found)


def _any_case(pattern: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", pattern)


_PATTERNS = {"assign": "(" + _any_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+", **{k: r.pattern.replace(r"\s", r"\x09-\x0D\x20") for k, _, r in _MORE}}
_KIND_ROWS = ", ".join(f"({n}, '{k}', '{p.replace(chr(39), chr(39) * 2)}')" for n, (k, p) in enumerate(_PATTERNS.items()))
#: What stands between matches, and the matches, give their places.
OP9_SQL = rf"""
WITH kinds AS (SELECT * FROM (VALUES {_KIND_ROWS}) v(o, kind, p)), d AS (SELECT doc_id, coalesce(text, '') t FROM documents),
{", ".join(f"m{n} AS (SELECT doc_id, {n} o, regexp_extract_all(t, '{p.replace(chr(39), chr(39) * 2)}') m, string_split_regex(t, '{p.replace(chr(39), chr(39) * 2)}') b FROM d)" for n, p in enumerate(_PATTERNS.values()))},
m AS ({" UNION ALL ".join(f"SELECT * FROM m{n} WHERE len(m) > 0" for n in range(len(_PATTERNS)))}),
w AS (SELECT doc_id, o, unnest([struct_pack(x := m[i], a := list_sum(list_transform(b[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0)) FOR i IN range(1, len(m) + 1)]) s FROM m),
f AS (SELECT doc_id, o, kind, s.a::BIGINT a, (s.a + length(s.x))::BIGINT z FROM w JOIN kinds USING (o) WHERE CASE o WHEN 0 THEN length(regexp_extract(s.x, p, 2)) >= 8 WHEN 1 THEN length(s.x) >= 16 WHEN 2 THEN length(s.x) >= 32 ELSE true END),
j AS (SELECT doc_id, count(*) FILTER (o = 0) n0, count(*) FILTER (o = 1) n1, count(*) FILTER (o = 2) n2, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, o) spans, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, o) FILTER (o < 3) base FROM f GROUP BY doc_id)
SELECT doc_id::BIGINT doc_id, coalesce(n0, 0)::BIGINT n_assign, coalesce(n1, 0)::BIGINT n_access, coalesce(n2, 0)::BIGINT n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans FROM d LEFT JOIN j USING (doc_id)
"""
