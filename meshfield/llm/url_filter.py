"""URL filters, in DataFrame operations only: rules on host suffix and path, and gradient-boosted trees for the URLs that no rule fits.

Trees grow level by level from one aggregate per level: sums of integer gradients and curvatures by node, feature and bin. Thresholds,
suffix statistics and trees come from a bounded sample of labelled URLs; scoring is one expression. A row's suffix statistic leaves out
the rows of its own group (the rule that labelled it, or a fold), so that a label never stands in a feature of its own row, and a
suffix that one group alone has labelled counts as unknown.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Labelled URLs in the sample that is fitted (smallest hashes), suffixes with statistics of their own, thresholds of a feature.
MAX_TRAIN, MAX_SUFFIXES, MAX_BINS, FOLDS = 20_000, 64, 16, 5
ROUNDS, DEPTH, RATE, RIDGE = 8, 3, 0.4, 1.0
#: Probability from which the trees block; labels come from few rules, so less certain URLs pass.
BLOCK_AT = 0.9
_UNIT = 1 << 20
FEATURES = ("f_length", "f_host", "f_path", "f_depth", "f_digits", "f_entropy", "f_params", "f_labels", "f_hyphens", "f_suffix")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ://, A-Z lower-cased; path up to ? or #. Null or no ://: both empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _count(s: Column, chars: str) -> Column:
    return F.length(s) - F.length(F.translate(s, chars, ""))


def suffix(host: Column) -> Column:
    return F.element_at(F.split(host, r"\."), -1)


def with_features(df: DataFrame, suffixes: dict[str, int], prior: int, key: Column | None = None) -> DataFrame:
    """df (url, host, path) plus integer features. key: of the table of suffix statistics (default: the host's suffix)."""
    key = suffix(F.col("host")) if key is None else key
    url = F.coalesce(F.col("url"), F.lit(""))
    body = F.concat("host", "path")
    n = F.greatest(F.length(body), F.lit(1))
    seen = F.array_distinct(F.filter(F.split(body, ""), lambda c: c != ""))
    share = F.transform(seen, lambda c: (F.length(body) - F.length(F.replace(body, c, F.lit("")))) / n)
    entropy = F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p))
    table = F.create_map(*[F.lit(x) for kv in suffixes.items() for x in kv]) if suffixes else None
    rate = F.coalesce(F.get(F.array(table), F.lit(0))[key] if suffixes else F.lit(None).cast("int"), F.lit(prior))
    return df.withColumns({
        "f_length": F.length(url),
        "f_host": F.length("host"),
        "f_path": F.length("path"),
        "f_depth": _count(F.col("path"), "/"),
        "f_digits": F.round(1000 * _count(url, "0123456789") / F.greatest(F.length(url), F.lit(1))).cast("int"),
        "f_entropy": F.round(100 * entropy).cast("int"),
        "f_params": _count(url, "?&"),
        "f_labels": _count(F.col("host"), "."),
        "f_hyphens": _count(F.col("host"), "-"),
        "f_suffix": rate,
    })


@dataclass
class Model:
    base: float = 0.0
    trees: list = field(default_factory=list)  # (feature, threshold, left, right) or a leaf's value
    suffixes: dict[str, int] = field(default_factory=dict)
    prior: int = 500

    def margin(self) -> Column:
        out = F.lit(float(self.base))
        for t in self.trees:
            out = out + _tree(t)
        return out


def _tree(t) -> Column:
    if not isinstance(t, tuple):
        return F.lit(float(t))
    return F.when(F.col(t[0]) <= t[1], _tree(t[2])).otherwise(_tree(t[3]))


def train(labelled: DataFrame, max_rows: int = MAX_TRAIN, rounds: int = ROUNDS, depth: int = DEPTH) -> Model:
    """Trees from labelled (url, label 1: block, 0: allow; group where known: what the label comes from, else one of FOLDS).

    Null labels are left out; repeated rows count each; with one class only, or no row, the model is a constant.
    """
    host, path = host_and_path(F.col("url"))
    group = F.col("group").cast("string") if "group" in labelled.columns else F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("string")
    rows = labelled.where("label is not null").select("url", host.alias("host"), path.alias("path"), F.col("label").cast("int").alias("label"), F.coalesce(group, F.lit("")).alias("grp"))
    rows = materialize(rows.orderBy(F.xxhash64("url"), "url", "label").limit(max_rows), "url-sample")
    n, n1 = rows.agg(F.count("*"), F.sum("label")).first()
    n1 = n1 or 0
    model = Model(base=math.log((n1 + 1) / (n - n1 + 1)), prior=round(1000 * (n1 + 1) / (n + 2)))
    if n1 in (0, n):
        return model
    top = rows.groupBy(suffix(F.col("host")).alias("s")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "s").limit(MAX_SUFFIXES)
    stats = rows.groupBy(suffix(F.col("host")).alias("s"), "grp").agg(F.count("*").alias("n"), F.sum("label").alias("k")).join(F.broadcast(top.select("s")), "s").collect()
    smooth = lambda k, n: round(1000 * (k + 10 * model.prior / 1000) / (n + 10))
    others = {}
    for s in sorted({r.s for r in stats}):
        own = {r.grp: (r.k, r.n) for r in stats if r.s == s}
        k, n = (sum(x[i] for x in own.values()) for i in (0, 1))
        if len(own) > 1:
            model.suffixes[s] = smooth(k, n)
            others |= {f"{s} {g}": smooth(k - x[0], n - x[1]) for g, x in own.items()}
    full = with_features(rows, others, model.prior, F.concat(suffix(F.col("host")), F.lit(" "), F.col("grp")))
    full = materialize(full.groupBy(*FEATURES).agg(F.count("*").alias("n"), F.sum("label").alias("k")), "url-features")
    at = [k / MAX_BINS for k in range(1, MAX_BINS)]
    cuts = full.agg(*[F.percentile_approx(f, at, 10_000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(cuts[f] or [])) for f in FEATURES}
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-model.margin()))
        g = F.round((p * F.col("n") - F.col("k")) * _UNIT).cast("long")
        h = F.round(p * (1 - p) * F.col("n") * _UNIT).cast("long")
        bins = F.array(*[_bin(f, cuts[f]) for f in FEATURES])
        table = full.select("*", g.alias("g"), h.alias("h"), F.posexplode(bins).alias("f", "bin"))
        model.trees.append(_grown(table, cuts, depth))
    return model


def _bin(name: str, cuts: list[int]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(name))) if cuts else F.lit(0)


def _grown(table: DataFrame, cuts: dict[str, list[int]], depth: int):
    """One tree; a level is one aggregate over all its nodes."""
    splits: dict[int, tuple[str, int]] = {}
    value: dict[int, float] = {}
    node, open_ = F.lit(1), {1}
    for level in range(depth + 1):
        if not open_:
            break
        sums: dict[int, dict] = {}
        for r in table.groupBy(node.alias("node"), "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            sums.setdefault(r.node, {}).setdefault(r.f, {})[r.bin] = (r.g / _UNIT, r.h / _UNIT)
        nxt = set()
        for k in sorted(open_):
            if k not in sums:
                value[k] = 0.0
                continue
            some = sums[k][0].values()
            g, h = sum(x[0] for x in some), sum(x[1] for x in some)
            value[k] = -RATE * g / (h + RIDGE)
            best = (1e-6, None, None)
            for f, name in enumerate(FEATURES):
                gl = hl = 0.0
                for b, cut in enumerate(cuts[name]):
                    x = sums[k].get(f, {}).get(b, (0, 0))
                    gl, hl = gl + x[0], hl + x[1]
                    gain = round(gl * gl / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g * g / (h + RIDGE), 6)
                    if gain > best[0]:
                        best = (gain, name, cut)
            if best[1] and level < depth:
                splits[k] = best[1:]
                nxt |= {2 * k, 2 * k + 1}
        for k in sorted(nxt):
            if k % 2 == 0:
                f, cut = splits[k // 2]
                node = F.when(node == k // 2, F.when(F.col(f) <= cut, k).otherwise(k + 1)).otherwise(node)
        open_ = nxt

    def built(k: int):
        return (*splits[k], built(2 * k), built(2 * k + 1)) if k in splits else value.get(k, 0.0)

    return built(1)


def judge(pages: DataFrame, model: Model, rules=RULES) -> DataFrame:
    """pages (url, ...) plus host, path, rule, score (probability of block by the trees) and verdict.

    Columns of pages with these names, and with those of FEATURES, are replaced; all others are kept. Null and empty urls, and urls without
    ://, have an empty host and path and no rule; repeated rows get equal verdicts; of rules of equal length that fit the later one
    holds; urls of any length are read whole, and an empty table gives an empty one.
    """
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "score", "verdict", *FEATURES)]
    host, path = host_and_path(F.col("url"))
    rows = with_features(pages.select(*keep, host.alias("host"), path.alias("path")), model.suffixes, model.prior)
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    score = 1 / (1 + F.exp(-model.margin()))
    return rows.select(*keep, "host", "path", name.alias("rule"), score.alias("score"), F.coalesce(verdict, F.when(score >= BLOCK_AT, "block").otherwise("allow")).alias("verdict"))


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """The URLs that a rule decides, as labelled rows (url, label, group: the rule)."""
    host, path = host_and_path(F.col("url"))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = pages.select("url", host.alias("host"), path.alias("path"))
    rows = rows.select("url", F.when(verdict == "block", 1).when(verdict == "allow", 0).alias("label"), name.alias("group"))
    return rows.where("label is not null")


def held_out_auc(labelled: DataFrame, whole_groups: bool = True) -> float | None:
    """Area under the ROC curve of scores of labelled rows that no model has seen: of whole groups, or of a fold by the url's hash."""
    part = F.col("group") if whole_groups else F.pmod(F.xxhash64(F.lit(7), "url"), F.lit(FOLDS)).cast("string")
    rows = labelled.withColumn("part", part)
    scored = None
    for r in rows.select("part").distinct().orderBy("part").limit(100).collect():
        model = train(rows.where(F.col("part") != r.part).drop("part"))
        out = judge(rows.where(F.col("part") == r.part), model, rules=()).select(F.round("score", 6).alias("score"), "label")
        scored = out if scored is None else scored.union(out)
    if scored is None:
        return None
    counts = sorted((r.score, r.n, r.k) for r in scored.groupBy("score").agg(F.count("*").alias("n"), F.sum("label").alias("k")).collect())
    ones, below, area = sum(k for *_, k in counts), 0, 0.0
    zeros = sum(n for _, n, _ in counts) - ones
    for _, n, k in counts:
        area += k * (below + (n - k) / 2)
        below += n - k
    return area / (ones * zeros) if ones and zeros else None


def op4_url_filter(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, train(ruled(pages))).select("page_id", "host", "path", "rule", "verdict")
