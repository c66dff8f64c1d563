"""URL filter: explicit rules, and gradient-boosted trees on lexical features for what no rule covers.

Everything runs as DataFrame expressions. URLs that a rule decides are the labelled ones. A bounded sample of them (by
hash of the URL) is reduced to counts per vector of feature bins; each tree level is one aggregate of gradients by
(node, feature, bin), whose few rows reach the driver, which picks the splits. The finished trees are one
SQL expression on the features, scored inside whole-stage codegen without a shuffle.

Edge cases: a null URL or one without ``://`` has empty host and path, fits no rule and is judged by its features
(for null those of the empty text); a URL of any length is read whole; rows that repeat are judged, and learned from, one by one; of rules of one
length the first given wins; with labels of one class only, or none, the trees are a constant, and a score of 0 allows;
extra columns are kept, ones named like output columns are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import drop, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Labelled URLs to train on at most, suffixes with statistics of their own, and bins of a feature.
SAMPLE = 50_000
SUFFIXES = 1_000
BINS = 16
TREES, DEPTH, RATE, RIDGE = 10, 3, 0.3, 1.0


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed values of the query's contract.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path by position of the first ``://``; empty where there is none."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def matched_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits a host (or a parent domain of it) and a path prefix; else null."""
    text = verdict = None
    for rule in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, rule.text) if text is None else text.when(fits, rule.text)
        verdict = F.when(fits, rule.verdict) if verdict is None else verdict.when(fits, rule.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text.otherwise(none), verdict.otherwise(none))


def _count(text: Column, what: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))).cast("double")


def _entropy(text: Column) -> Column:
    """Bits per character of the text's own character distribution; 0 for the empty text."""
    size = F.length(text)
    chars = F.array_distinct(F.split(text, ""))
    share = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size
    bits = F.aggregate(chars, F.lit(0.0), lambda s, c: s - F.when(F.length(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))
    return F.when(size > 0, bits).otherwise(0.0)


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    size = F.length(url).cast("double")
    digits = size - F.length(F.translate(url, "0123456789", ""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    last = F.element_at(F.split(path, "/"), -1)
    return {
        "url_length": size,
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": _count(path, "/"),
        "digit_ratio": F.when(size > 0, digits / size).otherwise(0.0),
        "entropy": F.round(_entropy(url), 6),
        "parameters": F.when(F.length(query) > 0, _count(query, "&") + 1).otherwise(0.0),
        "host_dots": _count(host, "."),
        "hyphens": _count(host, "-"),
        "last_length": F.length(last).cast("double"),
    }


def host_suffix(host: Column) -> Column:
    return F.element_at(F.split(host, r"\."), -1)


class Tree:
    """A binary tree on named features; leaves add to the score."""

    def __init__(self, feature: str = "", cut: float = 0.0, left: Tree | None = None, right: Tree | None = None, leaf: float = 0.0):
        self.feature, self.cut, self.left, self.right, self.leaf = feature, cut, left, right, leaf

    def sql(self) -> str:
        if self.left is None or self.right is None:
            return f"{self.leaf!r}D"
        return f"IF(`{self.feature}` <= {self.cut!r}D, {self.left.sql()}, {self.right.sql()})"


def _node_sql(splits: dict[int, tuple[str, float]], node: int = 1) -> str:
    """Number of the node that a row reaches (children of k: 2k and 2k+1)."""
    if node not in splits:
        return str(node)
    feature, cut = splits[node]
    return f"IF(`{feature}` <= {cut!r}D, {_node_sql(splits, 2 * node)}, {_node_sql(splits, 2 * node + 1)})"


def _grow(table: DataFrame, names: list[str], score: str) -> Tree:
    """One tree for the logistic loss at ``score``, by histograms of gradients."""
    p = f"(1 / (1 + exp(-({score}))))"
    splits: dict[int, tuple[str, float]] = {}
    totals: dict[int, tuple[float, float]] = {}
    for depth in range(DEPTH):
        open_nodes = range(1 << depth, 2 << depth)
        stacked = table.selectExpr(
            f"{_node_sql(splits)} AS node", f"n * {p} - bad_url AS g", f"n * {p} * (1 - {p}) AS h",
            f"stack({len(names)}, " + ", ".join(f"'{n}', `{n}`" for n in names) + ") AS (feature, value)",
        )
        hist: dict[tuple[int, str], list[tuple[float, float, float]]] = {}
        for r in stacked.groupBy("node", "feature", "value").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            hist.setdefault((r["node"], r["feature"]), []).append((r["value"], r["g"], r["h"]))
        for node in open_nodes:
            best = (1e-6, "", 0.0, (0.0, 0.0), (0.0, 0.0))
            for name in names:
                bins = sorted(hist.get((node, name), []))
                g, h = math.fsum(b[1] for b in bins), math.fsum(b[2] for b in bins)
                totals[node] = (g, h)
                gl = hl = 0.0
                for value, dg, dh in bins[:-1]:
                    gl, hl = gl + dg, hl + dh
                    gain = gl * gl / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g * g / (h + RIDGE)
                    if gain > best[0] + 1e-9:
                        best = (gain, name, value, (gl, hl), (g - gl, h - hl))
            if best[1]:
                splits[node] = best[1:3]
                totals[2 * node], totals[2 * node + 1] = best[3], best[4]

    def build(node: int) -> Tree:
        if node in splits:
            return Tree(*splits[node], build(2 * node), build(2 * node + 1))
        g, h = totals.get(node, (0.0, 0.0))
        return Tree(leaf=round(-RATE * g / (h + RIDGE), 9))

    return build(1)


def train_trees(labelled: DataFrame, names: list[str]) -> str:
    """SQL for the log-odds of ``bad_url`` = 1, from a bounded table of features and ``bad_url`` (0 or 1)."""
    n, bad, *quantiles = labelled.agg(
        F.count("*"), F.coalesce(F.sum("bad_url"), F.lit(0)),
        *[F.percentile_approx(c, [k / BINS for k in range(1, BINS)], 10_000) for c in names],
    ).first()
    if not n:
        return "0D"
    prior = math.log((bad + 0.5) / (n - bad + 0.5))
    if bad in (0, n):
        return f"{prior!r}D"
    cuts = {c: sorted(set(q)) for c, q in zip(names, quantiles, strict=True)}

    def binned(name: str) -> str:
        """The smallest cut not below the value, so a split on bins is the same split on values."""
        tests = " ".join(f"WHEN `{name}` <= {c!r}D THEN {c!r}D" for c in cuts[name])
        return f"CASE {tests} ELSE double('Infinity') END AS `{name}`"

    table = labelled.selectExpr(*map(binned, names), "bad_url").groupBy(*names).agg(F.count("*").alias("n"), F.sum("bad_url").alias("bad_url"))
    table = materialize(table.coalesce(4), "bins")
    score = f"{prior!r}D"
    for _ in range(TREES):
        score += f" + {_grow(table, names, score).sql()}"
    drop(table)
    return score


def judge_urls(pages: DataFrame, url_col: str = "url", rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE, suffixes: int = SUFFIXES) -> DataFrame:
    """``pages`` with host, path, rule (or null), verdict (allow or block) and score (log-odds of block).

    ``sample`` bounds the labelled URLs of the fit, ``suffixes`` those with a rate of their own (the most frequent; others get the mean).
    """
    made = ("host", "path", "rule", "verdict", "score")
    keep = [c for c in pages.columns if c.lower() not in made]
    base = pages.select(pages[url_col].alias("u"), F.struct(*[pages[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(keep)]).alias("rest"))
    host, path = host_and_path(F.col("u"))
    parts = base.select("rest", "u", host.alias("host"), path.alias("path"))
    rule, ruled = matched_rule(F.col("host"), F.col("path"), rules)
    parts = parts.withColumns({"rule": rule, "ruled": ruled})
    features = lexical_features(F.coalesce("u", F.lit("")), F.col("host"), F.col("path"))
    labelled = parts.where("ruled is not null").select("u", "host", "path", (F.col("ruled") == "block").cast("int").alias("bad_url"))
    labelled = labelled.orderBy(F.xxhash64("u"), "u").limit(sample)
    labelled = labelled.select(
        "bad_url", F.pmod(F.xxhash64(F.lit("fold"), "u"), F.lit(2)).alias("fold"), host_suffix(F.col("host")).alias("suffix"), *[c.alias(n) for n, c in features.items()]
    )
    labelled = materialize(labelled, "labelled")
    total, bad = labelled.agg(F.count("*"), F.coalesce(F.sum("bad_url"), F.lit(0))).first()
    prior = bad / total if total else 0.5
    # A URL that is trained on gets its suffix's rate from the other half, so a rate never knows its own URL's label.
    per_fold = lambda c: [F.coalesce(F.sum(F.when(F.col("fold") != k, c)), F.lit(0)) for k in (0, 1)]
    stats = labelled.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("bad_url").alias("bad"), F.array(*per_fold(F.lit(1))).alias("ns"), F.array(*per_fold(F.col("bad_url"))).alias("bads"))
    rate = lambda k, n: F.round((k + 5 * prior) / (n + 5), 9)
    stats = stats.orderBy(F.desc("n"), "suffix").limit(suffixes).select(
        "suffix", rate(F.col("bad"), F.col("n")).alias("whole_rate"), F.array(*[rate(F.col("bads")[k], F.col("ns")[k]) for k in (0, 1)]).alias("fold_rates")
    )
    stats = materialize(stats, "suffixes")
    # At most ``suffixes`` rows are broadcast.
    rated = lambda df, found: df.join(F.broadcast(stats), "suffix", "left").withColumn("suffix_rate", F.coalesce(found, F.lit(prior)))
    names = [*features, "suffix_rate"]
    score = train_trees(rated(labelled, F.get("fold_rates", F.col("fold").cast("int"))).select(*names, "bad_url"), names)
    drop(labelled)
    every = parts.select("*", host_suffix(F.col("host")).alias("suffix"), *[c.alias(n) for n, c in features.items()])
    scored = rated(every, F.col("whole_rate"))
    scored = scored.withColumn("score", F.expr(score))
    verdict = F.coalesce("ruled", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return scored.select(
        *[F.col(f"rest.c{i}").alias(c) for i, c in enumerate(keep)], "host", "path", "rule", verdict.alias("verdict"), "score"
    )
