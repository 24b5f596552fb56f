"""URL filter: host and path rules, and gradient-boosted trees for the rest.

The trees are trained on URLs that a rule labels and look at lexical features
only.  Training takes a bounded sample on the driver; judging is one projection
of built-in functions, so it runs inside generated code next to the scan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 20, 3, 16, 0.3
SUFFIXES = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


FEATURES = ("length", "host_length", "path_length", "depth", "labels", "hyphens", "digit_ratio", "entropy", "parameters", "fragment", "extension", "suffix_rate")


def _count(c: Column, what: str) -> Column:
    return F.length(c) - F.length(F.translate(c, what, ""))


def features(url: Column, host: Column, path: Column, suffix_rate: Column) -> list[Column]:
    u = F.coalesce(url, F.lit(""))
    n = F.length(u)
    share = lambda c: (n - F.length(F.replace(u, c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(F.split(u, "")), F.lit(0.0), lambda a, c: F.when(c == "", a).otherwise(a - share(c) * F.log2(share(c))))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    out = [n, F.length(host), F.length(path), _count(path, "/"), _count(host, "."), _count(host, "-"),
           F.when(n > 0, _count(u, "0123456789") / n).otherwise(F.lit(0.0)), F.when(n > 0, entropy).otherwise(F.lit(0.0)),
           F.when(F.length(query) > 0, _count(query, "&") + 1).otherwise(F.lit(0)), F.instr(u, "#").cast("boolean").cast("int"),
           F.when(path.rlike(r"\.[A-Za-z0-9]{1,5}$"), F.lit(1)).otherwise(F.lit(0)), suffix_rate]
    return [F.coalesce(c.cast("double"), F.lit(0.0)).alias(name) for c, name in zip(out, FEATURES, strict=True)]


def suffix_of(host: Column) -> Column:
    """The last label of a host."""
    return F.regexp_extract(host, r"([^.]*)$", 1)


@dataclass
class Model:
    start: float = -1.0
    prior: float = 0.5
    rates: dict[str, float] = field(default_factory=dict)
    trees: list = field(default_factory=list)

    def suffix_rate(self, host: Column) -> Column:
        s, out = suffix_of(host), F.lit(self.prior)
        for suffix, rate in self.rates.items():
            out = F.when(s == suffix, F.lit(rate)).otherwise(out)
        return out

    def margin(self) -> Column:
        """Log-odds of block, from the feature columns."""
        def expr(t) -> Column:
            if not isinstance(t, tuple):
                return F.lit(float(t))
            j, cut, low, high = t
            return F.when(F.col(FEATURES[j]) <= cut, expr(low)).otherwise(expr(high))
        out = F.lit(self.start)
        for t in self.trees:
            out = out + expr(t)
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> tuple[float, list]:
    """Newton boosting of the logistic loss over quantile bins."""
    p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    start = math.log(p / (1 - p))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    slot = [np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]
    f, out = np.full(len(y), start), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        value = -total_g / (total_h + 1)
        best = (1e-6, -1, 0)
        if left and len(rows) >= 20:
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                a = np.cumsum(np.bincount(slot[j][rows], g[rows], len(c) + 1))[:-1]
                b = np.cumsum(np.bincount(slot[j][rows], h[rows], len(c) + 1))[:-1]
                gain = a * a / (b + 1) + (total_g - a) ** 2 / (total_h - b + 1) - total_g**2 / (total_h + 1)
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), -j - 1, k))
        if best[1] == -1 and best[0] <= 1e-6:
            f[rows] += rate * value
            return rate * value
        j, k = -best[1] - 1, best[2]
        low = slot[j][rows] <= k
        if low.all() or not low.any():
            f[rows] += rate * value
            return rate * value
        return (j, float(cuts[j][k]), grow(rows[low], g, h, left - 1), grow(rows[~low], g, h, left - 1))

    for _ in range(trees):
        q = 1 / (1 + np.exp(-f))
        out.append(grow(np.arange(len(y)), q - y, q * (1 - q), depth))
    return start, out


def fit(pages: DataFrame, url_col: str = "url", rules=RULES, sample: int = SAMPLE_ROWS) -> Model:
    """Trains on at most `sample` URLs that a rule fits, those of smallest hash."""
    url = F.col(url_col)
    parts = pages.select(url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    known = parts.withColumn("verdict", rule_for(F.col("host"), F.col("path"), rules)[1]).where("verdict is not null")
    few = known.orderBy(F.xxhash64("url"), "url").limit(sample)
    rows = few.select((F.col("verdict") == "block").cast("int").alias("y"), suffix_of(F.col("host")).alias("suffix"), *features(F.col("url"), F.col("host"), F.col("path"), F.lit(0.0))).collect()
    if not rows:
        return Model()
    y, suffix = np.array([r.y for r in rows], float), [r.suffix for r in rows]
    seen: dict[str, list[float]] = {}
    for s, v in zip(suffix, y.tolist(), strict=True):
        seen.setdefault(s, []).append(v)
    prior = float(y.mean())
    top = sorted(seen, key=lambda s: (-len(seen[s]), s))[:SUFFIXES]
    rates = {s: (sum(seen[s]) + 10 * prior) / (len(seen[s]) + 10) for s in top}
    x = np.array([[r[f] for f in FEATURES] for r in rows], float)
    x[:, FEATURES.index("suffix_rate")] = [rates.get(s, prior) for s in suffix]
    start, trees = boost(x, y)
    return Model(start, prior, rates, trees)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, model: Model | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A null URL or one without `://` has an empty host and path, fits no rule
    and is judged by the trees; so is a URL of any length, read whole.  Where
    no URL has a label the trees say allow.  Repeated rows are judged each;
    null ids are kept; an empty table gives an empty result.
    """
    model = model or fit(pages, url_col, rules)
    url = F.col(url_col)
    parts = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    text, verdict = rule_for(F.col("host"), F.col("path"), rules)
    full = parts.select("page_id", "host", "path", text.alias("rule"), verdict.alias("by_rule"), *features(F.col("url"), F.col("host"), F.col("path"), model.suffix_rate(F.col("host"))))
    by_trees = F.when(model.margin() > 0, F.lit("block")).otherwise(F.lit("allow"))
    return full.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_trees).alias("verdict"))
