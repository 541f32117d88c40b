"""Paired statistics by group.

Ranks are taken from counts of equal values, which are added up before they are shuffled; a group of any size is a table of
its different values from there on. Resampling draws from these counts too: n draws with replacement are one multinomial
draw of counts, and the signs of equal differences one binomial draw. P-values of the few resulting rows run in Python.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F


def holm(df: DataFrame, group: str, p: str, alpha: float = 0.05) -> DataFrame:
    """Adds p_holm and significant: step-down corrected within the group, monotone; null stays null."""
    w = W.partitionBy(group, F.col(p).isNull()).orderBy(p, "name")
    m = F.count(p).over(W.partitionBy(group))
    x = df.withColumn("_adj", F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p)))
    x = x.withColumn("p_holm", F.when(F.col(p).isNotNull(), F.max("_adj").over(w.rowsBetween(W.unboundedPreceding, 0)))).drop("_adj")
    return x.withColumn("significant", F.col("p_holm") < alpha)


def _ranks(counts: DataFrame, group: str, value: str) -> DataFrame:
    """group, value, rank of a table of counts (group, value, c): the mean of the ranks from 1 that equal values share."""
    w = W.partitionBy(group).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    per = counts.groupBy(group, value).agg(F.sum("c").alias("c"))
    return per.select(group, value, (F.sum("c").over(w) - (F.col("c") - 1) / 2).alias("rank"))


def spearman(df: DataFrame, group: str, a: str, b: str, least: int = 5) -> DataFrame:
    """group, n, rho, mad: rank correlation and mean absolute difference; null under `least` pairs or without variation."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(group, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).alias("c"))
    for side in ("_a", "_b"):
        pairs = pairs.join(_ranks(pairs.select(group, side, "c"), group, side).withColumnRenamed("rank", f"{side}r"), [group, side])
    sizes = pairs.groupBy(group).agg(F.sum("c").alias("n"))
    x, y = F.col("_ar") - (F.col("n") + 1) / 2, F.col("_br") - (F.col("n") + 1) / 2
    g = pairs.join(sizes, group).groupBy(group).agg(
        F.first("n").alias("n"), F.sum(F.col("c") * x * y).alias("_xy"), F.sum(F.col("c") * x * x).alias("_xx"), F.sum(F.col("c") * y * y).alias("_yy"), (F.sum(F.col("c") * F.abs(F.col("_a") - F.col("_b"))) / F.first("n")).alias("mad")
    )
    rho = F.try_divide(F.col("_xy"), F.sqrt(F.col("_xx") * F.col("_yy")))
    return g.select(group, "n", F.when(F.col("n") >= least, rho).alias("rho"), F.when(F.col("n") >= least, F.col("mad")).alias("mad"))


def paired_t(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """group, n, mean_diff, t, p, dz, lo, hi: null but for the first two if the differences don't vary; lo and hi bound the
    mean with a confidence of 95 %."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(group, (F.col(a) - F.col(b)).alias("d"))
    g = d.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd"))
    se = F.col("sd") / F.sqrt("n")
    g = g.withColumn("t", F.when(F.col("sd") > 0, F.col("mean_diff") / se))
    half = _of_rows(t_critical)(F.when(F.col("n") >= 2, F.col("n"))) * se
    return g.select(
        group, "n", "mean_diff", "t", _of_rows(lambda t, n: t_p_value(t, n - 1))(F.col("t"), F.col("n")).alias("p"), F.when(F.col("sd") > 0, F.col("mean_diff") / F.col("sd")).alias("dz"),
        F.when(F.col("sd") > 0, F.col("mean_diff") - half).alias("lo"), F.when(F.col("sd") > 0, F.col("mean_diff") + half).alias("hi"),
    )


def _of_rows(fn):
    """A function of numbers as a column, for tables of a row per group; null where one of them is."""
    return F.udf(lambda *row: None if any(v is None for v in row) else fn(*map(float, row)), "double")


def wilcoxon(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """group, n, w_plus, w_minus, z, p: signed rank sums of the differences other than 0, and the two-sided p.

    p is exact up to 50 differences without ties, and else by the normal distribution with ties corrected for.
    """
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(group, (F.col(a) - F.col(b)).alias("d")).where("d <> 0")
    counts = d.groupBy(group, F.abs("d").alias("size")).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("d") > 0).alias("plus"))
    x = counts.join(_ranks(counts.select(group, "size", "c"), group, "size"), [group, "size"])
    g = x.groupBy(group).agg(
        F.sum("c").alias("n"), F.sum(F.col("plus") * F.col("rank")).alias("w_plus"), F.sum((F.col("c") - F.col("plus")) * F.col("rank")).alias("w_minus"), F.sum(F.col("c") * (F.col("c") * F.col("c") - 1)).cast("double").alias("_ties")
    )
    n = F.col("n").cast("double")
    se = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)
    g = g.withColumn("z", F.try_divide(F.least("w_plus", "w_minus") - n * (n + 1) / 4, se))
    p = F.udf(lambda n, w, ties, z: None if z is None else wilcoxon_p(int(n), w, ties, z), "double")
    return g.select(group, "n", "w_plus", "w_minus", "z", p("n", F.least("w_plus", "w_minus"), "_ties", "z").alias("p"))


def sign_test(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """group, wins, losses, ties, rank_biserial, p: two-sided binomial test of wins against losses."""
    c = lambda cond: F.count_if(cond)
    g = df.groupBy(group).agg(c(F.col(a) > F.col(b)).alias("wins"), c(F.col(a) < F.col(b)).alias("losses"), c(F.col(a) == F.col(b)).alias("ties"))
    return g.select("*", F.try_divide(F.col("wins") - F.col("losses"), F.col("wins") + F.col("losses")).alias("rank_biserial"), F.udf(sign_p, "double")("wins", "losses").alias("p"))


def compare_v1(df: DataFrame, group: str, a: str, b: str, critical: float = 1.984) -> DataFrame:
    """The older comparison: paired t with a fixed critical value, Wilcoxon, rank-biserial and sign test, by group."""
    t, w, s = paired_t(df, group, a, b), wilcoxon(df, group, a, b), sign_test(df, group, a, b)
    half = critical * F.abs(F.try_divide(F.col("mean_diff"), F.col("t")))
    t = t.select(group, "n", "mean_diff", "t", F.col("p").alias("p_t"), "dz", (F.col("mean_diff") - half).alias("lo"), (F.col("mean_diff") + half).alias("hi"))
    return t.join(w.select(group, F.least("w_plus", "w_minus").alias("w"), F.col("p").alias("p_w")), group, "left").join(s.select(group, "wins", "losses", "rank_biserial", F.col("p").alias("p_sign")), group)


def against_raw(scores: DataFrame, test: str = "permutation", least: int = 5, alpha: float = 0.05, iters: int = 20_000, seed: int = 42) -> DataFrame:
    """model, name, n_common, mean_diff, p, p_holm, significant of each variant against its model's `raw`.

    scores: model, variant, sid, composite, excluded; excluded and null scores take no part. The cases that both have are
    compared; under `least` there is no p. test: permutation (random signs), t or wilcoxon. p is corrected within a model.
    """
    valid = scores.where("not coalesce(excluded, false) and composite is not null").select("model", "variant", "sid", "composite")
    raw = valid.where("variant = 'raw'").select("model", "sid", F.col("composite").alias("base"))
    both = valid.where("variant <> 'raw'").join(raw, ["model", "sid"]).withColumn("_g", F.to_json(F.array("model", "variant")))
    sizes = both.groupBy("_g", "model", F.col("variant").alias("name")).agg(F.count(F.lit(1)).alias("n_common"), F.avg(F.col("composite") - F.col("base")).alias("mean_diff"))
    if test == "permutation":
        p = resample(both, "_g", "composite", "base", iters // 2, seed).select("_g", "p")
    else:
        p = (paired_t if test == "t" else wilcoxon)(both, "_g", "composite", "base").select("_g", "p")
    x = sizes.join(p, "_g", "left").withColumn("p", F.when(F.col("n_common") >= least, F.col("p"))).drop("_g")
    return holm(x, "model", "p", alpha)


def wilcoxon_p(n: int, w: float, ties: float, z: float) -> float:
    """Two-sided p of the smaller rank sum w of n differences."""
    if n <= 50 and ties == 0:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1.0
        for r in range(1, n + 1):
            ways[r:] += ways[:-r].copy()
        return min(1.0, 2 * float(ways[: int(w) + 1].sum()) / 2.0**n)
    return math.erfc(abs(z) / math.sqrt(2))


def sign_p(wins: int, losses: int) -> float | None:
    n, k = wins + losses, min(wins, losses)
    if not n:
        return None
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)
    top = log(k)
    tail, i = 0.0, k
    while i >= 0 and log(i) > top - 40:  # what is left is nothing beside the first term
        tail += math.exp(log(i) - top)
        i -= 1
    return min(1.0, 2 * math.exp(top) * tail)


def t_critical(n: float, alpha: float = 0.05) -> float:
    """The t whose two-sided p of n - 1 degrees of freedom is alpha, by bisection."""
    lo, hi = 0.0, 1e4
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_p_value(mid, n - 1) > alpha else (lo, mid)
    return (lo + hi) / 2


def t_p_value(t: float, df: float) -> float:
    """Two-sided p of Student's t, by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0

    def fraction(a: float, b: float, x: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                c = 1 + num / c
                d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    if x >= 1:
        return 1.0
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def bootstrap_ci(values: np.ndarray, counts: np.ndarray | None = None, iters: int = 10_000, seed: int = 42, alpha: float = 0.05) -> tuple[float | None, float | None]:
    """Percentile interval of the mean of values, each occurring counts times; none under two. Drawn in blocks, so that memory
    is bounded."""
    values = np.asarray(values, float)
    counts = np.ones(len(values), np.int64) if counts is None else np.asarray(counts, np.int64)
    v, c = values[~np.isnan(values)], counts[~np.isnan(values)]
    n = int(c.sum())
    if n < 2:
        return None, None
    rng = np.random.RandomState(seed)
    step = max(1, 5_000_000 // len(v))
    means = np.concatenate([rng.multinomial(n, c / n, min(step, iters - k)) @ v / n for k in range(0, iters, step)])
    return float(np.percentile(means, 100 * alpha / 2)), float(np.percentile(means, 100 * (1 - alpha / 2)))


def sign_flip(diff: np.ndarray, counts: np.ndarray | None = None, iters: int = 20_000, seed: int = 42) -> float:
    """Two-sided p of the paired permutation test of differences, each occurring counts times; 1 if all are 0."""
    diff = np.asarray(diff, float)
    counts = np.ones(len(diff), np.int64) if counts is None else np.asarray(counts, np.int64)
    d, c = diff[~np.isnan(diff)], counts[~np.isnan(diff)]
    if not len(d) or not d.any():
        return 1.0
    size, at = np.unique(np.abs(d), return_inverse=True)
    each = np.bincount(at, weights=c).astype(np.int64)
    n, observed = c.sum(), abs((d * c).sum() / c.sum())
    rng = np.random.RandomState(seed)
    seen, step = 0, max(1, 5_000_000 // len(size))
    for k in range(0, iters, step):
        plus = rng.binomial(each, 0.5, (min(step, iters - k), len(size)))
        seen += int((np.abs((2 * plus - each) @ size / n) >= observed - 1e-12).sum())
    return (seen + 1) / (iters + 1)


def resample(df: DataFrame, group: str, a: str, b: str, iters: int = 10_000, seed: int = 42) -> DataFrame:
    """group, n, mean, lo, hi, p: interval of the mean of a by iters draws, and the permutation test of a against b by twice as
    many. Nulls of either take no part in what needs them. A group comes to its task as counts of its different pairs."""
    counts = df.groupBy(F.col(group).alias("_g"), F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")).agg(F.count(F.lit(1)).alias("_c"))

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["_a", "_b"])
        x, y, c = g["_a"].to_numpy(float), g["_b"].to_numpy(float), g["_c"].to_numpy()
        known = ~np.isnan(x)
        n = int(c[known].sum())
        lo, hi = bootstrap_ci(x, c, iters, seed)
        return pd.DataFrame([(key[0], n, float((x[known] * c[known]).sum() / n) if n else None, lo, hi, sign_flip(x - y, c, 2 * iters, seed))], columns=[group, "n", "mean", "lo", "hi", "p"])

    kind = df.schema[group].dataType.simpleString()
    return counts.groupBy("_g").applyInPandas(run, f"`{group}` {kind}, n long, mean double, lo double, hi double, p double")
