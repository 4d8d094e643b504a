"""Comparison of models: intervals, effect size, paired t-test, bootstrap, sensitivity."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import t_ppf, t_two_sided_p


def confidence_interval(mean: float, std: float | None, n: int, confidence: float = 0.95) -> tuple[float, float]:
    """Student-t interval of a mean; the mean itself for fewer than two values."""
    if n < 2 or std is None:
        return mean, mean
    half = t_ppf((1 + confidence) / 2, n - 1) * std / math.sqrt(n)
    return mean - half, mean + half


def paired(a: DataFrame, b: DataFrame, key: str = "sample_id") -> DataFrame:
    """``(key, a, b)`` of the samples that both runs scored."""
    return a.where("ap IS NOT NULL").select(key, F.col("ap").alias("a")).join(b.where("ap IS NOT NULL").select(key, F.col("ap").alias("b")), key)


def cohens_d(mean_a: Column, mean_b: Column, var_a: Column, var_b: Column, n_a: Column, n_b: Column) -> Column:
    """Pooled-variance effect size; 0 for no variance, null for two values in all."""
    pooled = F.sqrt(F.try_divide((n_a - 1) * F.coalesce(var_a, F.lit(0.0)) + (n_b - 1) * F.coalesce(var_b, F.lit(0.0)), n_a + n_b - 2))
    return F.when(pooled == 0, 0.0).otherwise((mean_a - mean_b) / pooled)


def paired_summaries(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per group of ``pairs(a, b)``: n, means, difference, its deviation, t statistic, effect size."""
    d = F.col("a") - F.col("b")
    sums = [F.count(F.lit(1)).alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg(d).alias("diff"), F.stddev_samp(d).alias("std_diff"), F.var_samp("a").alias("va"), F.var_samp("b").alias("vb")]
    out = pairs.groupBy(*by).agg(*sums)
    t = F.try_divide(F.col("diff"), F.col("std_diff") / F.sqrt("n"))
    return out.select(*by, "n", "mean_a", "mean_b", "diff", "std_diff", t.alias("t"), cohens_d(F.col("mean_a"), F.col("mean_b"), F.col("va"), F.col("vb"), F.col("n"), F.col("n")).alias("d"))


def paired_summary(pairs: DataFrame) -> DataFrame:
    """One row: n, means, difference, its deviation, t statistic, effect size."""
    return paired_summaries(pairs)


def paired_ttest(a: DataFrame, b: DataFrame, confidence: float = 0.95, key: str = "sample_id") -> dict[str, float | int | None]:
    """Two-sided paired t-test of two runs' APs; an error for fewer than two common samples."""
    r = paired_summary(paired(a, b, key)).first()
    if r["n"] < 2:
        raise ValueError("a paired test needs two common samples")
    p = None if r["t"] is None else t_two_sided_p(r["t"], r["n"] - 1)
    lo, hi = confidence_interval(r["diff"], r["std_diff"], r["n"], confidence)
    return r.asDict() | {"p_value": p, "ci_low": lo, "ci_high": hi, "significant": p is not None and p < 1 - confidence}


def _resampled(values: list[float], rounds: int, rng: random.Random) -> list[float]:
    n = len(values)
    return [sum(rng.choices(values, k=n)) / n for _ in range(rounds)]


def bootstrap_map(values: list[float], rounds: int = 10_000, confidence: float = 0.95, seed: int = 42) -> tuple[float, float, float]:
    """(mean, low, high) by the percentile bootstrap with Python's seeded generator; NaN without values."""
    if not values:
        return math.nan, math.nan, math.nan
    means = sorted(_resampled(values, rounds, random.Random(seed)))
    tail = (1 - confidence) / 2
    return sum(values) / len(values), means[int(tail * rounds)], means[min(rounds - 1, int((1 - tail) * rounds))]


def bootstrap_difference(a: list[float], b: list[float], rounds: int = 10_000, confidence: float = 0.95, seed: int = 42) -> dict[str, float]:
    """Unpaired bootstrap of a difference of means; p is the share of differences that lie at least as far from the observed one as that from 0."""
    rng = random.Random(seed)
    observed = sum(a) / len(a) - sum(b) / len(b)
    diffs = sorted(sum(rng.choices(a, k=len(a))) / len(a) - sum(rng.choices(b, k=len(b))) / len(b) for _ in range(rounds))
    tail = (1 - confidence) / 2
    return {"diff": observed, "ci_low": diffs[int(tail * rounds)], "ci_high": diffs[min(rounds - 1, int((1 - tail) * rounds))], "p_value": sum(abs(d - observed) >= abs(observed) for d in diffs) / rounds}


def poisson_bootstrap(aps: DataFrame, rounds: int = 1000, by: str = "strategy") -> DataFrame:
    """Bootstrap of group means at any scale: Poisson(1) weights by hash, one exchange of rounds * groups rows."""
    u = (F.pmod(F.xxhash64("sample_id", "round"), F.lit(1 << 30)).cast("double") + 0.5) / (1 << 30)
    weight, total, cdf = F.lit(9), 0.0, []
    for k in range(9):
        total += math.exp(-1) / math.factorial(k)
        cdf.append(total)
    for k in reversed(range(9)):
        weight = F.when(u < cdf[k], k).otherwise(weight)
    drawn = aps.where("ap IS NOT NULL").select(by, "sample_id", "ap", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round")).select(by, "round", "ap", weight.alias("w"))
    means = drawn.groupBy(by, "round").agg(F.try_divide(F.sum(F.col("w") * F.col("ap")), F.sum("w")).alias("m"))
    return means.groupBy(by).agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("ci_low"), F.percentile("m", 0.975).alias("ci_high"))


def sensitivity(aps: DataFrame, by: list[str], permutation: str = "permutation_id") -> DataFrame:
    """Spread of a mean over example orders: deviation, variation, range, best and worst, and a level."""
    out = aps.groupBy(*by).agg(F.avg("ap").alias("mean"), F.coalesce(F.stddev_samp("ap"), F.lit(0.0)).alias("std"), (F.max("ap") - F.min("ap")).alias("range"), F.max_by(permutation, F.struct("ap", -F.col(permutation))).alias("best"), F.min_by(permutation, F.struct("ap", F.col(permutation))).alias("worst"))
    cv = F.when(F.col("mean") != 0, F.col("std") / F.col("mean")).otherwise(0.0)
    return out.withColumn("cv", cv).withColumn("level", F.when(F.col("cv") > 0.1, "high").when(F.col("cv") > 0.05, "moderate").otherwise("low"))


def compare_strategies(aps: DataFrame, baseline: str, confidence: float = 0.95) -> dict[str, dict]:
    """Paired test of every strategy against the baseline on their common samples: one grouped aggregate, a row per strategy."""
    known = aps.where("ap IS NOT NULL").select("strategy", "sample_id", "ap")
    base = known.where(F.col("strategy") == baseline).select("sample_id", F.col("ap").alias("b"))
    pairs = known.where(F.col("strategy") != baseline).withColumnRenamed("ap", "a").join(base, "sample_id")
    out = {}
    for r in paired_summaries(pairs, ("strategy",)).collect():
        if r["n"] < 2:
            raise ValueError(f"a paired test needs two common samples; {r['strategy']} has {r['n']}")
        p = None if r["t"] is None else t_two_sided_p(r["t"], r["n"] - 1)
        lo, hi = confidence_interval(r["diff"], r["std_diff"], r["n"], confidence)
        out[r["strategy"]] = {k: v for k, v in r.asDict().items() if k != "strategy"} | {"p_value": p, "ci_low": lo, "ci_high": hi, "significant": p is not None and p < 1 - confidence}
    return dict(sorted(out.items()))
