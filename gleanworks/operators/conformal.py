"""Conformal calibration of unit scores: keep a share beta of positives with confidence 1 - alpha."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written

NOISE = 1e-6
SEED = 42


def noise_values(n: int, seed: int = SEED, scale: float = NOISE) -> list[float]:
    """The tie-breaking offset of unit positions 0..n-1; a longer list begins with a shorter one."""
    return np.random.default_rng(seed).uniform(-scale, scale, n).tolist()


def noise_table(spark: SparkSession, n: int, seed: int = SEED) -> DataFrame:
    """``(unit_idx, eps)`` of ``n`` rows, n being the longest document's units."""
    values = noise_values(max(1, n), seed)
    return spark.createDataFrame(pa.table({"unit_idx": pa.array(range(len(values)), pa.int32()), "eps": pa.array(values, pa.float64())}))


def with_noise(units: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds ``noisy``: the score plus its position's offset.  The table of offsets is broadcast by its size, if small."""
    longest = units.agg(F.max("unit_idx")).first()[0]
    table = noise_table(units.sparkSession, (longest or 0) + 1, seed)
    return units.join(table, "unit_idx").withColumn("noisy", F.col("score") + F.col("eps")).drop("eps")


def row_scores(noisy: DataFrame, beta: float) -> DataFrame:
    """Per sample the largest threshold that keeps a share ``beta`` of its positives; infinity where none is needed."""
    w = Window.partitionBy("sample_id")
    frac = F.sum("label").over(w.orderBy(F.col("noisy").desc()).rowsBetween(Window.unboundedPreceding, 0)).cast("double") / F.nullif(F.sum("label").over(w), F.lit(0))
    kept = noisy.select("sample_id", "noisy", frac.alias("frac"))
    best = F.max(F.when(F.col("frac") >= F.lit(float(beta)), F.col("noisy"))) if beta > 0 else F.lit(None).cast("double")
    return kept.groupBy("sample_id").agg(F.coalesce(best, F.lit(float("inf"))).alias("q"))


def rank_of(n: int, alpha: float) -> int:
    return max(1, min(math.floor((n + 1) * alpha), n))


#: Bins that one pass of the rank search counts.
BINS = 1024


def threshold(scores: DataFrame, alpha: float) -> float | None:
    """The k-th smallest row score, k from the number of rows; None without rows.

    Scores are written out once.  Each pass counts equal bins of the range that holds
    rank k and goes on with one bin, until that holds a single value: nothing is sorted
    and no task sees all rows, whatever their number.
    """
    rows = written(scores.select(F.col("q").cast("double").alias("q")), "scores")
    finite = rows.where(F.col("q") < float("inf"))
    total = rows.count()
    if not total:
        return None
    k = rank_of(total, alpha)
    n, lo, hi = finite.agg(F.count("q"), F.min("q"), F.max("q")).first()
    if k > n:
        return float("inf")
    while lo < hi:
        bin_ = F.least(F.floor((F.col("q") - lo) / (hi - lo) * BINS), F.lit(BINS - 1))
        inside = finite.where((F.col("q") >= lo) & (F.col("q") <= hi))
        for r in sorted(inside.groupBy(bin_.alias("b")).agg(F.count("q").alias("n"), F.min("q").alias("lo"), F.max("q").alias("hi")).collect(), key=lambda r: r["b"]):  # at most BINS rows
            if k <= r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            k -= r["n"]
    return lo


def retained(noisy: DataFrame, cut: float) -> DataFrame:
    """Mask per unit: whether its noisy score reaches the threshold."""
    return noisy.withColumn("kept", F.col("noisy") >= F.lit(float(cut)))


def accepted_units(noisy: DataFrame, cut: float, text: str = "text") -> DataFrame:
    """Per sample the texts of its retained units, in order."""
    kept = retained(noisy, cut).where("kept").groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("unit_idx", F.col(text).alias("text")))).alias("u"))
    return kept.select("sample_id", F.col("u.text").alias("units"))


def coverage(noisy: DataFrame, cut: float, beta: float) -> DataFrame:
    """Share of samples that keep at least ``beta`` of their positives, and of units that are kept."""
    per = retained(noisy, cut).groupBy("sample_id").agg(F.sum("label").alias("pos"), F.sum(F.when(F.col("kept"), F.col("label")).otherwise(0)).alias("hit"), F.avg(F.col("kept").cast("double")).alias("share"))
    ok = (F.col("pos") == 0) | (F.col("hit") >= F.col("pos") * F.lit(float(beta)))
    return per.agg(F.avg(ok.cast("double")).alias("coverage"), F.avg("share").alias("kept_share"), F.count(F.lit(1)).alias("n"))
