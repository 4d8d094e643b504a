"""Fusion of several strategies' score vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default ensemble, best first.
ENSEMBLE = ("anchor_dpp", "bm25", "pattern_dpp", "random", "knn", "clarity")


def resolve_ensemble(strategies: list[str] | None = None, k: int | None = None) -> list[str]:
    """An explicit list of two to six, else the best ``k``, else the best four."""
    chosen = list(strategies) if strategies else list(ENSEMBLE[: k if k is not None else 4])
    if not 2 <= len(chosen) <= 6 or (k is not None and not strategies and not 2 <= k <= 6):
        raise ValueError("an ensemble has two to six strategies")
    return chosen


def fuse_long(units: DataFrame, weights: dict[str, float] | None = None, name: str = "fused") -> DataFrame:
    """Weighted mean over strategies per unit; missing scores drop out and the weights renormalise."""
    w = F.lit(1.0)
    if weights is not None:
        w = F.lit(None).cast("double")
        for s, x in weights.items():
            w = F.when(F.col("strategy") == s, F.lit(float(x))).otherwise(w)
    known = units.withColumn("w", w).withColumn("w", F.when(F.col("score").isNotNull(), F.col("w")))
    return known.groupBy("sample_id", "unit_idx").agg(F.first("intent").alias("intent"), F.first("label").alias("label"), F.try_divide(F.sum(F.col("w") * F.col("score")), F.sum("w")).alias("score")).withColumn("strategy", F.lit(name))


def fuse_arrays(vectors: list[Column], weights: list[float] | None = None) -> Column:
    """Element-wise weighted mean of parallel arrays; null vectors are skipped, all null gives null.

    Vectors of different lengths raise an error when the row is evaluated.
    """
    weights = weights or [1.0] * len(vectors)
    if len(weights) != len(vectors):
        raise ValueError("one weight per vector")
    pairs = F.filter(F.array(*[F.struct(v.alias("v"), F.lit(float(w)).alias("w")) for v, w in zip(vectors, weights, strict=True)]), lambda p: p["v"].isNotNull())
    sizes = F.array_distinct(F.transform(pairs, lambda p: F.size(p["v"])))
    total = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["w"])
    zero = F.transform(F.element_at(pairs, 1)["v"], lambda _: F.lit(0.0))
    summed = F.aggregate(pairs, zero, lambda a, p: F.zip_with(a, p["v"], lambda x, y: x + p["w"] * y))
    fused = F.when(F.size(sizes) > 1, F.raise_error(F.lit("score vectors differ in length"))).otherwise(F.transform(summed, lambda x: F.try_divide(x, total)))
    return F.when(F.size(pairs) > 0, fused)
