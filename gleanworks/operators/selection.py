"""Choice of few-shot examples from a pool: sampling, top-k, centroid, diversity and unit-level scores.

Rows that strategies see are ``(id, intent, labels, embedding, units)``; ``units``
is an array of unit vectors.  Results are ``(strategy, intent, rank, id, value)``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small
from .splits import hash_order, top_k_by_group

#: Most groups whose picks or means are broadcast to the rows.
FEW_GROUPS = 1000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """The vector at unit length; a zero vector stays zero."""
    n = F.greatest(norm(a), F.lit(1e-12))  # bound as a variable, since inside the inner function it is computed for every component
    return F.transform(F.array(n), lambda m: F.transform(a, lambda x: x.cast("double") / m))[0]


def mean_vector(df: DataFrame, vec: str, by: list[str]) -> DataFrame:
    """Component-wise mean per group as one array; aggregates components, never vectors."""
    parts = df.select(*by, F.posexplode(vec).alias("i", "x")).groupBy(*by, "i").agg(F.avg("x").alias("x"))
    return parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("mean"))


def select_random(pool: DataFrame, k: int, group: str | None = None, seed: int = 3) -> DataFrame:
    return top_k_by_group(pool, group, [hash_order("id", seed), F.col("id")], k)


def select_most_positive(pool: DataFrame, k: int, group: str | None = None, seed: int = 3, ties: list[Column] | None = None) -> DataFrame:
    """Most positive labels first; ties in shuffle order."""
    positives = F.aggregate("labels", F.lit(0), lambda a, x: a + x)
    return top_k_by_group(pool.withColumn("value", positives), group, [F.col("value").desc(), *(ties or [hash_order("id", seed)]), F.col("id")], k)


def select_representative(pool: DataFrame, k: int, group: str | None = None, digits: int | None = None) -> DataFrame:
    """Nearest to the centroid of the normalised embeddings, by Euclidean distance; ties by id.

    Distances are compared as rounded to ``digits`` (none: as they are).  Rows without a
    vector are left out; a shorter vector is compared in the components that it has.
    """
    by = [group] if group else []
    unit = pool.where(F.size("embedding") > 0).withColumn("_u", normalised(F.col("embedding")))
    keyed = unit if by else unit.withColumn("_all", F.lit(1))
    centre = mean_vector(keyed, "_u", by or ["_all"])  # one row per group
    both = keyed.join(F.broadcast(centre), by or ["_all"])
    gap = F.sqrt(F.aggregate(F.zip_with("_u", "mean", lambda x, y: F.coalesce((x - y) * (x - y), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x))
    value = gap if digits is None else F.round(gap, digits)
    return top_k_by_group(both.withColumn("value", value).drop("_u", "_all", "mean"), group, [F.col("value"), F.col("id")], k)


def class_mean(units: Column, labels: Column, label: int, unit_length: bool) -> Column:
    """Sum over the units of one class, as a struct of count and sum vector."""
    chosen = F.filter(F.arrays_zip(units.alias("u"), labels.alias("y")), lambda p: p["y"] == label)
    vectors = F.transform(chosen, lambda p: normalised(p["u"]) if unit_length else F.transform(p["u"], lambda x: x.cast("double")))
    zero = F.transform(F.element_at(units, 1), lambda _: F.lit(0.0))
    total = F.aggregate(vectors, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.struct(F.size(vectors).alias("n"), total.alias("sum"), vectors.alias("vectors"))


def unit_measures(pool: DataFrame) -> DataFrame:
    """Adds boundary, clarity, fisher and direction norm of every row's labelled unit vectors.

    All have closed forms in the class sums, so no pair of units is formed.
    """
    rows = pool.withColumn("_p", class_mean(F.col("units"), F.col("labels"), 1, True)).withColumn("_n", class_mean(F.col("units"), F.col("labels"), 0, True))
    rows = rows.withColumn("_rp", class_mean(F.col("units"), F.col("labels"), 1, False)).withColumn("_rn", class_mean(F.col("units"), F.col("labels"), 0, False))
    p, n = F.col("_p"), F.col("_n")
    mean = lambda c: F.transform(c["sum"], lambda x: x / c["n"])
    both = (p["n"] > 0) & (n["n"] > 0)
    inner = lambda c: (dot(c["sum"], c["sum"]) - c["n"]) / (c["n"] * (c["n"] - 1))
    spread = lambda c: F.when(c["n"] > 1, F.lit(1.0) - dot(mean(c), mean(c))).otherwise(0.0)
    gap = F.zip_with(mean(p), mean(n), lambda x, y: x - y)
    raw = F.zip_with(mean(F.col("_rp")), mean(F.col("_rn")), lambda x, y: x - y)
    return rows.select(
        *pool.columns,
        F.when(both, dot(mean(p), mean(n))).otherwise(0.0).alias("boundary"),
        F.when((p["n"] > 1) & (n["n"] > 1), (inner(p) + inner(n)) / 2).otherwise(0.0).alias("clarity"),
        F.when(both, dot(gap, gap) / (spread(p) + spread(n) + 1e-8)).otherwise(0.0).alias("fisher"),
        F.when(both, raw).otherwise(F.transform(F.element_at("units", 1), lambda _: F.lit(0.0))).alias("direction"),
    )


def select_by_measure(pool: DataFrame, measure: str, k: int, group: str | None = None) -> DataFrame:
    return top_k_by_group(unit_measures(pool).withColumn("value", F.col(measure)), group, [F.col("value").desc(), F.col("id")], k)


def gram(vectors: np.ndarray, ridge: float = 1e-6) -> np.ndarray:
    """Cosine similarities with a small ridge, so every principal minor is positive."""
    if vectors.ndim != 2:
        raise ValueError("vectors must form a matrix")
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return unit @ unit.T + ridge * np.eye(len(unit))


def logdet(kernel: np.ndarray, chosen: list[int]) -> float:
    if not chosen:
        return 0.0
    sign, value = np.linalg.slogdet(kernel[np.ix_(chosen, chosen)])
    return float(value) if sign > 0 else -math.inf


def greedy_dpp(vectors: np.ndarray, k: int, ridge: float = 1e-6, start: list[int] | None = None) -> list[int]:
    """Greedy MAP of a k-DPP by incremental Cholesky: O(n k) kernel columns, O(n k^2) work.

    The candidate that raises the determinant most is taken; ties go to the lowest
    index (gains equal within 1e-12 count as ties, so rounding decides nothing).
    """
    n, chosen = len(vectors), list(start or [])
    if k > n:
        raise ValueError("more examples asked for than rows")
    kernel = gram(vectors, ridge)
    rows, left = np.zeros((k, n)), np.diag(kernel).copy()
    done = np.zeros(n, bool)

    def take(i: int, at: int) -> None:
        row = (kernel[i] - rows[:at, i] @ rows[:at]) / math.sqrt(max(left[i], 1e-300))
        rows[at] = row
        left[:] -= row**2
        done[i] = True

    for at, i in enumerate(chosen):
        take(i, at)
    while len(chosen) < k:
        gains = np.where(done, -np.inf, left)
        i = int(np.flatnonzero(gains >= gains.max() - 1e-12)[0])
        take(i, len(chosen))
        chosen.append(i)
    return chosen


def select_dpp(pool: DataFrame, k: int, group: str | None = None, anchor: bool = False, vec: str = "embedding", min_norm: float = 0.0, ridge: float = 1e-6) -> DataFrame:
    """Diverse rows per group by greedy MAP of a k-DPP; ``anchor`` starts from the most central row.

    Round by round, every row's remaining gain follows from its cosines with the rows
    chosen so far, and each group's best row is a partial-aggregated minimum: no group
    is gathered and no kernel is formed.  Ties (gains equal to 11 digits) go to the lowest id.
    ``value`` is the log-determinant of the group's choice.
    """
    key = F.col(group) if group else F.lit("")
    rows = pool.select(key.cast("string").alias("g"), "id", F.col(vec).alias("v"))
    rows = rows.where(norm(F.col("v")) > min_norm) if min_norm else rows
    base = rows.select("g", "id", normalised(F.col("v")).alias("u"), F.round(norm(F.col("v")), 11).alias("size"))
    groups = base.select("g").distinct()
    side = F.broadcast if small(groups, FEW_GROUPS) else lambda rows: rows
    first = F.round(dot(F.col("u"), F.col("u")) + ridge, 11)
    if anchor:
        base = base.join(side(mean_vector(base, "u", ["g"])), "g")
        gap = F.zip_with("u", "mean", lambda x, y: x - y)
        first = -F.round(norm(gap), 11)
        base = base.withColumn("first", first).drop("mean")
    else:
        base = base.withColumn("first", F.col("size") if k == 1 else first)
    kind = dict(base.dtypes)["id"]
    none = F.expr(f"cast(array() as array<struct<id:{kind},u:array<double>,c:array<double>,left:double>>)")
    picks = groups.withColumn("p", none)
    for at in range(k):
        c = F.aggregate("p", F.expr("cast(array() as array<double>)"), lambda done, x: F.concat(done, F.array((dot(F.col("u"), x["u"]) - dot(done, x["c"])) / F.sqrt(x["left"]))))
        scored = base.join(side(picks), "g").withColumn("c", c).withColumn("left", F.greatest(dot(F.col("u"), F.col("u")) + ridge - dot(F.col("c"), F.col("c")), F.lit(1e-300)))
        chosen = F.exists("p", lambda x: x["id"] == F.col("id"))
        gain = F.col("first") if at == 0 else F.round("left", 11)
        best = F.min_by(F.struct("id", "u", "c", "left"), F.struct(chosen, -gain, "id"))
        # A group with no row left keeps its picks.
        picks = scored.groupBy("g").agg(F.any_value("p").alias("p"), best.alias("best")).select("g", F.when(F.exists("p", lambda x: x["id"] == F.col("best.id")), F.col("p")).otherwise(F.concat("p", F.array("best"))).alias("p"))
    value = F.aggregate("p", F.lit(0.0), lambda s, x: s + F.log(x["left"]))
    return picks.select("g", value.alias("value"), F.posexplode("p").alias("at", "x")).select("g", F.col("x.id").alias("id"), (F.col("at") + 1).alias("rank"), "value")


def select_pattern_dpp(pool: DataFrame, k: int, group: str | None = None) -> DataFrame:
    """Diverse directions from irrelevant to relevant units; rows without a direction are left out."""
    return select_dpp(unit_measures(pool), k, group, vec="direction", min_norm=1e-8)


Selector = Callable[..., DataFrame]
_STRATEGIES: dict[str, Selector] = {
    "random": select_random,
    "most_positive": select_most_positive,
    "rep": select_representative,
    "dpp": select_dpp,
    "anchor_dpp": lambda pool, k, group=None: select_dpp(pool, k, group, anchor=True),
    "boundary": lambda pool, k, group=None: select_by_measure(pool, "boundary", k, group),
    "clarity": lambda pool, k, group=None: select_by_measure(pool, "clarity", k, group),
    "fisher": lambda pool, k, group=None: select_by_measure(pool, "fisher", k, group),
    "pattern_dpp": select_pattern_dpp,
}
LOCAL = ("bm25", "knn")
#: What strategies look at: labels alone, the vectors of units, and else the vector of the whole text (as registered ones do).
BY_LABELS = ("random", "most_positive")
BY_UNITS = ("boundary", "clarity", "fisher", "pattern_dpp")
SUFFIX = "_stratified"


def register(name: str, strategy: Selector) -> None:
    """Add a strategy; it is given labels and the vectors of whole texts."""
    _STRATEGIES[name] = strategy


def list_strategies(include_stratified: bool = False) -> list[str]:
    return sorted(_STRATEGIES) + ([f"{s}{SUFFIX}" for s in sorted(_STRATEGIES)] if include_stratified else [])


def is_local_strategy(name: str) -> bool:
    return name in LOCAL


def resolve_strategy_name(name: str, multi_intent: bool = False) -> str:
    """Adds the suffix on multi-intent data where the strategy has a stratified form."""
    return f"{name}{SUFFIX}" if multi_intent and name in _STRATEGIES else name


def normalize_strategy_name(name: str) -> str:
    return name.removesuffix(SUFFIX)


def select(pool: DataFrame, name: str, k: int, intent: str = "intent") -> DataFrame:
    """Run a strategy by name; a stratified one chooses up to ``k`` rows of each intent."""
    base = normalize_strategy_name(name)
    if base not in _STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; known: {', '.join(list_strategies(True))}")
    if base == "dpp" and k < 2:
        raise ValueError("dpp needs at least two examples")
    if name.endswith(SUFFIX) and intent not in pool.columns:
        raise ValueError(f"stratified selection needs a column {intent!r}")
    return _STRATEGIES[base](pool, k, intent if name.endswith(SUFFIX) else None)


def gather(pool: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen pool rows in order of rank."""
    picks = chosen.select("id", "rank").withColumnRenamed("rank", "_rank")
    return pool.join(picks, "id").orderBy("_rank").withColumnRenamed("_rank", "rank")


def ranked_within(df: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)
