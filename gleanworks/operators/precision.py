"""Average precision per sample, and aggregates over samples, strategies and intents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import t_quantile


def average_precision(units: DataFrame, keys: tuple[str, ...] = ("sample_id", "strategy"), carry: tuple[str, ...] = ("intent",)) -> DataFrame:
    """AP of every ``keys`` group of ``units(label, score)``; null without scores or with one class only.

    Units tied on score form one step.  Grouping by score first shrinks the windows'
    input; all windows share one partitioning and order, so there is one exchange.
    The steps are summed along the window, highest score first: an aggregate that spills
    adds partial sums, and the last digit, which can decide a histogram's bin, would change.
    """
    steps = units.groupBy(*keys, "score").agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in carry])
    total, ahead = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(F.col("score").desc())
    cum = steps.select(*keys, *carry, "p", "score", F.sum("p").over(ahead).alias("cp"), F.sum("n").over(ahead).alias("cn"), F.sum("p").over(total).alias("tp"), F.sum("n").over(total).alias("tn"))
    run = cum.withColumn("run", F.sum(F.col("p").cast("double") * F.col("cp") / F.col("cn")).over(ahead))
    ap = F.when((F.max("tp") > 0) & (F.max("tp") < F.max("tn")) & (F.count("score") == F.count(F.lit(1))), F.max("run") / F.max("tp"))
    return run.groupBy(*keys).agg(*[F.first(c).alias(c) for c in carry], ap.alias("ap"))


def ap_of_arrays(scores: Column, labels: Column) -> Column:
    """AP of one row's parallel arrays, as an expression (no exchange): one sort and one pass.

    Units tied on score form one step: its precision counts once the step is complete.
    """
    pairs = F.reverse(F.array_sort(F.transform(F.arrays_zip(scores.alias("s"), labels.alias("y")), lambda u: F.struct(u["s"].cast("double").alias("s"), F.when(u["y"] == 1, 1).otherwise(0).alias("y")))))
    zero = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("hits"), F.lit(0).alias("at"), F.lit(None).cast("double").alias("s"), F.lit(0.0).alias("sum"))

    def closed(a: Column) -> Column:
        return a["sum"] + F.coalesce(F.try_divide(a["at"].cast("double") * a["hits"], a["seen"]), F.lit(0.0))

    def step(a: Column, u: Column) -> Column:
        same = a["s"].eqNullSafe(u["s"])
        return F.struct((a["seen"] + 1).alias("seen"), (a["hits"] + u["y"]).alias("hits"), F.when(same, a["at"] + u["y"]).otherwise(u["y"]).alias("at"), u["s"].alias("s"), F.when(same, a["sum"]).otherwise(closed(a)).alias("sum"))

    positives = F.size(F.filter(labels, lambda y: y == 1))
    total = F.aggregate(pairs, zero, step, closed)
    return F.when(scores.isNotNull() & (positives > 0) & (positives < F.size(labels)), total / positives)


def summarize(aps: DataFrame, by: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """MAP per group: nulls are left out, NaN where none is left."""
    return aps.groupBy(*by).agg(F.coalesce(F.avg("ap"), F.lit(float("nan"))).alias("map"), F.count("ap").alias("n"))


#: Bins over [0, 1] of the percentile search.
BINS = 1024


def percentiles(aps: DataFrame, by: tuple[str, ...], shares: list[float]) -> DataFrame:
    """``(*by, q)``: exact linear percentiles of ``ap`` (in [0, 1]) as an array.

    Equal values are counted, bins of values are summed, and a value's rank is its bin's
    base plus its place in the bin, so a group's values are never gathered.
    """
    by = list(by)
    values = aps.where("ap IS NOT NULL").groupBy(*by, "ap").agg(F.count(F.lit(1)).alias("c")).withColumn("b", F.floor(F.col("ap") * BINS))
    bins = values.groupBy(*by, "b").agg(F.sum("c").alias("s"))
    earlier = Window.unboundedPreceding, -1
    placed = bins.select(*by, "b", F.coalesce(F.sum("s").over(Window.partitionBy(*by).orderBy("b").rowsBetween(*earlier)), F.lit(0)).alias("base"), F.sum("s").over(Window.partitionBy(*by)).alias("n"))
    inside = F.coalesce(F.sum("c").over(Window.partitionBy(*by, "b").orderBy("ap").rowsBetween(*earlier)), F.lit(0))
    ranked = values.withColumn("_at", inside).join(placed, [*by, "b"]).withColumn("_at", F.col("_at") + F.col("base"))
    ends = []
    for i, q in enumerate(shares):
        at = F.floor(F.lit(q) * (F.col("n") - 1)).cast("long")
        holds = lambda r: (F.col("_at") <= r) & (r < F.col("_at") + F.col("c"))
        ends += [F.max(F.when(holds(at), F.col("ap"))).alias(f"_a{i}"), F.max(F.when(holds(F.least(at + 1, F.col("n") - 1)), F.col("ap"))).alias(f"_z{i}")]
    found = ranked.groupBy(*by).agg(F.max("n").alias("_n"), *ends)
    part = lambda i, q: F.col(f"_a{i}") + (F.col(f"_z{i}") - F.col(f"_a{i}")) * (F.lit(q) * (F.col("_n") - 1) - F.floor(F.lit(q) * (F.col("_n") - 1)))
    return found.select(*by, F.array(*[part(i, q) for i, q in enumerate(shares)]).alias("q"))


def ap_stats(aps: DataFrame, by: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Mean, sample deviation (null for one), linear percentiles, least and largest; errors over all rows."""
    q = [0.05, 0.25, 0.5, 0.75, 0.95]
    out = aps.groupBy(*by).agg(F.avg("ap").alias("mean_ap"), F.stddev_samp("ap").alias("std_ap"), F.min("ap").alias("min_ap"), F.max("ap").alias("max_ap"), F.count("ap").alias("n_scored"), F.count_if(F.col("ap").isNull()).alias("n_failed"))
    out = out.join(percentiles(aps, by, q), list(by), "left")
    rate = F.coalesce(F.try_divide(F.col("n_failed"), F.col("n_failed") + F.col("n_scored")), F.lit(0.0))
    return out.select(*by, "mean_ap", "std_ap", *[F.col("q")[i].alias(f"p{round(x * 100)}") for i, x in enumerate(q)], "min_ap", "max_ap", "n_scored", "n_failed", rate.alias("error_rate"))


def distribution_stats(aps: DataFrame, by: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Report figures: population deviation, seven quantiles, shares of zero and perfect APs; half-even rounding."""
    q = [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]
    known = aps.where("ap IS NOT NULL")
    out = known.groupBy(*by).agg(F.count("ap").alias("n"), F.avg("ap").alias("m"), F.stddev_pop("ap").alias("s"), F.avg(F.when(F.col("ap") == 0, 100.0).otherwise(0.0)).alias("z"), F.avg(F.when(F.col("ap") >= 1, 100.0).otherwise(0.0)).alias("o")).join(percentiles(known, by, q), list(by))
    return out.select(*by, "n", F.bround("m", 4).alias("mean"), F.bround("s", 4).alias("std"), *[F.bround(F.col("q")[i], 4).alias(f"p{round(x * 100)}") for i, x in enumerate(q)], F.bround("z", 1).alias("pct_zero"), F.bround("o", 1).alias("pct_perfect"))


def run_metrics(aps: DataFrame, by: tuple[str, ...] = ("strategy",), confidence: float = 0.95) -> DataFrame:
    """Mean, deviation (0 for one value), median, extremes and the Student-t interval.

    The quantile depends on n alone and is looked up for the group sizes that occur.
    """
    known = aps.where("ap IS NOT NULL AND NOT isnan(ap)")
    out = known.groupBy(*by).agg(F.count("ap").alias("n"), F.avg("ap").alias("mean_ap"), F.coalesce(F.stddev_samp("ap"), F.lit(0.0)).alias("std_ap"), F.min("ap").alias("min_ap"), F.max("ap").alias("max_ap"))
    out = out.join(percentiles(known, by, [0.5]), list(by)).withColumn("median_ap", F.col("q")[0]).drop("q")
    half = t_quantile(F.col("n") - 1, (1 + confidence) / 2) * F.col("std_ap") / F.sqrt("n")
    half = F.when(F.col("n") > 1, half).otherwise(0.0)
    return out.select(*by, "n", "mean_ap", "std_ap", "median_ap", "min_ap", "max_ap", (F.col("mean_ap") - half).alias("ci_low"), (F.col("mean_ap") + half).alias("ci_high"))


def intent_metrics(aps: DataFrame, intent: str = "intent", failed: Column | None = None) -> DataFrame:
    """Per intent: rows, scored, failed, mean, deviation, extremes; best mean first."""
    failed = F.col("ap").isNull() if failed is None else failed
    out = aps.groupBy(F.col(intent).alias("intent")).agg(F.count(F.lit(1)).alias("n_samples"), F.count_if(~failed).alias("n_success"), F.count_if(failed).alias("n_failed"), F.avg("ap").alias("mean_ap"), F.coalesce(F.stddev_samp("ap"), F.lit(0.0)).alias("std_ap"), F.min("ap").alias("min_ap"), F.max("ap").alias("max_ap"))
    return out.orderBy(F.coalesce(F.nanvl("mean_ap", F.lit(0.0)), F.lit(0.0)).desc(), "intent")


def first_failed(failed: DataFrame, by: tuple[str, ...], keep: int, key: str = "sample_id") -> DataFrame:
    """``(*by, samples)``: the first ``keep`` keys of every group; a bounded top-k, so a group of any size sends ``keep`` rows on."""
    w = Window.partitionBy(*by).orderBy(key)
    head = failed.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= keep)
    return head.groupBy(*by).agg(F.array_sort(F.collect_list(key)).alias("samples"))


def error_summary(aps: DataFrame, by: tuple[str, ...] = ("strategy",), keep: int = 20) -> DataFrame:
    """Failed samples per run: count, rate and the first ``keep`` of them by sample id; null when none failed."""
    first = first_failed(aps.where("ap IS NULL"), by, keep)
    counts = aps.groupBy(*by).agg(F.count_if(F.col("ap").isNull()).alias("total_errors"), F.count(F.lit(1)).alias("total"))
    return counts.join(first, list(by), "left").select(*by, F.when(F.col("total_errors") > 0, F.struct("total_errors", (F.col("total_errors") / F.col("total")).alias("error_rate"), "samples")).alias("error_summary"))


def windowing_guard(samples: DataFrame, min_avg_units: float = 30, max_avg_positive: float = 0.15) -> DataFrame:
    """Whether documents are long, or positives rare, enough to sample around positives."""
    positive = F.try_divide(F.aggregate("labels", F.lit(0), lambda a, x: a + x).cast("double"), F.size("labels"))
    out = samples.agg(F.avg(F.size("labels")).alias("avg_units"), F.avg(positive).alias("avg_positive"))
    return out.select("avg_units", "avg_positive", ((F.col("avg_units") > min_avg_units) | (F.col("avg_positive") < max_avg_positive)).alias("windowed"))
