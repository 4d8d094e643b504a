"""Queries over the store of experiment runs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIMARY_MODEL = "gemini-2.5-flash-lite"


def normalized(name: Column) -> Column:
    return F.regexp_replace(name, "_stratified$", "")


def json_param(params: Column, key: str, default: str = "0") -> Column:
    """A field of a JSON parameter string as text."""
    return F.coalesce(F.get_json_object(params, f"$.{key}"), F.lit(default))


def safe_int(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(0))


def strategy_label(name: Column, n_icl: Column) -> Column:
    """``icl0...`` as it is, others as ``icl<n>_<strategy>``."""
    return F.when(name.like("icl0%"), name).otherwise(F.concat(F.lit("icl"), n_icl, F.lit("_"), name))


def _newest(*by: str):
    return Window.partitionBy(*by).orderBy(F.col("created_at").desc(), F.col("run_id").desc())


def latest(runs: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The newest run of every group; ties by the larger id."""
    return runs.withColumn("_rn", F.row_number().over(_newest(*by))).where("_rn = 1").drop("_rn")


def comparison(runs: DataFrame, datasets: DataFrame, models: DataFrame, dataset_id: int | None = None, model_ids: list[int] | None = None, strategies: list[str] | None = None, limit: int = 100) -> DataFrame:
    """Completed runs with dataset and model names, newest first; filters come before the limit.

    The joins carry no hint: dimension tables are broadcast by their size, if small.
    """
    r = runs.where("status = 'completed'")
    if dataset_id is not None:
        r = r.where(F.col("dataset_id") == dataset_id)
    if model_ids:
        r = r.where(F.col("llm_model_id").isin(*model_ids))
    if strategies:
        r = r.where(F.col("icl_strategy_name").isin(*strategies))
    out = r.join(datasets, "dataset_id").join(models, "llm_model_id")
    return out.select("run_id", "dataset_name", "model_name", "icl_strategy_name", json_param(F.col("icl_strategy_params"), "k").alias("n_icl"), "mean_ap", "created_at").orderBy(F.col("created_at").desc(), F.col("run_id").desc()).limit(limit)


def strategy_comparison(runs: DataFrame) -> DataFrame:
    """Per strategy: runs, scored samples, mean, least and largest MAP; best first."""
    out = runs.where("status = 'completed' AND icl_strategy_name IS NOT NULL").groupBy("icl_strategy_name")
    return out.agg(F.count(F.lit(1)).alias("n_runs"), F.sum("n_samples_scored").alias("n_samples"), F.avg("mean_ap").alias("avg_map"), F.min("mean_ap").alias("min_map"), F.max("mean_ap").alias("max_map")).orderBy(F.col("avg_map").desc(), "icl_strategy_name")


def performance_matrix(runs: DataFrame, model_id: int | None = None) -> DataFrame:
    """Latest run per dataset, model, strategy and n_icl with its change from the run before.

    ``lead`` over the newest-first window reads the previous run in the same pass.
    """
    r = runs.where("status = 'completed'")
    if model_id is not None:
        r = r.where(F.col("llm_model_id") == model_id)
    r = r.withColumn("n_icl", json_param(F.col("icl_strategy_params"), "k")).withColumn("strategy", normalized(F.col("icl_strategy_name")))
    w = _newest("dataset_id", "llm_model_id", "strategy", "n_icl")
    ranked = r.withColumn("rn", F.row_number().over(w)).withColumn("previous", F.lead("mean_ap").over(w)).where("rn = 1")
    return ranked.select("dataset_id", "llm_model_id", strategy_label(F.col("strategy"), F.col("n_icl")).alias("label"), "mean_ap", F.round(F.col("mean_ap") - F.col("previous"), 4).alias("delta"), "run_id")


def cross_model(runs: DataFrame, primary: int, models: list[int]) -> DataFrame:
    """Latest MAP per label (rows) and model (columns), for labels that a model besides ``primary`` ran."""
    r = runs.where("status = 'completed'").withColumn("label", strategy_label(normalized(F.col("icl_strategy_name")), json_param(F.col("icl_strategy_params"), "k")))
    newest = latest(r, ("label", "llm_model_id"))
    pivoted = newest.groupBy("label").pivot("llm_model_id", models).agg(F.first("mean_ap"))
    others = [F.col(str(m)).isNotNull() for m in models if m != primary]
    keep = others[0]
    for c in others[1:]:
        keep = keep | c
    order = [primary, *[m for m in models if m != primary]]
    return pivoted.where(keep).select("label", *[F.col(str(m)).alias(f"model_{m}") for m in order])


def between(df: DataFrame, start: date | str | None = None, end: date | str | None = None, column: str = "created_at") -> DataFrame:
    """Half-open date range: from the start of ``start`` to the end of the day ``end``; unreadable dates are out."""
    when = F.col(column) if dict(df.dtypes)[column].startswith("timestamp") else F.try_to_timestamp(F.col(column))
    if start is not None:
        df = df.where(when >= F.lit(str(start)).cast("timestamp"))
    if end is not None:
        df = df.where(when < F.lit(str(end)).cast("timestamp") + F.expr("INTERVAL 1 DAY"))
    return df


def tagged(runs: DataFrame, tags: list[str]) -> DataFrame:
    """Runs that have any of ``tags``."""
    return runs.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))) if tags else runs


def of_strategy(runs: DataFrame, name: str) -> DataFrame:
    return runs.where(F.col("icl_strategy_name").isin(name, f"{name}_stratified"))


def kpis(runs: DataFrame) -> DataFrame:
    """All figures of the overview in one aggregate."""
    done = F.col("status") == "completed"
    return runs.agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("completed"), F.count_if(F.col("status") == "running").alias("running"), F.avg(F.when(done, F.col("mean_ap"))).alias("avg_map"))


def summary_view(runs: DataFrame, datasets: DataFrame) -> DataFrame:
    """Per dataset: run counts by state, MAP statistics and samples; datasets without runs included."""
    out = datasets.join(runs, "dataset_id", "left").groupBy("dataset_id", "dataset_name")
    done = F.col("status") == "completed"
    ap = F.when(done, F.col("mean_ap"))
    return out.agg(F.count("run_id").alias("n_runs"), F.count_if(done).alias("n_completed"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.avg(ap).alias("avg_map"), F.stddev_samp(ap).alias("std_map"), F.min(ap).alias("min_map"), F.max(ap).alias("max_map"), F.coalesce(F.sum("n_samples_scored"), F.lit(0)).alias("n_samples"))


def against_baseline(runs: DataFrame, baseline: str, mark: float = 0.02) -> DataFrame:
    """Latest MAP and number of runs per strategy, difference to the baseline's, and a flag; baseline first."""
    r = runs.where("status = 'completed'").withColumn("strategy", normalized(F.col("icl_strategy_name")))
    n = r.groupBy("strategy").agg(F.count(F.lit(1)).alias("n_runs"))
    newest = latest(r, ("strategy",)).select("strategy", "mean_ap").join(n, "strategy")
    base = newest.where(F.col("strategy") == baseline).select(F.col("mean_ap").alias("base"))  # one row
    out = newest.join(F.broadcast(base))
    diff = F.col("mean_ap") - F.col("base")
    return out.select("strategy", "mean_ap", "n_runs", diff.alias("diff"), (F.abs(diff) > mark).alias("marked")).orderBy((F.col("strategy") == baseline).desc(), F.col("mean_ap").desc(), "strategy")


def icl_table(runs: DataFrame, top: int = 3) -> DataFrame:
    """Latest MAP per strategy and n_icl with its dense rank among all distinct values."""
    r = runs.where("status = 'completed'").withColumn("strategy", normalized(F.col("icl_strategy_name"))).withColumn("n_icl", safe_int(json_param(F.col("icl_strategy_params"), "k")))
    newest = latest(r, ("strategy", "n_icl")).select("strategy", "n_icl", "mean_ap")
    best = newest.select("mean_ap").distinct().orderBy(F.col("mean_ap").desc()).limit(top)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("mean_ap").desc())))  # ``top`` rows
    return newest.join(F.broadcast(ranked), "mean_ap", "left").select("strategy", "n_icl", "mean_ap", "rank")


def pivot_icl(table: DataFrame, strategies: list[str]) -> DataFrame:
    return table.groupBy("n_icl").pivot("strategy", strategies).agg(F.first("mean_ap")).orderBy("n_icl")


def distinct_strategies(runs: DataFrame) -> DataFrame:
    return runs.where("icl_strategy_name IS NOT NULL").select(normalized(F.col("icl_strategy_name")).alias("strategy")).distinct()


def distinct_tags(runs: DataFrame) -> DataFrame:
    return runs.select(F.explode("tags").alias("tag")).distinct()


def run_options(runs: DataFrame, datasets: DataFrame) -> DataFrame:
    """``#id - dataset - strategy - icl<n>`` labels for a selector."""
    n = json_param(F.col("icl_strategy_params"), "k")
    return runs.join(datasets, "dataset_id").select("run_id", F.concat_ws(" - ", F.concat(F.lit("#"), F.col("run_id").cast("string")), "dataset_name", "icl_strategy_name", F.concat(F.lit("icl"), n)).alias("label"))


def in_order(runs: DataFrame, ids: list[int]) -> DataFrame:
    """Runs of ``ids`` in that order; missing ids are left out."""
    return runs.where(F.col("run_id").isin(*ids)).withColumn("pos", F.array_position(F.array(*[F.lit(i).cast("long") for i in ids]), F.col("run_id").cast("long"))).orderBy("pos")


def cross_run_aps(run_samples: DataFrame, ids: list[int], split: str | None = None) -> DataFrame:
    """One row per sample, one column per run."""
    rows = run_samples.where(F.col("run_id").isin(*ids))
    if split:
        rows = rows.where(F.col("split") == split)
    return rows.groupBy("sample_index").pivot("run_id", ids).agg(F.first("ap"))


def category_shares(counts: DataFrame) -> DataFrame:
    """Share of every category; the window runs over one row per category."""
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def gauge(rate: Column) -> Column:
    return F.when(rate < 0.05, "good").when(rate < 0.15, "warning").otherwise("bad")


def shorten(text: Column, width: int = 100) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text)


def histogram(aps: DataFrame, bins: int = 30) -> DataFrame:
    """Counts of APs in equal bins over [0, 1]; nulls and NaN are left out."""
    known = aps.where("ap IS NOT NULL AND NOT isnan(ap)")
    return known.groupBy(F.least(F.floor(F.col("ap") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
