"""Reports over stored runs: one run in full, and the figures of all corpora for one model."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import precision, runs, statistics

# The labels whose runs the report compares, in order of preference, and the best single run of each corpus.
BASELINE = "icl0"
ENSEMBLES = ("icl2_moe4", "icl2_moe")
BEST_SINGLE = {
    "ectsum": "icl3_anchor_dpp",
    "subsume": "icl3_bm25",
    "hotpotqa": "icl2_anchor_dpp",
    "physionet": "icl3_random",
    "puma": "icl2_anchor_dpp",
    "evidence_inference": "icl1_anchor_dpp",
    "contractnli": "icl3_pattern_dpp",
}


def run_report(run_rows: DataFrame, samples: DataFrame) -> DataFrame:
    """Per run of ``run_rows``: its row, duration, counts, AP figures with their interval, intents and failed samples.

    ``samples(run_id, sample_index, intent, ap, status)`` are aggregated by run; failed
    samples are listed up to 100 a run, their number is always whole.
    """
    by = ("run_id",)
    mine = samples.join(run_rows.select("run_id"), "run_id", "left_semi")
    metrics = precision.run_metrics(mine, by).drop("n")
    counts = mine.groupBy(*by).agg(F.count(F.lit(1)).alias("n_samples"), F.count_if(F.col("status") == "scored").alias("n_success"))
    per = mine.groupBy("run_id", "intent").agg(F.count(F.lit(1)).alias("n_samples"), F.avg("ap").alias("mean_ap"), F.count_if(F.col("status") != "scored").alias("n_failed"))
    intents = per.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("intent", "n_samples", "mean_ap", "n_failed"))).alias("intent_metrics"))
    failed = precision.first_failed(mine.where("status = 'failed'"), by, 100, "sample_index").withColumnRenamed("samples", "failed_samples")
    out = run_rows
    for part in (counts, metrics, intents, failed):
        out = out.join(part, "run_id", "left")
    seconds = F.col("completed_at").cast("double") - F.col("started_at").cast("double")
    return out.withColumn("duration_seconds", seconds).withColumn("n_failed", F.col("n_samples") - F.col("n_success"))


def matrix(run_rows: DataFrame, datasets: DataFrame, model_id: int | None = None) -> DataFrame:
    """``(dataset_name, label, mean_ap, std_ap, run_id, n_samples)``: the latest run of every corpus and label."""
    latest = runs.performance_matrix(run_rows, model_id).select("dataset_id", "label", "run_id")
    return latest.join(run_rows.select("run_id", "mean_ap", "std_ap", F.col("n_samples_scored").alias("n_samples")), "run_id").join(datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name")), "dataset_id").drop("dataset_id")


def compared(cells: DataFrame) -> DataFrame:
    """``(dataset_name, role, label, run_id)``: every corpus's baseline, ensemble and best single run, where it has them."""
    rank = F.when(F.col("label") == BASELINE, F.struct(F.lit("icl0").alias("role"), F.lit(0).alias("at")))
    for i, label in enumerate(ENSEMBLES):
        rank = rank.when(F.col("label") == label, F.struct(F.lit("ensemble").alias("role"), F.lit(i).alias("at")))
    best = F.create_map(*[F.lit(x) for kv in BEST_SINGLE.items() for x in kv])[F.col("dataset_name")]
    named = cells.withColumn("_r", rank).where("_r IS NOT NULL").select("dataset_name", "_r.role", "_r.at", "label", "run_id")
    single = cells.where(F.col("label") == best).select("dataset_name", F.lit("best_single").alias("role"), F.lit(0).alias("at"), "label", "run_id")
    picked = named.unionByName(single).groupBy("dataset_name", "role").agg(F.min_by(F.struct("label", "run_id"), "at").alias("x"))
    return picked.select("dataset_name", "role", "x.label", "x.run_id")


def distributions(picked: DataFrame, samples: DataFrame) -> DataFrame:
    """AP distribution of every compared run's scored samples."""
    aps = samples.where("status = 'scored' AND ap IS NOT NULL").join(F.broadcast(picked), "run_id")  # three runs a corpus
    return precision.distribution_stats(aps, ("dataset_name", "role", "run_id"))


def intervals(picked: DataFrame, samples: DataFrame, rounds: int = 1000) -> DataFrame:
    """Bootstrap intervals of every compared run's MAP, by weights that hashes draw."""
    aps = samples.where("status = 'scored' AND ap IS NOT NULL").join(F.broadcast(picked), "run_id")
    keyed = aps.select(F.concat_ws("\x1f", "dataset_name", "role").alias("strategy"), F.col("sample_index").alias("sample_id"), "ap")
    out = statistics.poisson_bootstrap(keyed, rounds)
    return out.select(F.split("strategy", "\x1f")[0].alias("dataset_name"), F.split("strategy", "\x1f")[1].alias("role"), "mean", "ci_low", "ci_high")


def paired(picked: DataFrame, samples: DataFrame) -> DataFrame:
    """Per corpus the ensemble against the baseline and against the best single run, on their common samples."""
    aps = samples.where("status = 'scored' AND ap IS NOT NULL").join(F.broadcast(picked), "run_id").select("dataset_name", "role", "sample_index", "ap")
    base = aps.where("role <> 'ensemble'").select("dataset_name", F.col("role").alias("against"), "sample_index", F.col("ap").alias("b"))
    both = aps.where("role = 'ensemble'").select("dataset_name", "sample_index", F.col("ap").alias("a")).join(base, ["dataset_name", "sample_index"])
    return statistics.paired_summaries(both, ("dataset_name", "against"))


def paper_data(run_rows: DataFrame, samples: DataFrame, datasets: DataFrame, model_id: int | None = None, rounds: int = 1000) -> dict[str, DataFrame]:
    """The report's tables by name: the strategy matrix, distributions, intervals, differences and reproducibility."""
    cells = matrix(run_rows, datasets, model_id)
    picked = compared(cells)
    times = picked.join(run_rows.select("run_id", "icl_strategy_name", "n_samples_scored", "total_duration_ms", "total_llm_time_ms", "avg_sample_time_ms"), "run_id")
    return {"strategy_matrix": cells, "ap_distributions": distributions(picked, samples), "bootstrap_cis": intervals(picked, samples, rounds), "paired_diffs": paired(picked, samples), "reproducibility": times}


def write_paper_data(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as a folder of JSON lines below ``path``."""
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{path}/{name}")


def summary(tables: dict[str, DataFrame]) -> str:
    """A short text: the matrix and the differences, a row per corpus and label."""
    lines = [f"{r['dataset_name']:20s} {r['label']:25s} MAP={r['mean_ap']:.3f} (run {r['run_id']})" for r in tables["strategy_matrix"].where("mean_ap IS NOT NULL").orderBy("dataset_name", "label").collect()]
    lines += [f"{r['dataset_name']:20s} ensemble against {r['against']}: {r['diff']:+.3f} (n={r['n']})" for r in tables["paired_diffs"].orderBy("dataset_name", "against").collect()]
    return "\n".join(lines)


def as_json(report_row) -> str:
    """One report row as JSON text; times in ISO form."""
    return json.dumps(report_row.asDict(recursive=True), default=str)
