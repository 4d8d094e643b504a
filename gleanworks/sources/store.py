"""The run store: Parquet tables of datasets, models, runs and samples.

Runs change state, Parquet rows do not, so every change appends a full version of
its row; the current row is the newest version.  Tables are not compacted.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import DATASETS, MODELS, RUN_SAMPLES, RUNS

TABLES = {"datasets": (DATASETS, ("id",)), "models": (MODELS, ("id",)), "runs": (RUNS, ("run_id",)), "run_samples": (RUN_SAMPLES, ("run_id", "split", "sample_index"))}
AGGREGATES = {"mean_ap", "std_ap", "n_samples_scored", "n_samples_failed", "n_retries_total", "error_rate", "ap_percentiles", "intent_metrics", "prompt_content", "error_summary", "tags"}
SETTABLE = AGGREGATES | {"metadata", "total_duration_ms", "total_llm_time_ms", "avg_sample_time_ms", "icl_strategy_name", "icl_strategy_params", "icl_permutation_id", "icl_diversity_metrics"}
MOVES = {"pending": {"running", "completed", "failed"}, "running": {"completed", "failed"}, "completed": set(), "failed": set()}


class RunStore:
    """Reads and writes the four tables below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _schema(self, name: str) -> T.StructType:
        return T.StructType.fromDDL(f"{TABLES[name][0]}, _version long, _gone boolean")

    def init(self, drop_existing: bool = False) -> None:
        """Create the tables; existing ones stay unless dropped."""
        for name in TABLES:
            mode = "overwrite" if drop_existing else "append"
            self.spark.createDataFrame([], self._schema(name)).write.mode(mode).parquet(f"{self.path}/{name}")

    def append(self, name: str, rows: DataFrame, gone: bool = False) -> None:
        full = rows.withColumn("_version", F.lit(time.time_ns())).withColumn("_gone", F.lit(gone))
        fields = [(F.col(f.name) if f.name in full.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self._schema(name).fields]
        full.select(*fields).write.mode("append").parquet(f"{self.path}/{name}")

    def table(self, name: str) -> DataFrame:
        """Current rows."""
        raw = self.spark.read.schema(self._schema(name)).parquet(f"{self.path}/{name}")
        w = Window.partitionBy(*TABLES[name][1]).orderBy(F.col("_version").desc())
        return raw.withColumn("_rn", F.row_number().over(w)).where("_rn = 1 AND NOT _gone").drop("_rn", "_version", "_gone")

    def _row(self, name: str, values: dict) -> DataFrame:
        kinds = {f.name: f.dataType for f in self._schema(name).fields}
        return self.spark.createDataFrame([tuple(values.values())], T.StructType([T.StructField(k, kinds[k]) for k in values]))

    def _new_id(self) -> int:
        return uuid.uuid4().int >> 66

    def get_or_create(self, name: str, key: str, **values) -> dict:
        """The dataset or model called ``key``, inserted first if there is none."""
        found = self.table(name).where(F.col("name") == key).first()
        if found is None:
            self.append(name, self._row(name, {"id": self._new_id(), "name": key} | values).withColumn("created_at", F.current_timestamp()))
            found = self.table(name).where(F.col("name") == key).first()
        return found.asDict(recursive=True)

    def create_run(self, dataset_id: int, llm_model_id: int, **values) -> int:
        run_id = self._new_id()
        row = {"run_id": run_id, "dataset_id": dataset_id, "llm_model_id": llm_model_id, "split": "test", "status": "pending"} | values
        self.append("runs", self._row("runs", row).withColumn("created_at", F.current_timestamp()))
        return run_id

    def _move(self, run_id: int, status: str, stamp: str, values: dict) -> None:
        run = self.table("runs").where(F.col("run_id") == run_id)
        now = run.select("status").first()
        if now is None:
            raise ValueError(f"no run {run_id}")
        if status not in MOVES[now["status"]]:
            raise ValueError(f"run {run_id} is {now['status']}, not to be {status}")
        out = run.withColumn("status", F.lit(status)).withColumn(stamp, F.current_timestamp())
        if values:
            patch = self._row("runs", {"run_id": run_id} | values)
            out = out.drop(*values).join(F.broadcast(patch), "run_id")  # one row
        self.append("runs", out)

    def start_run(self, run_id: int) -> None:
        self._move(run_id, "running", "started_at", {})

    def complete_run(self, run_id: int, **values) -> None:
        unknown = set(values) - SETTABLE
        if unknown:
            raise ValueError(f"unknown run fields: {', '.join(sorted(unknown))}")
        self._move(run_id, "completed", "completed_at", values)

    def fail_run(self, run_id: int, message: str | None = None) -> None:
        self._move(run_id, "failed", "completed_at", {"error_message": message})

    def store_samples(self, run_id: int, scored: DataFrame, scores: str, ap: str, labels: str = "input_unit_labels", split: str = "test", index: str = "sample_id", sub_scores: str | None = None) -> None:
        """A row per sample; failed where the score vector is null; null sub-scores drop out, an empty map is null."""
        subs = F.map_filter(sub_scores, lambda _, v: v.isNotNull()) if sub_scores else F.lit(None)
        rows = scored.select(
            F.lit(run_id).alias("run_id"),
            F.col(index).alias("sample_index"),
            F.lit(split).alias("split"),
            *([F.col("intent")] if "intent" in scored.columns else []),
            F.col(ap).alias("ap"),
            F.col(scores).alias("scores"),
            F.col(labels).alias("labels"),
            F.size(labels).alias("n_sentences"),
            F.when(F.col(scores).isNull(), "failed").otherwise("scored").alias("status"),
            (F.when(F.size(subs) > 0, subs) if sub_scores else subs).alias("sub_scores"),
            F.current_timestamp().alias("created_at"),
        )
        self.append("run_samples", rows)

    def samples(self, run_id: int, split: str | None = None, status: str | None = None, intent: str | None = None) -> DataFrame:
        rows = self.table("run_samples").where(F.col("run_id") == run_id)
        for column, value in (("split", split), ("status", status), ("intent", intent)):
            if value is not None:
                rows = rows.where(F.col(column) == value)
        return rows.orderBy("sample_index")

    def runs_of(self, dataset_id: int, status: str | None = None, llm_model_id: int | None = None) -> DataFrame:
        rows = self.table("runs").where(F.col("dataset_id") == dataset_id)
        if status is not None:
            rows = rows.where(F.col("status") == status)
        if llm_model_id is not None:
            rows = rows.where(F.col("llm_model_id") == llm_model_id)
        return rows.orderBy(F.col("created_at").desc())

    def delete_run(self, run_id: int) -> bool:
        """Delete a run and its samples; whether there was one."""
        run = self.table("runs").where(F.col("run_id") == run_id)
        if run.first() is None:
            return False
        self.append("run_samples", self.table("run_samples").where(F.col("run_id") == run_id), gone=True)
        self.append("runs", run, gone=True)
        return True

    def delete_all(self, include_datasets: bool = False) -> int:
        """Delete every run (and dataset and model); the number of runs."""
        n = self.table("runs").count()
        for name in ("run_samples", "runs", *(("datasets", "models") if include_datasets else ())):
            self.append(name, self.table(name), gone=True)
        return n

    def export(self, run_id: int) -> DataFrame:
        """One run as a JSON document."""
        return self.table("runs").where(F.col("run_id") == run_id).select(F.to_json(F.struct("*")).alias("json"))
