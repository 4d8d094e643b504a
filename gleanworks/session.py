"""Session settings and table loading."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

#: Largest side that a join may broadcast without a proven bound.
BROADCAST_ROWS = 100_000


def build_session(app: str = "gleanworks", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; ``conf`` overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    return ready(builder.getOrCreate())


def ready(spark: SparkSession) -> SparkSession:
    """Ship this package's functions with the plans, so executors need no installation."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])
    return spark


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``limit`` rows; reads no more than one row beyond."""
    return df.limit(limit + 1).count() <= limit


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local one only where it is unset and the session runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gleanworks-"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and kept when executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/gleanworks-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
