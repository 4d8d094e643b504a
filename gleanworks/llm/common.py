"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import re
import sys
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches handed to Python workers hold at most this many rows.
ARROW_ROWS = 512


#: Folders that ``materialise`` and its like made in this process, for ``release``.
_MADE: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"
_BROADCAST = "spark.sql.autoBroadcastJoinThreshold"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none and runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gleanworks-"))
    return spark.sparkContext.getCheckpointDir()


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; ``release`` deletes it."""
    path = f"{shared_dir(spark)}/gleanworks-{uuid.uuid4().hex}"
    _MADE.append(path)
    return f"{path}/{name}"


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Delete what this process has written to the shared folder; results that still read it must be written out before."""
    while _MADE:
        delete(spark, _MADE.pop())


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that no result reads any more."""
    for table in tables:
        delete(table.sparkSession, table._written)


def prepare(spark: SparkSession) -> SparkSession:
    """Ship this package with the plans, keep Arrow batches small (for this session), and have a shared folder for checkpoints."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])
    shared_dir(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


@contextlib.contextmanager
def tidy(spark: SparkSession, ordered: bool = False) -> Iterator[None]:
    """Session settings for the jobs inside, put back afterwards.

    Shuffle files go as soon as a job is done: what is written out is not computed again.
    With ``ordered``, joins are merge joins at every size, and the order of bucketed files
    counts, so that they do not sort.
    """
    wanted = {_CLEANUP: "true"} | ({_ORDER: "true", _BROADCAST: "-1"} if ordered else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = folder(spark, name)
    with tidy(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hex_digest(text: Column) -> Column:
    """Lower-case SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def literal(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def min_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of ``edges(a, b)``: every vertex with the smallest vertex it reaches.

    Alternates the large-star and small-star steps, so the number of rounds grows
    with the logarithm of the vertex count, and each vertex's neighbours are only
    aggregated, never gathered.  The minima that a round starts with also tell whether
    all components are stars around their smallest vertex; then they are the result.
    What a round writes out is read back in a few tasks if it is small, so that the
    driver keeps track of few tasks.  Self loops keep isolated vertices.  Returns
    ``(vertex, component)``; an empty input gives an empty result.
    """

    def turned(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
        return rows.select(F.inline(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs])))

    known = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e, alone = materialise(known.distinct(), "edges"), None
    for k in range(max_rounds + 1):
        least, other = F.min("b"), F.max(F.when(F.col("b") != F.col("a"), F.col("b")))
        low = turned(e, ("a", "b"), ("b", "a")).groupBy("a").agg(F.least(least, F.col("a")).alias("m"), ((least < F.col("a")) & (other > least)).alias("open"), other.isNull().alias("alone"))
        # Written out, so that the join can split a vertex with very many edges.
        low = materialise(low, "low")
        is_open, any_alone = low.agg(F.max("open"), F.max("alone")).first()
        if not is_open:
            break
        large = e.where("a <> b").join(low.select(F.col("a").alias("b"), "m"), "b").select("a", F.col("m").alias("b"))
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        after = materialise(turned(small, ("a", "m"), ("b", "m")).where("a <> b").distinct(), "edges")
        if k == 0 and any_alone:  # they have no part in later rounds
            alone = low.where("alone")
            discard(e)
        else:
            discard(e, low)
        e = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    discard(e)
    found = low if alone is None else low.union(alone)
    return found.select(F.col("a").alias("vertex"), F.col("m").alias("component"))
