"""Pool / calibration / test splits and per-group top-k."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POOL, CAL, POOL_PER_INTENT, SEED, TEST_CAP = 50, 100, 20, 3, 10_000


def hash_order(key: str, seed: int = SEED) -> Column:
    """A reproducible shuffle order."""
    return F.xxhash64(F.col(key), F.lit(seed))


def first_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows: a top-k that keeps k rows per task, not a global sort."""
    return df.orderBy(*order).limit(k)


def split_uniform(df: DataFrame, pool: int = POOL, cal: int = CAL, key: str = "sample_id", order: list[Column] | None = None, test_cap: int | None = None) -> DataFrame:
    """Adds ``split``: the first ``pool`` rows of the shuffle, the next ``cal``, the rest test.

    Only pool and calibration rows are ranked; they are bounded and broadcast, so
    the table itself is neither sorted nor exchanged.
    """
    order = order or [hash_order(key), F.col(key)]
    head = first_k(df.select(key, *[c.alias(f"_o{i}") for i, c in enumerate(order)]), [F.col(f"_o{i}") for i in range(len(order))], pool + cal + (test_cap or 0))
    ranked = head.withColumn("_rank", F.row_number().over(Window.orderBy(*[F.col(f"_o{i}") for i in range(len(order))])))
    out = df.join(F.broadcast(ranked.select(key, "_rank")), key, "left")
    named = F.when(F.col("_rank") <= pool, "pool").when(F.col("_rank") <= pool + cal, "cal").otherwise("test")
    out = out.withColumn("split", named)
    return (out.where(F.col("_rank").isNotNull()) if test_cap is not None else out).drop("_rank")


def split_stratified(df: DataFrame, per_intent: int = POOL_PER_INTENT, cal: int = CAL, key: str = "sample_id", intent: str = "intent", order: list[Column] | None = None) -> DataFrame:
    """``per_intent`` pool rows of every intent; calibration and test from the shuffled rest.

    Only keys are ranked, by a per-task limited window, and pool and calibration rows,
    which are bounded per intent, are joined back: the table is neither sorted nor exchanged.
    """
    order = order or [hash_order(key), F.col(key)]
    names = [f"_o{i}" for i in range(len(order))]
    keys = df.select(key, intent, *[c.alias(n) for n, c in zip(names, order, strict=True)])
    w = Window.partitionBy(intent).orderBy(*names)
    pool = keys.withColumn("_in", F.row_number().over(w)).where(F.col("_in") <= per_intent).select(key, *names)
    rest = keys.join(pool.select(key), key, "left_anti")
    head = first_k(rest.select(key, *names), [F.col(n) for n in names], cal)
    named = pool.select(key, F.lit("pool").alias("split")).unionByName(head.select(key, F.lit("cal").alias("split")))
    return df.join(named, key, "left").withColumn("split", F.coalesce("split", F.lit("test")))


def top_k_by_group(df: DataFrame, group: str | None, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every group with their ``rank``; a smaller group is taken whole."""
    if group is None:
        head = first_k(df, order, k)
        return head.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


# Where the processed corpora lie: folder and file.
FILES = {
    "puma": ("PUMA", "PUMA_processed.parquet"),
    "subsume": ("SubSumE", "SubSumE_processed.parquet"),
    "ectsum": ("ECTSum", "ECTSum_processed.parquet"),
    "physionet": ("PhysionetGoldCorpus", "physionet_goldcorpus_i2b2deid_claimlevel.parquet"),
    "hotpotqa": ("HotpotQA", "HotpotQA_processed.parquet"),
    "evidence_inference": ("EvidenceInference_v2", "EvidenceInference_processed.parquet"),
    "contractnli": ("ContractNLI", "ContractNLI_processed.parquet"),
}
#: Corpora whose pool is drawn per intent, and those whose test rows are capped.
BY_INTENT = ("puma", "subsume", "evidence_inference", "contractnli")
CAPS = {"hotpotqa": TEST_CAP}


def split_dataset(df: DataFrame, dataset: str, pool: int | None = None, cal: int | None = None, key: str = "sample_id", order: list[Column] | None = None) -> DataFrame:
    """``df`` with ``split`` as the corpus wants it: a pool per intent or a plain one, with its sizes and its cap."""
    name = dataset.lower()
    if name not in FILES:
        raise ValueError(f"unknown dataset {dataset!r}; known: {', '.join(FILES)}")
    cal = CAL if cal is None else cal
    if name in BY_INTENT and "intent" in df.columns:
        return split_stratified(df, POOL_PER_INTENT if pool is None else pool, cal, key, order=order)
    return split_uniform(df, POOL if pool is None else pool, cal, key, order, CAPS.get(name))


def split_and_save(df: DataFrame, dataset: str, folder: str, pool: int | None = None, cal: int | None = None, key: str = "sample_id", order: list[Column] | None = None) -> dict[str, DataFrame]:
    """The three parts as Parquet folders ``<dataset>_<part>.parquet``, written and read back by name."""
    parts = split_dataset(df, dataset, pool, cal, key, order)
    out = {}
    for part in ("pool", "cal", "test"):
        path = f"{folder}/{dataset.lower()}_{part}.parquet"
        parts.where(F.col("split") == part).write.mode("overwrite").parquet(path)
        out[part] = df.sparkSession.read.parquet(path)
    return out


def split_named(spark: SparkSession, dataset: str, root: str, file: str | None = None, pool: int | None = None, cal: int | None = None, key: str = "sample_id") -> dict[str, DataFrame]:
    """Split a processed corpus below ``root`` and save its parts beside it; an error where the file is missing.

    Rows without ``key`` are numbered by a hash of their content.
    """
    name = dataset.lower()
    if name not in FILES:
        raise ValueError(f"unknown dataset {dataset!r}; known: {', '.join(FILES)}")
    folder, default = FILES[name]
    try:
        df = spark.read.parquet(f"{root}/{folder}/{file or default}")
    except AnalysisException as error:
        raise FileNotFoundError(f"no processed corpus at {root}/{folder}/{file or default}") from error
    df = df if key in df.columns else df.withColumn(key, F.xxhash64(*df.columns))
    return split_and_save(df, name, f"{root}/{folder}", pool, cal, key)


def split_all(spark: SparkSession, root: str, pool: int | None = None, cal: int | None = None) -> dict[str, dict[str, DataFrame]]:
    """Every corpus whose processed file is there; the others are left out."""
    out = {}
    for name in FILES:
        try:
            out[name] = split_named(spark, name, root, pool=pool, cal=cal)
        except FileNotFoundError:
            continue
    return out
