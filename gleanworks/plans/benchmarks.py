"""The core relations derived from the benchmark tables, for queries, tests and bench."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.splits import split_dataset
from ..session import load

STRATEGIES = ("s1", "s2", "s3")


def wide_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per unit: order lines as units, 'returned' as label, three scores, priority as intent."""
    line = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_discount", "l_tax", "l_quantity")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    unit = line.withColumn("unit_idx", F.row_number().over(w) - 1).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return unit.select(
        F.col("l_orderkey").alias("sample_id"),
        "unit_idx",
        F.col("o_orderpriority").alias("intent"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_discount") * 10).alias("s1"),
        clip(F.col("l_tax") * 10 + F.lit(0.0)).alias("s2"),
        clip(F.col("l_quantity") / 50).alias("s3"),
    )


def unit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``wide_units`` in long form: a row per unit and strategy."""
    stacked = ", ".join(f"'{s}', {s}" for s in STRATEGIES)
    return wide_units(spark, sf_dir).select("sample_id", "unit_idx", "intent", "label", F.expr(f"stack({len(STRATEGIES)}, {stacked}) AS (strategy, score)"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sample: labels and score vectors as arrays in unit order."""
    rows = wide_units(spark, sf_dir).groupBy("sample_id", "intent").agg(F.array_sort(F.collect_list(F.struct("unit_idx", "label", *STRATEGIES))).alias("u"))
    return rows.select("sample_id", "intent", F.col("u.label").alias("labels"), *[F.col(f"u.{s}").alias(s) for s in STRATEGIES])


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as experiment runs: user as dataset, type as strategy, ``k`` of props as n_icl."""
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("run_id"),
        (F.col("user_id") % 20).alias("dataset_id"),
        (F.col("event_id") % 3).alias("llm_model_id"),
        F.concat("event_type", F.when(F.col("event_id") % 4 == 0, "_stratified").otherwise("")).alias("icl_strategy_name"),
        F.col("ts").alias("created_at"),
        F.col("value").alias("mean_ap"),
        F.col("props").alias("icl_strategy_params"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_id") % 50 == 1, "running").otherwise("completed").alias("status"),
        (F.col("event_id") % 97).cast("int").alias("n_samples_scored"),
        F.when(F.col("event_type") == "error", F.col("event_id") % 7).otherwise(0).cast("int").alias("n_samples_failed"),
    )


def text_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as samples: lines as units, language as intent, lines whose length is divisible by three as relevant."""
    docs = load(spark, sf_dir, "documents").where("text IS NOT NULL AND text <> ''")
    units = F.split("text", "\n")
    rows = docs.select(F.col("doc_id").alias("sample_id"), F.coalesce("lang", F.lit("")).alias("intent"), F.col("text").alias("input"), units.alias("input_units"))
    return rows.withColumn("input_unit_labels", F.transform("input_units", lambda u: (F.length(u) % 3 == 0).cast("int")))


def text_splits(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """``text_samples`` split as a corpus of several intents, in a portable order."""
    rows = text_samples(spark, sf_dir)
    order = [(F.col("sample_id") * 7919 + 3) % 1000, F.col("sample_id")]
    named = split_dataset(rows, "contractnli", order=order)
    return {part: named.where(F.col("split") == part).drop("split") for part in ("pool", "cal", "test")}


UNITS_SQL = """
wide AS (
  SELECT l_orderkey AS sample_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1)::INT AS unit_idx,
         o_orderpriority AS intent, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_discount * 10 AS s1,
         greatest(0.0::DOUBLE, least(1.0::DOUBLE, l_tax * 10 + 0.0::DOUBLE)) AS s2, greatest(0.0::DOUBLE, least(1.0::DOUBLE, l_quantity / 50)) AS s3
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
units AS (
  SELECT sample_id, unit_idx, intent, label, 's1' AS strategy, s1 AS score FROM wide UNION ALL
  SELECT sample_id, unit_idx, intent, label, 's2', s2 FROM wide UNION ALL
  SELECT sample_id, unit_idx, intent, label, 's3', s3 FROM wide)"""

AP_SQL = UNITS_SQL + """,
steps AS (SELECT sample_id, intent, strategy, score, sum(label) AS p, count(*) AS n FROM units GROUP BY ALL),
cum AS (
  SELECT sample_id, intent, strategy, p, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER g AS tp, sum(n) OVER g AS tn FROM steps
  WINDOW w AS (PARTITION BY sample_id, strategy ORDER BY score DESC), g AS (PARTITION BY sample_id, strategy)),
aps AS (
  SELECT sample_id, any_value(intent) AS intent, strategy,
         CASE WHEN max(tp) > 0 AND max(tp) < max(tn) THEN sum(p::DOUBLE * cp / cn) / max(tp) END AS ap FROM cum GROUP BY sample_id, strategy)"""

RUNS_SQL = """
runs AS (
  SELECT event_id AS run_id, user_id % 20 AS dataset_id, event_id % 3 AS llm_model_id,
         event_type || CASE WHEN event_id % 4 = 0 THEN '_stratified' ELSE '' END AS icl_strategy_name, ts AS created_at, value AS mean_ap,
         props AS icl_strategy_params, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 50 = 1 THEN 'running' ELSE 'completed' END AS status,
         (event_id % 97)::INT AS n_samples_scored, CASE WHEN event_type = 'error' THEN event_id % 7 ELSE 0 END::INT AS n_samples_failed
  FROM events)"""

TEXT_SQL = """
ts AS (SELECT doc_id AS sample_id, coalesce(lang, '') AS intent, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL AND text <> ''),
ta AS (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY (sample_id * 7919 + 3) % 1000, sample_id) AS i FROM ts),
tb AS (SELECT *, row_number() OVER (PARTITION BY i <= 20 ORDER BY (sample_id * 7919 + 3) % 1000, sample_id) AS rn FROM ta),
sp AS (SELECT sample_id, intent, text, ls, CASE WHEN i <= 20 THEN 'pool' WHEN rn <= 100 THEN 'cal' ELSE 'test' END AS split FROM tb),
tu AS (SELECT sample_id, intent, split, p - 1 AS unit_idx, (length(ls[p]) % 3 = 0)::INT AS label, ls[p] AS line,
              coalesce(list_sum(list_transform(regexp_extract_all(ls[p], '(?s).'), lambda c: unicode(c))), 0)::BIGINT AS codes
       FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS p FROM sp))"""


def scored_sql(shift: int, name: str = "x") -> str:
    """SQL of the stand-in scorer's scores with ``shift`` examples in the prompt, and of their average precision: ``<name>u`` and ``<name>a``, after ``TEXT_SQL``."""
    return f"""
{name}u AS (SELECT *, ((codes + {shift}) % 101) / 100.0::DOUBLE AS score FROM tu WHERE split <> 'pool'),
{name}s AS (SELECT sample_id, intent, split, score, sum(label) AS p, count(*) AS n FROM {name}u GROUP BY ALL),
{name}c AS (SELECT sample_id, intent, split, p, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER g AS tp, sum(n) OVER g AS tn FROM {name}s
  WINDOW w AS (PARTITION BY sample_id ORDER BY score DESC), g AS (PARTITION BY sample_id)),
{name}a AS (SELECT sample_id, any_value(intent) AS intent, any_value(split) AS split, CASE WHEN max(tp) > 0 AND max(tp) < max(tn) THEN sum(p::DOUBLE * cp / cn) / max(tp) END AS ap FROM {name}c GROUP BY sample_id)"""
