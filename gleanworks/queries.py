"""Registered queries over the benchmark tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import parsing, prompts, text
from .operators import conformal, errors, examples, fusion, precision, report, retrieval, runs, selection, splits, statistics
from .plans import experiment
from .plans.benchmarks import AP_SQL, RUNS_SQL, TEXT_SQL, UNITS_SQL, samples, scored_sql, text_samples, text_splits, unit_scores, wide_units
from .plans.benchmarks import runs as event_runs
from .session import load, ready, shared_folder, written
from .sources import corpora
from .sources.store import RunStore
from .streaming.errors import hourly

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
ALPHA, BETA = 0.1, 0.8


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: f(ready(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _aps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return precision.average_precision(unit_scores(spark, sf_dir))


# -- average precision and metrics


@query("ap_per_sample", f"WITH {AP_SQL} SELECT sample_id, strategy, intent, round(ap, 6) AS ap FROM aps")
def _(spark, d):
    return _r(_aps(spark, d)).select("sample_id", "strategy", "intent", "ap")


@query("ap_of_arrays", f"WITH {AP_SQL} SELECT sample_id, round(max(ap) FILTER (WHERE strategy = 's1'), 6) AS ap_s1, round(max(ap) FILTER (WHERE strategy = 's3'), 6) AS ap_s3 FROM aps GROUP BY sample_id")
def _(spark, d):
    return _r(samples(spark, d).select("sample_id", *[precision.ap_of_arrays(F.col(s), F.col("labels")).alias(f"ap_{s}") for s in ("s1", "s3")]))


@query("map_by_strategy", f"WITH {AP_SQL} SELECT strategy, round(coalesce(avg(ap), 'nan'::DOUBLE), 6) AS map, count(ap) AS n FROM aps GROUP BY strategy")
def _(spark, d):
    return _r(precision.summarize(_aps(spark, d)))


@query("map_by_intent", f"WITH {AP_SQL} SELECT intent, strategy, round(coalesce(avg(ap), 'nan'::DOUBLE), 6) AS map, count(ap) AS n FROM aps GROUP BY intent, strategy")
def _(spark, d):
    return _r(precision.summarize(_aps(spark, d), ("intent", "strategy")))


@query(
    "ap_percentiles",
    f"""WITH {AP_SQL} SELECT strategy, round(avg(ap), 6) AS mean_ap, round(stddev_samp(ap), 6) AS std_ap, round(quantile_cont(ap, 0.05), 6) AS p5, round(quantile_cont(ap, 0.25), 6) AS p25,
    round(quantile_cont(ap, 0.5), 6) AS p50, round(quantile_cont(ap, 0.75), 6) AS p75, round(quantile_cont(ap, 0.95), 6) AS p95, round(min(ap), 6) AS min_ap, round(max(ap), 6) AS max_ap,
    count(ap) AS n_scored, count(*) - count(ap) AS n_failed, round((count(*) - count(ap))::DOUBLE / count(*), 6) AS error_rate FROM aps GROUP BY strategy""",
)
def _(spark, d):
    return _r(precision.ap_stats(_aps(spark, d)))


@query(
    "ap_distribution_stats",
    f"""WITH {AP_SQL} SELECT strategy, count(ap) AS n, round_even(avg(ap), 4) AS mean, round_even(stddev_pop(ap), 4) AS std,
    {', '.join(f'round_even(quantile_cont(ap, {q}), 4) AS p{round(q * 100)}' for q in (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95))},
    round_even(100.0 * count(*) FILTER (WHERE ap = 0) / count(ap), 1) AS pct_zero, round_even(100.0 * count(*) FILTER (WHERE ap >= 1) / count(ap), 1) AS pct_perfect
    FROM aps WHERE ap IS NOT NULL GROUP BY strategy""",
)
def _(spark, d):
    return precision.distribution_stats(_aps(spark, d))


@query(
    "run_metrics",
    f"""WITH {AP_SQL}, m AS (SELECT strategy, count(ap) AS n, avg(ap) AS m, coalesce(stddev_samp(ap), 0) AS s, quantile_cont(ap, 0.5) AS md, min(ap) AS lo, max(ap) AS hi FROM aps WHERE ap IS NOT NULL GROUP BY strategy),
    q AS (SELECT *, (1.959963984540054 + 2.372271 / (n - 1) + 2.822500 / ((n - 1.0) * (n - 1))) * s / sqrt(n) AS h FROM m)
    SELECT strategy, n, round(m, 6) AS mean_ap, round(s, 6) AS std_ap, round(md, 6) AS median_ap, round(lo, 6) AS min_ap, round(hi, 6) AS max_ap, round(m - h, 5) AS ci_low, round(m + h, 5) AS ci_high FROM q""",
)
def _(spark, d):
    out = precision.run_metrics(_aps(spark, d))
    return out.select(*[F.round(c, 5 if c.startswith("ci") else 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(
    "intent_metrics",
    f"""WITH {AP_SQL} SELECT intent, count(*) AS n_samples, count(ap) AS n_success, count(*) - count(ap) AS n_failed, round(avg(ap), 6) AS mean_ap,
    round(coalesce(stddev_samp(ap), 0), 6) AS std_ap, round(min(ap), 6) AS min_ap, round(max(ap), 6) AS max_ap FROM aps WHERE strategy = 's1' GROUP BY intent""",
)
def _(spark, d):
    return _r(precision.intent_metrics(_aps(spark, d).where("strategy = 's1'")))


@query(
    "error_summary",
    f"""WITH {AP_SQL}, f AS (SELECT strategy, sample_id, row_number() OVER (PARTITION BY strategy ORDER BY sample_id) AS rn FROM aps WHERE ap IS NULL)
    SELECT a.strategy, count(*) FILTER (WHERE ap IS NULL) AS total_errors, round(count(*) FILTER (WHERE ap IS NULL) / count(*)::DOUBLE, 6) AS error_rate,
    (SELECT string_agg(sample_id::VARCHAR, ',' ORDER BY sample_id) FROM f WHERE f.strategy = a.strategy AND rn <= 20) AS samples FROM aps a GROUP BY a.strategy""",
)
def _(spark, d):
    e = precision.error_summary(_aps(spark, d))
    return _r(e.select("strategy", "error_summary.total_errors", "error_summary.error_rate", F.array_join(F.transform("error_summary.samples", lambda s: s.cast("string")), ",").alias("samples")))


@query(
    "windowing_guard",
    f"""WITH {UNITS_SQL}, s AS (SELECT sample_id, count(*) AS n, sum(label) AS p FROM wide GROUP BY sample_id)
    SELECT round(avg(n), 6) AS avg_units, round(avg(p::DOUBLE / n), 6) AS avg_positive, avg(n) > 30 OR avg(p::DOUBLE / n) < 0.15 AS windowed FROM s""",
)
def _(spark, d):
    return _r(precision.windowing_guard(samples(spark, d)))


# -- fusion


@query("fuse_equal", f"WITH {UNITS_SQL} SELECT sample_id, unit_idx, intent, label, round((s1 + s2 + s3) / 3, 6) + 0.0 AS score, 'fused' AS strategy FROM wide")
def _(spark, d):
    return _r(fusion.fuse_long(unit_scores(spark, d)))


@query(
    "fuse_weighted_nullskip",
    f"""WITH {UNITS_SQL}, n AS (SELECT sample_id, unit_idx, label, intent, strategy, CASE WHEN strategy = 's2' AND sample_id % 3 = 0 THEN NULL ELSE score END AS score FROM units)
    SELECT sample_id, unit_idx, any_value(intent) AS intent, any_value(label) AS label,
    round(sum(CASE strategy WHEN 's1' THEN 1.0::DOUBLE WHEN 's2' THEN 3.0 ELSE 2.0 END * score) / sum(CASE WHEN score IS NULL THEN 0.0::DOUBLE WHEN strategy = 's1' THEN 1.0 WHEN strategy = 's2' THEN 3.0 ELSE 2.0 END), 6) + 0.0 AS score,
    'moe' AS strategy FROM n GROUP BY sample_id, unit_idx""",
)
def _(spark, d):
    u = unit_scores(spark, d).withColumn("score", F.when((F.col("strategy") == "s2") & (F.col("sample_id") % 3 == 0), None).otherwise(F.col("score")))
    return _r(fusion.fuse_long(u, {"s1": 1.0, "s2": 3.0, "s3": 2.0}, "moe"))


@query(
    "fuse_arrays",
    f"""WITH {UNITS_SQL} SELECT sample_id, round(sum((s1 + 3 * CASE WHEN sample_id % 3 = 0 THEN 0 ELSE s2 END) / CASE WHEN sample_id % 3 = 0 THEN 1 ELSE 4 END), 5) AS total, count(*) AS n FROM wide GROUP BY sample_id""",
)
def _(spark, d):
    s2 = F.when(F.col("sample_id") % 3 != 0, F.col("s2"))
    f = samples(spark, d).select("sample_id", fusion.fuse_arrays([F.col("s1"), s2], [1.0, 3.0]).alias("v"))
    return f.select("sample_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.size("v").cast("long").alias("n"))


# -- conformal

_NOISE = "noise(unit_idx, eps) AS (VALUES " + ", ".join(f"({i}, {e!r}::DOUBLE)" for i, e in enumerate(conformal.noise_values(64))) + ")"
_CONFORMAL = f"""WITH {UNITS_SQL}, {_NOISE},
z AS (SELECT w.sample_id, w.unit_idx, w.label, w.s1 + n.eps AS ns FROM wide w JOIN noise n ON n.unit_idx = w.unit_idx),
c AS (SELECT sample_id, ns, sum(label) OVER (PARTITION BY sample_id ORDER BY ns DESC ROWS UNBOUNDED PRECEDING)::DOUBLE / nullif(sum(label) OVER (PARTITION BY sample_id), 0) AS frac FROM z),
r AS (SELECT sample_id, coalesce(max(CASE WHEN frac >= {BETA}::DOUBLE THEN ns END), 'inf'::DOUBLE) AS q FROM c GROUP BY sample_id),
o AS (SELECT q, row_number() OVER (ORDER BY q) AS rn, count(*) OVER () AS n FROM r),
t AS (SELECT q AS threshold FROM o WHERE rn = greatest(1, least(floor((n + 1) * {ALPHA}::DOUBLE)::BIGINT, n))),
k AS (SELECT z.*, ns >= threshold AS kept FROM z, t)"""


def _noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conformal.with_noise(wide_units(spark, sf_dir).select("sample_id", "unit_idx", "label", F.col("s1").alias("score")))


def _cut(noisy: DataFrame) -> float:
    return conformal.threshold(conformal.row_scores(noisy, BETA), ALPHA)


@query("conformal_row_scores", f"{_CONFORMAL} SELECT sample_id, q FROM r")
def _(spark, d):
    return conformal.row_scores(_noisy(spark, d), BETA)


@query("conformal_threshold", f"{_CONFORMAL} SELECT threshold FROM t")
def _(spark, d):
    return spark.range(1).select(F.lit(float(_cut(_noisy(spark, d)))).alias("threshold"))


@query("conformal_retained", f"{_CONFORMAL} SELECT sample_id, unit_idx, kept FROM k")
def _(spark, d):
    noisy = _noisy(spark, d)
    return conformal.retained(noisy, _cut(noisy)).select("sample_id", "unit_idx", "kept")


@query("conformal_accepted", f"{_CONFORMAL} SELECT sample_id, string_agg('u' || unit_idx, ' ' ORDER BY unit_idx) AS units FROM k WHERE kept GROUP BY sample_id")
def _(spark, d):
    noisy = _noisy(spark, d).withColumn("text", F.concat(F.lit("u"), F.col("unit_idx").cast("string")))
    return conformal.accepted_units(noisy, _cut(noisy)).select("sample_id", F.array_join("units", " ").alias("units"))


@query(
    "conformal_coverage",
    f"""{_CONFORMAL}, p AS (SELECT sample_id, sum(label) AS pos, sum(CASE WHEN kept THEN label ELSE 0 END) AS hit, avg(kept::INT) AS share FROM k GROUP BY sample_id)
    SELECT round(avg((pos = 0 OR hit >= pos * {BETA}::DOUBLE)::INT), 6) AS coverage, round(avg(share), 6) AS kept_share, count(*) AS n FROM p""",
)
def _(spark, d):
    noisy = _noisy(spark, d)
    return _r(conformal.coverage(noisy, _cut(noisy), BETA))


# -- splits and selection by labels


def _portable(spark: SparkSession):
    return [(F.col("sample_id") * 7919 + 3) % 1000, F.col("sample_id")]


@query(
    "split_uniform",
    f"""WITH {UNITS_SQL}, s AS (SELECT DISTINCT sample_id, intent FROM wide), r AS (SELECT *, row_number() OVER (ORDER BY (sample_id * 7919 + 3) % 1000, sample_id) AS rn FROM s)
    SELECT sample_id, intent, CASE WHEN rn <= 50 THEN 'pool' WHEN rn <= 150 THEN 'cal' ELSE 'test' END AS split FROM r""",
)
def _(spark, d):
    s = samples(spark, d).select("sample_id", "intent")
    return splits.split_uniform(s, order=_portable(spark)).select("sample_id", "intent", "split")


@query(
    "split_stratified",
    f"""WITH {UNITS_SQL}, s AS (SELECT DISTINCT sample_id, intent FROM wide),
    a AS (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY (sample_id * 7919 + 3) % 1000, sample_id) AS i FROM s),
    b AS (SELECT *, row_number() OVER (PARTITION BY i <= 20 ORDER BY (sample_id * 7919 + 3) % 1000, sample_id) AS rn FROM a)
    SELECT sample_id, intent, CASE WHEN i <= 20 THEN 'pool' WHEN rn <= 100 THEN 'cal' ELSE 'test' END AS split FROM b""",
)
def _(spark, d):
    s = samples(spark, d).select("sample_id", "intent")
    return splits.split_stratified(s, order=_portable(spark)).select("sample_id", "intent", "split")


def _label_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select(F.col("sample_id").alias("id"), "intent", "labels")


_POSITIVES = f"WITH {UNITS_SQL}, s AS (SELECT sample_id AS id, any_value(intent) AS intent, sum(label)::INT AS value FROM wide GROUP BY sample_id)"


@query("most_positive_topk", f"{_POSITIVES} SELECT id, value, row_number() OVER (ORDER BY value DESC, id) AS rank FROM s ORDER BY value DESC, id LIMIT 10")
def _(spark, d):
    return selection.select_most_positive(_label_pool(spark, d), 10, ties=[F.col("id")]).select("id", "value", "rank")


@query("most_positive_topk_by_intent", f"{_POSITIVES}, r AS (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY value DESC, id) AS rank FROM s) SELECT id, intent, value, rank FROM r WHERE rank <= 3")
def _(spark, d):
    return selection.select_most_positive(_label_pool(spark, d), 3, "intent", ties=[F.col("id")]).select("id", "intent", "value", "rank")


@query("random_selection")
def _(spark, d):
    return selection.select(_label_pool(spark, d), "random_stratified", 5).select("id", "intent", "rank")


# -- paired statistics


@query(
    "paired_join_diff",
    f"""WITH {AP_SQL}, p AS (SELECT a.ap AS a, b.ap AS b FROM aps a JOIN aps b ON b.sample_id = a.sample_id WHERE a.strategy = 's1' AND b.strategy = 's3' AND a.ap IS NOT NULL AND b.ap IS NOT NULL)
    SELECT count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(a - b), 6) AS diff, round(stddev_samp(a - b), 6) AS std_diff, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 6) AS t,
    round((avg(a) - avg(b)) / sqrt(((count(*) - 1) * var_samp(a) + (count(*) - 1) * var_samp(b)) / (2 * count(*) - 2)), 6) AS d FROM p""",
)
def _(spark, d):
    aps = _aps(spark, d)
    pick = lambda s: aps.where(F.col("strategy") == s).select("sample_id", "ap")
    return _r(statistics.paired_summary(statistics.paired(pick("s1"), pick("s3"))))


@query("poisson_bootstrap")
def _(spark, d):
    return statistics.poisson_bootstrap(_aps(spark, d), 100)


@query(
    "permutation_sensitivity",
    """WITH e AS (SELECT event_type, event_id AS p, value AS ap FROM events), m AS (SELECT event_type, avg(ap) AS mean, coalesce(stddev_samp(ap), 0) AS std, max(ap) - min(ap) AS range FROM e GROUP BY event_type),
    o AS (SELECT event_type, first(p ORDER BY ap DESC, p) AS best, first(p ORDER BY ap, p) AS worst FROM e GROUP BY event_type)
    SELECT m.event_type, round(mean, 6) AS mean, round(std, 6) AS std, round(range, 6) AS range, best, worst, round(CASE WHEN mean <> 0 THEN std / mean ELSE 0 END, 6) AS cv,
    CASE WHEN mean <> 0 AND std / mean > 0.1 THEN 'high' WHEN mean <> 0 AND std / mean > 0.05 THEN 'moderate' ELSE 'low' END AS level FROM m JOIN o ON o.event_type = m.event_type""",
)
def _(spark, d):
    e = load(spark, d, "events").select("event_type", F.col("event_id").alias("permutation_id"), F.col("value").alias("ap"))
    return _r(statistics.sensitivity(e, ["event_type"]))


# -- run store

_DIMS = "ds AS (SELECT n_nationkey AS dataset_id, n_name AS dataset_name FROM nation), md AS (SELECT r_regionkey AS llm_model_id, r_name AS model_name FROM region)"
_K = "coalesce(json_extract_string(icl_strategy_params, '$.k'), '0')"
_NORM = "regexp_replace(icl_strategy_name, '_stratified$', '')"


def _dims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ds = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("dataset_id"), F.col("n_name").alias("dataset_name"))
    return ds, load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("llm_model_id"), F.col("r_name").alias("model_name"))


@query("latest_run", f"WITH {RUNS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY {_NORM} ORDER BY created_at DESC, run_id DESC) AS rn FROM runs) SELECT {_NORM} AS strategy, run_id, round(mean_ap, 6) AS mean_ap FROM r WHERE rn = 1")
def _(spark, d):
    r = event_runs(spark, d).withColumn("strategy", runs.normalized(F.col("icl_strategy_name")))
    return _r(runs.latest(r, ("strategy",)).select("strategy", "run_id", "mean_ap"))


@query(
    "performance_matrix",
    f"""WITH {RUNS_SQL}, r AS (SELECT *, {_K} AS k, {_NORM} AS s FROM runs WHERE status = 'completed'),
    w AS (SELECT *, row_number() OVER w AS rn, lead(mean_ap) OVER w AS previous FROM r WINDOW w AS (PARTITION BY dataset_id, llm_model_id, s, k ORDER BY created_at DESC, run_id DESC))
    SELECT dataset_id, llm_model_id, CASE WHEN s LIKE 'icl0%' THEN s ELSE 'icl' || k || '_' || s END AS label, round(mean_ap, 6) AS mean_ap, round(mean_ap - previous, 4) AS delta, run_id FROM w WHERE rn = 1""",
)
def _(spark, d):
    return _r(runs.performance_matrix(event_runs(spark, d)))


@query(
    "cross_model_pivot",
    f"""WITH {RUNS_SQL}, r AS (SELECT *, 'icl' || {_K} || '_' || {_NORM} AS label FROM runs WHERE status = 'completed'),
    w AS (SELECT *, row_number() OVER (PARTITION BY label, llm_model_id ORDER BY created_at DESC, run_id DESC) AS rn FROM r)
    SELECT label, round(max(mean_ap) FILTER (WHERE llm_model_id = 0), 6) AS model_0, round(max(mean_ap) FILTER (WHERE llm_model_id = 1), 6) AS model_1, round(max(mean_ap) FILTER (WHERE llm_model_id = 2), 6) AS model_2
    FROM w WHERE rn = 1 GROUP BY label HAVING count(*) FILTER (WHERE llm_model_id IN (1, 2)) > 0""",
)
def _(spark, d):
    return _r(runs.cross_model(event_runs(spark, d), 0, [0, 1, 2]))


@query("strategy_comparison", f"WITH {RUNS_SQL} SELECT icl_strategy_name, count(*) AS n_runs, sum(n_samples_scored)::BIGINT AS n_samples, round(avg(mean_ap), 6) AS avg_map, round(min(mean_ap), 6) AS min_map, round(max(mean_ap), 6) AS max_map FROM runs WHERE status = 'completed' GROUP BY 1")
def _(spark, d):
    return _r(runs.strategy_comparison(event_runs(spark, d)))


@query(
    "runs_comparison",
    f"""WITH {RUNS_SQL}, {_DIMS} SELECT run_id, dataset_name, model_name, icl_strategy_name, {_K} AS n_icl, round(mean_ap, 6) AS mean_ap, created_at FROM runs JOIN ds USING (dataset_id) JOIN md USING (llm_model_id)
    WHERE status = 'completed' ORDER BY created_at DESC, run_id DESC LIMIT 100""",
)
def _(spark, d):
    return _r(runs.comparison(event_runs(spark, d), *_dims(spark, d)))


@query(
    "run_summary_view",
    f"""WITH {RUNS_SQL}, {_DIMS} SELECT ds.dataset_id, dataset_name, count(run_id) AS n_runs, count(*) FILTER (WHERE status = 'completed') AS n_completed, count(*) FILTER (WHERE status = 'failed') AS n_failed,
    round(avg(mean_ap) FILTER (WHERE status = 'completed'), 6) AS avg_map, round(stddev_samp(mean_ap) FILTER (WHERE status = 'completed'), 6) AS std_map, round(min(mean_ap) FILTER (WHERE status = 'completed'), 6) AS min_map,
    round(max(mean_ap) FILTER (WHERE status = 'completed'), 6) AS max_map, coalesce(sum(n_samples_scored), 0)::BIGINT AS n_samples FROM ds LEFT JOIN runs ON runs.dataset_id = ds.dataset_id GROUP BY 1, 2""",
)
def _(spark, d):
    return _r(runs.summary_view(event_runs(spark, d), _dims(spark, d)[0]))


@query("kpi_counts", f"WITH {RUNS_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'running') AS running, round(avg(mean_ap) FILTER (WHERE status = 'completed'), 6) AS avg_map FROM runs")
def _(spark, d):
    return _r(runs.kpis(event_runs(spark, d)))


@query("date_range_filter", f"WITH {RUNS_SQL} SELECT run_id, created_at FROM runs WHERE created_at >= (SELECT min(created_at)::DATE FROM runs) AND created_at < (SELECT min(created_at)::DATE FROM runs) + INTERVAL 2 DAY")
def _(spark, d):
    r = event_runs(spark, d)
    first = r.agg(F.min("created_at")).first()[0].date()
    from datetime import timedelta

    return runs.between(r, first, first + timedelta(days=1)).select("run_id", "created_at")


@query(
    "strategy_icl_table",
    f"""WITH {RUNS_SQL}, r AS (SELECT *, coalesce(try_cast({_K} AS INT), 0) AS n_icl, {_NORM} AS strategy FROM runs WHERE status = 'completed'),
    w AS (SELECT *, row_number() OVER (PARTITION BY strategy, n_icl ORDER BY created_at DESC, run_id DESC) AS rn FROM r),
    l AS (SELECT strategy, n_icl, mean_ap, dense_rank() OVER (ORDER BY mean_ap DESC) AS k FROM w WHERE rn = 1)
    SELECT strategy, n_icl, round(mean_ap, 6) AS mean_ap, CASE WHEN k <= 3 THEN k END AS rank FROM l""",
)
def _(spark, d):
    return _r(runs.icl_table(event_runs(spark, d)))


@query(
    "stat_comparison_vs_baseline",
    f"""WITH {RUNS_SQL}, r AS (SELECT *, {_NORM} AS strategy FROM runs WHERE status = 'completed'), w AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY created_at DESC, run_id DESC) AS rn, count(*) OVER (PARTITION BY strategy) AS n_runs FROM r),
    l AS (SELECT * FROM w WHERE rn = 1) SELECT l.strategy, round(l.mean_ap, 6) AS mean_ap, l.n_runs, round(l.mean_ap - b.mean_ap, 6) AS diff, abs(l.mean_ap - b.mean_ap) > 0.02 AS marked FROM l, (SELECT mean_ap FROM l WHERE strategy = 'view') b""",
)
def _(spark, d):
    return _r(runs.against_baseline(event_runs(spark, d), "view"))


@query("json_param_extract", f"WITH {RUNS_SQL} SELECT {_K} AS n_icl, count(*) AS n FROM runs GROUP BY 1")
def _(spark, d):
    return event_runs(spark, d).groupBy(runs.json_param(F.col("icl_strategy_params"), "k").alias("n_icl")).agg(F.count(F.lit(1)).alias("n"))


@query("distinct_normalized_strategies", f"WITH {RUNS_SQL} SELECT DISTINCT {_NORM} AS strategy FROM runs")
def _(spark, d):
    return runs.distinct_strategies(event_runs(spark, d))


@query("run_options", f"WITH {RUNS_SQL}, {_DIMS} SELECT run_id, '#' || run_id || ' - ' || dataset_name || ' - ' || icl_strategy_name || ' - icl' || {_K} AS label FROM runs JOIN ds USING (dataset_id)")
def _(spark, d):
    return runs.run_options(event_runs(spark, d), _dims(spark, d)[0])


@query("runs_in_order", f"WITH {RUNS_SQL} SELECT run_id, round(mean_ap, 6) AS mean_ap, CASE run_id WHEN 5 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS pos FROM runs WHERE run_id IN (5, 3, 8)")
def _(spark, d):
    return _r(runs.in_order(event_runs(spark, d), [5, 3, 8]).select("run_id", "mean_ap", F.col("pos").cast("int").alias("pos")))


@query("ap_histogram", f"WITH {AP_SQL} SELECT least(floor(ap * 30), 29)::INT AS bin, count(*) AS n FROM aps WHERE ap IS NOT NULL GROUP BY 1")
def _(spark, d):
    return runs.histogram(_aps(spark, d))


@query("cross_run_aps", f"WITH {AP_SQL} SELECT sample_id AS sample_index, round(max(ap) FILTER (WHERE strategy = 's1'), 6) AS run_1, round(max(ap) FILTER (WHERE strategy = 's2'), 6) AS run_2 FROM aps WHERE strategy <> 's3' GROUP BY 1")
def _(spark, d):
    a = _aps(spark, d).select(F.col("sample_id").alias("sample_index"), F.when(F.col("strategy") == "s1", 1).when(F.col("strategy") == "s2", 2).otherwise(3).alias("run_id"), "ap")
    return _r(runs.cross_run_aps(a, [1, 2]).withColumnRenamed("1", "run_1").withColumnRenamed("2", "run_2"))


# -- errors

_SAID = (
    "HTTP 429: timeout", "Connection refused", "JSON decode failed", "request timed out", "odd thing", "HTTP 503", "401 Unauthorized", "blocked by the safety filter",
    "prompt is too long", "missing score for unit 3", "score out of range", "empty response", "Internal error", "model overloaded", "network unreachable", "Quota exceeded for today",
)
_MESSAGES = f"m AS (SELECT event_id AS sample_id, ts, user_id, event_type AS intent, (event_id * 37 % 6000)::INT AS input_length, {list(_SAID)!r}[event_id % {len(_SAID)} + 1] AS message FROM events)"


def _rule_sql(pick: int) -> str:
    cases = " ".join(f"WHEN regexp_matches(lower(message), '{r[0]}') THEN '{r[pick]}'" for r in errors.RULES)
    return f"CASE {cases} ELSE '{errors.NO_MATCH[pick]}' END"


_CATEGORIES = f"{_MESSAGES}, c AS (SELECT *, {_rule_sql(1)} AS category, {_rule_sql(2)} AS error_type, {_rule_sql(3)} AS severity FROM m)"
_ACTION = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in errors.ACTIONS.items()) + " END"
_LONG = "SELECT {by}'category' AS dimension, category AS value, count(*) AS n FROM {rows} GROUP BY ALL UNION ALL SELECT {by}'error_type', error_type, count(*) FROM {rows} GROUP BY ALL UNION ALL SELECT {by}'severity', severity, count(*) FROM {rows} GROUP BY ALL"
_BUCKET = "CASE WHEN input_length IS NULL THEN 'unknown' " + " ".join(f"WHEN input_length <= {b} THEN '<={b}'" for b in errors.BUCKETS) + f" ELSE '>{errors.BUCKETS[-1]}' END"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    said = F.get(F.array(*map(F.lit, _SAID)), (F.col("event_id") % len(_SAID)).cast("int"))
    return errors.categorize(e.select(F.col("event_id").alias("sample_id"), "ts", "user_id", F.col("event_type").alias("intent"), (F.col("event_id") * 37 % 6000).cast("int").alias("input_length"), said.alias("message")))


@query("error_categorize", f"WITH {_CATEGORIES} SELECT sample_id, message, category, error_type, severity, {_ACTION} AS action FROM c")
def _(spark, d):
    return _messages(spark, d).select("sample_id", "message", "category", "error_type", "severity", "action")


@query("error_counts", f"WITH {_CATEGORIES} {_LONG.format(by='', rows='c')}")
def _(spark, d):
    return errors.counts(_messages(spark, d))


def _analysis_sql(rows: str, by: str, total: str) -> str:
    keys = f"{by}, " if by else ""
    join = f"s.{by} IS NOT DISTINCT FROM l.{by}" if by else "true"
    return f"""l AS ({_LONG.format(by=keys, rows=rows)}), s AS (SELECT {keys}count(*) AS total_errors FROM {rows} GROUP BY ALL)
    SELECT {'l.' + by + ', ' if by else ''}dimension, value, n, total_errors, round(n::DOUBLE / total_errors, 6) AS share, round(total_errors::DOUBLE / {total}, 6) AS error_rate, round(1 - total_errors::DOUBLE / {total}, 6) AS success_rate FROM l JOIN s ON {join}"""


@query("error_analysis", f"WITH {_CATEGORIES}, e AS (SELECT * FROM c WHERE intent = 'error'), {_analysis_sql('e', '', '(SELECT count(*) FROM events)')}")
def _(spark, d):
    m = _messages(spark, d)
    return _r(errors.analyze(m.where("intent = 'error'"), total=m.count()))


@query("error_analysis_by_intent", f"WITH {_CATEGORIES}, {_analysis_sql('c', 'intent', 'total_errors')}")
def _(spark, d):
    return _r(errors.analyze_by_intent(_messages(spark, d)))


@query("error_by_bucket", f"WITH {_CATEGORIES}, b AS (SELECT *, {_BUCKET} AS bucket FROM c), {_analysis_sql('b', 'bucket', 'total_errors')}")
def _(spark, d):
    return _r(errors.analyze_by_length(_messages(spark, d)))


@query("error_patterns_having", f"WITH {_CATEGORIES} SELECT error_type, count(*) AS n, min(sample_id) AS first_id, first(substr(message, 1, 200) ORDER BY sample_id) AS example, first(category ORDER BY sample_id) AS category, first({_ACTION} ORDER BY sample_id) AS action FROM c GROUP BY error_type HAVING count(*) >= 2")
def _(spark, d):
    return errors.patterns(_messages(spark, d))


@query("error_pattern_members", f"WITH {_CATEGORIES} SELECT error_type, sample_id, {_ACTION} AS action FROM c WHERE error_type IN (SELECT error_type FROM c GROUP BY error_type HAVING count(*) >= 2)")
def _(spark, d):
    return errors.pattern_members(_messages(spark, d))


@query("error_timeline_hourly", "SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def _(spark, d):
    return errors.timeline(load(spark, d, "events").where("event_type = 'error'"))


@query("error_by_intent", f"WITH {_CATEGORIES} SELECT coalesce(intent, 'No Intent') AS intent, category, count(*) AS n FROM c GROUP BY 1, 2")
def _(spark, d):
    return errors.by_intent(_messages(spark, d))


@query("error_category_shares", f"WITH {_CATEGORIES}, n AS (SELECT category, count(*) AS n FROM c GROUP BY category) SELECT category, n, round(n::DOUBLE / (SELECT sum(n) FROM n), 6) AS share FROM n")
def _(spark, d):
    return _r(runs.category_shares(_messages(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"))))


@query("length_buckets", "SELECT CASE WHEN text IS NULL THEN 'unknown' WHEN length(text) <= 100 THEN '<=100' WHEN length(text) <= 500 THEN '<=500' WHEN length(text) <= 1000 THEN '<=1000' WHEN length(text) <= 2000 THEN '<=2000' WHEN length(text) <= 5000 THEN '<=5000' ELSE '>5000' END AS bucket, count(*) AS n FROM documents GROUP BY 1")
def _(spark, d):
    return load(spark, d, "documents").groupBy(errors.length_bucket(F.length("text")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("streaming_timeline_batch", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    return _r(hourly(load(spark, d, "events")), 4)


# -- vectors

_VEC = "e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT id, label, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM e)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("intent"), "embedding")


@query(
    "rep_centroid_topk",
    f"""WITH {_VEC}, x AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u), c AS (SELECT i, avg(x) AS c FROM x GROUP BY i), g AS (SELECT id, round(sqrt(sum((x - c) * (x - c))), 6) AS value FROM x JOIN c USING (i) GROUP BY id)
    SELECT id, value, row_number() OVER (ORDER BY value, id) AS rank FROM g ORDER BY value, id LIMIT 10""",
)
def _(spark, d):
    return _r(selection.select_representative(_vectors(spark, d), 10, digits=6)).select("id", "value", "rank")


@query("knn_topk", f"WITH {_VEC}, s AS (SELECT q.id AS query_id, p.id, round(list_dot_product(q.v, p.v), 9) AS s FROM u q, u p WHERE q.id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM s) SELECT query_id, id, round(s, 6) AS similarity, rank FROM r WHERE rank <= 3")
def _(spark, d):
    v = _vectors(spark, d)
    return _r(retrieval.knn(v.where("id % 100 = 0"), v, 3))


@query("knn_topk_by_label", f"WITH {_VEC}, s AS (SELECT q.id AS query_id, p.id, round(list_dot_product(q.v, p.v), 9) AS s FROM u q JOIN u p ON p.label = q.label WHERE q.id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM s) SELECT query_id, id, round(s, 6) AS similarity, rank FROM r WHERE rank <= 3")
def _(spark, d):
    v = _vectors(spark, d)
    return _r(retrieval.knn(v.where("id % 100 = 0"), v, 3, "intent"))


def _unit_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    g = e.groupBy(F.floor(F.col("vec_id") / 10).cast("long").alias("id")).agg(F.array_sort(F.collect_list(F.struct("vec_id", (F.col("label") % 2).alias("y"), "embedding"))).alias("u"))
    return g.select("id", F.lit("").alias("intent"), F.col("u.y").alias("labels"), F.col("u.embedding").alias("units"))


@query(
    "unit_measures",
    f"""WITH {_VEC}, g AS (SELECT id // 10 AS id, id AS uid, label % 2 AS y, v FROM u),
    p AS (SELECT a.id, a.y AS ya, b.y AS yb, a.uid = b.uid AS own, list_dot_product(a.v, b.v) AS s FROM g a JOIN g b ON a.id = b.id),
    m AS (SELECT id, avg(s) FILTER (WHERE ya = 1 AND yb = 0) AS b, avg(s) FILTER (WHERE ya = 1 AND yb = 1 AND NOT own) AS cp, avg(s) FILTER (WHERE ya = 0 AND yb = 0 AND NOT own) AS cn,
      avg(s) FILTER (WHERE ya = 1 AND yb = 1) AS pp, avg(s) FILTER (WHERE ya = 0 AND yb = 0) AS nn FROM p GROUP BY id)
    SELECT id, round(coalesce(b, 0), 6) AS boundary, round(coalesce((cp + cn) / 2, 0), 6) AS clarity, round(coalesce((pp + nn - 2 * b) / ((1 - pp) + (1 - nn) + 1e-8), 0), 4) AS fisher FROM m""",
)
def _(spark, d):
    out = selection.unit_measures(_unit_pool(spark, d))
    return out.select("id", F.round("boundary", 6).alias("boundary"), F.round("clarity", 6).alias("clarity"), F.round("fisher", 4).alias("fisher"))


@query(
    "direction_norm",
    """WITH g AS (SELECT vec_id // 10 AS id, label % 2 AS y, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    c AS (SELECT id, i, avg(x) FILTER (WHERE y = 1) - avg(x) FILTER (WHERE y = 0) AS x FROM g GROUP BY id, i) SELECT id, round(sqrt(sum(coalesce(x, 0) * coalesce(x, 0))), 6) AS norm FROM c GROUP BY id""",
)
def _(spark, d):
    return _r(selection.unit_measures(_unit_pool(spark, d)).select("id", selection.norm(F.col("direction")).alias("norm")))


@query("dpp_by_label")
def _(spark, d):
    return selection.select(_vectors(spark, d), "dpp_stratified", 4)


@query("anchor_dpp")
def _(spark, d):
    return selection.select(_vectors(spark, d), "anchor_dpp", 5)


# -- text


@query(
    "bm25_topk",
    r"""WITH d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS t FROM documents), n AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
    tf AS (SELECT id, len(t) AS dl, term, count(*) AS tf FROM (SELECT id, t, unnest(t) AS term FROM d) GROUP BY ALL),
    i0 AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, n GROUP BY term, n), i AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM i0) ELSE raw END AS idf FROM i0),
    q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS term FROM benchmark) GROUP BY ALL),
    s AS (SELECT query_id, id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 9) AS score FROM q JOIN tf USING (term) JOIN i USING (term), n GROUP BY query_id, id),
    z AS (SELECT b.item_id AS query_id, d.id, coalesce(s.score, 0) AS score FROM benchmark b CROSS JOIN d LEFT JOIN s ON s.query_id = b.item_id AND s.id = d.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM z) SELECT query_id, id, round(score, 5) AS score, rank FROM r WHERE rank <= 3""",
)
def _(spark, d):
    pool = load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return _r(retrieval.bm25(load(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), pool, 3), 5)


@query("sentence_split_count")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", F.size(text.sentences_udf("text")).alias("n_sentences"))


_LINES = "l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)"


@query(
    "span_overlap_labels",
    f"""WITH {_LINES}, s AS (SELECT doc_id, unnest(range(len(ls))) AS i, ls FROM l),
    o AS (SELECT doc_id, i, coalesce(list_sum(list_transform(ls[1:i], lambda x: length(x) + 1)), 0) AS a, length(ls[i + 1]) AS n FROM s)
    SELECT doc_id, string_agg(CASE WHEN a < 150 AND 50 < a + n THEN '1' ELSE '0' END, '' ORDER BY i) AS labels FROM o GROUP BY doc_id""",
)
def _(spark, d):
    lines = load(spark, d, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("ls"))
    ends = F.aggregate("ls", F.expr("cast(array() as array<struct<start:int,end:int>>)"), lambda a, x: F.concat(a, F.array(F.struct(F.coalesce(F.try_element_at(a, F.lit(-1))["end"] + 1, F.lit(0)).alias("start"), (F.coalesce(F.try_element_at(a, F.lit(-1))["end"] + 1, F.lit(0)) + F.length(x)).alias("end")))))
    marks = F.array(F.struct(F.lit(50).alias("start"), F.lit(150).alias("end")))
    return lines.select("doc_id", ends.alias("spans")).select("doc_id", F.array_join(F.transform(text.overlap_labels(F.col("spans"), marks), lambda x: x.cast("string")), "").alias("labels"))


@query("numbered_units", f"WITH {_LINES}, s AS (SELECT doc_id, unnest(range(len(ls))) AS i, ls FROM l) SELECT doc_id, md5(string_agg(i || '. ' || ls[i + 1], chr(10) ORDER BY i)) AS digest FROM s GROUP BY doc_id")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(prompts.numbered(F.split(F.coalesce("text", F.lit("")), "\n"))).alias("digest"))


@query("text_explode_collect", "SELECT lang, count(*) AS n_words, count(DISTINCT w) AS n_distinct FROM (SELECT lang, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM documents) GROUP BY lang".replace("\\\\", "\\"))
def _(spark, d):
    words = load(spark, d, "documents").select("lang", F.explode(retrieval.tokens(F.col("text"))).alias("w"))
    return words.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("c")).groupBy("lang").agg(F.sum("c").alias("n_words"), F.count(F.lit(1)).alias("n_distinct"))


@query("turn_concat", "SELECT conv_id, count(*) AS n_turns, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role)) AS digest FROM conversations GROUP BY conv_id")
def _(spark, d):
    c = load(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return c.select("conv_id", "n_turns", F.md5(F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n")).alias("digest"))


@query("icl_example_format")
def _(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("u"))
    labelled = docs.withColumn("y", F.transform("u", lambda x, i: (i % 3 == 0).cast("int")))
    return labelled.select("doc_id", prompts.example(F.col("u"), F.col("y"), F.lit("find facts"), seed=F.col("doc_id")).alias("example"))


@query(
    "score_parse_normalize",
    """SELECT * FROM (VALUES (1, 2, '0.2,0.9'), (2, 2, '0.7,0.05'), (3, 2, '0.3,0.0'), (4, 4, '0.5,0.5,0.5,0.0'), (5, 4, NULL), (6, 2, '1.0,0.4'), (7, 1, NULL), (8, 0, '')) AS t(id, n, scores)""",
)
def _(spark, d):
    rows = [
        (1, 2, '{"1":0.2,"2":0.9}'),
        (2, 2, '{"0":7,"1":0.5}'),
        (3, 2, '{"0": 0.3, "1": 0.'),
        (4, 4, '<think>hm</think>{"0":0.5,"1":0.5,"2":0.5}'),
        (5, 4, '{"0":0.5,"1":0.5}'),
        (6, 2, 'Here: ```json\n{"0": 1.0, "1": 0.4}\n``` and ```json\n{"0": 0.0}\n```'),
        (7, 1, "no numbers"),
        (8, 0, "{}"),
    ]
    values = ", ".join("({}, {}, '{}')".format(i, n, c.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")) for i, n, c in rows)
    t = spark.sql(f"SELECT * FROM VALUES {values} AS t(id, n, content)")
    v = parsing.densify(parsing.parse_scores(F.col("content"), F.col("n")), F.col("n"))
    return t.select("id", "n", F.array_join(F.transform(v, lambda x: x.cast("string")), ",").alias("scores"))


@query("labels_to_scores", f"WITH {UNITS_SQL} SELECT sample_id, '{{' || string_agg('\"' || unit_idx || '\": ' || label || '.0', ', ' ORDER BY unit_idx) || '}}' AS scores FROM wide GROUP BY sample_id")
def _(spark, d):
    return samples(spark, d).select("sample_id", prompts.format_scores(prompts.score_dict(F.col("labels"))).alias("scores"))


@query("error_rank_by_category", f"WITH {_CATEGORIES}, n AS (SELECT category, count(*) AS n FROM c GROUP BY category) SELECT category, n, dense_rank() OVER (ORDER BY n DESC) AS rank FROM n")
def _(spark, d):
    n = _messages(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"))  # a row per category
    return n.withColumn("rank", F.dense_rank().over(Window.orderBy(F.col("n").desc())))


# -- experiments: examples chosen and formatted, every row scored by the stand-in scorer, evaluated and stored


def _run(spark: SparkSession, sf_dir: str, store: RunStore | None = None, **settings) -> experiment.Result:
    parts = text_splits(spark, sf_dir)
    return experiment.run_experiment(experiment.Settings("contractnli", **settings), experiment.offline_scorer, parts["pool"], parts["cal"], parts["test"], store)


def _scored(result: experiment.Result) -> DataFrame:
    ap = F.round(f"{result.output}_ap", 6).alias("ap")
    part = lambda df, split: df.select("sample_id", "intent", F.lit(split).alias("split"), F.size(result.output).cast("long").alias("n"), ap)
    return part(result.test, "test").unionByName(part(result.cal, "cal"))


def _scored_sql(shift: int) -> str:
    return f"WITH {TEXT_SQL}, {scored_sql(shift)}, n AS (SELECT sample_id, count(*) AS n FROM xu GROUP BY 1) SELECT sample_id, intent, split, n, round(ap, 6) AS ap FROM xa JOIN n USING (sample_id)"


@query("experiment_icl_free", _scored_sql(0))
def _(spark, d):
    return _scored(_run(spark, d, no_icl=True))


@query("experiment_global", _scored_sql(3))
def _(spark, d):
    return _scored(_run(spark, d, strategy="rep"))


@query("experiment_local", _scored_sql(2))
def _(spark, d):
    return _scored(_run(spark, d, strategy="bm25", n_icl=2))


@query("experiment_moe", _scored_sql(2))
def _(spark, d):
    return _scored(_run(spark, d, strategy="moe", moe_strategies=["most_positive", "knn", "random"], n_icl=2))


@query("experiment_summary", f"WITH {TEXT_SQL}, {scored_sql(3)} SELECT split, round(avg(ap), 6) AS map, count(ap) AS n FROM xa GROUP BY split")
def _(spark, d):
    return _r(_run(spark, d, strategy="most_positive").summary)


def _stored(spark: SparkSession, sf_dir: str) -> tuple[RunStore, experiment.Result]:
    """A fresh store with a run without examples and an ensemble's run with its two strategies."""
    store = RunStore(spark, f"{shared_folder(spark)}/gleanworks-{uuid.uuid4().hex}/store")
    store.init()
    _run(spark, sf_dir, store, no_icl=True, tags=["base"])
    return store, _run(spark, sf_dir, store, strategy="moe", moe_strategies=["random", "most_positive"], n_icl=2, run_name="both")


_ROWS = f"""WITH {TEXT_SQL}, {scored_sql(0)}, {scored_sql(2, "y")},
r AS (SELECT 'icl0' AS strategy, * FROM xa UNION ALL SELECT s.strategy, ya.* FROM ya, (SELECT unnest(['moe2', 'random', 'most_positive']) AS strategy) s)"""


@query(
    "run_store_runs",
    f"""{_ROWS} SELECT strategy, 'completed' AS status, 'contractnli' AS dataset, round(avg(ap), 6) AS mean_ap, round(stddev_samp(ap), 6) AS std_ap, round(quantile_cont(ap, 0.5), 6) AS p50, count(*) AS n_samples_scored, 0 AS n_samples_failed,
    0.0::DOUBLE AS error_rate, count(DISTINCT intent) AS n_intents FROM r WHERE split = 'test' GROUP BY strategy""",
)
def _(spark, d):
    store, _result = _stored(spark, d)
    ds = store.table("datasets").select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset"))
    rows = store.table("runs").join(ds, "dataset_id")
    intents = F.size(F.filter(F.map_values("intent_metrics"), lambda m: m["n"] > 0))
    return _r(rows.select(F.col("icl_strategy_name").alias("strategy"), "status", "dataset", "mean_ap", "std_ap", F.col("ap_percentiles.p50").alias("p50"), F.col("n_samples_scored").cast("long").alias("n_samples_scored"), "n_samples_failed", "error_rate", intents.cast("long").alias("n_intents")))


@query("run_store_samples", f"{_ROWS} SELECT strategy, sample_id, split, round(ap, 6) AS ap, 'scored' AS status FROM r WHERE split = 'test' OR strategy IN ('icl0', 'moe2')")
def _(spark, d):
    store, _result = _stored(spark, d)
    named = store.table("runs").select("run_id", F.col("icl_strategy_name").alias("strategy"))
    return _r(store.table("run_samples").join(named, "run_id").select("strategy", F.col("sample_index").cast("long").alias("sample_id"), "split", "ap", "status"))


@query("run_report", f"""{_ROWS} SELECT strategy, count(*) AS n_samples, count(*) AS n_success, 0::BIGINT AS n_failed, round(avg(ap), 6) AS mean_ap, round(quantile_cont(ap, 0.5), 6) AS median_ap, round(min(ap), 6) AS min_ap, round(max(ap), 6) AS max_ap,
    count(DISTINCT intent) AS n_intents FROM r WHERE split = 'test' GROUP BY strategy""")
def _(spark, d):
    store, _result = _stored(spark, d)
    rows = store.table("runs").select("run_id", F.col("icl_strategy_name").alias("strategy"), "started_at", "completed_at")
    out = report.run_report(rows, store.table("run_samples").where("split = 'test'"))
    return _r(out.select("strategy", "n_samples", "n_success", "n_failed", "mean_ap", "median_ap", "min_ap", "max_ap", F.size("intent_metrics").cast("long").alias("n_intents")))


@query("paper_matrix", f"""{_ROWS} SELECT 'contractnli' AS dataset_name, CASE strategy WHEN 'icl0' THEN 'icl0' ELSE 'icl2_' || strategy END AS label, round(avg(ap), 6) AS mean_ap, count(*) AS n_samples FROM r WHERE split = 'test' GROUP BY strategy""")
def _(spark, d):
    store, _result = _stored(spark, d)
    tables = report.paper_data(store.table("runs"), store.table("run_samples").where("split = 'test'"), store.table("datasets"), rounds=10)
    return _r(tables["strategy_matrix"].select("dataset_name", "label", "mean_ap", F.col("n_samples").cast("long").alias("n_samples")))


@query("examples_most_positive", f"WITH {TEXT_SQL}, n AS (SELECT sample_id, any_value(intent) AS intent, sum(label) AS p FROM tu WHERE split = 'pool' GROUP BY 1) SELECT intent, max(p)::BIGINT AS most, count(*) AS n_pool, least(count(*), 3) AS n_chosen FROM n GROUP BY intent")
def _(spark, d):
    pool = text_splits(spark, d)["pool"]
    chosen = written(examples.choose(pool, "most_positive", 3, True))
    positives = F.aggregate("input_unit_labels", F.lit(0), lambda a, x: a + x)
    best = chosen.groupBy("intent").agg(F.max(F.when(F.col("rank") == 1, positives)).cast("long").alias("most"), F.count(F.lit(1)).alias("n_chosen"))
    return best.join(pool.groupBy("intent").agg(F.count(F.lit(1)).alias("n_pool")), "intent").select("intent", "most", "n_pool", "n_chosen")


@query("examples_blocks", f"WITH {TEXT_SQL}, n AS (SELECT intent, count(DISTINCT sample_id) AS c FROM tu WHERE split = 'pool' GROUP BY 1) SELECT intent, least(c, 3) AS n_examples FROM n")
def _(spark, d):
    chosen = written(examples.choose(text_splits(spark, d)["pool"], "rep", 3, True))
    return examples.global_blocks(chosen, True).select("intent", F.regexp_count("examples", F.lit("(?m)^Example [0-9]+$")).cast("long").alias("n_examples"))


@query("examples_windowed")
def _(spark, d):
    pool = text_splits(spark, d)["pool"]
    return examples.window_pool(pool, 2).select("sample_id", F.size("input_units").alias("n_units"), F.aggregate("input_unit_labels", F.lit(0), lambda a, x: a + x).alias("n_positive"))


@query("examples_local_bm25", r"""WITH """ + TEXT_SQL + r""", p AS (SELECT sample_id, intent, text FROM sp WHERE split = 'pool'), q AS (SELECT sample_id, intent FROM sp WHERE split = 'test') SELECT q.sample_id AS query_id, least(count(*), 2) AS n FROM q JOIN p ON p.intent = q.intent GROUP BY 1""")
def _(spark, d):
    parts = text_splits(spark, d)
    found = examples.local_choice(parts["pool"], parts["test"], "bm25", 2, True)
    return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


@query("split_dataset_by_name", f"WITH {TEXT_SQL} SELECT split, intent, count(*) AS n, sum(sample_id)::BIGINT AS ids FROM sp GROUP BY split, intent")
def _(spark, d):
    order = [(F.col("sample_id") * 7919 + 3) % 1000, F.col("sample_id")]
    parts = splits.split_and_save(text_samples(spark, d).select("sample_id", "intent"), "ContractNLI", f"{shared_folder(spark)}/gleanworks-{uuid.uuid4().hex}", order=order)
    every = [df.withColumn("split", F.lit(part)) for part, df in parts.items()]
    return every[0].unionByName(every[1]).unionByName(every[2]).groupBy("split", "intent").agg(F.count(F.lit(1)).alias("n"), F.sum("sample_id").alias("ids"))


@query("split_uniform_capped", f"""WITH {UNITS_SQL}, s AS (SELECT DISTINCT sample_id FROM wide), r AS (SELECT *, row_number() OVER (ORDER BY (sample_id * 7919 + 3) % 1000, sample_id) AS rn FROM s)
    SELECT sample_id, CASE WHEN rn <= 50 THEN 'pool' WHEN rn <= 150 THEN 'cal' ELSE 'test' END AS split FROM r WHERE rn <= 10150""")
def _(spark, d):
    return splits.split_dataset(samples(spark, d).select("sample_id"), "hotpotqa", order=_portable(spark)).select("sample_id", "split")


# -- loaders, on raw files written from the benchmark table in each corpus's format


def _raw(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Callable[[DataFrame, str], str]]:
    """Items as ``(item_id, ws)``, their first words, and a function that writes text rows to a new folder."""
    path = f"{shared_folder(spark)}/gleanworks-{uuid.uuid4().hex}"
    items = load(spark, sf_dir, "benchmark").where("text IS NOT NULL").select("item_id", F.split("text", r"\s+").alias("ws"))

    def put(rows: DataFrame, name: str) -> str:
        rows.write.text(f"{path}/{name}")
        return f"{path}/{name}"

    return items.where(F.size("ws") > 5), put


def _array(entry: Column) -> Column:
    """All entries as one JSON array, as these corpora come."""
    return F.concat(F.lit("["), F.array_join(F.collect_list(entry), ","), F.lit("]"))


def _flags(labels: str) -> Column:
    return F.array_join(F.transform(labels, lambda y: y.cast("string")), "")


_WORDS = r"w AS (SELECT item_id, ws FROM (SELECT item_id, regexp_split_to_array(text, '\s+') AS ws FROM benchmark WHERE text IS NOT NULL) WHERE len(ws) > 5)"


@query("load_ectsum", f"WITH {_WORDS} SELECT 'test' AS split, array_to_string(ws, chr(10)) AS input, len(ws) AS n_units, array_to_string(list_transform(ws, lambda x: (length(x) % 2 = 0)::INT), '') AS labels, ws[1] || '|' || ws[2] AS output FROM w")
def _(spark, d):
    items, put = _raw(spark, d)
    labels = F.array_join(F.transform("ws", lambda x: (F.length(x) % 2 == 0).cast("int").cast("string")), "\n")
    entry = F.struct(F.array_join("ws", "\n").alias("doc"), F.concat(F.col("ws")[0], F.lit("\n"), F.col("ws")[1]).alias("summaries"), labels.alias("labels"))
    out = corpora.ectsum(spark, {"test": put(items.select(F.to_json(entry)), "ectsum")})
    return out.select("split", "input", F.size("input_units").cast("long").alias("n_units"), _flags("input_unit_labels").alias("labels"), F.array_join("output_units", "|").alias("output"))


@query("load_hotpotqa", f"WITH {_WORDS} SELECT 'q' || item_id AS intent, ws[1] || ' ' || ws[2] || ' ' || ws[3] AS input, '011' AS labels, ws[2] || ' ' || ws[3] AS output_text FROM w")
def _(spark, d):
    items, put = _raw(spark, d)
    line = '{"question": "q%s", "answer": "a", "supporting_facts": [["T", 1], ["U", 0]], "context": [["T", %s], ["U", %s]]}'
    entry = F.format_string(line, F.col("item_id").cast("string"), F.to_json(F.slice("ws", 1, 2)), F.to_json(F.slice("ws", 3, 1)))
    out = corpora.hotpotqa(spark, [put(items.agg(_array(entry)), "hotpotqa")])
    return out.select("intent", "input", _flags("input_unit_labels").alias("labels"), "output_text")


@query("load_contractnli", f"WITH {_WORDS} SELECT item_id AS doc_id, 'claim' AS intent, 'h1' AS hyp_id, 'Entailment' AS nli_label, ws[1] || '|' || ws[2] AS units, '01' AS labels, ws[2] AS output_text FROM w")
def _(spark, d):
    items, put = _raw(spark, d)
    one, two = F.col("ws")[0], F.col("ws")[1]
    spans = F.array(F.array(F.lit(0), F.length(one)), F.array(F.length(one) + 1, F.length(one) + 1 + F.length(two)))
    said = F.expr("map('h1', named_struct('choice', 'Entailment', 'spans', array(1)), 'h2', named_struct('choice', 'NotMentioned', 'spans', cast(array() as array<int>)))")
    doc = F.struct(F.col("item_id").alias("id"), F.array_join(F.slice("ws", 1, 2), " ").alias("text"), spans.alias("spans"), F.lit("f").alias("file_name"), F.array(F.struct(said.alias("annotations"))).alias("annotation_sets"))
    file = F.concat(F.lit('{"labels": {"h1": {"hypothesis": "claim"}, "h2": {"hypothesis": "other"}}, "documents": '), _array(F.to_json(doc)), F.lit("}"))
    out = corpora.contractnli(spark, put(items.agg(file), "contractnli"), "dev")
    return out.select("doc_id", "intent", "hyp_id", "nli_label", F.array_join("input_units", "|").alias("units"), _flags("input_unit_labels").alias("labels"), "output_text")


@query("load_subsume", f"""WITH {_WORDS}, s AS (SELECT (item_id % 5)::VARCHAR AS state, item_id, ws[1] AS sentence FROM w), g AS (SELECT state, string_agg(sentence, ' ' ORDER BY item_id) AS input, string_agg((item_id % 2 = 0)::INT::VARCHAR, '' ORDER BY item_id) AS labels FROM s GROUP BY state)
    SELECT 'state ' || state AS intent, input, labels, 'chosen' AS output_text FROM g""")
def _(spark, d):
    items, put = _raw(spark, d)
    state = F.concat(F.lit("s"), (F.col("item_id") % 5).cast("string"))
    sentences = items.select(state.alias("name"), F.col("item_id").alias("sid"), F.col("ws")[0].alias("sentence"))
    head = spark.range(1).select(F.lit("name,sid,sentence").alias("value"))
    rows = sentences.select(F.concat_ws(",", "name", F.col("sid").cast("string"), F.concat(F.lit('"'), F.replace("sentence", F.lit('"'), F.lit('\\"')), F.lit('"'))).alias("value"))
    states = corpora.subsume_states(spark, put(head.unionByName(rows).coalesce(1), "states"))
    ids = F.array_sort(F.collect_list(F.when(F.col("sid") % 2 == 0, F.col("sid"))))
    packed = sentences.groupBy("name").agg(ids.alias("ids"))
    summary = F.struct(F.col("name").alias("state_name"), F.lit(1).alias("state_id"), F.col("ids").alias("sentence_ids"), F.array(F.lit("chosen")).alias("sentences"), F.expr("cast(array() as array<string>)").alias("used_keywords"))
    entry = F.struct(F.concat(F.lit("state "), F.substring("name", 2, 9)).alias("intent"), F.lit("h").alias("HITId"), F.array(summary).alias("summaries"))
    # A file holds the summaries of one intent.
    users = [corpora.subsume_summaries(spark, put(packed.where(F.col("name") == f"s{k}").select(F.to_json(entry)).coalesce(1), f"user{k}")) for k in range(5)]
    users = reduce(DataFrame.unionByName, users)
    return corpora.subsume(users, states).select("intent", "input", _flags("input_unit_labels").alias("labels"), "output_text")


@query("load_puma", f"WITH {_WORDS} SELECT 'CAUSE' AS intent, ws[1] || ' one.|' || ws[2] || ' two.' AS units, '01' AS labels, ws[2] || ' two.' AS output_text FROM w")
def _(spark, d):
    items, put = _raw(spark, d)
    one, two = F.concat(F.col("ws")[0], F.lit(" one.")), F.concat(F.col("ws")[1], F.lit(" two."))
    raw = F.concat(F.lit("uri: x\nanswer_0: "), one, F.lit("\nanswer_1: "), two, F.lit("\n"))
    start = F.instr(raw, "\nanswer_1: ") + 10
    mark = F.struct(F.array(start, start + 3).alias("label_spans"))
    entry = F.struct(F.lit("q").alias("question"), F.lit("").alias("context"), raw.alias("raw_text"), F.create_map(F.lit("CAUSE"), F.array(mark)).alias("labelled_answer_spans"), F.expr("map('CAUSE', 's')").alias("labelled_summaries"))
    out = corpora.puma(spark, put(items.agg(_array(F.to_json(entry))), "puma"))
    return out.select("intent", F.array_join("input_units", "|").alias("units"), _flags("input_unit_labels").alias("labels"), "output_text")


@query("load_evidence_inference", f"WITH {_WORDS} SELECT 'User1' AS intent, ws[1] || '. ' || ws[2] || ' end.' AS input, item_id AS prompt, 'train' AS split FROM w")
def _(spark, d):
    items, put = _raw(spark, d)
    body = F.concat(F.col("ws")[0], F.lit(". "), F.col("ws")[1], F.lit(" end."))
    head = lambda line: spark.range(1).select(F.lit(line).alias("value"))
    marks = items.select(F.format_string("%s,1,%s,0,3", F.col("item_id").cast("string"), F.col("item_id").cast("string")).alias("value"))
    asked = items.select(F.format_string("%s,%s,o,i,c", F.col("item_id").cast("string"), F.col("item_id").cast("string")).alias("value"))
    annotations = corpora.evidence_annotations(spark, put(head("PMCID,UserID,PromptID,Evidence Start,Evidence End").unionByName(marks).coalesce(1), "marks"))
    prompts_ = corpora.evidence_prompts(spark, put(head("PromptID,PMCID,Outcome,Intervention,Comparator").unionByName(asked).coalesce(1), "prompts"))
    parts = corpora.evidence_splits(spark, {"train": put(items.select(F.col("item_id").cast("string")), "train")})
    both = corpora.evidence_inference_raw(annotations, prompts_, parts)
    articles = items.select(F.col("item_id").alias("PMCID"), body.alias("text"))
    rows = corpora.evidence_inference(both, articles).select("intent", "input")
    known = both.join(articles, "PMCID").select(F.col("text").alias("input"), F.col("PromptID").alias("prompt"), "split")
    return rows.join(known.dropDuplicates(["prompt"]), "input").select("intent", "input", "prompt", "split")


@query("load_physionet", f"WITH {_WORDS} SELECT '1||||' || item_id AS id, 'NAME' AS kind, 1 AS n_positive FROM w")
def _(spark, d):
    items, put = _raw(spark, d)
    number = F.col("item_id").cast("string")
    # Offsets are counted from the line break after the record's head.
    records = items.select(F.concat(F.lit("START_OF_RECORD=1||||"), number, F.lit("||||\nSeen by Ann today ; no pain at all ; fever .||||END_OF_RECORD")).alias("value"))
    marks = spark.range(1).select(F.lit("record_id,begin,length,type").alias("value")).unionByName(items.select(F.concat(F.lit("1||||"), number, F.lit(",8,3,NAME")).alias("value")))
    notes = put(spark.range(1).select(F.lit(str({"id": "1||||none_sent_0", "correction": "[]"}))), "notes")
    sents = corpora.apply_corrections(corpora.physionet_sentences(corpora.physionet_records(spark, put(records.coalesce(1), "records")), corpora.physionet_annotations(spark, put(marks.coalesce(1), "marks"))), corpora.physionet_corrections(spark, notes))
    docs = corpora.claims_to_documents(corpora.sentences_to_claims(sents))
    kinds = sents.select(F.regexp_replace("record_id", "_sent_.*", "").alias("id"), F.explode("ner_tags").alias("tag")).where("tag LIKE 'B-%'").select("id", F.substring("tag", 3, 9).alias("kind")).distinct()
    return docs.select("id", F.size(F.filter("claim_labels", lambda y: y == 1)).alias("n_positive")).join(kinds, "id").select("id", "kind", "n_positive")
