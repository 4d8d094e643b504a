"""Experiments end to end, calls with retries and pauses, examples, splits by corpus, reports, and searches against brute force."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanworks.functions import text
from gleanworks.operators import conformal, examples, precision, report, retrieval, selection, splits, statistics
from gleanworks.plans import calls, experiment
from gleanworks.sources.store import RunStore

SAMPLES = "sample_id long, intent string, input string, input_units array<string>, input_unit_labels array<int>"


@pytest.fixture(scope="module")
def parts(spark):
    """Pool, calibration and test rows of two intents."""
    rng = random.Random(4)
    rows = []
    for i in range(60):
        units = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(3)) for _ in range(rng.randrange(2, 7))]
        rows.append((i, f"q{i % 2}", " ".join(units), units, [int((i + j) % 3 == 0) for j in range(len(units))]))
    df = spark.createDataFrame(rows, SAMPLES)
    return {"pool": df.where("sample_id < 16"), "cal": df.where("sample_id BETWEEN 16 AND 29"), "test": df.where("sample_id >= 30")}


def scores(units, shift):
    return [(sum(map(ord, u)) + shift) % 101 / 100 for u in units]


def ap(values, labels):
    """Average precision with ties as one step, by definition."""
    if not 0 < sum(labels) < len(labels):
        return None
    total = 0.0
    for level in sorted(set(values), reverse=True):
        above = [y for s, y in zip(values, labels, strict=True) if s >= level]
        total += sum(y for s, y in zip(values, labels, strict=True) if s == level) * sum(above) / len(above)
    return total / sum(labels)


def run(parts, store=None, scorer=experiment.offline_scorer, **settings):
    return experiment.run_experiment(experiment.Settings("contractnli", **settings), scorer, parts["pool"], parts["cal"], parts["test"], store)


def test_ensemble_is_scored_fused_and_stored(spark, parts, tmp_path):
    store = RunStore(spark, str(tmp_path / "store"))
    store.init()
    result = run(parts, store, strategy="moe", moe_strategies=["bm25", "rep"], weights=[1.0, 3.0], n_icl=2, run_name="both", tags=["t"])
    for r in result.test.collect():
        want = scores(r.input_units, 2)
        assert r.scores_icl2_moe == pytest.approx(want) and r.sub_scores["rep"] == pytest.approx(want)
        assert r.scores_icl2_moe_ap == (pytest.approx(ap(want, r.input_unit_labels)) if ap(want, r.input_unit_labels) is not None else None)
    rows = {r.icl_strategy_name: r for r in store.table("runs").collect()}
    assert set(rows) == {"moe2", "bm25", "rep"} and all(r.status == "completed" and r.n_samples_scored == 30 for r in rows.values())
    assert json.loads(rows["moe2"].icl_strategy_params)["weights"] == [1.0, 3.0] and rows["moe2"].tags == ["t"] and rows["moe2"].run_id == result.run_id
    assert set(rows["moe2"].intent_metrics) == {"q0", "q1"}
    params = json.loads(rows["rep"].icl_strategy_params)
    assert len(params["sample_indices"]) == 4 and set(params["sample_indices_by_intent"]) == {"q0", "q1"}
    assert rows["rep"].prompt_content["icl_examples.q0"].count("Example ") == 2
    held = store.table("run_samples").groupBy("run_id", "split").count().collect()
    assert {(r.run_id == result.run_id, r.split): r["count"] for r in held if r.run_id == result.run_id} == {(True, "test"): 30, (True, "cal"): 14}
    full = report.run_report(store.table("runs"), store.table("run_samples").where("split = 'test'")).where(F.col("run_id") == result.run_id).first()
    assert (full.n_samples, full.n_success, full.n_failed, full.failed_samples) == (30, 30, 0, None) and full.duration_seconds >= 0 and json.loads(report.as_json(full))["status"] == "completed"


def test_settings_are_checked(parts):
    for bad in ({"strategy": "nope"}, {"strategy": "dpp", "n_icl": 1}, {"strategy": "moe", "moe_k": 7}, {"strategy": "moe", "moe_strategies": ["rep", "nope"]}):
        with pytest.raises(ValueError):
            run(parts, **bad)
    with pytest.raises(ValueError):
        experiment.Settings("unknown").check()
    assert experiment.Settings("puma", no_icl=True).output == "scores_icl0"


def test_failed_rows_are_stored_as_failed(spark, parts, tmp_path):
    store = RunStore(spark, str(tmp_path / "store"))
    store.init()

    def half(prompts):
        return [None if "q1" in p else experiment.offline_scorer([p])[0] for p in prompts]

    result = run(parts, store, half, no_icl=True, n_samples=20)
    row = store.table("runs").first()
    assert (row.n_samples_scored, row.n_samples_failed, row.error_rate) == (10, 10, 0.5) and row.icl_strategy_name == "icl0"
    assert row.error_summary.by_category == {"scoring_failure": 10} and len(row.error_summary.samples) == 10
    assert store.samples(result.run_id, "test", "failed").count() == 10
    out = report.run_report(store.table("runs"), store.table("run_samples").where("split = 'test'")).first()
    assert out.n_failed == 10 and len(out.failed_samples) == 10


def test_calls_retry_and_pause_together():
    slept, now = [], [0.0]

    def sleep(s):
        slept.append(s)
        now[0] += s

    seen = {}

    def scorer(prompts):
        (p,) = prompts
        seen[p] = seen.get(p, 0) + 1
        if p == "limited" and seen[p] == 1:
            raise RuntimeError("HTTP 429, retry in 7s")
        if p == "broken":
            raise ValueError("no")
        if p == "late" and seen[p] < 3:
            raise ValueError("not yet")
        return [p.upper()]

    got = calls.ask(scorer, ["a", "limited", "broken", "late"], attempts=3, concurrency=1, base_delay=1, pause=calls.Pause(sleep, lambda: now[0]))
    assert [(c.response, c.retries, c.error) for c in got] == [("A", 0, None), ("LIMITED", 1, None), (None, 2, "ValueError: no"), ("LATE", 2, None)]
    assert slept == [12.0, 1, 2, 1, 2]
    many = calls.ask(lambda p: [p[0] * 2], [str(i) for i in range(50)], concurrency=8)
    assert [c.response for c in many] == [str(i) * 2 for i in range(50)]
    pause = calls.Pause(sleep, lambda: now[0])
    assert [pause.hit(RuntimeError("quota")) for _ in range(4)] == [60, 120, 240, 300]
    pause.clear()
    assert pause.hit(RuntimeError("quota")) == 60 and calls.wait_hint(RuntimeError("retry_delay { seconds: 9 }")) == 9


def test_cache_keeps_prompts_from_the_scorer(spark, parts, tmp_path):
    path = str(tmp_path / "asked")

    def counting(prompts):
        with open(path, "a") as f:
            f.write("x" * len(prompts))
        return experiment.offline_scorer(prompts)

    cache = experiment.ResponseCache(spark, str(tmp_path / "cache"), counting, "m")
    for _ in range(2):
        scored = experiment.score(parts["cal"], None, respond_with=cache).collect()
        assert all(r.relevancy_scores == pytest.approx(scores(r.input_units, 0)) for r in scored)
    assert len(open(path).read()) == 14 and cache.table().count() == 14


def test_examples_of_a_pool(spark, parts):
    pool = parts["pool"]
    cut = {r.sample_id: (r.input_units, r.input_unit_labels) for r in examples.window_pool(pool, 1, 1).collect()}
    for at, r in enumerate(pool.orderBy("sample_id").collect()):
        want = text.windowed(r.input_units, r.input_unit_labels, 1, 1, 0.5, examples.SEED + at)
        assert cut.get(r.sample_id) == (want if want else None)
    chosen = examples.choose(pool, "rep", 3, True)
    assert {(r.intent, r.rank) for r in chosen.collect()} == {(q, k) for q in ("q0", "q1") for k in (1, 2, 3)}
    blocks = {r.intent: r.examples for r in examples.global_blocks(chosen, True).collect()}
    assert set(blocks) == {"q0", "q1"} and blocks["q0"].startswith("Example 1\nIntent: q0\nUnits:\n0. ")
    one = examples.global_blocks(examples.choose(pool, "random", 2), False, False).collect()
    assert len(one) == 1 and one[0].intent is None and "Intent:" not in one[0].examples and one[0].examples.count("Example ") == 2
    for strategy in ("boundary", "clarity", "fisher", "pattern_dpp", "anchor_dpp"):
        assert examples.choose(pool, strategy, 2).count() == 2
    local = examples.local_blocks(pool, parts["cal"], "knn", 2, True).collect()
    assert len(local) == 14 and all(r.examples.count("Example ") == 2 for r in local)
    with pytest.raises(ValueError):
        examples.local_choice(pool, pool, "rep")


def test_corpora_are_split_and_saved_by_name(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").alias("sample_id"), (F.col("id") % 3).cast("string").alias("intent"))
    rows.write.parquet(str(tmp_path / "PUMA" / "PUMA_processed.parquet"))
    rows.drop("sample_id").withColumn("input", F.monotonically_increasing_id()).write.parquet(str(tmp_path / "ECTSum" / "ECTSum_processed.parquet"))
    out = splits.split_all(spark, str(tmp_path))
    sizes = {name: {part: df.count() for part, df in found.items()} for name, found in out.items()}
    assert sizes == {"puma": {"pool": 60, "cal": 100, "test": 240}, "ectsum": {"pool": 50, "cal": 100, "test": 250}}
    assert {r["count"] for r in out["puma"]["pool"].groupBy("intent").count().collect()} == {20}
    ids = [r.sample_id for df in out["puma"].values() for r in df.collect()]
    assert sorted(ids) == list(range(400)) and spark.read.parquet(str(tmp_path / "PUMA" / "puma_cal.parquet")).count() == 100
    with pytest.raises(FileNotFoundError):
        splits.split_named(spark, "subsume", str(tmp_path))
    with pytest.raises(ValueError):
        splits.split_dataset(rows, "nope")
    capped = splits.split_dataset(spark.range(10_300).withColumnRenamed("id", "sample_id"), "hotpotqa")
    assert {r.split: r["count"] for r in capped.groupBy("split").count().collect()} == {"pool": 50, "cal": 100, "test": 10_000}


def test_rank_search_and_percentiles_equal_sorting(spark):
    rng = np.random.default_rng(3)
    for values in ([0.5], [0.25] * 50 + [math.inf] * 3, [*rng.random(3000), *[0.125] * 900, *[math.inf] * 40], [*(1 - rng.random(500) * 1e-12)]):
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, q double")
        for alpha in (0.0, 0.1, 0.5, 1.0):
            assert conformal.threshold(df, alpha) == sorted(values)[conformal.rank_of(len(values), alpha) - 1]
    assert conformal.threshold(spark.createDataFrame([], "q double"), 0.1) is None
    rows = [("a", float(v)) for v in rng.random(777)] + [("b", 1.0)] * 40 + [("b", 0.5)] * 11 + [("c", 0.3), ("d", None)]
    got = {r.strategy: list(r.q) for r in precision.percentiles(spark.createDataFrame(rows, "strategy string, ap double"), ("strategy",), [0.0, 0.05, 0.5, 0.95, 1.0]).collect()}
    for g in "abc":
        assert got[g] == pytest.approx(list(np.percentile([v for k, v in rows if k == g], [0, 5, 50, 95, 100])))
    assert "d" not in got


def test_ap_expression_equals_definition(spark):
    rng = random.Random(2)
    rows = [([rng.randrange(6) / 5 for _ in range(n)], [rng.randrange(2) for _ in range(n)]) for n in [1, 2, *range(3, 60)]] + [(None, [1, 0])]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s array<double>, y array<int>").select("i", precision.ap_of_arrays(F.col("s"), F.col("y")).alias("ap")).collect()
    for r in got:
        want = ap(*rows[r.i]) if rows[r.i][0] is not None else None
        assert r.ap == (pytest.approx(want) if want is not None else None)


def test_block_search_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(90, 5))
    vectors[7] = 0
    vectors[50] = vectors[3]
    pool = spark.createDataFrame([(i, str(i % 2), v.tolist()) for i, v in enumerate(vectors)], "id long, g string, embedding array<double>")
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    near = np.round(unit @ unit.T, 9)
    for block in (7, 4096):
        monkeypatch.setattr(retrieval, "BLOCK", block)
        for group in (None, "g"):
            got = {}
            for r in retrieval.knn(pool.where("id % 9 = 0"), pool, 4, group).collect():
                got.setdefault(r.query_id, {})[r.rank] = r.id
            for q in range(0, 90, 9):
                open_ = [i for i in range(90) if group is None or i % 2 == q % 2]
                assert [got[q][k] for k in (1, 2, 3, 4)] == sorted(open_, key=lambda i: (-near[q, i], i))[:4]


def test_bm25_fills_up_with_texts_that_share_no_term(spark):
    pool = spark.createDataFrame([(i, "common rare" if i == 5 else "common") for i in range(8)] + [(20, "other"), (21, "")], "id long, text string")
    queries = spark.createDataFrame([(1, "rare"), (2, "nothing here"), (3, "")], "id long, text string")
    got = {}
    for r in retrieval.bm25(queries, pool, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score > 0))
    assert got == {1: [(5, True), (0, False), (1, False)], 2: [(0, False), (1, False), (2, False)], 3: [(0, False), (1, False), (2, False)]}


def test_strategies_are_compared_in_one_aggregate(spark):
    rng = random.Random(6)
    rows = [(s, i, rng.random()) for s in ("base", "x", "y") for i in range(30)] + [("x", 99, None)]
    aps = spark.createDataFrame(rows, "strategy string, sample_id long, ap double")
    got = statistics.compare_strategies(aps, "base")
    one = statistics.paired_ttest(aps.where("strategy = 'x'"), aps.where("strategy = 'base'"))
    assert list(got) == ["x", "y"] and got["x"] == pytest.approx(one)
    with pytest.raises(ValueError):
        statistics.compare_strategies(aps.where("strategy <> 'y' OR sample_id < 1"), "base")


def test_report_tables(spark):
    runs = spark.createDataFrame([(1, 10, "icl0", '{"k": 0}', 0.4), (2, 10, "moe4", '{"k": 2}', 0.6), (3, 10, "bm25", '{"k": 3}', 0.5), (4, 10, "random", '{"k": 1}', 0.1)], "run_id long, dataset_id long, icl_strategy_name string, icl_strategy_params string, mean_ap double")
    runs = runs.select("*", F.lit(1).alias("llm_model_id"), F.lit("completed").alias("status"), F.current_timestamp().alias("created_at"), F.lit(0.1).alias("std_ap"), F.lit(20).alias("n_samples_scored"), *[F.lit(1.0).alias(c) for c in ("total_duration_ms", "total_llm_time_ms", "avg_sample_time_ms")])
    samples = spark.range(20).crossJoin(spark.createDataFrame([(1, 0.4), (2, 0.6), (3, 0.5), (4, 0.1)], "run_id long, base double")).select("run_id", F.col("id").alias("sample_index"), F.lit("scored").alias("status"), (F.col("base") + F.col("id") / 1000 * F.col("run_id")).alias("ap"))
    tables = report.paper_data(runs, samples, spark.createDataFrame([(10, "subsume")], "id long, name string"), rounds=50)
    assert {r.role: r.label for r in report.compared(tables["strategy_matrix"]).collect()} == {"icl0": "icl0", "ensemble": "icl2_moe4", "best_single": "icl3_bm25"}
    assert tables["strategy_matrix"].count() == 4 and tables["ap_distributions"].count() == 3 and tables["reproducibility"].count() == 3
    # Means differ by the base and by 9.5 / 1000 for every run id in between.
    assert {r.against: r["diff"] for r in tables["paired_diffs"].collect()} == pytest.approx({"icl0": 0.2 + 0.0095, "best_single": 0.1 - 0.0095})
    bounds = {r.role: (r.ci_low, r["mean"], r.ci_high) for r in tables["bootstrap_cis"].collect()}
    assert all(lo <= m <= hi for lo, m, hi in bounds.values()) and "ensemble against icl0" in report.summary(tables)


def test_strategy_names(parts):
    assert selection.resolve_strategy_name("rep", True) == "rep_stratified" and selection.normalize_strategy_name("rep_stratified") == "rep"
