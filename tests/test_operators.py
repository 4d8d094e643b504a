import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanworks import queries
from gleanworks.functions import parsing, prompts, stats, text
from gleanworks.operators import conformal, errors, fusion, precision, retrieval, runs, selection, splits, statistics


def ap_brute(scores, labels):
    if sum(labels) in (0, len(labels)):
        return None
    out, seen, hit = 0.0, 0, 0
    for s in sorted(set(scores), reverse=True):
        tied = [y for x, y in zip(scores, labels, strict=True) if x == s]
        seen, hit = seen + len(tied), hit + sum(tied)
        out += sum(tied) / sum(labels) * hit / seen
    return out


def test_average_precision_both_forms(spark):
    rng = random.Random(0)
    rows = [(i, [rng.randrange(4) / 4 for _ in range(n)], [rng.randrange(2) for _ in range(n)]) for i, n in enumerate(rng.randrange(1, 9) for _ in range(40))]
    df = spark.createDataFrame(rows, "sample_id long, s array<double>, y array<int>")
    wide = {r.sample_id: r.ap for r in df.select("sample_id", precision.ap_of_arrays(F.col("s"), F.col("y")).alias("ap")).collect()}
    units = spark.createDataFrame([(i, "a", "x", y, s) for i, ss, ys in rows for s, y in zip(ss, ys, strict=True)], "sample_id long, strategy string, intent string, label int, score double")
    long = {r.sample_id: r.ap for r in precision.average_precision(units).collect()}
    for i, s, y in rows:
        want = ap_brute(s, y)
        for got in (wide[i], long[i]):
            assert got is None if want is None else got == pytest.approx(want)
    none = spark.createDataFrame([(1, None, [0, 1])], "i int, s array<double>, y array<int>")
    assert none.select(precision.ap_of_arrays(F.col("s"), F.col("y"))).first()[0] is None


def test_average_precision_sums_along_the_scores(spark):
    """Steps are added one by one from the highest score on, also when the aggregate starts anew within a sample."""
    rng = random.Random(1)
    rows = [(i, [rng.randrange(10) / 10 for _ in range(n)], [rng.randrange(2) for _ in range(n)]) for i, n in enumerate(rng.randrange(6, 15) for _ in range(300))]
    units = spark.createDataFrame([(i, "a", "x", y, s) for i, ss, ys in rows for s, y in zip(ss, ys, strict=True)], "sample_id long, strategy string, intent string, label int, score double")

    def one_by_one(scores, labels):
        out, seen, hit = 0.0, 0, 0
        for s in sorted(set(scores), reverse=True):
            tied = [y for x, y in zip(scores, labels, strict=True) if x == s]
            seen, hit = seen + len(tied), hit + sum(tied)
            out += float(sum(tied)) * hit / seen
        return out / sum(labels) if 0 < sum(labels) < len(labels) else None

    want = {i: one_by_one(s, y) for i, s, y in rows}
    aps = lambda: {r.sample_id: r.ap for r in precision.average_precision(units).select("sample_id", "ap").collect()}
    assert aps() == want
    spark.conf.set("spark.sql.TungstenAggregate.testFallbackStartsAt", "2, 3")
    try:
        assert aps() == want
    finally:
        spark.conf.unset("spark.sql.TungstenAggregate.testFallbackStartsAt")


def test_fusion_rules(spark):
    df = spark.createDataFrame([([0.2, 0.4], None, [0.8, 1.0]), (None, None, None), ([1.0], [1.0, 2.0], None)], "a array<double>, b array<double>, c array<double>")
    fuse = fusion.fuse_arrays([F.col("a"), F.col("b"), F.col("c")], [1, 1, 2])
    assert df.limit(1).select(fuse).first()[0] == pytest.approx([0.6, 0.8])
    assert df.where("a IS NULL").select(fuse).first()[0] is None
    with pytest.raises(Exception, match="differ in length"):
        df.where("size(b) = 2").select(fuse).collect()
    assert fusion.resolve_ensemble() == list(fusion.ENSEMBLE[:4])
    with pytest.raises(ValueError):
        fusion.resolve_ensemble(["random"])


def test_conformal_edges_and_coverage(spark):
    rng = random.Random(1)
    rows = [(i, u, rng.randrange(2), rng.random()) for i in range(300) for u in range(rng.randrange(1, 8))]
    noisy = conformal.with_noise(spark.createDataFrame(rows, "sample_id long, unit_idx int, label int, score double"))
    zero = conformal.row_scores(noisy, 0.0)
    assert zero.where("q < double('inf')").count() == 0
    full = {r.sample_id: r.q for r in conformal.row_scores(noisy, 1.0).collect()}
    best = {}
    for r in noisy.collect():
        if r.label:
            best[r.sample_id] = min(best.get(r.sample_id, math.inf), r.noisy)
    assert full == {i: best.get(i, math.inf) for i in full}
    cut = conformal.threshold(conformal.row_scores(noisy, 0.8), 0.1)
    assert conformal.coverage(noisy, cut, 0.8).first().coverage >= 0.9 - 1 / 300
    assert conformal.rank_of(100, 0.1) == 10 and conformal.rank_of(5, 0) == 1 and conformal.rank_of(5, 1) == 5
    assert conformal.noise_values(3) == conformal.noise_values(9)[:3]


def test_splits(spark):
    df = spark.range(400).select(F.col("id").alias("sample_id"), (F.col("id") % 3).cast("string").alias("intent"))
    sizes = {r.split: r["count"] for r in splits.split_uniform(df).groupBy("split").count().collect()}
    assert sizes == {"pool": 50, "cal": 100, "test": 250}
    strat = splits.split_stratified(df)
    assert {r["count"] for r in strat.where("split = 'pool'").groupBy("intent").count().collect()} == {20}
    assert strat.where("split = 'cal'").count() == 100 and strat.select("sample_id").distinct().count() == 400
    few = {r.split: r["count"] for r in splits.split_uniform(df.limit(60)).groupBy("split").count().collect()}
    assert few == {"pool": 50, "cal": 10}
    capped = splits.split_uniform(df, test_cap=30)
    assert capped.where("split = 'test'").count() == 30


def test_dpp_takes_the_best_determinant():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(7, 4))
    kernel = selection.gram(v)
    chosen = selection.greedy_dpp(v, 3)
    for k in (1, 2):
        gains = [selection.logdet(kernel, [*chosen[:k], i]) if i not in chosen[:k] else -np.inf for i in range(7)]
        assert chosen[k] == int(np.argmax(gains))
    assert chosen[0] == 0
    with pytest.raises(ValueError):
        selection.greedy_dpp(v, 8)


def test_dpp_by_rounds_equals_the_kernel_form(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(40, 5))
    vectors[7], vectors[11] = vectors[3], 0.0
    pool = spark.createDataFrame([(i, "ab"[i % 3 == 0], v.tolist()) for i, v in enumerate(vectors)], "id long, intent string, embedding array<double>")
    for group in (None, "intent"):
        got = selection.select_dpp(pool, 4, group).orderBy("g", "rank").collect()
        for g in {r.g for r in got}:
            ids = [i for i in range(40) if not group or "ab"[i % 3 == 0] == g]
            want = selection.greedy_dpp(vectors[ids], 4)
            assert [r.id for r in got if r.g == g] == [ids[i] for i in want]
            assert next(r.value for r in got if r.g == g) == pytest.approx(selection.logdet(selection.gram(vectors[ids]), want), abs=1e-6)
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    centre = int(np.linalg.norm(unit - unit.mean(0), axis=1).round(11).argmin())
    assert [r.id for r in selection.select_dpp(pool, 3, anchor=True).orderBy("rank").collect()] == selection.greedy_dpp(vectors, 3, start=[centre])
    assert selection.select_dpp(pool.where("id < 2"), 5).count() == 2 and selection.select_dpp(pool.limit(0), 3).count() == 0


def test_knn_in_blocks_equals_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(6)
    pool = spark.createDataFrame([(i, "ab"[i % 2], rng.normal(size=3).tolist()) for i in range(60)], "id long, intent string, embedding array<double>")
    for group in (None, "intent"):
        want = sorted(map(tuple, retrieval.knn(pool.where("id < 9"), pool, 4, group).collect()))
        with monkeypatch.context() as m:
            m.setattr(retrieval, "small", lambda df: False)
            m.setattr(retrieval, "BLOCK", 7)
            assert sorted(map(tuple, retrieval.knn(pool.where("id < 9"), pool, 4, group).collect())) == want


def test_representative_ties_by_rounded_distance(spark):
    # opposite vectors: the centroid is almost zero and distances differ by less than 1e-6
    rows = [(1, [1.0, 0.0]), (2, [-1.0, 2e-7]), (3, [0.0, 1.0]), (4, [1e-7, -1.0]), (5, None), (6, [])]
    pool = spark.createDataFrame(rows, "id long, embedding array<double>")
    exact, ties = ([(r.id, r.rank) for r in selection.select_representative(pool, 6, digits=d).orderBy("rank").collect()] for d in (None, 6))
    assert [i for i, _ in exact] != [1, 2, 3, 4] and sorted(i for i, _ in exact) == [1, 2, 3, 4]
    assert ties == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_representative_query_equals_its_sql_on_close_vectors(spark, tmp_path):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 8))
    rows = [(i + 30 * c, (v + (2 - c) * 1e-7 * np.sin(np.arange(8) + i)).tolist(), i % 3) for c in range(3) for i, v in enumerate(base)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = duck.execute(queries.ORACLES["rep_centroid_topk"]).fetchall()
    got = [tuple(r) for r in queries.QUERIES["rep_centroid_topk"](spark, str(tmp_path)).orderBy("rank").collect()]
    assert got == sorted(want, key=lambda r: r[2])


def test_strategies_by_name(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "ab"[i % 2], [0, 0, 1, 1], rng.normal(size=3).tolist(), rng.normal(size=(4, 3)).tolist()) for i in range(12)]
    pool = spark.createDataFrame(rows, "id long, intent string, labels array<int>, embedding array<double>, units array<array<double>>")
    for name in selection.list_strategies(True):
        got = selection.select(pool, name, 3)
        assert got.count() == (6 if name.endswith("_stratified") else 3), name
    assert selection.resolve_strategy_name("dpp", True) == "dpp_stratified" and selection.normalize_strategy_name("dpp_stratified") == "dpp"
    assert [r.id for r in selection.gather(pool, selection.select(pool, "rep", 2)).collect()] == [r.id for r in selection.select(pool, "rep", 2).orderBy("rank").collect()]
    with pytest.raises(ValueError):
        selection.select(pool, "dpp", 1)


def test_bm25_formula(spark):
    docs = [(0, "a b b c"), (1, "a c d"), (2, "a e"), (3, "x y z z z")]
    pool = spark.createDataFrame(docs, "id long, text string")
    got = {(r.query_id, r.id): r.score for r in retrieval.bm25(spark.createDataFrame([(9, "B b z a")], "id long, text string"), pool, 4).collect()}
    words = {i: t.split() for i, t in docs}
    n, avg = 4, sum(map(len, words.values())) / 4
    raw = {t: math.log(n - df + 0.5) - math.log(df + 0.5) for t in {w for d in words.values() for w in d} if (df := sum(t in d for d in words.values()))}
    mean = sum(raw.values()) / len(raw)
    for i, d in words.items():
        want = sum((raw[q] if raw[q] >= 0 else 0.25 * mean) * d.count(q) * 2.5 / (d.count(q) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for q in "b b z a".split())
        assert got[9, i] == pytest.approx(want, abs=1e-6)


def test_statistics(spark):
    assert stats.t_ppf(0.975, 9) == pytest.approx(2.262157, abs=1e-5)
    assert stats.t_two_sided_p(2.262157, 9) == pytest.approx(0.05, abs=1e-5)
    a = spark.createDataFrame([(i, i / 10 + 0.1) for i in range(8)], "sample_id long, ap double")
    b = spark.createDataFrame([(i, i / 10 + (0.02 if i % 2 else 0)) for i in range(9)], "sample_id long, ap double")
    r = statistics.paired_ttest(a, b)
    assert r["n"] == 8 and r["diff"] == pytest.approx(0.09) and r["significant"]
    with pytest.raises(ValueError):
        statistics.paired_ttest(a.limit(1), b)
    m, lo, hi = statistics.bootstrap_map([0.1, 0.5, 0.9], 500)
    assert lo <= m <= hi and math.isnan(statistics.bootstrap_map([])[0])
    assert statistics.bootstrap_difference([0.9] * 5, [0.1] * 5, 200)["diff"] == pytest.approx(0.8)


def test_error_rules(spark):
    said = {
        "HTTP 429: timeout": ("rate_limit", "rate_limit_exceeded", "low"),
        "request timed out": ("timeout", "request_timeout", "low"),
        "Connection refused": ("content_filter", "content_filtered", "medium"),
        "HTTP 503": ("network_error", "network_error", "low"),
        "bad JSON": ("parsing_error", "json_parse_error", "medium"),
        "score out of range": ("validation_error", "invalid_score_format", "medium"),
        "Internal error": ("api_error", "api_internal_error", "low"),
        "Unauthorized": ("authentication", "auth_failed", "critical"),
        None: ("unknown", "unknown_error", "high"),
    }
    df = spark.createDataFrame(list(enumerate(said)), "sample_id long, message string")
    got = {r.message: (r.category, r.error_type, r.severity) for r in errors.categorize(df).collect()}
    assert got == said
    assert "Errors: 9 of 18" in errors.report(errors.categorize(df), 18)
    rates = {(r.error_rate, r.success_rate) for r in errors.analyze(errors.categorize(df), total=18).collect()}
    assert rates == {(0.5, 0.5)}


def test_error_patterns_have_all_members(spark):
    rows = [(i, "HTTP 429") for i in range(150)] + [(150, "bad JSON"), (151, "odd"), (152, None)]
    members = errors.pattern_members(errors.categorize(spark.createDataFrame(rows, "sample_id long, message string"))).collect()
    got = {}
    for r in members:
        got.setdefault((r.error_type, r.action), []).append(r.sample_id)
    assert {k: sorted(v) for k, v in got.items()} == {("rate_limit_exceeded", errors.ACTIONS["rate_limit"]): list(range(150)), ("unknown_error", errors.ACTIONS["unknown"]): [151, 152]}


def test_errors_of_stored_runs(spark, tmp_path):
    schema = "run_id long, dataset_id long, status string, n_samples_scored int, n_samples_failed int, error_summary struct<samples:array<struct<index:int,message:string,retries:int>>>"
    rows = [(1, 7, "completed", 8, 2, ([(0, "HTTP 429", 1), (3, None, None)],)), (2, 7, "failed", None, 5, ([(1, "HTTP 429", 0)],)), (3, 7, "running", 9, 0, None), (4, 8, "completed", 1, 0, None)]
    runs = spark.createDataFrame(rows, schema)
    one = {(r.dimension, r.value): (r.n, r.error_rate) for r in errors.of_run(runs, 1).collect()}
    assert one["category", "rate_limit"] == (1, 0.2) and one["error_type", "unknown_error"] == (1, 0.2)
    every = {(r.dimension, r.value): (r.n, r.error_rate) for r in errors.of_dataset(runs, 7).collect()}
    assert every["severity", "low"] == (2, 0.2) and errors.of_run(runs, 99).count() == 0 and errors.of_run(runs, 4).count() == 0
    errors.export(errors.categorize(errors.from_runs(runs)), str(tmp_path / "errors"))
    assert spark.read.csv(str(tmp_path / "errors"), header=True).count() == 3


def test_run_queries_on_tags_and_options(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "run_id long, tags array<string>")
    assert [r.run_id for r in runs.tagged(df, ["b", "z"]).collect()] == [1]
    assert {r.tag for r in runs.distinct_tags(df).collect()} == {"a", "b", "c"}
    cut = spark.range(1).select(runs.shorten(F.lit("x" * 120)), runs.gauge(F.lit(0.1)), runs.safe_int(F.lit("q"))).first()
    assert len(cut[0]) == 100 and cut[0].endswith("...") and cut[1] == "warning" and cut[2] == 0


def test_text_goldens():
    assert text.split_sentences("Dr. Smith recommended 2.5 mg of medicine.") == ["Dr. Smith recommended 2.5 mg of medicine."]
    assert text.split_sentences("First sentence. Second sentence.") == ["First sentence.", "Second sentence."]
    assert [s[1:] for s in text.sentence_spans("First. Second.")] == [(0, 6), (7, 14)]
    assert len(text.answer_sentences("answer_1: A b. C d.\nanswer_2: E f.")) == 3
    assert text.split_sentences(" \n") == []
    tokens = "HISTORY : pain , and fever ; no cough".split()
    got = text.claims(tokens, ["O"] * 3 + ["B-X"] + ["O"] * (len(tokens) - 4))
    assert got[0][0] == 0 and got[-1][1] == len(tokens) and all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))
    assert text.windowed(["a", "b"], [0, 0]) is None
    units, labels = text.windowed([str(i) for i in range(40)], [int(i == 20) for i in range(40)], seed=1)
    assert sum(labels) == 1 and labels.count(0) >= 3 and units == sorted(units, key=int)
    assert text.split_long(" ".join(["w"] * 400)) == [" ".join(["w"] * 400)]
    listed = ", ".join(["w"] * 400)
    assert "".join(text.split_long(listed, 150)).replace(" ", "") == listed.replace(" ", "") and all(text.n_tokens(p) <= 150 for p in text.split_long(listed, 150))
    assert text.split_long("a b; c d; e", 3, 0.6) == ["a b", "; c d", "; e"]
    assert [s[1:] for s in text.note_spans("One up; two. Three.", 2)] == [(0, 6), (6, 12), (13, 19)]


def test_claims_follow_the_rules():
    """Delimiters close a claim, headers open one, long ranges are cut after conjunctions and commas."""
    cut = lambda words, **k: [" ".join(words.split()[a:z]) for a, z, _ in text.claims(words.split(), ["X"] * len(words.split()), **k)]
    assert cut("Pt well ; PMH: asthma HPI: cough | none") == ["Pt well ;", "PMH: asthma", "HPI: cough |", "none"]
    assert cut("time 10 : 30 and dose : two") == ["time 10 : 30 and dose :", "two"]
    assert cut("a b , then c d e", most=4) == ["a b ,", "then c d e"]
    assert cut("a b and c d e f", most=4) == ["a b and", "c d e f"]
    assert cut("a , b c d e", most=4) == ["a ,", "b c d e"]
    assert cut("a b c d e f g", most=3) == ["a b c d", "e f g"]
    assert text.claims("a ; b c d".split(), ["O"] * 5) == [(0, 5, 0)]
    assert text.parse_correction("[[('a', 'B-X')], 3, []]") == [[("a", "B-X")]] and text.parse_correction("os.x") == [] and text.parse_correction(None) == []
    assert text.correct_tags(["a", "b", "a"], ["O"] * 3, [[("a", "B-X"), ("b", "I-X")]]) == ["B-X", "I-X", "O"]


def test_retry_and_prompts(spark):
    r = spark.range(1).select(parsing.retry_delay(F.lit("Please retry in 12.5s")), parsing.is_rate_limit(F.lit("HTTP 429")), prompts.missing_prompt(F.array(F.lit("x"), F.lit("y")), F.array(F.lit("1")))).first()
    waits = [spark.range(1).select(parsing.retry_delay(F.lit(m)), parsing.is_rate_limit(F.lit(m), F.lit("ResourceExhausted"))).first() for m in ("retry_delay { seconds: 30 }", "wait 5 seconds", "no")]
    assert [w[0] for w in waits] == [30, 5, None] and all(w[1] for w in waits)
    assert spark.range(1).select(parsing.is_rate_limit(F.lit("limit exceeded"))).first()[0] and not spark.range(1).select(parsing.is_rate_limit(F.lit(None).cast("string"))).first()[0]
    assert r[0] == 12.5 and r[1] and "1. y" in r[2] and "0. x" not in r[2]
    assert parsing.pause_seconds(None, 3) == 240 and parsing.pause_seconds(7, 1) == 12
    with pytest.raises(ValueError):
        prompts.zero_shot("puma", F.array(F.lit("x")))
