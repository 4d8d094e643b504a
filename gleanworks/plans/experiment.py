"""Scoring experiments: prompts, a pluggable scorer, targeted retry, cache, ensembles, evaluation, calibration, storage."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embedding import Embedder, hashed
from ..functions.parsing import densify, missing, parse_scores
from ..functions.prompts import RULE, WITH_INTENT, WITHOUT_INTENT, ZERO_SHOT, missing_prompt, scoring_prompt
from ..operators import conformal, examples, fusion, precision, selection
from ..operators.precision import ap_of_arrays
from ..sources.corpora import MULTI_INTENT
from ..session import written
from ..sources.store import RunStore
from .calls import MAX_ATTEMPTS, Pause, Scorer, ask

#: ``(prompts(key, prompt), key) -> (key, response, ms, retries, error)``.
Responder = Callable[[DataFrame, str], DataFrame]


def offline_scorer(prompts: list[str]) -> list[str | None]:
    """A deterministic stand-in for a model: a unit's score follows from its characters and the number of examples."""
    out = []
    for prompt in prompts:
        lines = prompt.rpartition("Units:\n")[2].partition("\n\n")[0].split("\n")
        shift = len(re.findall(r"(?m)^Example \d+$", prompt))
        pairs = [(head, body) for head, dot, body in (line.partition(". ") for line in lines) if dot and head.isdigit()]
        out.append("{" + ", ".join(f'"{i}": {(sum(map(ord, body)) + shift) % 101 / 100}' for i, body in pairs) + "}")
    return out


def respond(prompts: DataFrame, scorer: Scorer, key: str = "sample_id", attempts: int = 1, concurrency: int = 1, pause: Pause | None = None) -> DataFrame:
    """``(key, response, ms, retries, error)`` for ``(key, prompt)``; failed prompts have no response.

    The prompts of an Arrow batch are asked ``concurrency`` at a time; a task's pause
    after a rate limit holds for all of them.
    """
    kind = dict(prompts.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shared = pause or Pause()
        for frame in frames:
            calls = ask(scorer, frame["prompt"].tolist(), attempts, concurrency, pause=shared)
            yield pd.DataFrame({key: frame[key], "response": [c.response for c in calls], "ms": [c.ms for c in calls], "retries": [c.retries for c in calls], "error": [c.error for c in calls]})

    return prompts.select(key, "prompt").mapInPandas(run, f"{key} {kind}, response string, ms double, retries int, error string")


def responder(scorer: Scorer, attempts: int = 1, concurrency: int = 1) -> Responder:
    return lambda prompts, key: respond(prompts, scorer, key, attempts, concurrency)


def cached(prompts: DataFrame, cache: DataFrame | None, scorer: Scorer, model: str, key: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """(responses, new cache rows): only prompts that the cache lacks reach the scorer.

    The cache key covers the model and the prompt, not limits such as time-outs.
    """
    keyed = prompts.withColumn("cache_key", F.sha2(F.concat_ws("\x1f", F.lit(model), "prompt"), 256))
    fresh = keyed if cache is None else keyed.join(cache.select("cache_key"), "cache_key", "left_anti")
    asked = fresh.dropDuplicates(["cache_key"]).select("cache_key", "prompt")
    new = respond(asked, scorer, "cache_key").where("response IS NOT NULL").select("cache_key", "response")
    known = new if cache is None else cache.select("cache_key", "response").unionByName(new)
    return keyed.select(key, "cache_key").join(known, "cache_key", "left").select(key, "response"), new


class ResponseCache:
    """Responses by model and prompt in a Parquet folder; ``score`` asks it in place of the scorer."""

    def __init__(self, spark: SparkSession, path: str, scorer: Scorer, model: str):
        self.spark, self.path, self.scorer, self.model = spark, path, scorer, model

    def table(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("cache_key string, response string").parquet(self.path)
        except AnalysisException:
            return None

    def __call__(self, prompts: DataFrame, key: str) -> DataFrame:
        """Prompts that the folder lacks are asked and appended first; answers are then read from it."""
        _, new = cached(prompts, self.table(), self.scorer, self.model, key)
        new.write.mode("append").parquet(self.path)
        keyed = prompts.select(key, F.sha2(F.concat_ws("\x1f", F.lit(self.model), "prompt"), 256).alias("cache_key"))
        one = self.table().dropDuplicates(["cache_key"])
        return keyed.join(one, "cache_key", "left").select(key, "response", F.lit(0.0).alias("ms"), F.lit(0).alias("retries"), F.when(F.col("response").isNull(), "no response").alias("error"))


def score(samples: DataFrame, scorer: Scorer | None, output: str = "relevancy_scores", examples: Column | None = None, intent: Column | None = None, task: str = "", units: str = "input_units", key: str = "sample_id", attempts: int = MAX_ATTEMPTS, max_missing: float = 0.25, respond_with: Responder | None = None, profile: bool = False, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``samples`` with a score vector, null for rows that stay too incomplete.

    The first attempt asks for all units, each later one only for what is missing.
    ``respond_with`` takes the scorer's place (a cache, or calls with retries of their
    own).  With ``profile`` the columns ``<output>_ms``, ``_retries`` and ``_calls`` follow.
    ``keep`` writes responses out, so that no prompt is asked twice.
    """
    n, ask_all = F.size(units), respond_with or responder(scorer)
    first = keep(ask_all(samples.select(key, scoring_prompt(F.col(units), intent, examples, task).alias("prompt")), key))
    rows = samples.join(first.withColumnsRenamed({"ms": "_ms", "retries": "_retries"}).drop("error"), key, "left")
    rows = rows.withColumn("_scores", parse_scores(F.col("response"), n)).withColumn("_calls", F.lit(1)).drop("response")
    for _ in range(attempts - 1):
        gaps = missing(F.col("_scores"), n)
        again = keep(ask_all(rows.where(F.size(gaps) > 0).select(key, missing_prompt(F.col(units), gaps, intent, examples, task).alias("prompt")), key))
        rows = rows.join(again.select(key, "response", "ms", "retries"), key, "left")
        more = F.map_filter(parse_scores(F.col("response"), n), lambda k, _: F.array_contains(gaps, k))
        asked = F.col("ms").isNotNull()
        rows = rows.withColumn("_scores", F.map_concat("_scores", more)).withColumns({"_ms": F.coalesce("_ms", F.lit(0.0)) + F.coalesce("ms", F.lit(0.0)), "_retries": F.coalesce("_retries", F.lit(0)) + F.coalesce("retries", F.lit(0)) + asked.cast("int"), "_calls": F.col("_calls") + asked.cast("int")})
        rows = rows.drop("response", "ms", "retries")
    out = rows.withColumn(output, densify(F.col("_scores"), n, max_missing)).drop("_scores")
    if profile:
        return out.withColumnsRenamed({"_ms": f"{output}_ms", "_retries": f"{output}_retries", "_calls": f"{output}_calls"})
    return out.drop("_ms", "_retries", "_calls")


def evaluate(scored: DataFrame, output: str = "relevancy_scores", labels: str = "input_unit_labels") -> DataFrame:
    return scored.withColumn(f"{output}_ap", ap_of_arrays(F.col(output), F.col(labels)))


def to_units(scored: DataFrame, scores: str, labels: str = "input_unit_labels", key: str = "sample_id") -> DataFrame:
    """Long form of a score vector; failed rows have no units."""
    pairs = F.arrays_zip(F.col(labels).alias("label"), F.col(scores).alias("score"))
    return scored.where(F.col(scores).isNotNull()).select(F.col(key).alias("sample_id"), F.posexplode(pairs).alias("unit_idx", "u")).select("sample_id", "unit_idx", F.col("u.label").alias("label"), F.col("u.score").alias("score"))


def calibrate_and_retain(scored: DataFrame, scores: str, alpha: float, beta: float) -> tuple[float | None, DataFrame]:
    """The threshold from calibration rows, and test units with their retention mask."""
    cal = conformal.with_noise(to_units(scored.where("split = 'cal'"), scores))
    cut = conformal.threshold(conformal.row_scores(cal, beta), alpha)
    test = conformal.with_noise(to_units(scored.where("split = 'test'"), scores))
    return cut, conformal.retained(test, float("inf") if cut is None else cut)


def profile(calls: DataFrame) -> DataFrame:
    """Run totals from ``(sample_id, duration_ms, retry, success)`` rows of calls."""
    per = calls.groupBy("sample_id").agg(F.sum("duration_ms").alias("ms"), F.count_if("retry").alias("retries"), F.max("success").alias("ok"))
    return per.agg(F.sum("ms").alias("total_ms"), F.avg("ms").alias("avg_sample_ms"), F.sum("retries").alias("retries"), F.count_if("ok").alias("n_success"), F.count(F.lit(1)).alias("n_samples"))


def profile_of(scored: DataFrame, output: str) -> DataFrame:
    """Run totals from the columns that ``score`` adds with ``profile``."""
    ms, ok = F.col(f"{output}_ms"), F.col(output).isNotNull()
    return scored.agg(
        F.sum(ms).alias("total_ms"), F.avg(ms).alias("avg_sample_ms"), F.sum(f"{output}_retries").alias("retries"), F.sum(f"{output}_calls").alias("calls"), F.count_if(ok).alias("n_success"), F.count_if(~ok).alias("n_failed")
    )


@dataclass
class Settings:
    """What an experiment runs; ``check`` raises for combinations that make no sense."""

    dataset: str
    strategy: str = "anchor_dpp"
    n_icl: int = examples.N_ICL
    seed: int = examples.SEED
    no_icl: bool = False
    moe_k: int | None = None
    moe_strategies: list[str] | None = None
    weights: list[float] | None = None
    context_window: int | None = None
    remote_ratio: float = 0.5
    n_samples: int = 0
    task: str = ""
    provider: str = "offline"
    model: str = "stand-in"
    run_name: str | None = None
    name_suffix: str | None = None
    tags: list[str] = field(default_factory=list)
    store_sub_strategies: bool = True

    @property
    def multi_intent(self) -> bool:
        return self.dataset in MULTI_INTENT

    @property
    def has_intent(self) -> bool:
        return ZERO_SHOT[self.dataset][0]

    @property
    def output(self) -> str:
        return "scores_icl0" if self.no_icl else f"scores_icl{self.n_icl}_{selection.normalize_strategy_name(self.strategy)}"

    def ensemble(self) -> list[str]:
        names = fusion.resolve_ensemble(self.moe_strategies, self.moe_k)
        for name in names:
            _known(name)
        return names

    def check(self) -> None:
        if self.dataset not in ZERO_SHOT:
            raise ValueError(f"unknown dataset {self.dataset!r}")
        if self.no_icl:
            return
        if self.strategy == "moe":
            self.ensemble()
            return
        _known(self.strategy)
        if self.strategy == "dpp" and self.n_icl < 2:
            raise ValueError("dpp needs at least two examples")


def _known(name: str) -> None:
    if not selection.is_local_strategy(name) and selection.normalize_strategy_name(name) not in selection.list_strategies():
        raise ValueError(f"unknown strategy {name!r}; known: {', '.join([*selection.list_strategies(), *selection.LOCAL])}")


@dataclass
class Result:
    """Scored test and calibration rows, the score column's name, MAP per split, and the examples' blocks by strategy."""

    test: DataFrame
    cal: DataFrame
    output: str
    summary: DataFrame
    blocks: dict[str, DataFrame] = field(default_factory=dict)
    chosen: dict[str, DataFrame] = field(default_factory=dict)
    subs: list[str] = field(default_factory=list)
    run_id: int | None = None


def _asked(rows: DataFrame, blocks: DataFrame | None, settings: Settings, scorer: Scorer | None, output: str, respond_with: Responder | None) -> DataFrame:
    """``rows`` with ``output`` and its call figures; each prompt holds the block of its sample, intent or corpus."""
    text = None
    if blocks is not None:
        if "sample_id" in blocks.columns:
            rows = rows.join(blocks, "sample_id", "left")
        else:
            one = blocks.withColumnRenamed("intent", "_intent")  # a row per intent
            rows = rows.join(F.broadcast(one), F.col("_intent").isNull() | (F.col("intent") == F.col("_intent")) if "intent" in rows.columns else F.lit(True), "left").drop("_intent")
        text = F.col("examples")
    intent = F.col("intent") if settings.has_intent and "intent" in rows.columns else None
    task = ZERO_SHOT[settings.dataset][1] if blocks is None else settings.task
    return score(rows, scorer, output, text, intent, task, respond_with=respond_with, profile=True, keep=written).drop("examples")


def _block_of(name: str, rows: DataFrame, pool: DataFrame, settings: Settings, embedder: Embedder, chosen: dict[str, DataFrame]) -> DataFrame:
    """The examples of a strategy for ``rows``: per sample for local strategies, else chosen once from the pool."""
    window = {"context_window": settings.context_window, "remote_ratio": settings.remote_ratio}
    if selection.is_local_strategy(name):
        return examples.local_blocks(pool, rows, name, settings.n_icl, settings.multi_intent, settings.has_intent, settings.seed, task=settings.task, embedder=embedder, **window)
    if name not in chosen:
        chosen[name] = written(examples.choose(pool, name, settings.n_icl, settings.multi_intent, settings.seed, embedder=embedder, **window), "chosen")
    return examples.global_blocks(chosen[name], settings.multi_intent, settings.has_intent, settings.seed)


def score_moe(rows: DataFrame, scorer: Scorer | None, blocks: dict[str, DataFrame], settings: Settings, output: str | None = None, respond_with: Responder | None = None) -> DataFrame:
    """``rows`` with every strategy's vector in ``sub_scores``, their weighted mean in ``output``, and summed call figures.

    A strategy that failed on a row drops out of its mean; a row is failed if all did.
    """
    output = output or f"scores_icl{settings.n_icl}_moe"
    out, parts = rows, {}
    for name, block in blocks.items():
        sub = f"_sub_{name}"
        mine = _asked(rows, block, settings, scorer, sub, respond_with).select("sample_id", *[f"{sub}{x}" for x in ("", "_ms", "_retries", "_calls")])
        out, parts[name] = out.join(mine, "sample_id", "left"), sub
    vectors = [F.col(c) for c in parts.values()]
    known = F.map_from_arrays(F.array(*[F.lit(n) for n in parts]), F.array(*vectors))
    sums = {f"{output}_{x}": sum((F.coalesce(F.col(f"{c}_{x}"), F.lit(0)) for c in parts.values()), F.lit(0)) for x in ("ms", "retries", "calls")}
    fused = out.withColumns({output: fusion.fuse_arrays(vectors, settings.weights), "sub_scores": known} | sums)
    return fused.drop(*[f"{c}{x}" for c in parts.values() for x in ("", "_ms", "_retries", "_calls")])


def run_experiment(settings: Settings, scorer: Scorer | None, pool: DataFrame, cal: DataFrame, test: DataFrame, store: RunStore | None = None, respond_with: Responder | None = None, embedder: Embedder = hashed) -> Result:
    """Choose examples, score the calibration and the test rows, evaluate, and store the run where a store is given.

    Without examples, with an ensemble (``moe``), with examples per sample (local
    strategies) or with examples chosen once, as the settings say.
    """
    settings.check()
    if settings.n_samples > 0:
        test = test.orderBy("sample_id").limit(settings.n_samples)
    blocks: dict[str, DataFrame] = {}
    chosen: dict[str, DataFrame] = {}
    names = [] if settings.no_icl else settings.ensemble() if settings.strategy == "moe" else [settings.strategy]

    def scored(rows: DataFrame, split: str) -> DataFrame:
        mine = {n: _block_of(n, rows, pool, settings, embedder, chosen) for n in names}
        if split == "test":
            blocks.update(mine)
        if settings.strategy == "moe" and not settings.no_icl:
            out = score_moe(rows, scorer, mine, settings, settings.output, respond_with)
        else:
            out = _asked(rows, mine.get(settings.strategy), settings, scorer, settings.output, respond_with)
        return written(evaluate(out, settings.output), split)

    done, held = scored(test, "test"), scored(cal, "cal")
    both = done.select(F.lit("test").alias("split"), F.col(f"{settings.output}_ap").alias("ap")).unionByName(held.select(F.lit("cal").alias("split"), F.col(f"{settings.output}_ap").alias("ap")))
    result = Result(done, held, settings.output, precision.summarize(both, ("split",)), blocks, chosen, names if settings.strategy == "moe" and not settings.no_icl else [])
    if store is not None:
        result.run_id = store_experiment(store, settings, result)
    return result


def aggregates(scored: DataFrame, output: str, multi_intent: bool = False) -> dict:
    """What a run stores about its rows: MAP, deviation, percentiles, counts, intents and failures."""
    aps = scored.select(F.lit("run").alias("strategy"), "sample_id", F.col(f"{output}_ap").alias("ap"), *(["intent"] if "intent" in scored.columns else []))
    r = precision.ap_stats(aps).first()
    failed = scored.where(F.col(output).isNull())
    totals = profile_of(scored, output).first()
    n_scored, n_failed = (totals["n_success"], totals["n_failed"]) if totals else (0, 0)
    out = {
        "mean_ap": r and r["mean_ap"], "std_ap": r and r["std_ap"], "n_samples_scored": n_scored, "n_samples_failed": n_failed, "n_retries_total": int(totals["retries"] or 0),
        "error_rate": n_failed / (n_scored + n_failed) if n_scored + n_failed else 0.0, "total_duration_ms": totals["total_ms"], "total_llm_time_ms": totals["total_ms"], "avg_sample_time_ms": totals["avg_sample_ms"],
    }
    if r and r["mean_ap"] is not None:
        out["ap_percentiles"] = (r["p5"], r["p25"], r["p50"], r["p75"], r["p95"], r["min_ap"], r["max_ap"])
    if multi_intent and "intent" in scored.columns:
        out["intent_metrics"] = {m["intent"]: (m["mean_ap"], m["n_success"]) for m in precision.intent_metrics(aps.where("ap IS NOT NULL")).collect() if m["intent"] is not None}  # a row per intent
    if n_failed:
        first = [x["sample_id"] for x in failed.select("sample_id").orderBy("sample_id").limit(20).collect()]
        out["error_summary"] = (n_failed, out["error_rate"], {"scoring_failure": n_failed}, [(int(i), "Scoring failed (null scores)", 0) for i in first])
    return out


def _described(settings: Settings, result: Result, name: str | None = None) -> tuple[str, dict, dict[str, str]]:
    """(strategy name, its parameters, the examples' text by intent) of a run, or of one strategy of an ensemble."""
    suffix = f"_{settings.name_suffix}" if settings.name_suffix else ""
    if settings.no_icl:
        return f"icl0{suffix}", {"strategy_name": f"icl0{suffix}", "n_icl": 0, "k": 0}, {}
    if name is None and result.subs:
        title = f"moe{len(result.subs)}{suffix}"
        weights = settings.weights or [1 / len(result.subs)] * len(result.subs)
        return title, {"strategy_name": title, "n_icl_examples": settings.n_icl, "k": settings.n_icl, "fusion_method": "score_average", "sub_strategies": result.subs, "weights": weights}, {"default": "MoE fusion (see sub_strategies in metadata)"}
    name = name or settings.strategy
    params: dict = {"strategy_name": name, "n_icl_examples": settings.n_icl, "k": settings.n_icl}
    texts: dict[str, str] = {}
    if name in result.chosen:
        picks = result.chosen[name].select("sample_id", "rank", *(["intent"] if "intent" in result.chosen[name].columns else [])).collect()  # n_icl rows an intent
        params["sample_indices"] = [r["sample_id"] for r in sorted(picks, key=lambda r: (str(r["intent"]) if settings.multi_intent else "", r["rank"]))]
        if settings.multi_intent:
            by: dict[str, list] = {}
            for r in sorted(picks, key=lambda r: r["rank"]):
                by.setdefault(str(r["intent"]), []).append(r["sample_id"])
            params["sample_indices_by_intent"] = by
        texts = {r["intent"] or "default": r["examples"] for r in result.blocks[name].collect()}
    return name, params, texts


def _store_one(store: RunStore, settings: Settings, result: Result, test: DataFrame, cal: DataFrame | None, output: str, name: str | None, run_name: str | None, subs: bool) -> int:
    dataset = store.get_or_create("datasets", settings.dataset, has_intent=settings.has_intent)
    model = store.get_or_create("models", settings.model, provider=settings.provider)
    title, params, texts = _described(settings, result, name)
    run_id = store.create_run(dataset["id"], model["id"], name=run_name, metadata=json.dumps(params))
    store.start_run(run_id)
    prompt = {"template": scoring_template(settings)} | {f"icl_examples.{k}": v for k, v in texts.items()}
    values = aggregates(test, output, settings.multi_intent)
    store.complete_run(run_id, icl_strategy_name=title, icl_strategy_params=json.dumps(params), prompt_content=prompt, **({"tags": settings.tags} if settings.tags else {}), **values)
    for split, rows in (("test", test), ("cal", cal)):
        if rows is not None:
            # Questions as intents are as many as samples, and not stored with them.
            rows = rows.drop("intent") if settings.dataset == "hotpotqa" else rows
            store.store_samples(run_id, rows, output, f"{output}_ap", split=split, sub_scores="sub_scores" if subs and split == "test" else None)
    return run_id


def scoring_template(settings: Settings) -> str:
    """The fixed part of the prompts of a run."""
    return "\n\n".join([WITH_INTENT if settings.has_intent else WITHOUT_INTENT, *([f"Task: {settings.task}"] if settings.task else []), RULE])


def store_experiment(store: RunStore, settings: Settings, result: Result) -> int:
    """Store the run and its samples; an ensemble's strategies follow as runs of their own."""
    run_id = _store_one(store, settings, result, result.test, result.cal, result.output, None, settings.run_name, bool(result.subs))
    if settings.store_sub_strategies:
        for name in result.subs:
            sub = f"scores_icl{settings.n_icl}_{selection.normalize_strategy_name(name)}"
            zero = {f"{sub}_{x}": F.lit(v) for x, v in (("ms", 0.0), ("retries", 0), ("calls", 0))}
            rows = evaluate(result.test.withColumns({sub: F.col("sub_scores")[name]} | zero), sub)
            _store_one(store, settings, result, rows, None, sub, name, f"icl{settings.n_icl}_{name}", False)
    return run_id
