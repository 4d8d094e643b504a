"""Few-shot examples from a pool to the text of a prompt: windowing, choice, formatting.

A pool holds the rows of a corpus's pool split, which is bounded; a block is the
formatted examples of one intent, of the whole corpus, or of one sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions.embedding import Embedder, hashed, input_text
from ..functions.text import windowed_udf
from ..session import written
from . import retrieval, selection
from .precision import windowing_guard

N_ICL, SEED, MIN_NEGATIVES = 3, 3, 2


def should_window(pool: DataFrame) -> bool:
    """Whether a pool's documents are long, or positives rare, on average."""
    row = windowing_guard(pool.select(F.col("input_unit_labels").alias("labels"))).first()
    return bool(row and row["windowed"])


def window_pool(pool: DataFrame, context_window: int, min_negatives: int = 3, remote_ratio: float = 0.5, seed: int = SEED) -> DataFrame:
    """Every row cut to its positives, their surroundings and some far negatives; rows without positives go.

    A row's seed is ``seed`` and its place in order of sample_id.
    """
    place = F.row_number().over(Window.orderBy("sample_id")) - 1  # a pool is bounded
    cut = windowed_udf(context_window, min_negatives, remote_ratio)
    rows = pool.withColumn("_seed", (place + seed).cast("int")).withColumn("_w", cut("input_units", "input_unit_labels", "_seed"))
    kept = rows.where("_w.units IS NOT NULL").withColumn("input_units", F.col("_w.units")).withColumn("input_unit_labels", F.col("_w.labels"))
    return kept.select(*pool.columns)


def _windowed(pool: DataFrame, context_window: int | None, min_negatives: int, remote_ratio: float, seed: int) -> DataFrame:
    if context_window is None or not should_window(pool):
        return pool
    return window_pool(pool, context_window, min_negatives, remote_ratio, seed)


def candidates(pool: DataFrame, strategy: str, embedder: Embedder = hashed) -> DataFrame:
    """A pool as a strategy sees it: ``(id, intent, labels)`` and, where it needs them, ``embedding`` or the ``units``' vectors.

    Vectors are written out, so that no expression that uses them computes them again.
    """
    text = input_text(F.col("input") if "input" in pool.columns else None, F.col("input_units"))
    intent = F.col("intent") if "intent" in pool.columns else F.lit("")
    base = selection.normalize_strategy_name(strategy)
    rows = pool.select(F.col("sample_id").alias("id"), intent.alias("intent"), F.col("input_unit_labels").alias("labels"), *([embedder(text).alias("embedding")] if base not in (*selection.BY_LABELS, *selection.BY_UNITS) else []), *([F.transform("input_units", lambda u: embedder(u)).alias("units")] if base in selection.BY_UNITS else []))
    return rows if base in selection.BY_LABELS else written(rows, "candidates")


def choose(pool: DataFrame, strategy: str, n_icl: int = N_ICL, multi_intent: bool = False, seed: int = SEED, context_window: int | None = None, min_negatives: int = 3, remote_ratio: float = 0.5, embedder: Embedder = hashed) -> DataFrame:
    """The chosen (and windowed) pool rows with their ``rank``; up to ``n_icl`` of every intent where there are several."""
    rows = _windowed(pool, context_window, min_negatives, remote_ratio, seed)
    name = selection.resolve_strategy_name(strategy, multi_intent and "intent" in rows.columns)
    picks = selection.select(candidates(rows, name, embedder), name, n_icl).select(F.col("id").alias("sample_id"), "rank")
    return rows.join(picks, "sample_id")


def formatted(rows: DataFrame, has_intent: bool = True, seed: int = SEED, min_negatives: int = MIN_NEGATIVES) -> DataFrame:
    """``rows`` with the text of their ``example``."""
    intent = F.col("intent") if has_intent and "intent" in rows.columns else None
    return rows.withColumn("example", prompts.example(F.col("input_units"), F.col("input_unit_labels"), intent, min_negatives, F.lit(seed)))


def _blocks(ranked: DataFrame, by: list[str]) -> DataFrame:
    packed = ranked.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "example"))).alias("_e"))
    return packed.select(*by, prompts.examples_block(F.transform("_e", lambda e: e["example"])).alias("examples"))


def global_blocks(chosen: DataFrame, multi_intent: bool = False, has_intent: bool = True, seed: int = SEED) -> DataFrame:
    """``(intent, examples)``: a block per intent, or one whose intent is null for all samples."""
    rows = formatted(chosen, has_intent, seed)
    if not multi_intent or "intent" not in chosen.columns:
        rows = rows.withColumn("intent", F.lit(None).cast("string"))
    return _blocks(rows, ["intent"])


def local_choice(pool: DataFrame, queries: DataFrame, strategy: str, n_icl: int = N_ICL, by_intent: bool = False, task: str = "", embedder: Embedder = hashed) -> DataFrame:
    """``(query_id, rank, id)``: the pool rows nearest to every query, by BM25 or by cosine of vectors.

    With ``by_intent`` both sides' texts begin with their intent and only rows of the query's intent are searched.
    """
    if not selection.is_local_strategy(strategy):
        raise ValueError(f"unknown local strategy {strategy!r}; known: {', '.join(selection.LOCAL)}")

    def side(rows: DataFrame) -> DataFrame:
        text = input_text(F.col("input") if "input" in rows.columns else None, F.col("input_units"))
        intent = F.col("intent") if by_intent else None
        return rows.select(F.col("sample_id").alias("id"), *(["intent"] if by_intent else []), retrieval.retrieval_text(text, intent, task).alias("text"))

    q, p, group = side(queries), side(pool), "intent" if by_intent else None
    if strategy == "bm25":
        return retrieval.bm25(q, p, n_icl, group).select("query_id", "rank", "id")
    vector = lambda rows: written(rows.withColumn("embedding", embedder(F.col("text"))).drop("text"), "vectors")
    return retrieval.knn(vector(q), vector(p), n_icl, group).select("query_id", "rank", "id")


def local_blocks(pool: DataFrame, queries: DataFrame, strategy: str, n_icl: int = N_ICL, multi_intent: bool = False, has_intent: bool = True, seed: int = SEED, context_window: int | None = None, min_negatives: int = 3, remote_ratio: float = 0.5, task: str = "", embedder: Embedder = hashed) -> DataFrame:
    """``(sample_id, examples)``: a block of its own for every query.

    The search sees whole pool rows; the examples are windowed, and rows without positives left out.
    """
    found = local_choice(pool, queries, strategy, n_icl, multi_intent and has_intent, task, embedder)
    texts = formatted(_windowed(pool, context_window, min_negatives, remote_ratio, seed), has_intent, seed).select(F.col("sample_id").alias("id"), "example")
    ranked = found.join(texts, "id").withColumnRenamed("query_id", "sample_id")
    return _blocks(ranked, ["sample_id"])
