"""Prompt text as expressions: numbered units, examples, scoring and retry prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DEFAULT_INTENT

RULE = "Answer with one JSON object that maps every unit number to a relevance between 0 and 1."
WITH_INTENT = "Rate how relevant each unit is to the intent."
WITHOUT_INTENT = "Rate how relevant each unit is to the gist of the document."
#: Tasks of the seven corpora for prompts without examples; an empty one has no task line.
ZERO_SHOT = {
    "puma": (True, "Choose the parts of the answers that take the given perspective."),
    "subsume": (True, "Choose the sentences that serve the query."),
    "ectsum": (False, "Choose the statements that belong in a summary of the earnings call."),
    "physionet": (False, "Choose the claims that hold protected health information."),
    "hotpotqa": (True, "Choose the sentences that help answer the question."),
    "evidence_inference": (False, "Choose the sentences that report evidence of an effect."),
    "contractnli": (True, "Choose the spans that support or contradict the hypothesis."),
}


def numbered(units: Column) -> Column:
    """``i. text`` lines, from 0."""
    return F.array_join(F.transform(units, lambda x, i: F.concat(i.cast("string"), F.lit(". "), x)), "\n")


def score_dict(labels: Column, high: float = 1.0, low: float = 0.0) -> Column:
    """Labels as a map from index to score, in numeric order."""
    return F.map_from_entries(F.transform(labels, lambda y, i: F.struct(i.cast("string").alias("key"), F.when(y == 1, F.lit(high)).otherwise(F.lit(low)).alias("value"))))


def format_scores(scores: Column) -> Column:
    """A JSON object with keys in numeric order."""
    order = F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct(e["key"].cast("int").alias("k"), e["value"].alias("v"))))
    return F.concat(F.lit("{"), F.array_join(F.transform(order, lambda e: F.concat(F.lit('"'), e["k"].cast("string"), F.lit('": '), e["v"].cast("string"))), ", "), F.lit("}"))


def example(units: Column, labels: Column, intent: Column | None = None, min_negatives: int = 2, seed: Column | None = None) -> Column:
    """One contrastive example: numbered units, every positive, and sampled negatives in order.

    There are as many negatives as positives, at least ``min_negatives``; the sample
    follows a hash of seed and position.
    """
    pairs = F.transform(units, lambda x, i: F.struct(i.alias("i"), x.alias("x"), F.get(labels, i).alias("y"), F.xxhash64(i, seed if seed is not None else F.lit(0)).alias("h")))
    positive = F.filter(pairs, lambda p: p["y"] == 1)
    negative = F.filter(pairs, lambda p: p["y"] != 1)
    count = F.greatest(F.size(positive), F.lit(min_negatives))
    drawn = F.array_sort(F.transform(F.slice(F.array_sort(F.transform(negative, lambda p: F.struct(p["h"].alias("h"), p["i"].alias("i"), p["x"].alias("x")))), F.lit(1), count), lambda p: F.struct(p["i"].alias("i"), p["x"].alias("x"))))
    line = lambda p: F.concat(F.lit("- ["), p["i"].cast("string"), F.lit("] "), p["x"])
    head = F.concat(F.lit("Intent: "), intent, F.lit("\n")) if intent is not None else F.lit("")
    return F.concat(head, F.lit("Units:\n"), numbered(units), F.lit("\nRelevant:\n"), F.array_join(F.transform(positive, line), "\n"), F.lit("\nNot relevant:\n"), F.array_join(F.transform(drawn, line), "\n"), F.lit("\nScores: "), format_scores(score_dict(labels)))


def examples_block(examples: Column) -> Column:
    """Numbered examples from an ordered array."""
    return F.array_join(F.transform(examples, lambda e, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit("\n"), e)), "\n\n")


def scoring_prompt(units: Column, intent: Column | None = None, examples: Column | None = None, task: str = "") -> Column:
    """The prompt of one document; a missing intent is the default one."""
    parts = [F.lit(WITH_INTENT if intent is not None else WITHOUT_INTENT)]
    if task:
        parts.append(F.lit(f"Task: {task}"))
    if examples is not None:
        parts.append(examples)
    if intent is not None:
        parts.append(F.concat(F.lit("Intent: "), F.coalesce(intent, F.lit(DEFAULT_INTENT))))
    return F.concat_ws("\n\n", *parts, F.concat(F.lit("Units:\n"), numbered(units)), F.lit(RULE))


def missing_prompt(units: Column, indices: Column, intent: Column | None = None, examples: Column | None = None, task: str = "") -> Column:
    """The retry prompt: only the missing units, under their original numbers."""
    lines = F.array_join(F.filter(F.transform(units, lambda x, i: F.when(F.array_contains(indices, i.cast("string")), F.concat(i.cast("string"), F.lit(". "), x))), lambda x: x.isNotNull()), "\n")
    parts = [F.lit("Some units have no score yet. " + (WITH_INTENT if intent is not None else WITHOUT_INTENT))]
    if task:
        parts.append(F.lit(f"Task: {task}"))
    if examples is not None:
        parts.append(examples)
    if intent is not None:
        parts.append(F.concat(F.lit("Intent: "), F.coalesce(intent, F.lit(DEFAULT_INTENT))))
    return F.concat_ws("\n\n", *parts, F.concat(F.lit("Units:\n"), lines), F.lit(RULE))


def zero_shot(dataset: str, units: Column, intent: Column | None = None) -> Column:
    """The prompt without examples for one of the seven corpora."""
    needs, task = ZERO_SHOT[dataset.lower()]
    if needs and intent is None:
        raise ValueError(f"{dataset} needs an intent")
    return scoring_prompt(units, intent if needs else None, task=task)
