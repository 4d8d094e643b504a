"""Model responses to score vectors, as expressions: strip, parse, repair, normalise, shift, fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A unit index and its number, as they occur in a broken response.
PAIR = r'"(\d+)"\s*:\s*(\d+\.?\d*)'
FENCE = r"(?s)```(?:json)?\s*(.*?)```"
MAX_MISSING = 0.25


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` reads it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def strip_thinking(content: Column) -> Column:
    """Without ``<think>`` blocks and surrounding white space."""
    return F.regexp_replace(F.regexp_replace(content, r"(?s)<think>.*?</think>", ""), r"^\s+|\s+$", "")


def _numbers(json: Column) -> Column:
    """A JSON object of numbers as a map; null where it is none or holds other values."""
    numbers = F.transform_values(F.from_json(json, "map<string,string>"), lambda _, v: v.try_cast("double"))
    whole = lambda m: F.when(F.size(F.filter(F.map_values(m), lambda v: v.isNull())) == 0, m)
    return F.when(json.rlike(r"(?s)^\s*\{.*\}\s*$"), let(numbers, whole))


def repaired(content: Column) -> Column:
    """A map from all ``"int": number`` pairs, a later pair replacing an earlier one; null without any."""

    def last(found: Column) -> Column:
        kept = F.filter(F.arrays_zip(found["k"].alias("k"), found["v"].alias("v")), lambda p, i: ~F.array_contains(F.slice(found["k"], i + 2, F.size(found["k"])), p["k"]))
        return F.when(F.size(found["k"]) > 0, F.map_from_entries(F.transform(kept, lambda p: F.struct(p["k"].alias("key"), p["v"].cast("double").alias("value")))))

    return let(F.struct(F.regexp_extract_all(content, F.lit(PAIR), F.lit(1)).alias("k"), F.regexp_extract_all(content, F.lit(PAIR), F.lit(2)).alias("v")), last)


def parse_json(content: Column) -> Column:
    """The response as a map: whole, else the first fenced block, else repaired."""
    text = strip_thinking(content)
    fenced = F.nullif(F.regexp_extract(text, FENCE, 1), F.lit(""))
    return F.coalesce(_numbers(text), _numbers(fenced), repaired(text))


def normalize(scores: Column) -> Column:
    """Any value over 1 divides all by ten; values are then clipped to [0, 1]."""
    scaled = lambda m: let(F.when(F.array_max(F.map_values(m)) > 1, 10.0).otherwise(1.0), lambda by: F.transform_values(m, lambda _, v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / by))))
    return let(scores, scaled)


def shift(scores: Column, n: Column) -> Column:
    """Keys that run from another start without gaps, exactly one per unit, moved to 0."""

    def moved(m: Column, keys: Column) -> Column:
        low = F.array_min(keys)
        whole = (F.size(keys) == n) & (F.size(F.filter(keys, lambda k: k.isNull())) == 0) & (F.array_max(keys) - low == n - 1) & (low != 0)
        return F.when(whole, let(low, lambda first: F.transform_keys(m, lambda k, _: (k.try_cast("int") - first).cast("string")))).otherwise(m)

    return let(scores, lambda m: let(F.transform(F.map_keys(m), lambda k: k.try_cast("int")), lambda keys: moved(m, keys)))


def missing(scores: Column, n: Column) -> Column:
    """Unit indices without a score."""
    return F.when(n > 0, F.array_except(F.transform(F.sequence(F.lit(0), n - 1), lambda i: i.cast("string")), F.map_keys(scores))).otherwise(F.expr("cast(array() as array<string>)"))


def parse_scores(content: Column, n: Column) -> Column:
    """Normalised map of the known unit indices; an empty map for a hopeless response."""
    known = let(shift(normalize(parse_json(content)), n), lambda m: F.map_filter(m, lambda k, _: k.try_cast("int").between(0, n - 1)))
    return F.coalesce(known, F.expr("cast(map() as map<string,double>)"))


def densify(scores: Column, n: Column, max_missing: float = MAX_MISSING) -> Column:
    """Dense vector; gaps are 0 if their share is at most ``max_missing``, else the row is null.

    Scores are put in order of their index once; a whole answer is then read off.
    """

    def dense(m: Column) -> Column:
        gaps = F.size(missing(m, n))
        at = F.array_sort(F.transform(F.filter(F.map_entries(m), lambda e: e["key"].try_cast("int").between(0, n - 1)), lambda e: F.struct(e["key"].cast("int").alias("i"), e["value"].alias("v"))))
        filled = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.try_element_at(m, i.cast("string")), F.lit(0.0)))
        vector = F.when((gaps == 0) & (F.size(at) == n), F.transform(at, lambda e: e["v"])).otherwise(filled)
        return F.when(n == 0, F.expr("cast(array() as array<double>)")).when(gaps.cast("double") / n <= max_missing, vector)

    return let(scores, dense)


# Marks of a rate limit, and the patterns of a wait in seconds, in order.
RATE_LIMIT_MARKS = ("429", "rate limit", "ratelimit", "quota", "resourceexhausted", "too many requests", "exceeded")
RETRY_DELAYS = (r"retry in (\d+\.?\d*)\s*s", r"retry_delay.*?seconds:\s*(\d+)", r"(\d+\.?\d*)\s*seconds?")


def is_rate_limit(error: Column, kind: Column | None = None) -> Column:
    """Whether an error's message, or the name of its kind, holds a mark of a rate limit."""
    held = F.lit(False)
    for mark in RATE_LIMIT_MARKS:
        for text in (error, kind):
            if text is not None:
                held = held | F.coalesce(F.contains(F.lower(text), F.lit(mark)), F.lit(False))
    return held


def retry_delay(error: Column) -> Column:
    """Seconds that an error message asks to wait, by the first pattern that fits."""
    return F.coalesce(*[F.nullif(F.regexp_extract(error, "(?id)" + p, 1), F.lit("")) for p in RETRY_DELAYS]).cast("double")


def pause_seconds(hint: float | None, strikes: int, base: float = 60, cap: float = 300, buffer: float = 5) -> float:
    """How long all tasks of a worker wait after a rate limit."""
    return hint + buffer if hint is not None else min(cap, base * 2 ** max(0, strikes - 1))
