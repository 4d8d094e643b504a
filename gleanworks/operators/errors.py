"""Error analysis: categories from messages, counts, patterns, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ordered rules (pattern, category, error type, severity, action); the first match counts.
RULES = (
    (r"rate.?limit|too.?many.?requests|429|quota.?exceeded", "rate_limit", "rate_limit_exceeded", "low", "Reduce concurrency or add delay between requests"),
    (r"timeout|timed?.?out|deadline.?exceeded|request.?took.?too.?long", "timeout", "request_timeout", "low", "Increase timeout or reduce input length"),
    (r"context.?length|token.?limit|maximum.?context|too.?long|max.?tokens", "context_length", "context_length_exceeded", "medium", "Reduce input length or use chunking"),
    (r"content.?filter|safety|blocked|harmful|inappropriate|refused", "content_filter", "content_filtered", "medium", "Review input content for policy violations"),
    (r"authentication|unauthorized|invalid.?api.?key|401|forbidden|403", "authentication", "auth_failed", "critical", "Check API key configuration"),
    (r"connection.?error|network|dns|unreachable|connection.?refused|502|503|504", "network_error", "network_error", "low", "Check network connectivity, retry later"),
    (r"json|parse|decode|invalid.?json|expecting.?value|unterminated", "parsing_error", "json_parse_error", "medium", "LLM returned malformed JSON, may need prompt adjustment"),
    (r"missing.?key|key.?error|required.?field|validation|missing.?score", "validation_error", "missing_required_field", "medium", "LLM response missing expected fields"),
    (r"score.?format|invalid.?score|score.?out.?of.?range|not.?a.?number", "validation_error", "invalid_score_format", "medium", "LLM returned score in unexpected format"),
    (r"empty.?response|no.?content|blank|null.?response", "parsing_error", "empty_response", "medium", "LLM returned empty response, may need retry"),
    (r"api.?error|service.?unavailable|internal.?error|500", "api_error", "api_internal_error", "low", "Transient API error, retry should resolve"),
    (r"model.?not.?found|invalid.?model|model.?overloaded", "api_error", "model_error", "high", "Check model name or try different model"),
)
# What a message without a match is, and the action suggested for each category.
NO_MATCH = ("", "unknown", "unknown_error", "high", "")
ACTIONS = {
    "api_error": "Retry the request or check API status",
    "rate_limit": "Reduce concurrency or add delay between requests",
    "timeout": "Increase timeout or reduce input length",
    "parsing_error": "Check LLM response format, adjust prompt",
    "validation_error": "Review prompt template for missing instructions",
    "context_length": "Reduce input length or use chunking",
    "content_filter": "Review input content for policy violations",
    "authentication": "Check API key configuration",
    "network_error": "Check network connectivity, retry later",
    "unknown": "Investigate error details manually",
}
SEVERITIES = ("low", "medium", "high", "critical")
# Upper bounds of the input length buckets.
BUCKETS = (100, 500, 1000, 2000, 5000)
_KINDS = ("category", "error_type", "severity")


def _first_rule(message: Column, pick: int) -> Column:
    lowered, out = F.lower(F.coalesce(message, F.lit(""))), F.lit(NO_MATCH[pick])
    for rule in reversed(RULES):
        out = F.when(lowered.rlike("(?d)" + rule[0]), rule[pick]).otherwise(out)
    return out


def categorize(errors: DataFrame, message: str = "message") -> DataFrame:
    """Adds category, error_type and severity by the first rule that matches, and the category's suggested action."""
    out = errors.withColumns({name: _first_rule(F.col(message), i) for i, name in enumerate(_KINDS, start=1)})
    return out.withColumn("action", F.create_map(*[x for kv in ACTIONS.items() for x in map(F.lit, kv)])[F.col("category")])


def counts(categorized: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, dimension, value, n)`` by category, error type and severity, in one pass."""
    out = categorized.groupingSets([[*by, k] for k in _KINDS], *by, *_KINDS).agg(F.count(F.lit(1)).alias("n"), *[F.grouping(k).alias(f"_{k}") for k in _KINDS])
    dimension = F.coalesce(*[F.when(F.col(f"_{k}") == 0, F.lit(k)) for k in _KINDS])
    value = F.coalesce(*[F.when(F.col(f"_{k}") == 0, F.col(k)) for k in _KINDS])
    return out.select(*by, dimension.alias("dimension"), value.alias("value"), "n")


def analyze(categorized: DataFrame, by: tuple[str, ...] = (), total: int | None = None) -> DataFrame:
    """``counts`` with the group's errors, the share of them that each row makes up, and the error and success rates.

    ``total`` is the number of samples; without it the errors themselves are the total.
    """
    rows = counts(categorized, by)
    sums = rows.where("dimension = 'category'").groupBy(*[F.col(b).alias(f"_{b}") for b in by]).agg(F.sum("n").alias("total_errors"))
    if by:
        match = F.lit(True)
        for b in by:
            match = match & F.col(b).eqNullSafe(F.col(f"_{b}"))
        both = rows.join(sums, match)
    else:
        both = rows.crossJoin(F.broadcast(sums))  # one row
    out = both.withColumn("error_rate", rate(F.col("total_errors"), F.lit(total) if total is not None else F.col("total_errors")))
    return out.select(*by, "dimension", "value", "n", "total_errors", (F.col("n") / F.col("total_errors")).alias("share"), "error_rate", (1 - F.col("error_rate")).alias("success_rate"))


def rate(n_errors: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(n_errors, total), F.lit(0.0))


def patterns(categorized: DataFrame, min_count: int = 2) -> DataFrame:
    """Error types that occur at least ``min_count`` times, most frequent first: count, first id, its message (200 characters), category, action."""
    first = F.min_by(F.struct(F.substring("message", 1, 200).alias("example"), "category", "action"), "sample_id").alias("f")
    ranked = categorized.groupBy("error_type").agg(F.count(F.lit(1)).alias("n"), F.min("sample_id").alias("first_id"), first)
    return ranked.where(F.col("n") >= min_count).select("error_type", "n", "first_id", "f.example", "f.category", "f.action").orderBy(F.col("n").desc(), "error_type")


def pattern_members(categorized: DataFrame, min_count: int = 2) -> DataFrame:
    """``(error_type, sample_id, action)``: every error of the types that ``patterns`` returns, a row each."""
    frequent = categorized.groupBy(F.col("error_type").alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_count).select("_key")
    return categorized.join(F.broadcast(frequent), F.col("error_type") == F.col("_key"), "left_semi").select("error_type", "sample_id", "action")  # a row per rule


def timeline(errors: DataFrame, ts: str = "ts") -> DataFrame:
    """Errors by hour; unreadable times are left out."""
    when = F.col(ts) if dict(errors.dtypes)[ts].startswith("timestamp") else F.try_to_timestamp(F.col(ts))
    return errors.select(F.date_trunc("HOUR", when).alias("hour")).where("hour IS NOT NULL").groupBy("hour").agg(F.count(F.lit(1)).alias("n"))


def by_intent(categorized: DataFrame) -> DataFrame:
    """Errors of every intent by category; a missing intent is ``No Intent``."""
    return categorized.groupBy(F.coalesce("intent", F.lit("No Intent")).alias("intent"), "category").agg(F.count(F.lit(1)).alias("n"))


def analyze_by_intent(categorized: DataFrame) -> DataFrame:
    """``analyze`` of every intent; a missing intent is a group of its own."""
    return analyze(categorized, ("intent",))


def analyze_by_length(categorized: DataFrame, length: str = "input_length") -> DataFrame:
    """``analyze`` of every bucket of input lengths."""
    return analyze(categorized.withColumn("bucket", length_bucket(F.col(length))), ("bucket",))


def length_bucket(length: Column) -> Column:
    out = F.lit(f">{BUCKETS[-1]}")
    for b in reversed(BUCKETS):
        out = F.when(length <= b, f"<={b}").otherwise(out)
    return F.when(length.isNull(), "unknown").otherwise(out)


def from_runs(runs: DataFrame) -> DataFrame:
    """Error entries that runs keep in their summaries, as rows; a missing message is ``Unknown error``, missing retries are 0."""
    entry = runs.select("run_id", F.explode("error_summary.samples").alias("e"))
    return entry.select("run_id", F.col("e.index").alias("sample_id"), F.coalesce("e.message", F.lit("Unknown error")).alias("message"), F.coalesce("e.retries", F.lit(0)).alias("retries"))


def scored_samples(runs: DataFrame) -> int:
    """How many samples the runs have scored or failed."""
    return runs.agg(F.sum(F.coalesce("n_samples_scored", F.lit(0)) + F.coalesce("n_samples_failed", F.lit(0)))).first()[0] or 0


def of_run(runs: DataFrame, run_id: int) -> DataFrame:
    """``analyze`` of one run's stored errors; no rows for an unknown run."""
    one = runs.where(F.col("run_id") == run_id)
    return analyze(categorize(from_runs(one)), total=scored_samples(one))


def of_dataset(runs: DataFrame, dataset_id: int) -> DataFrame:
    """``analyze`` of the stored errors of a dataset's completed and failed runs."""
    ended = runs.where((F.col("dataset_id") == dataset_id) & F.col("status").isin("completed", "failed"))
    return analyze(categorize(from_runs(ended)), total=scored_samples(ended))


def report(categorized: DataFrame, total: int | None = None) -> str:
    """A short text of counts and the five most frequent patterns."""
    rows = counts(categorized).collect()
    n = sum(r["n"] for r in rows if r["dimension"] == "category")
    lines = [f"Errors: {n}" + (f" of {total} ({100 * n / total:.1f} %)" if total else "")]
    for d in ("category", "severity"):
        lines += [f"  {d} {r['value']}: {r['n']}" for r in sorted(rows, key=lambda r: (-r["n"], r["value"])) if r["dimension"] == d]
    lines += [f"  {r['n']} x {r['error_type']}: {r['example']}" for r in patterns(categorized).limit(5).collect()]
    return "\n".join(lines)


def export(categorized: DataFrame, path: str) -> None:
    """The errors as CSV with a header, in as many files as there are partitions."""
    names = [c for c in ("sample_id", "run_id", "intent", "category", "error_type", "severity", "message", "retries", "input_length", "action") if c in categorized.columns]
    categorized.select(*names).write.mode("overwrite").csv(path, header=True)
