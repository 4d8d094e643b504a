"""Temperature mixing of sources to target weights, in DataFrame expressions only.

Source token shares are raised to an exponent and normalised.  The exponent is
bisected: to the mixture of a target entropy, then upwards as far as the limit on
repetitions asks for.  Each step of the bisection tries ``FAN`` points of the interval
in one aggregation over the sources, so their number has no limit.  The weights become
token quotas of a budget, and each source is read in seeded permutations, a new one in
every epoch, until its quota is met; the quota is cut into equal blocks so that every
block has the target mixture.

Cumulative tokens inside a source are two-level prefix sums over about sqrt(rows)
hash ranges, so a source with a third of all rows is spread like any other.

Defined results: null source is a source of its own; null text has no words;
documents without words take no quota and appear once per epoch that reaches them;
a source without any words has no share and no epoch, so its documents are left
out, as in the query's SQL, and a table without words gives no rows;
rows that share a doc_id are separate documents; extra columns are kept; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Share of the largest possible entropy that the mixture aims at.
TARGET_ENTROPY = 0.97
MAX_REPEATS = 4.0
BLOCKS = 64
SEED = 11
#: Parts that one step cuts the exponent's interval into, and its width at the end.
FAN = 256
WIDTH = 2.0**-50
WORDS = r"[^\x20\x09-\x0D]+"


def _tried(shares: DataFrame, lo: float, hi: float) -> list[tuple[float, float, float]]:
    """(exponent, entropy, largest weight over share) at ``FAN + 1`` points of an interval, in one aggregation."""
    points = shares.select("s", F.explode(F.sequence(F.lit(0), F.lit(FAN))).alias("k")).withColumn("x", F.lit(lo) + (hi - lo) * F.col("k") / FAN)
    power = F.pow("s", "x")
    sums = points.groupBy("k", "x").agg(F.sum(power).alias("z"), F.sum(power * F.log("s")).alias("l"), F.max(power / F.col("s")).alias("m"))
    entropy = F.log("z") - F.col("x") * F.col("l") / F.col("z")
    return [tuple(r)[1:] for r in sorted(sums.select("k", "x", entropy, F.col("m") / F.col("z")).collect())]


def solve(shares: DataFrame, entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, budget: float = 1.0) -> float:
    """The exponent for ``shares(s)`` of all sources that hold tokens; ``budget`` is in units of all tokens.

    It lies in [0, 1]: 1 keeps the shares, 0 makes them equal.
    """
    goal = entropy * math.log(max(shares.count(), 1))

    def last(lo: float, hi: float, holds) -> tuple[float, float]:
        """The ends of the part, ``WIDTH`` wide, in which ``holds`` turns from true to false."""
        while hi - lo > WIDTH:
            tried = _tried(shares, lo, hi)
            k = max([i for i, t in enumerate(tried[:-1]) if holds(t)], default=0)
            if (tried[k][0], tried[k + 1][0]) == (lo, hi):
                break
            lo, hi = tried[k][0], tried[k + 1][0]
        return lo, hi

    peaked = lambda t: t[1] < goal
    often = lambda t: t[2] * budget > max_repeats
    ends = _tried(shares, 0.0, 1.0)
    exponent, now = 1.0, ends[-1]
    if peaked(now):
        exponent = last(0.0, 1.0, lambda t: not peaked(t))[0]
        now = _tried(shares, exponent, exponent)[0]
    return last(exponent, 1.0, often)[1] if often(now) and exponent < 1.0 else exponent


def quotas(sources: DataFrame, entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, budget: float = 1.0) -> DataFrame | None:
    """``sources(_mx_src, t, c)`` with their weight and quota of tokens; None without tokens."""
    total = sources.agg(F.sum("t")).first()[0] or 0
    if total == 0:
        return None
    live = sources.where("t > 0").withColumn("s", F.col("t") / float(total))
    exponent = solve(live.select("s"), entropy, max_repeats, budget)
    z = live.agg(F.sum(F.pow("s", F.lit(exponent)))).first()[0]
    weight = F.round(F.pow("s", F.lit(exponent)) / z, 9)
    return live.select("_mx_src", F.col("t").alias("_mx_total"), weight.alias("_mx_weight"), F.floor(weight * (budget * total)).cast("long").alias("_mx_quota"), F.greatest(F.lit(1), F.floor(F.sqrt("c"))).cast("long").alias("_mx_ranges"))


def mix_sources(docs: DataFrame, tokens: str | None = None, budget: float = 1.0, entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """``docs`` repeated or left out to meet the mixture, with ``epoch`` and ``block``.

    ``tokens`` names a column of token counts; without it words of ``text`` count.
    Nulls, repeats, ties and empty tables: see the module's defined results.
    """
    count = F.col(tokens).cast("long") if tokens else F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    keep = [c for c in docs.columns if c not in ("epoch", "block")]
    rows = docs.select(*keep, F.coalesce(count, F.lit(0)).cast("long").alias("_mx_n"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("_mx_src"))
    sources = materialise(rows.groupBy("_mx_src").agg(F.sum("_mx_n").alias("t"), F.count(F.lit(1)).alias("c")), "sources")
    quota = quotas(sources, entropy, max_repeats, budget)
    if quota is None:
        return rows.where("false").select(*keep, F.lit(0).cast("long").alias("epoch"), F.lit(0).cast("long").alias("block"))
    epochs = F.expr("if(_mx_quota = 0, array(), sequence(0L, (_mx_quota - 1) div _mx_total))")
    # A row per source: small sides are broadcast by their size, a hot source of a larger one is split by the join.
    read = rows.join(materialise(quota, "quota"), "_mx_src").withColumn("epoch", F.explode(epochs))
    read = read.withColumn("_mx_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    ranged = read.withColumn("_mx_range", F.expr("cast(conv(substr(_mx_key, 1, 8), 16, 10) as bigint) * _mx_ranges div 4294967296"))
    part = ["_mx_src", "epoch", "_mx_range"]
    sizes = ranged.groupBy(*part).agg(F.sum("_mx_n").alias("_mx_sum"))
    before = Window.partitionBy("_mx_src", "epoch").orderBy("_mx_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*part, F.coalesce(F.sum("_mx_sum").over(before), F.lit(0)).alias("_mx_base"))
    inside = Window.partitionBy(*part).orderBy("_mx_key", "_mx_n").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_mx_at", F.coalesce(F.sum("_mx_n").over(inside), F.lit(0))).join(bases, part)
    at = placed.withColumn("_mx_at", F.col("epoch") * F.col("_mx_total") + F.col("_mx_at") + F.col("_mx_base")).where("_mx_at < _mx_quota")
    return at.select(*keep, "epoch", F.expr(f"_mx_at * {blocks} div _mx_quota").alias("block"))


def op2_temperature_mix(docs: DataFrame) -> DataFrame:
    """Every kept occurrence of a document: ``(doc_id, source, n_tokens, epoch, block)``.

    A null source is one of its own, null and empty texts have no words, repeated rows
    count each, extra columns are ignored, tables without words give no rows.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    return mix_sources(docs.select("doc_id", "source", words.alias("n_tokens")), tokens="n_tokens")


OP2_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('s' || source, '') AS s, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0)::BIGINT AS n FROM documents),
t AS (SELECT s, sum(n)::BIGINT AS t, sum(n)::DOUBLE / (SELECT sum(n) FROM d) AS share FROM d GROUP BY s),
live AS (SELECT * FROM t WHERE share > 0),
goal AS (SELECT {TARGET_ENTROPY} * ln(count(*)) AS h FROM live),
peaked(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN h < (SELECT h FROM goal) THEN lo ELSE (lo + hi) / 2 END, CASE WHEN h < (SELECT h FROM goal) THEN (lo + hi) / 2 ELSE hi END
  FROM (SELECT i, lo, hi, (SELECT ln(sum(pow(share, (lo + hi) / 2))) - sum(pow(share, (lo + hi) / 2) * (lo + hi) / 2 * ln(share)) / sum(pow(share, (lo + hi) / 2)) FROM live) AS h FROM peaked WHERE i < 50)),
start AS (SELECT CASE WHEN (SELECT -sum(share * ln(share)) FROM live) < (SELECT h FROM goal) THEN (SELECT lo FROM peaked WHERE i = 50) ELSE 1.0 END AS x),
often(i, lo, hi) AS (
  SELECT 0, x, 1.0::DOUBLE FROM start
  UNION ALL
  SELECT i + 1, CASE WHEN r > {MAX_REPEATS} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN r > {MAX_REPEATS} THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT i, lo, hi, (SELECT max(pow(share, (lo + hi) / 2) / share) / sum(pow(share, (lo + hi) / 2)) FROM live) AS r FROM often WHERE i < 50)),
final AS (
  SELECT CASE WHEN (SELECT max(pow(share, x) / share) / sum(pow(share, x)) FROM live) > {MAX_REPEATS} THEN (SELECT hi FROM often WHERE i = 50) ELSE x END AS x FROM start),
q AS (
  SELECT s, t, floor(round(pow(share, (SELECT x FROM final)) / (SELECT sum(pow(share, (SELECT x FROM final))) FROM live), 9) * (SELECT sum(n) FROM d))::BIGINT AS q FROM live),
r AS (SELECT d.doc_id, d.source, d.n, q.s, q.t, q.q, unnest(range(0, (q.q + q.t - 1) // q.t)) AS epoch FROM d JOIN q ON q.s = d.s),
c AS (
  SELECT *, epoch * t + coalesce(sum(n) OVER (PARTITION BY s, epoch ORDER BY md5('{SEED}:' || epoch || ':' || coalesce(doc_id::VARCHAR, '')), n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM r)
SELECT doc_id, source, n AS n_tokens, epoch, (pos * {BLOCKS}) // q AS block FROM c WHERE pos < q
"""
