"""Multi-party perspective rotation of dialogues, in DataFrame expressions only.

Each participant of a conversation in turn is the assistant; the others become
named users, system turns stay system turns, and only the assistant's words (and
their end mark) are trained on.  Every dialogue is rendered in segments of ``SEGMENT``
consecutive turns, so no row or task holds an unbounded conversation; segments follow
each other in order and concatenate to the whole rendering.

A turn's place in its conversation is a sum over three levels: turns of earlier
ranges of turn numbers, of earlier turn numbers and text hashes in the range, and of
earlier rows with the same number and hash.  Equal rows are counted, not listed, until
they are rendered.  So neither a long conversation, nor one with many rows of one turn
number, is gathered or sorted as a whole.

Marks in names and texts are escaped: a backslash is put in before the ``|`` of every
``<|`` and before the ``>`` of every ``|>``, after any backslashes there; taking one
backslash out of each gives the original.

Defined results: null text is empty; a null role is the participant ``unknown``;
a null turn sorts before turn 0; rows without conv_id belong to no dialogue and
give no row; turns of one number follow in the order of their text's md5, then role;
repeated rows are rendered each; a dialogue with system turns only has no participant
and gives no row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Turns of one rendered segment.
SEGMENT = 64
#: Turn numbers of one range of the first level.
RANGE = 64
END = "<|end|>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|"), r"\|(\\*)>", r"|$1\\>")


def places(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, key, n, at)``: distinct rows, how often they occur, and the place of the first."""
    said = turns.where("conv_id IS NOT NULL").select("conv_id", F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # Written out: the sums of all three levels and the participants are read off it.
    rows = materialise(said.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n")), "turns")
    rows = rows.withColumn("key", F.md5("text")).withColumn("range", F.floor(F.col("turn") / RANGE).cast("long")).withColumn("hash", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "range", "turn", "hash").agg(F.sum("n").alias("n"))
    inner = F.coalesce(F.sum("n").over(earlier(Window.partitionBy("conv_id", "range").orderBy("turn", "hash"))), F.lit(0))
    ranges = sums.groupBy("conv_id", "range").agg(F.sum("n").alias("n"))
    outer = F.coalesce(F.sum("n").over(earlier(Window.partitionBy("conv_id").orderBy("range"))), F.lit(0))
    bases = sums.select("conv_id", "range", "turn", "hash", inner.alias("inner")).join(ranges.select("conv_id", "range", outer.alias("outer")), ["conv_id", "range"])
    own = F.coalesce(F.sum("n").over(earlier(Window.partitionBy("conv_id", "turn", "hash").orderBy("key", "role"))), F.lit(0))
    placed = rows.withColumn("own", own).join(bases.select("conv_id", "turn", "hash", (F.col("inner") + F.col("outer")).alias("base")), ["conv_id", "turn", "hash"])
    return placed.select("conv_id", "turn", "role", "text", "key", "n", (F.col("base") + F.col("own")).alias("at"))


def rotate(turns: DataFrame, segment: int = SEGMENT, end: str = END) -> DataFrame:
    """``(conv_id, perspective, segment, n_turns, n_trained, rendered, mask)``, a row per participant and ``segment`` turns.

    ``mask`` is ``array<struct<start, end>>`` in code points of ``rendered``.  Nulls,
    repeats, ties and empty tables: see the module's defined results.
    """
    rows = materialise(places(turns), "places")
    people = rows.where("role <> 'system'").select("conv_id", F.col("role").alias("perspective")).distinct()
    cut = rows.withColumn("segment", F.explode(F.sequence(F.expr(f"at div {segment}"), F.expr(f"(at + n - 1) div {segment}"))))
    first, last = F.greatest(F.col("at"), F.col("segment") * segment), F.least(F.col("at") + F.col("n"), (F.col("segment") + 1) * segment)
    cut = cut.withColumn("copies", (last - first).cast("int")).withColumn("at", first).withColumn("role_text", escaped(F.col("role"))).withColumn("body", F.concat(escaped(F.col("text")), F.lit(end)))
    seen = cut.join(people, "conv_id")
    own = F.col("role") == F.col("perspective")
    head = F.when(F.col("role") == "system", F.lit("<|system|>\n")).when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), F.col("role_text"), F.lit("|>\n")))
    piece = F.struct("at", "copies", head.alias("head"), "body", (own & (F.col("role") != "system")).alias("own"))
    lists = seen.groupBy("conv_id", "perspective", "segment").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    every = F.flatten(F.transform("p", lambda x: F.array_repeat(x, x["copies"])))
    spans = F.expr(
        "aggregate(p, struct(0 AS at, cast(array() as array<struct<start:int,end:int>>) AS m), (a, x) -> struct(a.at + length(x.head) + length(x.body) AS at, "
        "if(x.own, concat(a.m, array(struct(a.at + length(x.head) AS start, a.at + length(x.head) + length(x.body) AS end))), a.m) AS m)).m"
    )
    return lists.withColumn("p", every).select("conv_id", "perspective", "segment", F.size("p").cast("long").alias("n_turns"), F.size(F.filter("p", lambda x: x["own"])).cast("long").alias("n_trained"), F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"])), "").alias("rendered"), spans.alias("mask"))


def op9_perspectives(turns: DataFrame) -> DataFrame:
    """``rotate`` with the mask as ``start:end`` pairs joined by commas; its defined results hold."""
    mask = F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rotate(turns).select("conv_id", "perspective", "segment", "n_turns", "n_trained", "rendered", mask.alias("mask"))


OP9_SQL = rf"""
WITH t AS (
  SELECT conv_id, coalesce(turn, -1)::BIGINT AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, md5(text), role) - 1) AS at FROM t),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
e AS (
  SELECT *, regexp_replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), '\|(\\*)>', '|\1\\>', 'g') AS name,
         regexp_replace(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g'), '\|(\\*)>', '|\1\\>', 'g') || '<|end|>' || chr(10) AS body FROM s),
j AS (
  SELECT e.conv_id, p.perspective, at // {SEGMENT} AS segment, at, role = perspective AS own, body,
         CASE WHEN role = 'system' THEN '<|system|>' WHEN role = perspective THEN '<|assistant|>' ELSE '<|user name=' || name || '|>' END || chr(10) AS head
  FROM e JOIN p ON p.conv_id = e.conv_id),
o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, segment ORDER BY at ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM j)
SELECT conv_id, perspective, segment, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_trained, string_agg(head || body, '' ORDER BY at) AS rendered,
       coalesce(string_agg((stop - length(body))::VARCHAR || ':' || stop::VARCHAR, ',' ORDER BY at) FILTER (WHERE own), '') AS mask
FROM o GROUP BY conv_id, perspective, segment
"""
