"""Repeated three-line windows, in DataFrame expressions only.

Every three consecutive lines of a document form a window.  A window whose lines
occurred before (in a smaller doc_id, or earlier in the same document) marks its
three lines; the union of marked positions is removed.  Windows of blank lines
only are ignored, and documents of fewer than three lines have no window.

The exchange carries 128 bits of hash and a position per window, never text; the
first occurrence is a partial-aggregated minimum, so a window that fills a third
of the corpus costs one row per task.

Defined results: null text has no lines and stays null; rows without doc_id are
kept whole; rows that share a doc_id count as one place in the corpus, but each
text loses only its own windows; extra columns are kept; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hex_digest

WIDTH = 3
_POS = "cast(2147483648 as decimal(10,0))"


def windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(doc_id, t, pos, h1, h2, place)``: the text's hash, each window's first line (from 1), its hash and its place in the corpus."""
    lines = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("t"), F.split("text", "\n").alias("lines"))
    items = ", ".join(f"element_at(lines, i + {k})" for k in range(width))
    backward = ", ".join(f"element_at(lines, i + {k})" for k in reversed(range(width)))
    blank = " AND ".join(f"trim(element_at(lines, i + {k})) = ''" for k in range(width))
    cut = lines.where(F.size("lines") >= width).select(
        "doc_id",
        "t",
        F.expr(f"inline(transform(filter(sequence(1, size(lines) - {width - 1}), i -> NOT ({blank})), i -> struct(i AS pos, xxhash64({items}) AS h1, xxhash64(7, {backward}) AS h2)))"),
    )
    return cut.withColumn("place", F.expr(f"cast(doc_id as decimal(20,0)) * {_POS} + pos"))


def repeated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(doc_id, t, starts)``: the windows of each text that occurred before."""
    w = windows(docs, width)
    first = w.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = w.join(first, ["h1", "h2"]).where("place > first")
    return later.groupBy("doc_id", "t").agg(F.collect_set("pos").alias("starts"))


def drop_repeated_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and ``n_lines``, ``n_removed``."""
    found = repeated(docs, width).select(F.col("doc_id").alias("_ld_id"), F.col("t").alias("_ld_t"), F.col("starts").alias("_ld_starts"))
    rest = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    both = docs.select(*rest).join(found, (docs["doc_id"] == F.col("_ld_id")) & (F.xxhash64(docs["text"]) == F.col("_ld_t")), "left")
    cut = both.withColumn("_ld_lines", F.split("text", "\n"))
    covered = F.expr(f"flatten(transform(_ld_starts, p -> sequence(p, p + {width - 1})))")
    cut = cut.withColumn("_ld_kept", F.when(F.col("_ld_starts").isNotNull(), F.array_except(F.sequence(F.lit(1), F.size("_ld_lines")), covered)))
    text = F.when(F.col("_ld_kept").isNull(), F.col("text")).otherwise(F.array_join(F.expr("transform(_ld_kept, i -> element_at(_ld_lines, i))"), "\n"))
    n_lines = F.coalesce(F.size("_ld_lines"), F.lit(0))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(n_lines)
    return cut.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in rest],
        n_lines.cast("long").alias("n_lines"),
        F.when(F.col("_ld_kept").isNull(), F.lit(0)).otherwise(n_lines - F.size("_ld_kept")).cast("long").alias("n_removed"),
    )


def op8_line_windows(docs: DataFrame) -> DataFrame:
    out = drop_repeated_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", hex_digest(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


OP8_SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
w AS (
  SELECT doc_id, p, ls[p] || chr(10) || ls[p + 1] || chr(10) || ls[p + 2] AS w
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS p FROM l)
  WHERE NOT (trim(ls[p]) = '' AND trim(ls[p + 1]) = '' AND trim(ls[p + 2]) = '')),
ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS rn FROM w),
covered AS (SELECT DISTINCT doc_id, p + k AS p FROM ranked, (SELECT unnest([0, 1, 2]) AS k) WHERE rn > 1),
every AS (SELECT doc_id, p, ls[p] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS p FROM l)),
kept AS (
  SELECT e.doc_id, count(*) AS n_lines, count(c.p) AS n_removed,
         coalesce(string_agg(CASE WHEN c.p IS NULL THEN e.line END, chr(10) ORDER BY e.p), '') AS text
  FROM every e LEFT JOIN covered c ON c.doc_id = e.doc_id AND c.p = e.p GROUP BY e.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
