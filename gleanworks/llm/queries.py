"""Registered queries of the corpus operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, jaccard, linededup, media, merkle, mixing, packing, pii, substring, toxicity
from .common import prepare, table


def _over(name: str, f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(table(prepare(spark), sf_dir, name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_index": _over("documents", substring.op1_substring_index),
    "op2_temperature_mix": _over("documents", mixing.op2_temperature_mix),
    "op3_toxicity": lambda spark, sf_dir: toxicity.op3_toxicity(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op4_media_sequences": _over("documents", media.op4_media_sequences),
    "op5_merkle": _over("documents", merkle.op5_merkle),
    "op6_ffd_packing": _over("documents", packing.op6_ffd_packing),
    "op7_weak_pii": _over("documents", pii.op7_weak_pii),
    "op8_line_windows": _over("documents", linededup.op8_line_windows),
    "op9_perspectives": _over("conversations", chat.op9_perspectives),
    "op10_token_groups": _over("documents", jaccard.op10_token_groups),
}

_OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
k AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM d)),
f AS (SELECT k, min(doc_id) AS lo FROM k GROUP BY k HAVING min(doc_id) < max(doc_id)),
s AS (SELECT DISTINCT k.doc_id, k.p FROM k JOIN f ON f.k = k.k WHERE k.doc_id > f.lo),
w AS (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
g AS (
  SELECT w.doc_id, w.i, w.word, coalesce(max(s.p) OVER (PARTITION BY w.doc_id ORDER BY w.i) > w.i - 50, FALSE) AS gone
  FROM w LEFT JOIN s ON s.doc_id = w.doc_id AND s.p = w.i),
r AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""

_OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[p:p + 3], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS p FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT x.a, x.b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2) x
  JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r(v, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) m ON m.v = d.doc_id
"""

ORACLES: dict[str, str] = {
    "op1_substring_index": _OP1_SQL,
    "op2_temperature_mix": mixing.OP2_SQL,
    "op8_line_windows": linededup.OP8_SQL,
    "op9_perspectives": chat.OP9_SQL,
    "op10_token_groups": _OP10_SQL,
}
