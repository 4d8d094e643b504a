"""Per-query retrieval from a pool: cosine nearest neighbours and BM25."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small, written
from .selection import ranked_within

K1, B, EPSILON = 1.5, 0.75, 0.25


#: Rows of either side that one block of the nearest-neighbour search holds.
BLOCK = 4096


def _packed(rows: DataFrame, prefix: str) -> DataFrame:
    """``(_g, <prefix>ids, <prefix>vecs)``: the rows of a group in blocks of about ``BLOCK``."""
    sizes = rows.groupBy(F.col("_g").alias("_h")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_n"))
    dealt = rows.join(sizes, F.col("_g").eqNullSafe(F.col("_h"))).select("_g", "id", "vec", F.pmod(F.xxhash64("id"), F.col("_n")).alias("_b"))
    packed = dealt.groupBy("_g", "_b").agg(F.collect_list(F.struct("id", "vec")).alias("_r"))
    return packed.select(F.col("_g").alias(f"{prefix}g"), F.col("_r.id").alias(f"{prefix}ids"), F.col("_r.vec").alias(f"{prefix}vecs"))


def knn(queries: DataFrame, pool: DataFrame, k: int, group: str | None = None) -> DataFrame:
    """``(query_id, rank, id, similarity)``: the ``k`` pool rows nearest by cosine, ties by id.

    Both sides are packed into blocks; every block of queries meets every block of the
    pool (of its group) in one matrix product, which sends on the best ``k`` per query.
    """
    key = F.col(group) if group else F.lit("")
    side = lambda df: df.select("id", key.cast("string").alias("_g"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    kind, of_query = dict(pool.dtypes)["id"], dict(queries.dtypes)["id"]
    q, p = _packed(side(queries), "q"), _packed(side(pool), "p")
    pairs = q.join(p, F.col("qg").eqNullSafe(F.col("pg"))).select("qids", "qvecs", "pids", "pvecs")

    def unit(vectors: pa.ListScalar) -> np.ndarray:
        rows = vectors.values
        flat = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        return flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qids, qvecs, pids, pvecs in zip(*batch.columns, strict=True):
                near = np.round(unit(qvecs) @ unit(pvecs).T, 9)
                names, found = pids.values, []
                order = np.argsort(np.array(names.to_pylist()), kind="stable")
                near = near[:, order]
                for i in range(len(near)):
                    top = np.argsort(-near[i], kind="stable")[:k]
                    found.append((np.full(len(top), i), order[top], near[i][top]))
                i, j, s = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([qids.values.take(pa.array(i)), names.take(pa.array(j)), pa.array(s)], names=["query_id", "id", "similarity"])

    scored = pairs.mapInArrow(run, f"query_id {of_query}, id {kind}, similarity double")
    return ranked_within(scored, "query_id", [F.col("similarity").desc(), F.col("id")], k)


def tokens(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def bm25_terms(pool: DataFrame, wanted: DataFrame, group: str | None = None) -> DataFrame:
    """Per (group, term, id) of the ``wanted(g, term)``: the term's weighted contribution to a query that holds it once.

    Documents' frequencies of all terms are counted with partial aggregation, for the
    mean idf; term counts by document are made for wanted terms only.  Negative idf
    values become ``EPSILON`` times the mean idf of the group.
    """
    g = F.col(group) if group else F.lit("")
    docs = pool.select(g.alias("g"), "id", tokens(F.col("text")).alias("t")).withColumn("dl", F.size("t"))
    stats = docs.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    df = docs.select("g", F.explode(F.array_distinct("t")).alias("term")).groupBy("g", "term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(stats), "g")  # a row per group
    df = df.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = df.groupBy("g").agg(F.avg("raw").alias("mean"))
    side = F.broadcast(wanted) if small(wanted) else wanted
    idf = df.join(side, ["g", "term"], "left_semi").join(F.broadcast(mean), "g").select("g", "term", "avgdl", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    tf = docs.select("g", "id", "dl", F.explode("t").alias("term")).join(side, ["g", "term"], "left_semi").groupBy("g", "id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return tf.join(idf, ["g", "term"]).select("g", "term", "id", part.alias("part"))


def bm25(queries: DataFrame, pool: DataFrame, k: int, group: str | None = None) -> DataFrame:
    """``(query_id, rank, id, score)``: the best ``k`` pool texts per query; repeated query terms count each time.

    Pool texts that share no term with a query score 0 and compete by id: the ``k`` that
    come first among them are found beside the hits, which are written out once.
    """
    g = F.col(group) if group else F.lit("")
    asked = queries.select(F.col("id").alias("query_id"), g.alias("g"), F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "g", "term").agg(F.count(F.lit(1)).alias("times"))
    wanted = written(asked.select("g", "term").distinct(), "wanted")
    hits = asked.join(bm25_terms(pool, wanted, group), ["g", "term"]).groupBy("query_id", "g", "id").agg(F.round(F.sum(F.col("times") * F.col("part")), 9).alias("score"))
    hits = written(hits, "hits")
    order = [F.col("score").desc(), F.col("id")]
    found = ranked_within(hits, "query_id", order, k).select("query_id", "id", "score")
    # The first k + m ids of a group, m the most hits of one of its queries, hold k without a hit for each.
    most = hits.groupBy("query_id", "g").agg(F.count(F.lit(1)).alias("m")).groupBy("g").agg(F.max("m").alias("m"))
    short = hits.where("score > 0").groupBy("query_id").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= k).select("query_id")
    needy = queries.select(F.col("id").alias("query_id"), g.alias("g")).join(short, "query_id", "left_anti")
    numbered = pool.select(g.alias("g"), "id").join(needy.select("g").distinct(), "g", "left_semi").withColumn("_at", F.row_number().over(Window.partitionBy("g").orderBy("id")))
    first = numbered.join(F.broadcast(most), "g", "left").where(F.col("_at") <= F.coalesce("m", F.lit(0)) + k).select("g", "id")
    spare = needy.join(first, "g").select("query_id", "id").join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("score", F.lit(0.0))
    return ranked_within(found.unionByName(spare), "query_id", order, k)


def retrieval_text(text: Column, intent: Column | None = None, task: str = "") -> Column:
    """Optional task and intent lines before the text."""
    lines = ([F.lit(f"Task: {task}")] if task else []) + ([F.when(intent.isNotNull() & (intent != ""), F.concat(F.lit("Intent: "), intent))] if intent is not None else [])
    return F.concat_ws("\n", *lines, text)
