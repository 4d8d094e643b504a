"""Toxicity scores from a small convolutional text classifier, trained in numpy.

A word's vector is the sum of hashed embeddings of the whole word and of three of
its prefixes; filters of one, two and three words slide over the whole text, each is
max-pooled, and a linear layer gives the logit.  Every bucket starts with its smoothed
log-odds in the training rows, in one of the vector's dimensions, so that max pooling
over dimensions can tell several toxic words from one; everything is then trained by
Adam and Adagrad.

The classifier is fitted in one executor task on a bounded sample: at most ``SAMPLE``
labelled rows, half of each class, the first in order of a digest of doc_id, none of
more than ``LONGEST`` bytes and ``SAMPLE_BYTES`` bytes together.  Rows with
crc32(doc_id) mod 3 = 1 are held out and their labels never read.  Fits on ``FOLDS``
parts of the sample score the part that they have not seen; these scores give the
final model its slope and offset, and each language its threshold.  Scores see the
text alone.

Defined results: null text counts as empty and gets the score of no words; rows with a
null label or id train nothing; texts beyond the sample's bounds are scored like all
others; without labels of both classes every score is 0.5; rows that share a doc_id
are each scored; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import hash_words, lower_ascii, slices, text_buffer

#: Most labelled rows that the classifier is fitted on, the longest of them, and their bytes together.
SAMPLE = 6000
LONGEST = 1 << 20
SAMPLE_BYTES = 48 << 20
BUCKETS = 1 << 17
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 12
PAD = max(WIDTHS)
PREFIXES = (4, 5, 6)
EPOCHS = 4
FOLDS = 3
SEED = 3
PREDICT = 0.7
#: Words whose windows are held at once.
CHUNK = 1 << 15
#: Training rows, and their words, of one step.
STEP_ROWS = 64
HELD_OUT = "pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1"

_LETTER = np.ones(256, dtype=bool)
_LETTER[:48] = False
_LETTER[[*range(58, 65), *range(91, 97), *range(123, 128)]] = False


def word_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first): bucket ids per word (whole, then prefixes), and each row's first row in ``ids``.

    Words are runs of letters, digits and non-ASCII bytes, ASCII lower-cased.
    ``PAD`` rows of the padding id ``BUCKETS`` follow each text, so that every width
    has a window in the shortest one.
    """
    buf, offsets = text_buffer(column)
    buf = lower_ascii(buf)
    inside = _LETTER[buf]
    first, last = inside.copy(), inside.copy()
    if len(buf) > 1:
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
    filled = np.diff(offsets) > 0
    first[offsets[:-1][filled]] = inside[offsets[:-1][filled]]
    last[offsets[1:][filled] - 1] = inside[offsets[1:][filled] - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    begin = np.searchsorted(starts, offsets)
    rows = len(offsets) - 1
    ids = np.full((len(starts) + PAD * rows, 1 + len(PREFIXES)), BUCKETS, dtype=np.int32)
    at = np.arange(len(starts)) + PAD * np.repeat(np.arange(rows), np.diff(begin))
    for k, size in enumerate((None, *PREFIXES)):
        ends = stops if size is None else np.minimum(stops, starts + size)
        ids[at, k] = (hash_words(buf, starts, ends, seed=k + 1) % np.uint64(BUCKETS)).astype(np.int32)
    return ids, begin[:-1] + PAD * np.arange(rows)


@dataclass
class Model:
    """Weights of the classifier; ``slope`` and ``shift`` make its logit a calibrated one."""

    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        x = self.embed[ids[:, 0]].astype(np.float32)
        for k in range(1, ids.shape[1]):
            x += self.embed[ids[:, k]]
        return x

    def pooled(self, ids: np.ndarray, first: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(largest, position): per row every filter's largest output, and with ``where`` the window that gave it.

        Windows lie inside their text and its padding.  ``CHUNK`` of them are held at a
        time, whatever the length of a text.
        """
        rows, total = len(first), len(ids)
        best = np.full((rows, len(WIDTHS) * FILTERS), -np.inf, np.float32)
        at = np.zeros(best.shape, np.int64) if where else None
        last = np.append(first[1:], total) - 1
        for a in range(0, total, CHUNK):
            z = min(total, a + CHUNK)
            x = self.vectors(ids[a : z + PAD - 1])
            x = np.concatenate([x, np.zeros((z - a + PAD - 1 - len(x), DIM), np.float32)])
            lo, hi = np.searchsorted(first, a, side="right") - 1, np.searchsorted(first, z)
            cuts = np.maximum(first[lo:hi] - a, 0)
            for k, (w, b, width) in enumerate(zip(self.filters, self.bias, WIDTHS, strict=True)):
                h = np.tile(b, (z - a, 1))
                for j in range(width):
                    h += x[j : j + z - a] @ w[j * DIM : (j + 1) * DIM]
                for j in range(width - 1):
                    out = last[lo:hi] - j - a
                    h[out[(out >= 0) & (out < z - a)]] = -np.inf
                span = slice(k * FILTERS, (k + 1) * FILTERS)
                if where:
                    for r, s, e in zip(range(lo, hi), cuts, [*cuts[1:], z - a], strict=True):
                        top = h[s:e].argmax(0)
                        value = h[s:e][top, np.arange(FILTERS)]
                        more = value > best[r, span]
                        best[r, span] = np.where(more, value, best[r, span])
                        at[r, span] = np.where(more, top + s + a, at[r, span])
                else:
                    best[lo:hi, span] = np.maximum(best[lo:hi, span], np.maximum.reduceat(h, cuts, axis=0))
        return np.maximum(best, 0), at

    def logits(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(ids, first)[0].astype(np.float64) @ self.out.astype(np.float64) + self.out_bias

    def scores(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(ids, first) * self.slope + self.shift, -30, 30)))


def _initial(docs: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> Model:
    seen = np.zeros((2, BUCKETS + 1))
    for doc, y in zip(docs, labels, strict=True):
        seen[int(y), np.unique(doc)] += 1
    n = np.array([(labels == 0).sum(), (labels == 1).sum()], dtype=float)
    strength, support = 2.0, seen.sum(0)
    rate = (seen + strength * support / n.sum() + 0.05) / (n[:, None] + strength + 0.1)
    odds = np.clip(np.log(rate[1]) - np.log(rate[0]), -1, 4) * (support >= 3)
    embed = rng.normal(0, 0.02, (BUCKETS + 1, DIM)).astype(np.float32)
    embed[np.arange(BUCKETS), np.arange(BUCKETS) % DIM] += 0.5 * odds[:-1]
    embed[support < 3] = 0
    embed[BUCKETS] = 0
    filters = [(np.tile(np.eye(DIM, FILTERS), (w, 1)) + rng.normal(0, 0.05, (w * DIM, FILTERS))).astype(np.float32) for w in WIDTHS]
    out = np.full(len(WIDTHS) * FILTERS, 0.25, np.float32)
    return Model(embed, filters, [np.full(FILTERS, -0.5, np.float32) for _ in WIDTHS], out, -2.0)


def fit(docs: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Train on the word ids of balanced rows."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, dtype=np.float32)
    model = _initial(docs, y, rng)
    params = [model.out, *model.filters, *model.bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    squares = np.full((BUCKETS + 1, 1), 0.1, np.float32)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for a in range(0, len(order), STEP_ROWS):
            rows = order[a : a + STEP_ROWS]
            ids = np.concatenate([docs[i] for i in rows])
            first = np.concatenate([[0], np.cumsum([len(docs[i]) for i in rows])[:-1]]).astype(np.int64)
            pooled, best = model.pooled(ids, first, where=True)
            p = 1 / (1 + np.exp(-np.clip(pooled @ model.out + model.out_bias, -30, 30)))
            g = (p - y[rows]) / len(rows)
            grads = [pooled.T @ g + 1e-4 * model.out]
            gw, gb = [], []
            for k, width in enumerate(WIDTHS):
                span = slice(k * FILTERS, (k + 1) * FILTERS)
                back = g[:, None] * model.out[span] * (pooled[:, span] > 0)
                at = np.minimum(best[:, span][:, :, None] + np.arange(width), len(ids) - 1)
                words = ids[at.ravel()]
                x = model.vectors(words).reshape(*best[:, span].shape, width * DIM)
                gw.append(np.einsum("df,dfx->xf", back, x) + 1e-4 * model.filters[k])
                gb.append(back.sum(0))
                grad = np.einsum("df,xf->dfx", back, model.filters[k]).reshape(-1, DIM)
                live = np.abs(grad).sum(1) > 0
                grad = grad[live]
                for j in range(ids.shape[1]):
                    b = words[live, j]
                    np.add.at(squares, b, (grad**2).mean(1, keepdims=True))
                    np.add.at(model.embed, b, -0.05 * grad / np.sqrt(squares[b]))
            model.embed[BUCKETS] = 0
            step += 1
            model.out_bias -= 0.02 * float(g.sum())
            for i, (param, grad) in enumerate(zip(params, [*grads, *gw, *gb], strict=True)):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad**2
                param -= 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return model


def platt(logits: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the weighted logistic regression of ``labels`` on ``logits``, by Newton steps with a small ridge."""
    a, b = 1.0, 0.0
    x = np.stack([logits, np.ones_like(logits)], axis=1)
    weight = weight / weight.mean()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ np.array([a, b]), -30, 30)))
        grad = x.T @ (weight * (p - labels)) + 1e-2 * np.array([a - 1.0, b])
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(max(a, 1e-3)), float(b)


def calibrate(scores: np.ndarray, labels: np.ndarray, langs: list[str | None], weight: np.ndarray) -> dict[str, float]:
    """Per language the threshold of best F1 at the corpus share of toxic rows; ``PREDICT`` where a class is missing."""
    out = {}
    for lang in sorted({x for x in langs if x is not None}):
        mine = np.array([x == lang for x in langs])
        if len(set(labels[mine].tolist())) < 2:
            out[lang] = PREDICT
            continue
        grid = np.arange(0.3, 0.96, 0.05)
        f1 = []
        for t in grid:
            hit = scores[mine] >= t
            tp = (weight[mine] * hit * labels[mine]).sum()
            f1.append(2 * tp / max((weight[mine] * (hit + labels[mine])).sum(), 1e-9))
        best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
        out[lang] = round(float(grid[best[len(best) // 2]]), 2)
    return out


def learn(texts: list[str], labels: list[int], langs: list[str | None], share: float, folds: int = FOLDS) -> Model:
    """Fit on all rows; slope, offset and thresholds come from fits that have not seen the rows they score.

    ``share`` is the share of label 1 among all labelled rows that are not held out.
    """
    y = np.asarray(labels, dtype=np.float64)
    docs: list[np.ndarray] = []
    for a in range(0, len(texts), 256):
        ids, first = word_ids(pa.array(texts[a : a + 256], pa.string()))
        docs += np.split(ids, first[1:])
    model = fit(docs, y)
    fold = np.zeros(len(docs), int)
    for label in (0, 1):  # every fold has its part of both classes
        mine = np.flatnonzero(y == label)
        fold[mine] = np.arange(len(mine)) % folds
    unseen = np.full(len(docs), np.nan)
    for k in range(folds):
        rest = np.flatnonzero(fold != k)
        if len(set(y[rest].tolist())) < 2:
            continue
        part = fit([docs[i] for i in rest], y[rest])
        for i in np.flatnonzero(fold == k):
            unseen[i] = part.logits(docs[i], np.zeros(1, np.int64))[0]
    known = ~np.isnan(unseen)
    share = min(max(share, 1e-3), 1 - 1e-3)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    if len(set(y[known].tolist())) == 2:
        model.slope, model.shift = platt(unseen[known], y[known], weight[known])
        scores = 1 / (1 + np.exp(-np.clip(unseen * model.slope + model.shift, -30, 30)))
        model.thresholds = calibrate(scores[known], y[known], [x for x, k in zip(langs, known, strict=True) if k], weight[known])
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on at most ``sample`` labelled rows that are not held out; None without both classes.

    Runs in one executor task that returns the weights; the driver sees neither texts
    nor training state.  Of rows that share a doc_id one text is trained on.
    """
    known = labels.where(f"doc_id IS NOT NULL AND toxic IN (0, 1) AND NOT {HELD_OUT}").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    pick = [known.where(F.col("toxic") == k).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample // 2) for k in (0, 1)]
    chosen = pick[0].unionByName(pick[1])  # at most ``sample`` rows of two integers
    share = counts[1] / (counts[0] + counts[1])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.col("lang").cast("string").alias("lang")).where(F.octet_length("text") <= LONGEST).join(F.broadcast(chosen.groupBy("doc_id").agg(F.min("toxic").alias("toxic"))), "doc_id")
    one = rows.groupBy("doc_id").agg(F.min_by(F.struct("toxic", "lang", "text"), F.md5("text")).alias("r")).select("doc_id", "r.*")
    dealt = one.repartition(1).sortWithinPartitions(F.md5(F.col("doc_id").cast("string")), "doc_id").select("text", "toxic", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic, langs, room = [], [], [], SAMPLE_BYTES
        for batch in batches:
            for text, y, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                room -= len(text.encode())
                if room >= 0:
                    texts.append(text)
                    toxic.append(y)
                    langs.append(lang)
        if len(set(toxic)) == 2:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(learn(texts, toxic, langs, share)))], pa.binary())], names=["model"])

    found = dealt.mapInArrow(run, "model binary").collect()
    return Model(**pickle.loads(found[0]["model"])) if found else None


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with a column ``toxic_score``; every whole text, one pass, no shuffle."""
    spark = docs.sparkSession
    rest = docs.drop("toxic_score") if "toxic_score" in docs.columns else docs
    if model is None:
        return rest.withColumn("toxic_score", F.lit(0.5))
    shared = spark.sparkContext.broadcast(vars(model))
    at = rest.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Model(**shared.value)
        for batch in batches:
            for piece in slices(batch, "text"):
                ids, first = word_ids(piece.column(at))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(net.scores(ids, first))], names=[*piece.schema.names, "toxic_score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return rest.mapInArrow(run, f"{fields}, toxic_score double")


def op3_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted, flagged)`` of every row, in any order.

    ``flagged`` compares the score with its language's threshold; ``predicted`` is the
    contract's.  Null texts are scored as empty ones, a null doc_id is kept and not held
    out, repeated rows are each scored, extra columns are ignored; without labels of
    both classes every score is 0.5; an empty table gives an empty result.
    """
    model = train(docs, labels)
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return score(slim, model).select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= PREDICT).cast("int").alias("predicted"), flagged(model).cast("int").alias("flagged"))


def flagged(model: Model | None):
    """Whether ``toxic_score`` reaches the threshold of the row's ``lang``."""
    limit = F.lit(PREDICT)
    for lang, t in (model.thresholds if model else {}).items():
        limit = F.when(F.col("lang") == lang, F.lit(t)).otherwise(limit)
    return F.col("toxic_score") >= limit
