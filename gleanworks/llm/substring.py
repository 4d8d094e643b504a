"""Incremental removal of repeated word windows, over a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words; its fingerprint is the smallest hash of
the ``GRAM``-word runs inside it, so equal windows have equal fingerprints and
neighbouring windows mostly share theirs: a run of the index holds about one row
per twenty words instead of one per word.

``SubstringIndex`` keeps sorted, immutable, bucketed runs in a shared folder: distinct
texts, their fingerprints, the distinct fingerprints, those that two texts have shared,
and 95-bit hashes of the windows behind these with the smallest doc_id that holds them.  ``ingest`` takes a batch, merge-joins its fingerprints with the
runs of history, hashes the windows behind newly shared ones (of the batch, and of the
texts in the index that hold them), merge-joins these with the window runs and returns
the batch's repeated windows: documents of earlier batches are not read again.  Once a
level has ``FANOUT`` runs they are merged into one of the next level.  A manifest,
written last, names the current runs; an index is opened again by its path alone, and a
batch that failed half-way leaves it as it was.

Hot values: a fingerprint's rows are spread over ``SALTS`` buckets, a window's run has one
row whatever the number of documents, and the join of a batch's windows with their first
documents is split by Spark where a window fills a partition.  Exact copies are found by
128 bits of their text and are never cut into windows.

Defined results: null text has no words; rows without doc_id are kept whole; rows
that share a doc_id never remove each other's words; documents of fewer than
``WINDOW`` words lose nothing; extra columns are ignored; an empty table gives an
empty result.  A document is held against all smaller doc_ids of its own and of
earlier batches, so batches in order of doc_id give the result of one whole table.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, discard, folder, materialise, parts, tidy
from .words import hash_runs, hash_words, slices, sliding_min, text_buffer, word_spans

WINDOW = 50
GRAM = 10
#: Runs of a level that are merged into one of the next.
FANOUT = 4
#: Batches that the registered query feeds, in order of doc_id: the last one meets merged runs.
BATCHES = 5
#: Buckets that the rows of one fingerprint are spread over.
SALTS = 8
#: Per kind of run: columns, those that buckets are dealt by, and the order inside a bucket.
KINDS = {
    "prints": ("h long, s int, t long, t2 long", ("h", "s"), ("h", "s", "t", "t2")),
    "heads": ("h long", ("h",), ("h",)),
    "shared": ("h long", ("h",), ("h",)),
    "texts": ("t long, t2 long, owner long, text string", ("t", "t2"), ("t", "t2")),
    "windows": ("k1 long, k2 int, lo long, hi long", ("k1", "k2"), ("k1", "k2")),
}


def keyed(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, t, t2)`` with two hashes of the text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"), F.xxhash64(F.lit(1), text).alias("t2"))


def _starts(first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a whole window fits into one row, and the rows' numbers."""
    n = np.maximum(np.diff(first) - window + 1, 0)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n)
    return at, np.repeat(np.arange(len(n)), n)


def fingerprints(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``(h, t, t2)``: the fingerprints of each text's windows, runs of equal ones once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                buf, offsets = text_buffer(piece.column(0))
                starts, stops, first = word_spans(buf, offsets)
                at, row = _starts(first, window)
                if len(at):
                    low = sliding_min(hash_runs(hash_words(buf, starts, stops), gram), window - gram + 1)[at]
                    keep = np.append(True, (low[1:] != low[:-1]) | (row[1:] != row[:-1]))
                    t, t2 = (piece.column(i).to_numpy()[row[keep]] for i in (1, 2))
                    yield pa.RecordBatch.from_arrays([pa.array(low[keep].view(np.int64)), pa.array(t), pa.array(t2)], names=["h", "t", "t2"])

    return docs.select("text", "t", "t2").where("text IS NOT NULL").mapInArrow(run, "h long, t long, t2 long")


class SubstringIndex:
    """An index in a folder that all executors share; opened again from its manifest where there is one."""

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT):
        self.spark, self.path = spark, path or folder(spark, "index")
        self.state = {"version": 0, "made": 0, "window": window, "gram": gram, "fanout": fanout, "buckets": parts(spark), "runs": {k: [] for k in KINDS}}
        self.names: dict[str, str] = {}
        self.merged: list[str] = []
        try:
            found = spark.read.text(f"{self.path}/manifest/*").collect()  # a line per ingest
        except AnalysisException:
            found = []
        if found:
            self.state = max((json.loads(r["value"]) for r in found), key=lambda m: m["version"])

    def _commit(self) -> None:
        self.state["version"] += 1
        line = self.spark.createDataFrame([(json.dumps(self.state),)], "value string").coalesce(1)
        line.write.text(f"{self.path}/manifest/{self.state['version']:06d}-{uuid.uuid4().hex}")

    def _write(self, kind: str, rows: DataFrame, dealt: bool = False) -> str:
        """A new run: a sorted file per bucket.  ``dealt`` rows come from a grouping by the buckets' columns, which are together already."""
        columns, by, order = KINDS[kind]
        self.state["made"] += 1
        run = f"{kind}-{self.state['made']:06d}-{uuid.uuid4().hex[:8]}"
        name = f"gleanworks_{uuid.uuid4().hex}"
        rows = rows.select(*[c.split()[0] for c in columns.split(", ")])
        rows = rows if dealt else rows.repartition(self.state["buckets"], *by)
        rows.write.format("parquet").option("compression", "zstd").bucketBy(self.state["buckets"], *by).sortBy(*order).option("path", f"{self.path}/{run}").saveAsTable(name)
        self.names[run] = name
        return run

    def _read(self, run: str) -> DataFrame:
        """A run as a bucketed table; a join on its buckets' columns exchanges nothing of it."""
        if run not in self.names:
            columns, by, order = KINDS[run.split("-")[0]]
            name = f"gleanworks_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({', '.join(by)}) SORTED BY ({', '.join(order)}) INTO {self.state['buckets']} BUCKETS LOCATION '{self.path}/{run}'")
            self.names[run] = name
        return self.spark.table(self.names[run])

    def runs(self, kind: str) -> list[DataFrame]:
        return [self._read(run) for _, run in self.state["runs"][kind]]

    def _add(self, kind: str, run: str, level: int = 0) -> None:
        """Name a run as current; a full level becomes one run of the next."""
        held = self.state["runs"][kind]
        held.append((level, run))
        full = [r for at, r in held if at == level]
        if len(full) >= self.state["fanout"]:
            every = reduce(DataFrame.unionByName, [self._read(r) for r in full])
            if kind == "windows":
                every = every.groupBy("k1", "k2").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            elif kind in ("heads", "shared"):
                every = every.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
            self.merged += full
            self.state["runs"][kind] = [x for x in held if x[1] not in full]
            self._add(kind, self._write(kind, every, kind not in ("texts", "prints")), level + 1)

    def _sweep(self) -> None:
        """Delete runs that the manifest no longer names; answers given before do not read them."""
        for run in self.merged:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.names.pop(run)}")
            delete(self.spark, f"{self.path}/{run}")
        self.merged.clear()

    def close(self) -> None:
        """Forget the tables' names in this session; the files and the manifest stay."""
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names.clear()

    def ingest(self, batch: DataFrame) -> DataFrame:
        """``(doc_id, t, copy, starts)`` of the batch: copies, and the windows seen in a smaller doc_id.

        Rows that lose nothing are left out.  Adds the batch to the index.
        """
        with tidy(self.spark, ordered=True):
            return self._ingest(keyed(batch.where("doc_id IS NOT NULL AND text IS NOT NULL")))

    def _ingest(self, rows: DataFrame) -> DataFrame:
        window, gram = self.state["window"], self.state["gram"]
        # Texts of the batch and their smallest doc_ids, here and in history.
        owners = rows.groupBy("t", "t2").agg(F.min("doc_id").alias("owner"))
        for i, old in enumerate(self.runs("texts")):
            owners = owners.join(old.select("t", "t2", F.col("owner").alias(f"o{i}")), ["t", "t2"], "left")
        past = F.coalesce(*[F.col(f"o{i}") for i in range(len(self.runs("texts")))], F.lit(None).cast("long"))
        owners = materialise(owners.select("t", "t2", "owner", past.alias("past")), "owners")
        copies = rows.select("doc_id", "t", "t2").join(owners.select("t", "t2", F.least("owner", "past").alias("first")), ["t", "t2"]).where("doc_id > first").select("doc_id", "t").distinct()
        fresh = rows.join(owners.where("past IS NULL"), ["t", "t2"]).where("doc_id = owner").dropDuplicates(["t", "t2"])
        texts = self._write("texts", fresh)
        prints = self._write("prints", fingerprints(self._read(texts), window, gram).withColumn("s", F.pmod("t", F.lit(SALTS)).cast("int")))
        new = self._read(prints)
        # Fingerprints of the batch that two texts share, and those of them that history holds or has opened.
        ends = new.groupBy("h").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
        heads = self._write("heads", ends, dealt=True)
        both, flags = ends, {}
        for kind in ("heads", "shared"):
            flags[kind] = [F.lit(False)]
            for i, run in enumerate(self.runs(kind)):
                both = both.join(run.withColumn(f"{kind}{i}", F.lit(True)), "h", "left")
                flags[kind].insert(0, F.col(f"{kind}{i}"))
        shared = both.select("h", "lo", "hi", F.coalesce(*flags["heads"]).alias("old"), F.coalesce(*flags["shared"]).alias("opened"))
        shared = materialise(shared.where("lo < hi OR old").drop("lo", "hi"), "shared")
        salted = lambda hs: hs.select("h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
        # Windows behind them: of the batch all, of history those not opened before.
        found = materialise(_windows(self._read(texts), new.join(salted(shared), ["h", "s"], "left_semi"), window, gram), "found")
        past_windows = []
        wanted = salted(shared.where("old AND NOT opened"))
        hits = [old.join(wanted, ["h", "s"], "left_semi") for old in self.runs("prints")]
        if hits:
            hits = materialise(reduce(DataFrame.unionByName, hits), "hits")
            past_windows = [_windows(old, hits, window, gram).select("k1", "k2", "owner") for old in self.runs("texts")]
        every = reduce(DataFrame.unionByName, [found.select("k1", "k2", "owner"), *past_windows])
        windows = self._write("windows", every.groupBy("k1", "k2").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi")), dealt=True)
        # The first document of every window of the batch, over all runs, where another one holds it.
        first = self._read(windows)
        for i, old in enumerate(self.runs("windows")):
            first = first.join(old.select("k1", "k2", F.col("lo").alias(f"lo{i}")), ["k1", "k2"], "left")
        least = F.least("lo", F.lit(2**63 - 1), *[F.col(f"lo{i}") for i in range(len(self.runs("windows")))])
        first = materialise(first.select("k1", "k2", "hi", least.alias("lo")).where("lo < hi").drop("hi"), "first")
        later = found.join(first, ["k1", "k2"]).where("owner > lo").groupBy("owner", "t").agg(F.collect_set("pos").alias("starts"))
        none = F.expr("cast(null as array<int>)")
        marks = later.select(F.col("owner").alias("doc_id"), "t", F.lit(False).alias("copy"), "starts").unionByName(copies.select("doc_id", "t", F.lit(True).alias("copy"), none.alias("starts")))
        marks = materialise(marks, "marks")
        opened_now = self._write("shared", shared.where("NOT opened").select("h"))
        for kind, run in (("texts", texts), ("prints", prints), ("heads", heads), ("shared", opened_now), ("windows", windows)):
            self._add(kind, run)
        self._commit()
        self._sweep()
        discard(found, first, shared, owners, *([hits] if past_windows else []))
        return marks


def _windows(texts: DataFrame, hits: DataFrame, window: int, gram: int) -> DataFrame:
    """``(k1, k2, owner, t, pos)`` of the windows of ``texts`` whose fingerprints are among the text's in ``hits(h, t, t2)``."""
    wanted = hits.groupBy("t", "t2").agg(F.collect_set("h").alias("hs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                buf, offsets = text_buffer(piece.column(2))
                starts, stops, first = word_spans(buf, offsets)
                at, row = _starts(first, window)
                if not len(at):
                    continue
                words = hash_words(buf, starts, stops)
                low = sliding_min(hash_runs(words, gram), window - gram + 1)[at]
                lists = piece.column(3)
                ends = np.searchsorted(row, np.arange(len(piece) + 1))
                hit = np.zeros(len(at), bool)
                for i in range(len(piece)):
                    hit[ends[i] : ends[i + 1]] = np.isin(low[ends[i] : ends[i + 1]].view(np.int64), lists[i].values.to_numpy())
                at, row = at[hit], row[hit]
                k1 = hash_runs(words, window)[at].view(np.int64)
                k2 = (hash_runs(hash_words(buf, starts, stops, seed=1), window)[at] >> np.uint64(33)).astype(np.int32)
                ids, t = piece.column(0).to_numpy(), piece.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(ids[row]), pa.array(t[row]), pa.array((at - first[row]).astype(np.int32))], names=["k1", "k2", "owner", "t", "pos"])

    return texts.join(wanted, ["t", "t2"]).select("owner", "t", "text", "hs").mapInArrow(run, "k1 long, k2 int, owner long, t long, pos int")


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Mask of the words that the windows at ``starts`` cover."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n), -1)
    return np.cumsum(edge[:n]) > 0


def remove(docs: DataFrame, found: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256[, kept])``: each document without its covered words."""
    rows = keyed(docs)
    marks = found.select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"), "copy", "starts")
    both = rows.join(marks, (rows["doc_id"] == marks["_id"]) & (rows["t"] == marks["_t"]), "left").select(rows["doc_id"], "text", "copy", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, copy, starts in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
                words = (text.as_py() or "").encode().split()
                kept = words
                if copy and len(words) >= window:
                    kept = []
                elif starts.is_valid:
                    gone = covered(len(words), starts.values.to_numpy().astype(np.int64), window)
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                joined = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode() if with_text else None))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            arrays = [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(columns[3], pa.string())] if with_text else arrays, names=[*names, "kept"] if with_text else names)

    return both.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else ""))


def deduplicate(docs: DataFrame, batches: int = BATCHES, window: int = WINDOW, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """Feed ``docs`` to a new index in ``batches`` ranges of doc_id and remove what repeats.

    Null texts have no words, rows without doc_id are kept whole, an empty table gives an empty result.
    """
    index = SubstringIndex(docs.sparkSession, window=window, gram=gram)
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if lo is None:
        lo, hi, batches = 0, 0, 1
    edges = [lo + (hi + 1 - lo) * i // batches for i in range(batches)] + [hi + 1]
    marks = [index.ingest(docs.where((F.col("doc_id") >= a) & (F.col("doc_id") < z))) for a, z in zip(edges, edges[1:], strict=False) if a < z]
    index.close()
    return remove(docs, reduce(DataFrame.unionByName, marks) if marks else index.ingest(docs.where("false")), window, with_text)


def op1_substring_index(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of every row; ``deduplicate``'s defined results hold."""
    return deduplicate(docs.select("doc_id", "text"), with_text=False)
