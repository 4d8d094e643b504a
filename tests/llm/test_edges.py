"""Every corpus query and pipeline stage on rows with nulls anywhere, repeats, long texts, clashing names, and on empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from gleanworks.llm import queries

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
TURNS = "conv_id long, turn long, role string, text string"
#: Names that operators use for columns of their own.
CLASHES = (
    "a", "b", "h", "k", "m", "n", "p", "t", "lo", "hi", "pos", "row", "key", "lines", "words", "tokens", "kept", "starts", "spans", "parts", "media",
    "epoch", "block", "label", "toxic", "score", "toxic_score", "held_out", "predicted", "flagged", "digest", "payload", "fingerprint", "near_next",
    "component_id", "n_shingles", "n_tokens", "n_words", "n_lines", "n_removed", "sequence_id", "offset", "start", "length", "segment", "part", "mask",
)
LONG = " ".join(f"w{i * 7919 % 5000}" for i in range(60_000))
LINES = "one line here\ntwo line here\nthree line here\nfour"
ROWS = [
    (None, None, None, None, None),
    (None, "text without id a@b.cd", "en", "s", 22),
    (1, None, "en", "s", None),
    (2, "", None, "s", 0),
    (3, " \t\n ", "en", None, 4),
    (4, LINES, "en", "s", len(LINES)),
    (4, LINES, "en", "s", len(LINES)),
    (5, LINES, "de", "s", len(LINES)),
    (6, LONG, "en", "s", len(LONG)),
    (7, LONG + " end", "en", "s'\\x", len(LONG) + 4),
    (8, "first text of a shared id", "fr", "s", 25),
    (8, "other text of a shared id", "fr", "s", 25),
    (-9, "x" * 100_000 + " 😀 +1 (017) 555-7713 " + "\n" * 3000, "es", "s", 103_021),
]
LABELLED = [(1, 1, 1), (3, None, 0), (4, 1, None), (5, None, 1), (5, None, 1), (6, 0, 0), (None, 1, 1), (99, 0, 0)]
SAID = [(1, 0, "system", "S"), (1, 1, "a", "x"), (1, 1, "a", "x"), (1, None, None, None), (None, 2, "b", "y"), (2, 0, "a", LONG), (3, None, "system", None)]


def clashing(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES if c not in df.columns])


def tables(spark, folder, empty):
    for name, rows, schema in (("documents", ROWS, DOCUMENTS), ("labels", LABELLED, LABELS), ("conversations", SAID, TURNS)):
        clashing(spark.createDataFrame([] if empty else rows, schema)).coalesce(2).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("odd"), False)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("empty"), True)


#: Queries that answer every row of documents once, whatever it holds.
ONE_ROW_EACH = ("op1_substring_index", "op3_toxicity", "op4_media_sequences", "op5_merkle", "op7_weak_pii", "op8_line_windows")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_on_odd_rows(spark, odd, name):
    rows = queries.QUERIES[name](spark, odd).collect()
    if name in ONE_ROW_EACH:
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ROWS)
    elif name == "op10_token_groups":
        groups = {r.doc_id: r.component_id for r in rows}
        assert groups[5] == groups[4] and groups[7] == groups[6] and groups[8] == 8
    else:
        assert rows


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_on_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_stages_on_odd_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd)
        assert out.columns == list(pipeline.COLUMNS), name
        kept[name] = sorted(str(r.doc_id) for r in out.select("doc_id").collect())
    everything = sorted(str(r[0]) for r in ROWS)
    assert kept["line_dedup"] == everything
    assert kept["near_duplicates"] == [i for i in everything if i not in ("5", "7")]
    assert {r.doc_id for r in pipeline.packing_stage(spark, docs, odd).select("doc_id").collect()} == {r[0] for r in ROWS}
    assert pipeline.run(spark, odd).count() > 0


def test_stages_on_empty_tables(spark, empty):
    docs = spark.read.parquet(f"{empty}/documents.parquet")
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs, empty).count() == 0, name
    assert pipeline.run(spark, empty).count() == 0
