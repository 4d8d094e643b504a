"""A corpus preparation pipeline: five operators, one after another, on the documents table.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  ``run`` writes each stage's rows as Parquet
to the shared folder and reads them back as the next one's input.

In every stage an empty table gives an empty result, extra columns are dropped
whatever their names, and what a stage says of nulls and repeated rows holds for each
of its input rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanworks.llm import jaccard, linededup, mixing, packing, toxicity
from gleanworks.llm.common import materialise, prepare, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches their language's threshold go.

    A null text is scored as an empty one, a null language has the threshold 0.7, rows
    without doc_id and repeated rows are judged each by their text; without labels of both
    classes nothing goes.
    """
    prepare(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _documents(toxicity.score(_documents(docs), model).where(~toxicity.flagged(model)))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three consecutive lines are taken out of the texts.

    Every row stays, with ``n_chars`` of what is left; null texts and rows without doc_id
    are kept as they are; of rows that share a doc_id each text loses its own windows only.
    """
    prepare(spark)
    cut = linededup.drop_repeated_lines(_documents(docs))
    return _documents(cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays.

    Texts without words, null texts and rows without doc_id are in no group and stay; rows
    that share a doc_id stay or go together.
    """
    prepare(spark)
    groups = jaccard.jaccard_components(docs, ngram=5, percent=80)
    gone = groups.where("doc_id <> component_id").select("doc_id")
    return _documents(docs.join(gone, "doc_id", "left_anti"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or thinned to the weights of a tempered mixture.

    A null source is one of its own; documents without words take no quota; the documents
    of a source without any words are left out; repeated rows count each.
    """
    return _documents(mixing.mix_sources(_documents(docs)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 2048 tokens.

    A null or empty text is one piece of the end id; rows with null or repeated ids are
    packed each.
    """
    prepare(spark)
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The trained classifier and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
