"""Scans of the seven raw corpora into the sample shape ``(intent, input, input_units, input_unit_labels, output_text, output_units)``.

Files must be staged; nothing is downloaded.  Every loader takes a session and
paths and returns a lazy DataFrame, so pruning and filters reach the scan.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import HEADERS, answers_udf, base_id, claims_udf, clip_to, corrected_udf, iob_tags, note_spans_udf, overlap_labels, sentence_index, spans_udf

PERSPECTIVES = ("CAUSE", "EXPERIENCE", "INFORMATION", "QUESTION", "SUGGESTION")
MULTI_INTENT = {"puma", "subsume", "evidence_inference", "contractnli"}
DATASETS = ("contractnli", "ectsum", "evidence_inference", "hotpotqa", "physionet", "puma", "subsume")
COLUMNS = ("intent", "input", "input_units", "input_unit_labels", "output_text", "output_units")
#: Per corpus, names of its own that stand for common columns.
RENAMES = {"physionet": {"input_claims": "input_units", "claim_labels": "input_unit_labels"}}


def dataset_config(name: str) -> dict[str, object]:
    key = name.lower()
    if key not in DATASETS:
        raise ValueError(f"unknown dataset {name!r}")
    return {"name": key, "multi_intent": key in MULTI_INTENT}


def standardize(df: DataFrame, dataset: str) -> DataFrame:
    """The common columns that exist, under their common names; everything else is dropped."""
    renames = RENAMES.get(dataset_config(dataset)["name"], {})
    return df.select(*[F.col(c).alias(renames.get(c, c)) for c in df.columns if renames.get(c, c) in COLUMNS])


def _positives(units: Column, labels: Column) -> Column:
    return F.filter(units, lambda u, i: F.get(labels, i) == 1)


def _finish(df: DataFrame, *more: str) -> DataFrame:
    out = _positives(F.col("input_units"), F.col("input_unit_labels"))
    return df.withColumn("output_units", out).withColumn("output_text", F.array_join("output_units", " ")).select(*COLUMNS, *more)


def puma(spark: SparkSession, path: str, corrections: DataFrame | None = None) -> DataFrame:
    """JSON array of questions with answers; one row per perspective that has a labelled span.

    ``corrections(row, raw_text)`` replaces single texts by their position in the file.
    """
    schema = "question string, context string, raw_text string, labelled_answer_spans map<string,array<struct<label_spans:array<int>>>>, labelled_summaries map<string,string>"
    raw = spark.read.schema(schema).json(path, multiLine=True).withColumn("row", F.monotonically_increasing_id())
    if corrections is not None:
        raw = raw.join(corrections.select("row", F.col("raw_text").alias("fixed")), "row", "left").withColumn("raw_text", F.coalesce("fixed", "raw_text"))
    rows = raw.withColumn("spans", answers_udf("raw_text")).withColumn("intent", F.explode(F.array(*[F.lit(p) for p in PERSPECTIVES])))
    marks = F.transform(F.coalesce(F.element_at("labelled_answer_spans", F.col("intent")), F.array()), lambda s: F.struct(F.get(s["label_spans"], 0).alias("start"), F.get(s["label_spans"], 1).alias("end")))
    labelled = rows.withColumn("input_unit_labels", overlap_labels(F.col("spans"), marks)).where(F.exists("input_unit_labels", lambda y: y == 1))
    return _finish(labelled.withColumn("input", F.col("raw_text")).withColumn("input_units", F.col("spans.text")))


def subsume_states(spark: SparkSession, path: str) -> DataFrame:
    """CSV ``name, sid, sentence`` grouped to one row per state, sentences in order of sid."""
    rows = spark.read.schema("name string, sid long, sentence string").csv(path, header=True)
    packed = rows.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("sid", F.coalesce("sentence", F.lit("")).alias("sentence")))).alias("s"))
    return packed.select(F.col("name").alias("state_name"), F.col("s.sid").alias("sids"), F.col("s.sentence").alias("sentences"))


def subsume_summaries(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per file, a row per summary."""
    schema = "intent string, HITId string, summaries array<struct<state_name:string,state_id:long,sentence_ids:array<long>,sentences:array<string>,used_keywords:array<string>>>"
    raw = spark.read.schema(schema).json(path, multiLine=True).withColumn("source_file", F.col("_metadata.file_name"))
    return raw.select("intent", "source_file", F.explode("summaries").alias("s")).select("intent", "source_file", "s.*")


def subsume(summaries: DataFrame, states: DataFrame) -> DataFrame:
    """Summaries with their state's sentences; a state that is missing leaves empty lists."""
    summaries = summaries.withColumnRenamed("sentences", "chosen")
    rows = summaries.join(states, "state_name", "left").withColumn("input_units", F.coalesce("sentences", F.expr("cast(array() as array<string>)")))
    rows = rows.withColumn("input_unit_labels", F.coalesce(F.transform("sids", lambda s: F.array_contains("sentence_ids", s).cast("int")), F.expr("cast(array() as array<int>)")))
    return rows.select("intent", F.array_join("input_units", " ").alias("input"), "input_units", "input_unit_labels", F.array_join("chosen", " ").alias("output_text"), F.col("chosen").alias("output_units"))


def ectsum(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """NDJSON per split with newline-separated text."""
    out = None
    for split, path in sorted(paths.items()):
        raw = spark.read.schema("doc string, summaries string, labels string").json(path)
        labels = F.transform(F.split("labels", "\n"), lambda x: x.try_cast("int"))
        part = raw.select(F.lit("").alias("intent"), F.col("doc").alias("input"), F.split("doc", "\n").alias("input_units"), labels.alias("input_unit_labels"), F.col("summaries").alias("output_text"), F.split("summaries", "\n").alias("output_units"), F.lit(split).alias("split"))
        out = part if out is None else out.unionByName(part)
    return out


def hotpotqa(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Questions with titled paragraphs; a sentence is relevant if (title, index) is a supporting fact."""
    raw = spark.read.schema("question string, answer string, supporting_facts string, context string").json(paths, multiLine=True)
    raw = raw.withColumn("facts", F.from_json("supporting_facts", "array<array<string>>")).withColumn("paragraphs", F.from_json("context", "array<array<string>>"))
    titled = F.flatten(F.transform("paragraphs", lambda p: F.transform(F.from_json(F.get(p, 1), "array<string>"), lambda s, i: F.struct(F.get(p, 0).alias("title"), i.cast("string").alias("i"), s.alias("s")))))
    rows = raw.withColumn("u", titled)
    label = F.transform("u", lambda x: F.exists("facts", lambda f: (F.get(f, 0) == x["title"]) & (F.get(f, 1) == x["i"])).cast("int"))
    rows = rows.select(F.col("question").alias("intent"), F.array_join("u.s", " ").alias("input"), F.col("u.s").alias("input_units"), label.alias("input_unit_labels"))
    return _finish(rows)


def evidence_inference(annotations: DataFrame, articles: DataFrame) -> DataFrame:
    """``annotations(PMCID, UserID, start, end)`` with ``articles(PMCID, text)``: a row per article and annotator.

    Invalid spans (negative offsets) are dropped first; articles without text give no row.
    """
    spans = annotations.where("start >= 0 AND end >= 0").groupBy("PMCID", "UserID").agg(F.collect_list(F.struct("start", "end")).alias("evidence"))
    rows = spans.join(articles, "PMCID", "left").where("trim(coalesce(text, '')) <> ''").withColumn("spans", spans_udf("text"))
    rows = rows.select(F.concat(F.lit("User"), F.col("UserID").cast("string")).alias("intent"), F.col("text").alias("input"), F.col("spans.text").alias("input_units"), overlap_labels(F.col("spans"), F.col("evidence")).alias("input_unit_labels"))
    return _finish(rows)


def evidence_annotations(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True)
    more = [F.col(c).try_cast("long").alias(c) for c in ("PromptID",) if c in raw.columns] + [F.col(c) for c in ("Label",) if c in raw.columns]
    return raw.select(F.col("PMCID").try_cast("long").alias("PMCID"), F.col("UserID").try_cast("long").alias("UserID"), F.col("Evidence Start").try_cast("int").alias("start"), F.col("Evidence End").try_cast("int").alias("end"), *more)


def evidence_prompts(spark: SparkSession, path: str) -> DataFrame:
    """``(PromptID, PMCID, Outcome, Intervention, Comparator)`` of the prompts file."""
    raw = spark.read.csv(path, header=True, multiLine=True)
    return raw.select(F.col("PromptID").try_cast("long").alias("PromptID"), F.col("PMCID").try_cast("long").alias("PMCID"), *[F.col(c) for c in ("Outcome", "Intervention", "Comparator")])


def evidence_splits(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """``(PromptID, split)`` from files with a prompt's id a line."""
    out = None
    for split, path in sorted(paths.items()):
        part = spark.read.text(path).select(F.trim("value").try_cast("long").alias("PromptID"), F.lit(split).alias("split")).where("PromptID IS NOT NULL")
        out = part if out is None else out.unionByName(part)
    return out


def evidence_inference_raw(annotations: DataFrame, prompts: DataFrame | None = None, splits: DataFrame | None = None) -> DataFrame:
    """Annotations beside the prompt they answer and its split, where these are given."""
    out = annotations
    if prompts is not None:
        out = out.join(prompts.drop("PMCID"), "PromptID", "left")
    if splits is not None:
        out = out.join(splits.dropDuplicates(["PromptID"]), "PromptID", "left")
    return out


def articles(spark: SparkSession, path: str) -> DataFrame:
    """``PMC<id>.txt`` files as (PMCID, text)."""
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_name"))
    return raw.select(F.regexp_extract("file", r"PMC(\d+)\.txt", 1).try_cast("long").alias("PMCID"), F.col("value").alias("text"))


def contractnli(spark: SparkSession, path: str, split: str = "") -> DataFrame:
    """Documents by hypotheses that they mention; spans named by the annotation are relevant."""
    schema = "documents array<struct<id:long,text:string,spans:array<array<int>>,file_name:string,annotation_sets:array<struct<annotations:map<string,struct<choice:string,spans:array<int>>>>>>>, labels map<string,struct<hypothesis:string>>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    docs = raw.select("labels", F.explode("documents").alias("d"))
    rows = docs.select("labels", "d", F.explode(F.get("d.annotation_sets", 0)["annotations"]).alias("hyp_id", "a")).where("a.choice <> 'NotMentioned'")
    units = F.transform("d.spans", lambda s: F.substring(F.col("d.text"), F.get(s, 0) + 1, F.get(s, 1) - F.get(s, 0)))
    rows = rows.withColumn("input_units", units).withColumn("input_unit_labels", F.transform("d.spans", lambda _, i: F.array_contains("a.spans", i).cast("int")))
    rows = rows.withColumn("intent", F.element_at("labels", F.col("hyp_id"))["hypothesis"]).withColumn("input", F.col("d.text")).withColumn("nli_label", F.col("a.choice")).withColumn("doc_id", F.col("d.id")).withColumn("source_split", F.lit(split))
    return _finish(rows, "hyp_id", "nli_label", "doc_id", "source_split")


def physionet_records(spark: SparkSession, path: str) -> DataFrame:
    """``START_OF_RECORD=<a>||||<b>||||`` blocks as (record_id, text)."""
    raw = spark.read.text(path, wholetext=True)
    pattern = r"(?s)START_OF_RECORD=(\d+)\|\|\|\|(\d+)\|\|\|\|(.*?)\|\|\|\|END_OF_RECORD"
    group = lambda i: F.regexp_extract_all("value", F.lit(pattern), F.lit(i))
    return raw.select(F.explode(F.arrays_zip(group(1).alias("a"), group(2).alias("b"), group(3).alias("t"))).alias("r")).select(F.concat_ws("||||", "r.a", "r.b").alias("record_id"), F.col("r.t").alias("text"))


def physionet_annotations(spark: SparkSession, path: str) -> DataFrame:
    """CSV ``record_id, begin, length, type`` grouped by record, ends computed."""
    raw = spark.read.schema("record_id string, begin int, length int, type string").csv(path, header=True)
    return raw.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct(F.col("begin").alias("start"), (F.col("begin") + F.col("length")).alias("end"), "type"))).alias("annotations"))


def physionet_corrections(spark: SparkSession, path: str) -> DataFrame:
    """``(record_id, corrections)`` from lines ``{'id': ..., 'correction': ...}``, in the order of the file."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("i", "line")).where("trim(line) <> ''")

    @F.pandas_udf("record_id string, correction string")
    def read(lines: pd.Series) -> pd.DataFrame:
        entries = [ast.literal_eval(line) for line in lines]
        return pd.DataFrame([(str(e["id"]), str(e["correction"])) for e in entries], columns=["record_id", "correction"])

    rows = raw.select("i", read("line").alias("c")).select("i", "c.*")
    return rows.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("i", "correction"))).alias("c")).select("record_id", F.col("c.correction").alias("corrections"))


def apply_corrections(sentences: DataFrame, corrections: DataFrame | None) -> DataFrame:
    """``sentences`` with the tags of corrected token sequences overwritten; corrections name sentences by record_id."""
    if corrections is None:
        return sentences
    both = sentences.join(corrections, "record_id", "left")
    return both.select("record_id", "tokens", corrected_udf("tokens", "ner_tags", "corrections").alias("ner_tags"))


def physionet(spark: SparkSession, records: str, annotations: str, corrections: str | None = None, most: int = 100, least: int = 3) -> DataFrame:
    """The whole corpus as documents of claims: records, annotations and corrections to sentences, claims, documents."""
    sentences = physionet_sentences(physionet_records(spark, records), physionet_annotations(spark, annotations))
    fixed = apply_corrections(sentences, physionet_corrections(spark, corrections) if corrections else None)
    return claims_to_documents(sentences_to_claims(fixed, most, least))


def physionet_sentences(records: DataFrame, annotations: DataFrame, shift: int = 1) -> DataFrame:
    """``(record_id, tokens, ner_tags)``: a row per sentence, annotations clipped to it and re-based.

    Sentences of more than 150 tokens are cut further.  Annotation offsets are moved by
    ``shift``, as the corpus counts them.
    """
    both = records.join(annotations, "record_id").withColumn("annotations", F.transform("annotations", lambda a: F.struct((a["start"] + shift).alias("start"), (a["end"] + shift).alias("end"), a["type"].alias("type"))))
    cut = both.select("record_id", "annotations", F.posexplode(note_spans_udf("text")).alias("i", "s"))
    cut = cut.select(F.concat_ws("_sent_", "record_id", "i").alias("record_id"), F.col("s.text").alias("text"), clip_to(F.col("annotations"), F.col("s.start"), F.col("s.end")).alias("spans"))

    @F.pandas_udf(T.StructType([T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("ner_tags", T.ArrayType(T.StringType()))]))
    def tag(texts, spans):
        return pd.DataFrame([iob_tags(t, [(s["start"], s["end"], s["type"]) for s in x]) for t, x in zip(texts, spans, strict=True)], columns=["tokens", "ner_tags"])

    return cut.select("record_id", tag("text", "spans").alias("t")).select("record_id", "t.*")


def sentences_to_claims(sentences: DataFrame, most: int = 100, least: int = 3) -> DataFrame:
    """A row per claim: ids, tokens, tags, text and label."""
    rows = sentences.select(base_id(F.col("record_id")).alias("base_id"), sentence_index(F.col("record_id")).alias("sentence_index"), "tokens", "ner_tags", F.posexplode(claims_udf(most, least)("tokens", "ner_tags")).alias("claim_index", "c"))
    piece = lambda c: F.slice(c, F.col("c.start") + 1, F.col("c.end") - F.col("c.start"))
    return rows.select("base_id", "sentence_index", "claim_index", piece("tokens").alias("claim_tokens"), piece("ner_tags").alias("claim_tags"), F.array_join(piece("tokens"), " ").alias("claim_text"), F.col("c.label").alias("claim_label"))


def claims_to_documents(claims: DataFrame, join_with: str = "") -> DataFrame:
    """Claims gathered to one row per document, in order."""
    packed = claims.groupBy("base_id").agg(F.array_sort(F.collect_list(F.struct("sentence_index", "claim_index", "claim_text", "claim_label"))).alias("c"))
    positive = F.transform(F.filter("c", lambda x: x["claim_label"] == 1), lambda x: x["claim_text"])
    return packed.select(F.col("base_id").alias("id"), F.array_join("c.claim_text", join_with).alias("input"), F.col("c.claim_text").alias("input_claims"), F.col("c.claim_label").alias("claim_labels"), F.array_join(positive, join_with).alias("output_text"), positive.alias("output_units"))


def header_tokens(token: Column) -> Column:
    """``X:`` with a known header or at least two capitals, as an expression."""
    return F.upper(F.regexp_replace(token, ":$", "")).isin(*sorted(HEADERS)) & token.endswith(":") | token.rlike("^[A-Z]{2,}:$")
