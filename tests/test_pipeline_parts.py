import json

import pytest
from pyspark.sql import functions as F

from gleanworks.operators.splits import split_uniform
from gleanworks.plans import experiment
from gleanworks.sources import corpora
from gleanworks.sources.store import RunStore
from gleanworks.streaming import errors as streaming


def write(path, data):
    path.write_text(data if isinstance(data, str) else json.dumps(data))
    return str(path)


def test_experiment_end_to_end(spark):
    rows = [(i, [f"unit {j} of {i}" for j in range(4)], [j % 2 for j in range(4)]) for i in range(200)]
    samples = spark.createDataFrame(rows, "sample_id long, input_units array<string>, input_unit_labels array<int>")
    scored = experiment.evaluate(experiment.score(split_uniform(samples), experiment.offline_scorer)).cache()
    assert scored.where("relevancy_scores IS NULL").count() == 0
    cut, kept = experiment.calibrate_and_retain(scored, "relevancy_scores", 0.1, 0.8)
    assert cut is not None and 0 < kept.where("kept").count() <= kept.count() == 50 * 4

    calls = []

    def flaky(prompts):
        calls.extend(prompts)
        return [None if "Some units" not in p else experiment.offline_scorer([p])[0] for p in prompts]

    assert experiment.score(samples.limit(3), flaky).where("size(relevancy_scores) = 4").count() == 3
    prompts = samples.limit(5).select("sample_id", F.lit("Units:\n0. a\n\n").alias("prompt"))
    first, new = experiment.cached(prompts, None, experiment.offline_scorer, "m")
    assert first.count() == 5 and new.count() == 1
    again, none = experiment.cached(prompts, new, experiment.offline_scorer, "m")
    assert again.where("response IS NOT NULL").count() == 5 and none.count() == 0


def test_run_store(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "store"))
    store.init()
    ds = store.get_or_create("datasets", "demo", has_intent=True)
    assert store.get_or_create("datasets", "demo")["id"] == ds["id"]
    model = store.get_or_create("models", "m", provider="local")
    run = store.create_run(ds["id"], model["id"], name="r")
    store.start_run(run)
    store.complete_run(run, mean_ap=0.5, tags=["a"])
    row = store.table("runs").first()
    assert (row.status, row.mean_ap, row.tags) == ("completed", 0.5, ["a"]) and row.started_at is not None
    with pytest.raises(ValueError):
        store.start_run(run)
    with pytest.raises(ValueError):
        store.complete_run(run, colour=1)
    scored = spark.createDataFrame([(0, [0.1], [1], 0.5), (1, None, [0, 1], None)], "sample_id int, s array<double>, input_unit_labels array<int>, ap double")
    store.store_samples(run, scored, "s", "ap")
    assert [r.status for r in store.samples(run).collect()] == ["scored", "failed"]
    assert json.loads(store.export(run).first().json)["mean_ap"] == 0.5
    assert store.delete_run(run) and not store.delete_run(run) and store.samples(run).count() == 0
    other = store.create_run(ds["id"], model["id"])
    store.fail_run(other, "broken")
    assert store.runs_of(ds["id"], "failed").count() == 1 and store.delete_all(True) == 1


def test_subsume_and_ectsum(spark, tmp_path):
    states = write(tmp_path / "s.csv", 'name,sid,sentence\nOhio,2,"B, c."\nOhio,1,A.\n')
    user = write(tmp_path / "u.txt", {"intent": "q", "HITId": "h", "summaries": [{"state_name": "Ohio", "state_id": 1, "sentence_ids": [2], "sentences": ["B, c."], "used_keywords": []}, {"state_name": "None", "state_id": 2, "sentence_ids": [1], "sentences": ["z"], "used_keywords": []}]})
    rows = {len(r.input_units): r for r in corpora.subsume(corpora.subsume_summaries(spark, user), corpora.subsume_states(spark, states)).collect()}
    assert rows[2].input_units == ["A.", "B, c."] and rows[2].input_unit_labels == [0, 1] and rows[0].input == ""
    nd = write(tmp_path / "e.json", json.dumps({"doc": "a\nb", "summaries": "s", "labels": "0\n1"}) + "\n")
    assert corpora.ectsum(spark, {"test": nd}).first().input_unit_labels == [0, 1]


def test_hotpotqa_contractnli_puma(spark, tmp_path):
    hot = write(tmp_path / "h.json", [{"question": "q?", "answer": "a", "supporting_facts": [["T", 1]], "context": [["T", ["x", "y"]], ["U", ["z"]]]}])
    r = corpora.hotpotqa(spark, [hot]).first()
    assert (r.input_units, r.input_unit_labels, r.output_units) == (["x", "y", "z"], [0, 1, 0], ["y"])
    nli = write(tmp_path / "c.json", {"documents": [{"id": 1, "text": "abcdef", "spans": [[0, 3], [3, 6]], "file_name": "f", "annotation_sets": [{"annotations": {"h1": {"choice": "Entailment", "spans": [1]}, "h2": {"choice": "NotMentioned", "spans": []}}}]}], "labels": {"h1": {"hypothesis": "H"}}})
    r = corpora.contractnli(spark, nli, "dev").collect()
    assert len(r) == 1 and r[0].input_units == ["abc", "def"] and r[0].input_unit_labels == [0, 1] and r[0].intent == "H"
    raw = "uri: x\nanswer_0: One two. Three four.\n"
    start = raw.index("Three")
    puma = write(tmp_path / "p.json", [{"question": "q", "context": "", "raw_text": raw, "labelled_answer_spans": {"CAUSE": [{"label_spans": [start, start + 5]}]}, "labelled_summaries": {}}])
    rows = corpora.puma(spark, puma).collect()
    assert len(rows) == 1 and rows[0].intent == "CAUSE" and rows[0].input_unit_labels == [0, 1]


def test_evidence_and_physionet(spark, tmp_path):
    (tmp_path / "txt").mkdir()
    write(tmp_path / "txt" / "PMC7.txt", "First fact. Second fact.")
    ann = write(tmp_path / "a.csv", "PMCID,UserID,Evidence Start,Evidence End\n7,1,12,20\n7,1,-1,5\n8,1,0,3\n")
    rows = corpora.evidence_inference(corpora.evidence_annotations(spark, ann), corpora.articles(spark, str(tmp_path / "txt"))).collect()
    assert len(rows) == 1 and rows[0].input_unit_labels == [0, 1] and rows[0].intent == "User1"
    ann = write(tmp_path / "a2.csv", "PMCID,UserID,PromptID,Evidence Start,Evidence End\n7,1,5,12,20\n")
    asked = write(tmp_path / "q.csv", 'PromptID,PMCID,Outcome,Intervention,Comparator\n5,7,"pain, any",drug,placebo\n')
    split = write(tmp_path / "train.txt", "5\n\n6\n")
    r = corpora.evidence_inference_raw(corpora.evidence_annotations(spark, ann), corpora.evidence_prompts(spark, asked), corpora.evidence_splits(spark, {"train": split})).first()
    assert (r.Outcome, r.Intervention, r.split, r.PMCID) == ("pain, any", "drug", "train", 7)
    rec = write(tmp_path / "r.text", "START_OF_RECORD=3||||4||||\nSeen by Doctor Who. No pain ; fever .||||END_OF_RECORD\n")
    marks = write(tmp_path / "m.csv", "record_id,begin,length,type\n3||||4,8,10,NAME\n")
    sents = corpora.physionet_sentences(corpora.physionet_records(spark, rec), corpora.physionet_annotations(spark, marks))
    assert any("B-NAME" in r.ner_tags for r in sents.collect())
    notes = write(tmp_path / "fix.txt", str({"id": "3||||4_sent_0", "correction": "[[('Seen', 'B-DATE')], [('nothing', 'B-X')]]"}) + "\n")
    fixed = corpora.apply_corrections(sents, corpora.physionet_corrections(spark, notes)).where("record_id like '%_sent_0'").first()
    assert fixed.ner_tags[0] == "B-DATE" and "B-NAME" in fixed.ner_tags
    assert corpora.physionet(spark, rec, marks, notes).count() == 1
    docs = corpora.standardize(corpora.claims_to_documents(corpora.sentences_to_claims(sents), " "), "physionet")
    r = docs.first()
    assert sum(r.input_unit_labels) >= 1 and len(r.input_units) == len(r.input_unit_labels)
    with pytest.raises(ValueError):
        corpora.dataset_config("nope")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i // 50} {i % 24:02d}:10:00", i, "error" if i % 3 else "view", 1.0, "{}") for i in range(100)]
    table = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts"))
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = streaming.hourly(streaming.event_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("timeline").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("timeline").collect()) == sorted(streaming.hourly(table).collect())
