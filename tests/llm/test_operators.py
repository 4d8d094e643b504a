"""Corpus operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanworks.llm import chat, common, linededup, media, merkle, mixing, packing, pii, substring, toxicity

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def words(rng, n, vocab=400):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


def test_substring_index(spark, docs_of):
    rng = random.Random(2)
    passage = words(rng, 70)
    texts = [None, "", "a b", " ".join(passage), " ".join(passage), " ".join(words(rng, 30) + passage + words(rng, 30)), " ".join(passage[:49])]
    texts += [" ".join(words(rng, 40) + passage[k : k + 55] + ["\t"] + passage[:50]) for k in range(8)] + [" ".join(["x"] * 300), " ".join(["x"] * 120), " ".join(words(rng, 5000))]
    seen, want = {}, {}
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        gone = np.zeros(len(w), bool)
        keys = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        for k, key in enumerate(keys):
            gone[k : k + 50] |= seen.get(key, i) < i
        for key in keys:
            seen.setdefault(key, i)
        want[i] = (len(w), int(gone.sum()), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    docs = docs_of(texts)
    for batches in (1, 3):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.deduplicate(docs, batches=batches).collect()}
        assert got == want
    assert substring.op1_substring_index(docs.limit(0)).count() == 0
    alone = substring.op1_substring_index(docs.withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert len(alone) == len(texts) and not any(r.n_removed for r in alone)


def test_substring_index_reopened_over_batches(spark, docs_of, tmp_path):
    """Six batches, each fed to an index opened anew from its path, answer as one table; merged runs replace their parts."""
    rng = random.Random(8)
    shared = [words(rng, 60) for _ in range(12)]
    texts = [" ".join(words(rng, rng.randrange(80)) + rng.choice(shared)[rng.randrange(9) :] + words(rng, rng.randrange(80))) for _ in range(90)]
    texts[40] = texts[3]
    texts[77] = texts[40]
    docs = docs_of(texts)
    whole = {tuple(r) for r in substring.deduplicate(docs, batches=1, with_text=False).collect()}
    path, marks = str(tmp_path / "index"), None
    for k in range(6):
        index = substring.SubstringIndex(spark, path)
        assert index.state["version"] == k
        found = index.ingest(docs.where((F.col("doc_id") >= 15 * k) & (F.col("doc_id") < 15 * k + 15)))
        marks = found if marks is None else marks.unionByName(found)
        assert all(len(runs) <= 2 * substring.FANOUT for runs in index.state["runs"].values())
        index.close()
    assert {tuple(r) for r in substring.remove(docs, marks, with_text=False).collect()} == whole
    last = substring.SubstringIndex(spark, path)
    assert [level for level, _ in last.state["runs"]["texts"]] == [1, 0, 0] and sum(r.count() for r in last.runs("texts")) == 88
    plan = last.runs("heads")[0].join(last.runs("heads")[1], "h")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    last.close()


def test_line_windows(spark, docs_of):
    texts = [None, "", "a\nb\nc\nd", "x\na\nb\nc", "a\nb\nc\na\nb\nc\nd", "\n\n\n\n", "\n\n\n", "a\nb"]
    out = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in linededup.drop_repeated_lines(docs_of(texts).withColumn("n_lines", F.lit(9))).collect()}
    assert out[2] == ("a\nb\nc\nd", 4, 0) and out[3] == ("x", 4, 3) and out[4] == ("", 7, 7)
    assert out[0] == (None, 0, 0) and out[5] == ("\n\n\n\n", 5, 0) and out[7] == ("a\nb", 2, 0)
    assert linededup.op8_line_windows(docs_of(texts).limit(0)).count() == 0


def test_line_windows_of_a_shared_id_stay_apart(spark, docs_of):
    texts = ["a\nb\nc", "a\nb\nc\nd", "e\nf\ng\nh", "a\nb\nc\nd"]
    out = linededup.drop_repeated_lines(docs_of(texts, [1, 2, 2, 2])).collect()
    assert sorted((r.doc_id, r.text, r.n_removed) for r in out) == [(1, "a\nb\nc", 0), (2, "d", 3), (2, "d", 3), (2, "e\nf\ng\nh", 0)]


def bisected(tokens, entropy, max_repeats):
    """Weights by a plain bisection, point by point."""
    shares = [t / sum(tokens) for t in tokens if t]
    weights = lambda x: [s**x / sum(q**x for q in shares) for s in shares]
    peaked = lambda x: -sum(w * np.log(w) for w in weights(x)) < entropy * np.log(len(shares))
    often = lambda x: max(w / s for w, s in zip(weights(x), shares, strict=True)) > max_repeats
    lo, hi = 0.0, 1.0
    if peaked(1.0):
        for _ in range(60):
            lo, hi = (lo, (lo + hi) / 2) if peaked((lo + hi) / 2) else ((lo + hi) / 2, hi)
        x = lo
    else:
        x = 1.0
    if often(x):
        lo, hi = x, 1.0
        for _ in range(60):
            lo, hi = ((lo + hi) / 2, hi) if often((lo + hi) / 2) else (lo, (lo + hi) / 2)
        x = hi
    return x, weights(x)


def test_mixing_weights_and_order(spark):
    for tokens, entropy, most in (([900, 90, 10], 0.9, 100), ([900, 90, 10], 1.0, 3), ([5, 5], 0.97, 4), ([1000, 1], 0.5, 2), ([7], 0.97, 4), (list(range(1, 900)), 0.99, 4)):
        sources = spark.createDataFrame([(f"s{i}", t, 10) for i, t in enumerate([*tokens, 0])], "_mx_src string, t long, c long")
        got = {r._mx_src: r._mx_weight for r in mixing.quotas(sources, entropy, most).collect()}
        _, want = bisected(tokens, entropy, most)
        assert got == pytest.approx({f"s{i}": w for i, w in enumerate(want)}, abs=2e-9)
    assert mixing.quotas(sources.where("t = 0")) is None
    rows = [(i, "a" if i < 80 else None if i < 90 else "b", 10, "e") for i in range(100)] + [(100, "c", 0, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n long, epoch string")
    out = mixing.mix_sources(docs, tokens="n", entropy=0.95, max_repeats=4.0, blocks=4).toPandas()
    share = out.groupby(out.source.fillna("none")).n.sum() / out.n.sum()
    _, want = bisected([100, 100, 800], 0.95, 4.0)
    assert share["b"] == pytest.approx(want[0], abs=0.02) and share["a"] == pytest.approx(want[2], abs=0.02)
    assert out.block.max() == 3 and mixing.op2_temperature_mix(docs.withColumn("text", F.lit("x")).limit(0)).count() == 0
    # Every whole epoch reads a source once, each in an order of its own.
    b = out[out.source == "b"]
    counts = b.groupby("epoch").doc_id.nunique()
    assert len(counts) > 1 and (counts[:-1] == 10).all() and b.groupby(["epoch", "doc_id"]).size().max() == 1


def test_mixing_leaves_out_sources_without_words(spark):
    """Stated in the docstring and the README."""
    rows = [(1, "a", 5), (2, "a", 0), (3, "b", 0), (4, None, 0), (5, "c", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n long")
    assert {r.doc_id for r in mixing.mix_sources(docs, tokens="n").collect()} - {2} == {1, 5}
    assert mixing.mix_sources(docs.where("n = 0"), tokens="n").count() == 0
    assert "without any words" in mixing.__doc__


def test_toxicity_learns_words_and_prefixes(spark, docs_of):
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(900):
        w = words(rng, rng.randrange(5, 60))
        toxic = i % 4 == 0
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["Vile!", "vilest", "horrid,"])
        texts.append(" ".join(w))
        labels.append((i, 0, int(toxic)))
    docs = docs_of([*texts, None, "", "vile " * 20_000])
    table = spark.createDataFrame([*labels, (None, 0, 1), (5000, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.op3_toxicity(docs, table).collect()}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(out[i].held_out for i in held) and len(held) < 400
    pos, neg = [out[i].score for i in held if labels[i][2]], [out[i].score for i in held if not labels[i][2]]
    assert np.mean([p > n for p in pos for n in neg]) > 0.97
    assert out[900].score == out[901].score and out[902].score > 0.5 and all(r.predicted == int(r.score >= 0.7) for r in out.values())
    none = toxicity.op3_toxicity(docs, table.where("toxic = 0"))
    assert {r.score for r in none.collect()} == {0.5}


def test_toxicity_forward_pass_equals_brute_force(monkeypatch):
    """Windows, padding, pooling and chunks of any size, against one window at a time."""
    rng = np.random.default_rng(0)
    texts = ["", None, "one", "One two", " ".join(f"w{i}" for i in range(50)), "x", "é ü " * 9]
    model = toxicity.Model(rng.normal(size=(toxicity.BUCKETS + 1, toxicity.DIM)).astype(np.float32), [rng.normal(size=(w * toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS], [rng.normal(size=toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS], rng.normal(size=3 * toxicity.FILTERS).astype(np.float32) * 0.1, 0.3, 0.7, -0.2)
    model.embed[toxicity.BUCKETS] = 0
    ids, first = toxicity.word_ids(pa.array(texts, pa.string()))
    want = []
    for a, z in zip(first, [*first[1:], len(ids)], strict=True):
        x = [sum(model.embed[j].astype(float) for j in row) for row in ids[a:z]]
        best = []
        for w, b, width in zip(model.filters, model.bias, toxicity.WIDTHS, strict=True):
            best.append(np.maximum(np.max([np.concatenate(x[i : i + width]) @ w + b for i in range(len(x) - width + 1)], axis=0), 0))
        want.append(1 / (1 + np.exp(-((np.concatenate(best) @ model.out + model.out_bias) * model.slope + model.shift))))
    for chunk in (5, 7, 1 << 15):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        assert model.scores(ids, first) == pytest.approx(np.array(want), abs=1e-4)
        top, at = model.pooled(ids, first, where=True)
        assert top == pytest.approx(model.pooled(ids, first)[0], abs=1e-4) and (at >= first[:, None]).all()


def test_toxicity_trains_on_long_texts_in_bounded_memory():
    import tracemalloc

    rng = random.Random(1)
    texts = [" ".join([*words(rng, 20_000), "vile" if i % 2 else "fine"]) for i in range(60)]
    tracemalloc.start()
    model = toxicity.learn(texts, [i % 2 for i in range(60)], ["en"] * 60, 0.5, folds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6 and model.thresholds.keys() == {"en"}
    a, b = toxicity.platt(np.array([-2.0, -1, 1, 2, 0.5, -0.5] * 50), np.array([0.0, 0, 1, 1, 0, 1] * 50), np.ones(300))
    assert a > 0 and abs(b) < 0.1


def test_media_round_trip(spark, docs_of):
    texts = [None, "", "a" * 64, "é" * 40, "x\0y", "x\0y", "long " * 30_000]
    rows = {r.doc_id: r for r in media.op4_media_sequences(docs_of(texts)).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        p = b + b"\0" * ((-len(b)) % 64 if b else 64)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.media_sha256 == hashlib.sha256(media.encode(p)).hexdigest() and r.media_bytes == len(media.encode(p))
        cells = [list(p[k : k + 64]) for k in range(0, len(p), 64)]
        change = sum(abs(x - y) for a, b in zip(cells, cells[1:], strict=False) for x, y in zip(a, b, strict=True))
        assert r.feature == f"{sum(p)}:{max(p)}:{change}:" + ".".join(str(sum(x // 16 == k for x in p)) for k in range(16))
    assert rows[4].feature == rows[5].feature and rows[0].feature == rows[1].feature
    page = '<p>One &amp; two</p><figure><img src="digest:' + "0" * 64 + '" alt="x"><figcaption>Cap <b>tion</b></figcaption></figure><script>no()</script>tail'
    assert media.parse_html(page) == [("text", "One & two", None, None), ("media", None, "digest:" + "0" * 64, "Cap tion"), ("text", "tail", None, None)]
    seqs = media.sequences(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string"), "page_id")
    missing = media.resolve(seqs, "page_id", media.described(media.media_store(docs_of(["q"])))).collect()
    assert len(missing) == 1 and missing[0].pos == 1 and missing[0].caption == "Cap tion" and missing[0].payload_bytes is None
    with pytest.raises(ValueError):
        media.decode(b"P5\n64 2\n255\nshort")


def test_pages_of_documents_interleave_text_and_media(spark, docs_of):
    """Paragraphs keep their order around the figure, marks in texts stay text, and media stay at their captions."""
    texts = ["one <b>\n\ntwo & three\n&lt;", None, "only"]
    docs = docs_of(texts)
    pages = docs.select("doc_id", media.page_of(F.col("text"), media._digest(F.col("text")), F.lit("cap")).alias("html"))
    store = media.described(media.media_store(docs))
    rows = {r.doc_id: [(i.kind, i.text or i.caption, i.media_bytes) for i in r["items"]] for r in media.interleave(media.sequences(pages, "doc_id"), "doc_id", store).collect()}
    size = lambda t: len(media.encode(media.pad((t or "").encode())))
    assert rows[0] == [("text", "one <b>", None), ("media", "cap", size(texts[0])), ("text", "two & three", None), ("text", "&lt;", None)]
    assert rows[1] == [("media", "cap", size(None))] and rows[2] == [("text", "only", None), ("media", "cap", size("only"))]
    several = "".join(f'<p>t{k}</p><figure><img src="digest:{hashlib.sha256(media.pad(t.encode())).hexdigest()}"><figcaption>c{k}</figcaption></figure>' for k, t in enumerate(["only", "none", "only"]))
    twice = spark.createDataFrame([(7, several), (7, several), (7, "<p>x</p>"), (None, several)], "page_id long, html string")
    got = media.interleave(media.sequences(twice, "page_id"), "page_id", store).collect()
    want = [("t0", None), ("c0", size("only")), ("t1", None), ("c1", None), ("t2", None), ("c2", size("only"))]
    assert sorted(len(r["items"]) for r in got) == [1, 6, 6, 6] and all([(i.text or i.caption, i.media_bytes) for i in r["items"]] == want for r in got if len(r["items"]) > 1)


def test_merkle(spark, docs_of):
    rng = random.Random(7)
    texts = [None, "", "🙂é", "\n".join(" ".join(words(rng, 12)) for _ in range(40)), "one line", "one line", " ".join(words(rng, 20_000))]
    ids = [3, 10, 11, 50, 51, 90, 400]
    rows = {r.doc_id: r for r in merkle.op5_merkle(docs_of(texts, ids)).collect()}
    order = sorted(range(len(ids)), key=lambda k: -ids[k])
    for at, k in enumerate(order):
        t, nxt = texts[k] or "", texts[order[(at + 1) % len(order)]] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        r = rows[ids[k]]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha(edited)) and 0 <= r.near_next <= 1
        assert (r.fingerprint == r.edited_fingerprint) == (t == edited)
    assert rows[51].fingerprint == rows[90].fingerprint and rows[3].fingerprint == rows[10].fingerprint and rows[50].near_edited > 0.4
    for r in rows.values():
        root, body = r.fingerprint.split("#")[0].split(":")
        sections = [x.split("=") for x in body.split("/")]
        assert root == sha("/".join(d for d, _ in sections))[:32]
        assert all(digest == sha(paragraphs)[:32] for digest, paragraphs in sections)
        assert len(r.fingerprint.split("#")[1]) <= 9 * merkle.SKETCH
    docs = docs_of(["a", "b"], [None, 1])
    assert merkle.op5_merkle(docs).count() == 2 and merkle.op5_merkle(docs.limit(0)).count() == 0


def test_merkle_differences_locate_edits(spark):
    """Edits, insertions, deletions and repeated paragraphs, found at the paragraph; equal texts differ nowhere."""
    rng = random.Random(17)
    lines = [" ".join(words(rng, 9)) for _ in range(60)]
    lines[30] = lines[31] = lines[5]
    edited = [*lines]
    edited[7] = "another line"
    edited[44] += " more"
    fewer = lines[:12] + lines[13:]
    once = lines[:31] + lines[32:]
    prints = spark.createDataFrame([(i, "\n".join(x)) for i, x in enumerate((lines, edited, fewer, once))], "i long, text string").withColumn("p", merkle.fingerprint(merkle.leaf_hashes(F.col("text"))))
    prints = {r.i: r.p for r in prints.collect()}

    def changed(a, b):
        found = spark.range(1).select(merkle.differences(F.lit(prints[a]), F.lit(prints[b]))).first()[0]
        first = [0]
        for s in prints[a].split(":")[1].split("/"):
            first.append(first[-1] + s.count(",") + 1)
        return [first[d.section] + d.paragraph for d in found]

    assert changed(0, 0) == [] and changed(0, 1) == [7, 44] and changed(1, 0) == [7, 44]
    assert changed(0, 2) == [12] and changed(2, 0) == []
    assert changed(0, 3) == [31] and changed(3, 0) == []


def test_merkle_likeness_estimates_long_texts(spark):
    rng = random.Random(19)
    w = words(rng, 30_000, 10**6)
    texts = [" ".join(w), " ".join(w[:20_000] + words(rng, 10_000, 10**6)), " ".join(words(rng, 30_000, 10**6))]
    a = spark.createDataFrame([tuple(texts)], "a string, b string, c string").select(*[merkle.sketch(merkle.leaf_hashes(F.col(c))).alias(c) for c in "abc"])
    near, far, same = a.select(merkle.likeness(F.col("a"), F.col("b")), merkle.likeness(F.col("a"), F.col("c")), merkle.likeness(F.col("a"), F.col("a"))).first()
    assert near == pytest.approx(2 / 3, abs=0.1) and far < 0.05 and same == 1


def test_merkle_ranges_hold_odd_ids(spark):
    """One far id does not put all others into one range."""
    ids = spark.range(2000).selectExpr("id AS doc_id").union(spark.range(1).selectExpr("1000000000000000 AS doc_id"))
    at, bucket = merkle._range_of(ids, 44)
    sizes = [r["count"] for r in ids.withColumn("_k", at).withColumn("b", bucket).groupBy("b").count().collect()]
    order = ids.withColumn("_k", at).withColumn("b", bucket).orderBy("doc_id").select("b").toPandas().b
    assert max(sizes) < 100 and sum(sizes) == 2001 and order.is_monotonic_increasing


def test_merkle_has_one_leaf_rule_for_all_lengths(spark, docs_of):
    """Pairs on both sides of 256 characters share the leaves of their common text."""
    rng = random.Random(11)
    line = " ".join(words(rng, 100))
    lines = "\n".join(" ".join(words(rng, 5)) for _ in range(20))[:260]
    rows = {r.doc_id: r for r in merkle.op5_merkle(docs_of([None, line[:300], line[:250], line[:260], lines[:250], lines], range(6))).collect()}
    assert rows[1].near_edited > 0.6 and rows[3].near_next > 0.8 and rows[5].near_next > 0.8
    diff = spark.range(1).select(merkle.differences(F.lit(rows[5].fingerprint), F.lit(rows[4].fingerprint))).first()[0]
    assert 0 < len(diff) < lines.count("\n") + 1


def test_merkle_leaves_survive_shifted_words(spark, docs_of):
    """A word put into or taken out of one long line disturbs only leaves beside it; long runs of one word still have several leaves."""
    w = words(random.Random(13), 400)
    texts = [" ".join(["new", *w]), " ".join(w), " ".join(w[:50] + w[51:]), None, " ".join(["x"] * 600), " ".join(["y"] * 600)]
    rows = {r.doc_id: r for r in merkle.op5_merkle(docs_of(texts, range(6))).collect()}
    assert rows[1].near_next > 0.9 and rows[2].near_next > 0.9
    assert rows[4].near_edited > 0 and rows[5].near_edited > 0


@pytest.fixture(scope="module")
def tokenizer():
    return packing.default_tokenizer()


def test_encoder_equals_the_tokenizer(tokenizer):
    from tokenizers import Tokenizer

    whole, fast = Tokenizer.from_file(tokenizer), packing.ChunkEncoder(tokenizer)
    texts = ["Don't STOP, it's 12a3 ''s.", "Straße ñ É. İ ΣΑΣ", "á ﬁ 日本語　x", "\x1c <|endoftext|> y", "", "ŉ ĳ ª µm ×÷"]
    for t in texts * 2:
        assert list(np.frombuffer(fast.text(t), "<u4")) == whole.encode(t, add_special_tokens=False).ids


def test_encoder_falls_back_for_other_files(tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    other = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.ChunkEncoder(packing.default_tokenizer()).by_chunks and not packing.ChunkEncoder(other).by_chunks
    settings = json.loads(Tokenizer.from_file(packing.default_tokenizer()).to_str())
    settings["normalizer"]["normalizers"].pop()
    (tmp_path / "cased.json").write_text(json.dumps(settings))
    for path in (other, str(tmp_path / "cased.json")):
        text = "Don't STOP  Über 12 it's\n"
        assert list(np.frombuffer(packing.ChunkEncoder(path).text(text), "<u4")) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_null_ids_spread_over_groups(spark, docs_of, tokenizer):
    rows = packing.pack(spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text")), tokenizer, group_docs=100).toPandas()
    groups = (rows.sequence_id // 2**32).value_counts()
    assert len(rows) == 2000 and len(groups) == 20 and groups.max() < 160


def test_packing(spark, docs_of, tokenizer):
    rng = random.Random(3)
    texts = [None, "", *(" ".join(words(rng, rng.randrange(1, 900))) for _ in range(60)), " ".join(words(rng, 9000))]
    rows = packing.pack(docs_of(texts), tokenizer, group_docs=20).toPandas()
    encode = packing.ChunkEncoder(tokenizer)
    for i, part in rows.groupby("doc_id"):
        ids = np.append(np.frombuffer(encode.text(texts[i] or ""), "<u4"), 1).astype("<u4")
        part = part.sort_values("start")
        assert part.doc_tokens.eq(len(ids)).all() and part.length.sum() == len(ids) and list(part.start) == [0, *part.length.cumsum()[:-1]]
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(part.start, part.length, part.ids_crc32, strict=True))
    for _, seq in rows.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert list(seq.offset) == [0, *seq.length.cumsum()[:-1]] and seq.length.sum() <= 2048
    assert set(rows.doc_id) == set(range(len(texts))) and packing.pack(docs_of(texts).limit(0), tokenizer).count() == 0


def test_tournament_tree_is_first_fit():
    rng = random.Random(1)
    lengths = [rng.randrange(1, 2049) for _ in range(300)]
    got, bins = packing.first_fit_decreasing(lengths, 2048), []
    for i in sorted(range(300), key=lambda i: (-lengths[i], i)):
        b = next((b for b, used in enumerate(bins) if used + lengths[i] <= 2048), len(bins))
        if b == len(bins):
            bins.append(0)
        assert got[i] == (b, bins[b])
        bins[b] += lengths[i]
    assert packing.first_fit_decreasing([], 5) == []


def luhn(d):
    return sum(v * 2 - 9 * (v > 4) if i % 2 else v for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def test_pii_base_spans(spark, docs_of):
    texts = [None, "", "mail a@b.c_x@d.e 1.2.3.4.5.6.7.8 999.1.1.1 000255.1.1.1 é+49 (0)30 123-4567-89. 4845168114407329-5 🎉 +1 (017) 555-7713x", "4845168114407329", "card 4845168114407328, a..b@c-.d.e2 +1+12345678901", "9" * 3000 + "@x.yz " + "a" * 3000, "1.2.3.4 " * 400, 'token = "908038b7daaf91e730d2f64001c52934d43d" x']
    rows = {r.doc_id: r for r in pii.op7_weak_pii(docs_of(texts)).collect()}
    for i, t in enumerate(texts):
        t, spans = t or "", []
        spans += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        spans += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub("[^0-9]", "", m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                spans.append(("card", *m.span()))
        spans += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
        spans.sort(key=lambda s: (s[1], pii.BASE.index(s[0])))
        assert rows[i].base_sha256 == sha(",".join(f"{k}:{a}:{z}" for k, a, z in spans)), (i, rows[i].spans)
        assert all(f"{k}:{a}:{z}" in rows[i].spans.split(",") for k, a, z in spans)
    assert pii.op7_weak_pii(docs_of(texts).limit(0)).count() == 0


def test_pii_added_spans_by_kind(spark, docs_of):
    """Planted spans of every added kind and decoys: recall and precision of each kind, and numbers without support stay out."""
    rng = random.Random(23)

    def iban():
        body = "".join(rng.choice("0123456789") for _ in range(18))
        check = 98 - int(body + "131400") % 97
        return f"DE{check:02d}{body}"

    plant = {
        "secret": lambda: f'{rng.choice(["token", "api_key", "password"])} = "{rng.getrandbits(160):040x}"',
        "iban": iban,
        "national": lambda: f"{rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}",
        "name": lambda: f'{rng.choice(["Mr", "Mrs.", "Dr."])} {rng.choice(pii.FIRST_NAMES)} {rng.choice(["Smith", "Weber", "García"])}',
        "address": lambda: f'{rng.randrange(1, 900)} {rng.choice(["Main", "Oak", "Station"])} Street',
    }
    decoys = ["Dr Pepper sold", "version 123-45", "DE12 ABCD EFGH 1234 5678", "000-12-3456", "ab = 'xy'", "room 12 Street", "9807915762804491", "1.2.3.999"]
    texts, want = [], []
    for i in range(400):
        parts, spans = [" ".join(words(rng, 6))], []
        for kind in rng.sample([*plant, None, None], 2):
            start = len(" ".join(parts)) + 1
            value = plant[kind]() if kind else rng.choice(decoys)
            parts += [value, " ".join(words(rng, 5))]
            if kind:
                spans.append((kind, start, start + len(value)))
        texts.append(" ".join(parts))
        want.append(spans)
    rows = {r.doc_id: [tuple(x.split(":")) for x in r.spans.split(",") if x] for r in pii.op7_weak_pii(docs_of(texts)).collect()}
    for kind in plant:
        truth = {(i, a, z) for i, spans in enumerate(want) for k, a, z in spans if k == kind}
        got = {(i, int(a), int(z)) for i, spans in rows.items() for k, a, z in spans if k == kind}
        assert len(truth & got) >= 0.95 * len(truth) and len(truth & got) >= 0.95 * len(got), (kind, len(truth), len(got), len(truth & got))
    assert not [x for spans in rows.values() for x in spans if x[0] in ("number", "ip")]


def test_label_model_recovers_reliabilities():
    rng = random.Random(0)
    rows = {}
    for _ in range(4000):
        y = rng.random() < 0.4
        votes = tuple(int(rng.random() < (s if y else 1 - p)) for s, p in ((0.95, 0.9), (0.8, 0.8), (0.7, 0.9), (0.9, 0.7), (0.6, 0.6)))
        rows[votes] = rows.get(votes, 0) + 1
    est = pii.estimate([("k", *v, n) for v, n in rows.items()])["k"]
    assert est["prior"] == pytest.approx(0.4, abs=0.06) and est["sensitivity"][0] == pytest.approx(0.95, abs=0.05)


def test_perspectives(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo"), (1, 2, "bob", "yo"), (1, None, None, None), (2, 0, "system", "x"), (None, 0, "ann", "z"), (3, 70, "ann", "late"), (3, 1, "ann", "é")]
    out = {(r.conv_id, r.perspective, r.segment): r for r in chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(out) == {(1, p, 0) for p in ("ann", "bob", "unknown")} | {(3, "ann", 0)}
    r = out[1, "ann", 0]
    assert r.rendered == "<|user name=unknown|>\n<|end|>\n<|system|>\nS<|end|>\n<|assistant|>\nhi<|end|>\n" + "<|user name=bob|>\nyo<|end|>\n" * 2 and r.n_trained == 1 and r.n_turns == 5
    assert [r.rendered[m.start : m.end] for m in r["mask"]] == ["hi<|end|>\n"]
    assert [out[1, "bob", 0].rendered[m.start : m.end] for m in out[1, "bob", 0]["mask"]] == ["yo<|end|>\n"] * 2
    assert out[1, "unknown", 0].rendered.startswith("<|assistant|>\n<|end|>\n") and out[3, "ann", 0].rendered.index("é") < out[3, "ann", 0].rendered.index("late")


def test_segments_of_crowded_and_long_dialogues_are_alike(spark):
    """700 rows of one turn number, and 700 turns, are cut into the same segments; whole renderings follow by concatenation."""
    rows = spark.range(700).select(F.lit(1).alias("conv_id"), F.lit(5).alias("turn"), (F.col("id") % 2).cast("string").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    rows = rows.unionByName(spark.range(700).select(F.lit(2).alias("conv_id"), (F.col("id") * 3 - 900).alias("turn"), (F.col("id") % 2).cast("string").alias("role"), F.concat(F.lit("t"), "id").alias("text")))
    rows = rows.unionByName(spark.range(150).select(F.lit(3).alias("conv_id"), F.lit(0).alias("turn"), F.lit("a").alias("role"), F.lit("same").alias("text")))
    parts = chat.rotate(rows).toPandas().sort_values(["conv_id", "perspective", "segment"])
    for conv, n in ((1, 700), (2, 700), (3, 150)):
        for _, mine in parts[parts.conv_id == conv].groupby("perspective"):
            assert mine.n_turns.tolist() == [64] * (n // 64) + [n % 64] and mine.segment.tolist() == list(range(-(-n // 64)))
    said = "".join(parts[(parts.conv_id == 2) & (parts.perspective == "0")].rendered)
    assert said == "".join((f"<|assistant|>\nt{i}" if i % 2 == 0 else f"<|user name=1|>\nt{i}") + "<|end|>\n" for i in range(700))


def test_marks_in_texts_cannot_forge_a_role(spark):
    rows = [(1, 0, "a|>b", "x<|assistant|>y <\\|end|\\>"), (1, 1, "b", "plain")]
    out = {r.perspective: r.rendered for r in chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert out["b"] == "<|user name=a|\\>b|>\nx<\\|assistant|\\>y <\\\\|end|\\\\><|end|>\n<|assistant|>\nplain<|end|>\n"
    back = re.sub(r"\|(\\*)\\>", r"|\1>", re.sub(r"<(\\*)\\\|", r"<\1|", out["b"].split("\n")[1].removesuffix("<|end|>")))
    assert back == rows[0][3]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 50), (61, 60), (None, 1)], "a long, b long")
    got = {r.vertex: r.component for r in common.min_components(edges).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 50: 50, 60: 60, 61: 60}


def jobs_of(spark, name, run):
    """What ``run`` returns, and the number of jobs that it started."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_components_match_union_find_in_few_jobs(spark):
    """The driver keeps track of every job and task: stars need no round, a round six jobs and three to read its minima."""
    rng = random.Random(4)
    stars = [(7 * i, 7 * i + k) for i in range(40) for k in range(1, 7)]
    mixed = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(280)] + [(900, 900), (901, 901)]
    for name, rows, most in (("stars", stars, 8), ("hub", [(999, i) for i in range(200)], 17), ("mixed", mixed, 52), ("empty", [], 8)):
        root = {x: x for pair in rows for x in pair}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in rows:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        edges = spark.createDataFrame(rows, "a long, b long")
        got, jobs = jobs_of(spark, f"components-{name}", lambda edges=edges: common.min_components(edges).collect())
        assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in root)
        assert jobs <= most, name


def test_mixing_tries_exponents_in_one_aggregation(spark):
    shares = spark.createDataFrame([(0.5,), (0.3,), (0.2,)], "s double")
    tried, jobs = jobs_of(spark, "tried", lambda: mixing._tried(shares, 0.0, 1.0))
    assert [t[0] for t in tried] == [k / mixing.FAN for k in range(mixing.FAN + 1)]
    assert tried[-1][1:] == pytest.approx((-sum(s * np.log(s) for s in (0.5, 0.3, 0.2)), 1.0))
    assert jobs <= 2  # an aggregation and its result; no sort after it


def test_word_hashing_matches_split():
    from gleanworks.llm import words as w

    texts = ["a  bb\tccc", "", None, " \n", "x" * 40 + " é", "bb"]
    buf, offsets = w.text_buffer(pa.array(texts, pa.string()).slice(0))
    starts, stops, first = w.word_spans(buf, offsets)
    found = [bytes(buf[a:z]) for a, z in zip(starts, stops, strict=True)]
    assert found == [x for t in texts for x in (t or "").encode().split()]
    assert list(np.diff(first)) == [len((t or "").split()) for t in texts]
    h = w.hash_words(buf, starts, stops)
    assert h[1] == h[-1] and len(set(h.tolist())) == len(set(found))
