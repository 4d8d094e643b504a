import hashlib
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline as pipeline
from gleanworks.llm import mixing, packing

from .test_jaccard import brute, edited
from .test_operators import bisected

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_stages_on_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        before, docs = docs.count(), stage(spark, docs, SF).cache()
        assert docs.columns == list(pipeline.COLUMNS), name
        assert name == "mixing" or docs.count() <= before
    packed = pipeline.run(spark, SF)
    kept = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept


def test_run_equals_brute_force(spark, tmp_path):
    """All stages of ``run`` on a fixture, each against a plain version; no label is toxic, so the first one keeps all."""
    rng = random.Random(31)
    block = [" ".join(f"b{rng.randrange(99)}" for _ in range(6)) for _ in range(4)]
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = [None, "", "\n\n", *(edited(rng, base, k) for k in (0, 1, 2, 30)), " ".join(base)]
    for i in range(40):
        lines = [" ".join(f"v{rng.randrange(2000)}" for _ in range(rng.randrange(3, 30))) for _ in range(rng.randrange(1, 9))]
        at = rng.randrange(len(lines) + 1)
        texts.append("\n".join(lines[:at] + (block if i % 3 == 0 else []) + lines[at:]))
    rows = [(i, t, "en", [None, "a", "b", "c"][i % 4 if i % 5 else 1], len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    # Repeated three-line windows.
    seen, cut = set(), {}
    for i, t, *_ in rows:
        lines = None if t is None else t.split("\n")
        gone = set()
        for p in range(len(lines or []) - 2):
            window = tuple(lines[p : p + 3])
            if any(x.strip() for x in window):
                if window in seen:
                    gone |= {p, p + 1, p + 2}
                seen.add(window)
        cut[i] = None if lines is None else "\n".join(x for p, x in enumerate(lines) if p not in gone)
    # The least document of each group of similar ones.
    groups = brute(list(cut.items()), 5, 80)
    kept = [(i, cut[i], rows[i][3]) for i in cut if groups[i][1] == i]
    # Permutations of every source, read until its quota is met.
    n = {i: len((t or "").split()) for i, t, _ in kept}
    sources = {}
    for i, _, s in kept:
        sources.setdefault(s, []).append(i)
    totals = {s: sum(n[i] for i in ids) for s, ids in sources.items()}
    live = [s for s in totals if totals[s]]
    _, weights = bisected([totals[s] for s in live], mixing.TARGET_ENTROPY, mixing.MAX_REPEATS)
    read = Counter()
    for s, w in zip(live, weights, strict=True):
        quota, at, epoch = int(round(w, 9) * sum(totals.values())), 0, 0
        while at < quota:
            for i in sorted(sources[s], key=lambda i: (hashlib.md5(f"{mixing.SEED}:{epoch}:{i}".encode()).hexdigest(), n[i])):
                if at < quota:
                    read[i] += 1
                at += n[i]
            epoch += 1
    # Pieces of their ids.
    encode, want = packing.ChunkEncoder(packing.default_tokenizer()), Counter()
    for i, times in read.items():
        ids = np.append(np.frombuffer(encode.text(cut[i] or ""), "<u4"), 1).astype("<u4")
        for a in range(0, len(ids), 2048):
            want[i, a, min(2048, len(ids) - a), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)] += times
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    assert len(kept) < len(rows) and any(cut[i] != rows[i][1] for i in cut) and max(read.values()) > 1
