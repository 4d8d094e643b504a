import random

import numpy as np
import pytest

from gleanworks.llm import jaccard

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def brute(rows, ngram=4, percent=85):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().translate(_LOWER).split()
        sets[i] = {tuple(w[k : k + ngram]) for k in range(len(w) - ngram + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("block", [6, 1024])
def test_components_match_brute_force(spark, docs_of, block):
    rng = random.Random(4)
    texts = [None, "", " \n", "one two", "One  TWO", "a b c d", "a b c d"]
    for size in (40, 5, 2):
        base = [f"w{rng.randrange(500)}" for _ in range(160)]
        texts += [edited(rng, base, rng.randrange(7)) for _ in range(size)]
    texts += [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs_of(texts), block=block).collect()}
    assert got == brute(rows)


def test_blocks_hold_bounded_rows_of_a_percolating_group(spark, docs_of, monkeypatch):
    """A chain of documents that share rare passages is one group; queries reach only blocks that share their prefix, and rows grow with the chain."""
    sent = []
    opened = jaccard._opened
    monkeypatch.setattr(jaccard, "_opened", lambda tasks, *a: (sent.append(tasks.where("q AND NOT m").count()), opened(tasks, *a))[1])
    for size in (100, 200):
        rng = random.Random(size)
        texts, last = [], [f"p{rng.randrange(10**6)}" for _ in range(12)]
        for k in range(size):
            own = [f"u{k}_{i}" for i in range(60)]
            tail = [f"t{k}_{i}" for i in range(12)]
            texts += [" ".join(last + own + tail), " ".join(last + own + tail + ["x"])]
            last = tail
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs_of(texts), block=16).collect()}
        assert got == brute(list(enumerate(texts)))
    assert sent[-1] <= 2.5 * max(1, sent[1])


def test_edge_rows(spark, docs_of):
    long = " ".join(str(i) for i in range(30_000))
    docs = docs_of(["a b c d e", "a b c d e", long, long + " z"], ids=[5, None, 7, 9])
    got = sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect() if r.doc_id is not None)
    assert got == [(False, 5, 2, 5), (False, 7, 29_997, 7), (False, 9, 29_998, 7)]
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_all_texts_of_a_shared_id_keep_their_links(spark, docs_of):
    rng = random.Random(9)
    one, two, three = ([f"{p}{rng.randrange(900)}" for _ in range(100)] for p in "abc")
    near = lambda w: " ".join([*w, "end"])
    texts = [near(one), near(two), " ".join(one), " ".join(two), None, near(three), " ".join(three), "", " ".join(three)]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs_of(texts, [4, 3, 9, 9, 9, 20, 21, 30, 22])).collect()}
    assert got == {(4, 98, 3), (3, 98, 3), (9, 97, 3), (9, 0, 3), (20, 98, 20), (21, 97, 20), (22, 97, 20), (30, 0, 30)}


def test_block_links_equal_pairwise():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 40))) for _ in range(30)]
    sizes, every = np.array([len(s) for s in sets]), np.ones(30, bool)
    a, b = jaccard.linked_pairs(np.arange(30), sizes, sets, every, every, 50)
    want = {(i, j) for i in range(30) for j in range(30) if i != j and 100 * len(np.intersect1d(sets[i], sets[j])) >= 50 * len(np.union1d(sets[i], sets[j]))}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want
