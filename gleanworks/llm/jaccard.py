"""Exact n-gram Jaccard join with a token-group matrix.

Documents are sets of hashed word shingles.  Equal sets are one vertex.  A set can
only have a partner if others hold nearly all of its shingles, which is checked in
steps of growing cost, each of which provably keeps every link:

1. of each set the shingles with the smallest hashes, a quarter of it, are counted
   across the corpus: of the first ``k`` shingles that linked sets have in common,
   each lies in both quarters, so a set with fewer shared ones has no partner;
2. for the survivors all shingles are counted; a set of which fewer than 85 % occur
   in another survivor has no partner;
3. sets that share one of their rarest shingles (the prefix for 85 %) are similar
   enough to be put into one group; linked sets always meet in a group;
4. a group is a 0/1 matrix of its sets over the union of their shingles.  A large
   group is cut into blocks of similar sets, of bounded sets and shingles, and each
   block's union is stored.  Sets are first held against the group's leader; those that
   it leaves unlinked query the blocks: a block whose union holds none of the query's
   prefix cannot reach 85 % of it and is never sent the query, and of the others a task
   opens those whose union's overlap with the query reaches that share.

Rows are exchanged as packed arrays or integers; no pair of documents is ever
emitted before it is known to be linked, and links leave a task as a forest.

Defined results: null text or a text without words has no shingles and is linked
with nothing; fewer words than a shingle are one shingle; rows that share a doc_id
are in one component, and the texts of each keep their own links (the query's SQL
joins such texts into one set instead); rows without doc_id keep a null component; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, min_components, parts, tidy
from .words import hash_runs, hash_words, lower_ascii, mix, slices, text_buffer, word_spans

NGRAM = 4
PERCENT = 85
#: Sets of a group, or of a block of a larger one, that one task holds.
BLOCK = 1024
#: Shingles of a group or block that one task holds.
TOKENS = 1_000_000
#: Documents for each range of shingle hashes, and of sets, in step 1: what a task holds at once.
RANGE_DOCS = 1024
_LOW48 = np.uint64((1 << 48) - 1)


def need(n, percent: int = PERCENT):
    """Least overlap of a set of ``n`` shingles with a linked one."""
    return (percent * n + 99) // 100


def spare(n):
    """Further shingles counted in step 1, beyond the prefix."""
    return np.maximum(1, n // 10)


def shingle_sets(column: pa.Array, ngram: int) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingle hashes."""
    buf, offsets = text_buffer(column)
    buf = lower_ascii(buf)
    starts, stops, first = word_spans(buf, offsets)
    words = hash_words(buf, starts, stops)
    runs = hash_runs(words, ngram)
    for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield np.unique(runs[a : z - ngram + 1]) if z - a >= ngram else hash_runs(words[a:z], z - a) if z > a else words[:0]


def signature(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that depend on a set's members only."""
    a, b = np.sum(s, dtype=np.uint64), np.sum(mix(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def described(docs: DataFrame, ngram: int = NGRAM) -> DataFrame:
    """``(doc_id, n, s1, s2)``: set sizes and signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                rows = [(len(s), *signature(s)) for s in shingle_sets(piece.column(1), ngram)]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([piece.column(0), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", "n", "s1", "s2"])

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long")


def _quarters(docs: DataFrame, ngram: int, percent: int, ranges: int) -> DataFrame:
    """``(range, tokens, sets)``: packed (hash, set signature) pairs of step 1.

    A shingle that three or more sets of one slice hold is sent for two of them,
    which suffices to mark it shared; the others are credited at once, in a row
    without tokens.  So a shingle in a third of all documents stays small.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                tokens, owners = [], []
                for s in shingle_sets(piece.column(0), ngram):
                    if len(s):
                        k = min(len(s), len(s) - need(len(s), percent) + int(spare(len(s))))
                        tokens.append(s[:k])
                        owners.append(np.full(k, np.uint64(signature(s)[0] & 0xFFFFFFFFFFFF)))
                if not tokens:
                    continue
                t, o = np.concatenate(tokens), np.concatenate(owners)
                order = np.lexsort((o, t))
                t, o = t[order], o[order]
                fresh = np.append(True, (t[1:] != t[:-1]) | (o[1:] != o[:-1]))
                t, o = t[fresh], o[fresh]
                begin = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
                rank = np.arange(len(t)) - np.repeat(begin, np.diff(np.append(begin, len(t))))
                given = o[rank >= 2]
                t, o = t[rank < 2], o[rank < 2]
                at = _ranges(t >> np.uint64(16), ranges)
                cuts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                ends = np.append(cuts[1:], len(at))
                low = t & _LOW48
                rows = [(int(at[a]), _pack48(low[a:z]), _pack48(o[a:z])) for a, z in zip(cuts, ends, strict=True)]
                if len(given):
                    rows.append((int(given[0] % np.uint64(ranges)), b"", _pack48(given)))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], names=["range", "tokens", "sets"])

    return docs.select("text").mapInArrow(run, "range int, tokens binary, sets binary")


def _pack48(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack48(blobs: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


def _ranges(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The range, of equal widths, that each 48-bit key lies in."""
    return ((keys >> np.uint64(24)) * np.uint64(ranges) >> np.uint64(24)).astype(np.int64)


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """The second and third column of each range's rows; rows come in order of their range."""
    at, one, two = None, [], []
    for batch in batches:
        for r, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if r != at and two:
                yield one, two
                one, two = [], []
            at = r
            one.append(x)
            two.append(y)
    if two:
        yield one, two


def _credits(quarters: DataFrame, n_parts: int, ranges: int) -> DataFrame:
    """``(s48, credit)``: how many of a set's counted shingles another set holds.

    Each range of hashes sends its counts on in one packed row per range of sets.  A task
    holds one range at a time, and their number grows with the documents.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, sets in _by_range(batches):
            credited = [_unpack48([o for t, o in zip(tokens, sets, strict=True) if not t])]
            t, o = _unpack48(tokens), _unpack48([o for t, o in zip(tokens, sets, strict=True) if t])
            order = np.lexsort((o, t))
            t, o = t[order], o[order]
            if len(t):
                fresh = np.append(True, (t[1:] != t[:-1]) | (o[1:] != o[:-1]))
                t, o = t[fresh], o[fresh]
                twin = t[1:] == t[:-1]
                credited.append(o[np.append(twin, False) | np.append(False, twin)])
            s, c = np.unique(np.concatenate(credited), return_counts=True)
            if len(s):
                at = _ranges(s, ranges)
                cuts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                ends = np.append(cuts[1:], len(s))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at[cuts], pa.int32()), pa.array([_pack48(s[a:z]) for a, z in zip(cuts, ends, strict=True)], pa.binary()), pa.array([c[a:z].astype("<u4").tobytes() for a, z in zip(cuts, ends, strict=True)], pa.binary())],
                    names=["range", "sets", "counts"],
                )

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets, counts in _by_range(batches):
            s, inverse = np.unique(_unpack48(sets), return_inverse=True)
            c = np.bincount(inverse, weights=np.frombuffer(b"".join(counts), "<u4"))
            yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int64)), pa.array(c.astype(np.int64))], names=["s48", "credit"])

    dealt = lambda rows: rows.repartition(n_parts, "range").sortWithinPartitions("range")
    packed = dealt(quarters.select("range", "tokens", "sets")).mapInArrow(count, "range int, sets binary, counts binary")
    return dealt(packed).mapInArrow(total, "s48 long, credit long")


def _sets(docs: DataFrame, ngram: int) -> DataFrame:
    """``(doc_id, n, s1, s2, tokens)`` with the hashes as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                sets = [s.view(np.int64) for s in shingle_sets(piece.column(1), ngram)]
                n = np.array([len(s) for s in sets], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(np.concatenate(sets)))
                s1, s2 = zip(*[signature(s.view(np.uint64)) for s in sets], strict=True)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), lists], names=["doc_id", "n", "s1", "s2", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, tokens array<long>")


def linked_pairs(ids: np.ndarray, sizes: np.ndarray, tokens: list[np.ndarray], query: np.ndarray, member: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between query and member sets of one block, as index pairs.

    The block's union decides which queries open it; overlaps of those are a
    product of 0/1 matrices over the shingles that two or more sets hold.
    """
    flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(ids)), [len(t) for t in tokens])
    _, inverse = np.unique(flat, return_inverse=True)
    by_member = np.bincount(inverse[member[owner]], minlength=inverse.max(initial=-1) + 1)
    own = member[owner].astype(np.int64) * query[owner]
    bound = np.bincount(owner, weights=(by_member[inverse] - own > 0), minlength=len(ids))
    opens = query & (bound >= need(sizes, percent))
    q, m = np.flatnonzero(opens), np.flatnonzero(member)
    if not len(q) or not len(m):
        return q[:0], q[:0]
    shared = np.bincount(inverse) > 1
    column = np.cumsum(shared) - 1
    width = int(shared.sum())
    keep = shared[inverse]
    owner, column = owner[keep], column[inverse[keep]]
    row_q, row_m = np.full(len(ids), -1), np.full(len(ids), -1)
    row_q[q], row_m[m] = np.arange(len(q)), np.arange(len(m))
    overlap = np.zeros((len(q), len(m)), np.float32)
    step = max(256, 8_000_000 // (len(q) + len(m)))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for a in range(0, width, step):
        lo, hi = np.searchsorted(column, [a, a + step])
        left, right = np.zeros((len(q), step), np.float32), np.zeros((len(m), step), np.float32)
        o, c = owner[lo:hi], column[lo:hi] - a
        left[row_q[o[row_q[o] >= 0]], c[row_q[o] >= 0]] = 1
        right[row_m[o[row_m[o] >= 0]], c[row_m[o] >= 0]] = 1
        overlap += left @ right.T
    total = sizes[q][:, None] + sizes[m][None, :]
    i, j = np.nonzero(100 * overlap.astype(np.float64) >= percent * (total - overlap))
    i, j = q[i], m[j]
    return i[i != j], j[i != j]


def _forest(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """(id, smallest id of its tree) for all nodes that have a link."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            if ids[x] < ids[y]:
                root[y] = x
            else:
                root[x] = y
    return [(int(ids[i]), int(ids[find(i)])) for i in sorted({*a.tolist(), *b.tolist()})]


def _opened(tasks: DataFrame, percent: int, n_parts: int) -> DataFrame:
    """``(a, b)`` links of ``tasks(task, doc_id, n, tokens, q, m)``; a task's rows fit one worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        task = None

        def solve() -> pa.RecordBatch:
            ids = np.array([h[0] for h in held])
            i, j = linked_pairs(ids, np.array([h[1] for h in held]), [h[2] for h in held], np.array([h[3] for h in held]), np.array([h[4] for h in held]), percent)
            rows = _forest(len(ids), i, j, ids)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["a", "b"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)
            for name, (doc_id, n, tokens, q, m) in zip(names, rows, strict=True):
                if name != task:
                    if held:
                        yield solve()
                    task, held = name, []
                held.append((doc_id, n, tokens.values.to_numpy(), q, m))
        if held:
            yield solve()

    dealt = tasks.select("task", "doc_id", "n", "tokens", "q", "m").repartition(n_parts, "task").sortWithinPartitions("task", "doc_id")
    return dealt.mapInArrow(run, "a long, b long")


def links(sets: DataFrame, prefix: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """``(a, b)``: a forest over all links between distinct ``sets(doc_id, n, tokens)``."""
    n_parts = parts(sets.sparkSession)
    heads = prefix.groupBy("h").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("hi")).where("b < hi").select("h", "b")
    groups = min_components(prefix.join(heads, "h").select(F.col("doc_id").alias("a"), "b")).select(F.col("vertex").alias("doc_id"), F.col("component").alias("g"))
    sizes = groups.join(sets.select("doc_id", "n"), "doc_id").groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("held")).where("size > 1")
    sizes = sizes.select("g", "size", (F.ceil(F.greatest(F.col("size") / block, F.col("held") / TOKENS))).cast("int").alias("blocks"))
    grouped = materialise(sets.join(groups, "doc_id").join(sizes, "g"), "groups")
    small = grouped.where("blocks = 1").select(F.concat_ws(":", "g").alias("task"), "doc_id", "n", "tokens", F.lit(True).alias("q"), F.lit(True).alias("m"))
    found = _opened(small, percent, n_parts)
    large = grouped.where("blocks > 1")
    if not large.limit(1).count():
        return found
    # The leader of a large group is the set with most shingles that the group shares widely.
    exploded = large.select("g", "size", "doc_id", "n", F.explode("tokens").alias("h"))
    # Written out, so that the joins with them can split a hot shingle of a group.
    wide = materialise(exploded.groupBy("g", "h").agg(F.count(F.lit(1)).alias("c"), F.first("size").alias("size")).where("2 * c >= size").select("g", "h"), "wide")
    centre = exploded.join(wide, ["g", "h"]).groupBy("g", "doc_id", "n").agg(F.count(F.lit(1)).alias("w"))
    leaders = centre.groupBy("g").agg(F.max_by("doc_id", F.struct(F.col("w") / F.col("n"), -F.col("doc_id"))).alias("leader"))
    leaders = materialise(leaders, "leaders")
    core = materialise(large.join(leaders.withColumn("doc_id", F.col("leader")), ["g", "doc_id"]).select("g", "leader", F.col("n").alias("n0"), F.explode("tokens").alias("h")), "core")
    near = exploded.join(core, ["g", "h"]).groupBy("g", "doc_id", "n", "leader", "n0").agg(F.count(F.lit(1)).alias("c")).where(f"doc_id <> leader AND 100 * c >= {percent} * (n + n0 - c)")
    joined = materialise(near.select("doc_id", "leader"), "joined")
    rest = large.join(joined, "doc_id", "left_anti").join(leaders.select(F.col("leader").alias("doc_id")), "doc_id", "left_anti")
    # Blocks of similar sets: those with the same smallest prefix shingle meet; crowded ones are cut.
    key = prefix.groupBy("doc_id").agg(F.min("h").alias("key"))
    keyed = large.join(key, "doc_id").withColumn("bucket", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    cuts = keyed.groupBy("g", "bucket").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / TOKENS)).cast("int").alias("cuts"))
    name = F.concat_ws(":", "g", "bucket", F.pmod(F.xxhash64("doc_id"), F.col("cuts")).cast("string"))
    members = materialise(keyed.join(cuts, ["g", "bucket"]).select(name.alias("block"), "g", "doc_id", "n", "tokens"), "blocks")
    union = materialise(members.select("g", "block", F.explode("tokens").alias("h")).distinct(), "unions")
    asks = materialise(rest.select("g", "doc_id", "n").join(prefix, "doc_id").join(union, ["g", "h"]).select("block", "doc_id", "n").distinct(), "asks")
    rounds = asks.groupBy("block").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / TOKENS)).cast("int").alias("rounds"))
    asking = asks.join(rounds, "block").withColumn("r", F.pmod(F.xxhash64("doc_id"), F.col("rounds")).cast("int")).select("block", "doc_id", "r").join(rest.select("doc_id", "n", "tokens"), "doc_id")
    asked = members.join(rounds, "block").withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)))
    row = lambda rows, q: rows.select(F.concat_ws(":", "block", F.col("r").cast("string")).alias("task"), "doc_id", "n", "tokens", F.lit(q).alias("q"), F.lit(not q).alias("m"))
    return found.unionByName(joined.select(F.col("doc_id").alias("a"), F.col("leader").alias("b"))).unionByName(_opened(row(asking, True).unionByName(row(asked, False)), percent, n_parts))


def jaccard_components(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row; components of links of at least ``percent`` %."""
    with tidy(docs.sparkSession):
        return _components(docs, ngram, percent, block)


def _components(docs: DataFrame, ngram: int, percent: int, block: int) -> DataFrame:
    n_parts = parts(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    info = materialise(described(texts, ngram), "info")
    owners = info.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("owner"))
    # A doc_id with different texts can own several sets: all but the first get a vertex of their own.
    known = info.where("doc_id IS NOT NULL").withColumn("set", F.struct("n", "s1", "s2"))
    repeated = materialise(known.groupBy("doc_id").agg(F.min("set").alias("lo"), F.max("set").alias("hi")).where("lo <> hi").select("doc_id"), "repeated")
    shared_ids = repeated.limit(1).count() > 0
    owners = owners.withColumn("v", F.col("owner"))
    if shared_ids:
        firsts = owners.groupBy("owner").agg(F.min(F.struct("n", "s1", "s2")).alias("first"))
        owners = owners.join(firsts, "owner").withColumn("v", F.when(F.struct("n", "s1", "s2") == F.col("first"), F.col("owner")).otherwise(F.xxhash64("n", "s1", "s2"))).drop("first")
    ranges = max(n_parts, -(-info.count() // RANGE_DOCS))
    credit = _credits(_quarters(texts, ngram, percent, ranges), n_parts, ranges)
    least = F.greatest(F.lit(1), F.floor(F.floor((percent * F.col("n") + 99) / 100) / 10))
    alive = owners.withColumn("s48", F.col("s1").bitwiseAND(F.lit((1 << 48) - 1))).join(credit, "s48").where(F.col("credit") >= least).select("owner", "v", "n", "s1", "s2")
    if shared_ids:
        alive = materialise(alive, "alive")
    found = _sets(texts.join(alive.select(F.col("owner").alias("doc_id")).distinct(), "doc_id", "left_semi"), ngram)
    if shared_ids:
        found = found.drop("doc_id").join(alive.select(F.col("v").alias("doc_id"), "n", "s1", "s2"), ["n", "s1", "s2"])
    sets = materialise(found.dropDuplicates(["doc_id"]).select("doc_id", "n", "tokens"), "sets")
    tokens = sets.select("doc_id", "n", F.explode("tokens").alias("h"))
    common = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = tokens.join(common, "h").groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("s"))
    enough = F.floor((percent * F.col("n") + 99) / 100)
    prefix = materialise(shared.where(F.size("s") >= enough).select("doc_id", F.explode(F.slice("s", F.lit(1), (F.size("s") - enough + 1).cast("int"))).alias("p")).select("doc_id", "p.h"), "prefix")
    edges = links(sets, prefix, percent, block)
    if shared_ids:
        own = owners.where("v <> owner").select("v", "owner")
        for end in ("a", "b"):
            edges = edges.join(own.select(F.col("v").alias(end), F.col("owner").alias("o")), end, "left").withColumn(end, F.coalesce("o", end)).drop("o")
        texts_of = known.join(repeated, "doc_id", "left_semi").join(owners, ["n", "s1", "s2"]).select(F.col("doc_id").alias("a"), F.col("owner").alias("b"))
        edges = edges.unionByName(texts_of.distinct())
    members = min_components(edges)
    named = owners.join(members.select(F.col("vertex").alias("owner"), "component"), "owner", "left").select("n", "s1", "s2", F.coalesce("component", "owner").alias("component"))
    out = info.join(named, ["n", "s1", "s2"], "left")
    if shared_ids:
        # Rows without shingles follow the other rows of their doc_id.
        of_id = members.select(F.col("vertex").alias("doc_id"), F.col("component").alias("of_id"))
        out = out.join(of_id, "doc_id", "left").withColumn("component", F.coalesce("component", "of_id")).drop("of_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def op10_token_groups(docs: DataFrame) -> DataFrame:
    """``jaccard_components`` of 4-word shingles at 85 %; the module's defined results hold."""
    return jaccard_components(docs)
