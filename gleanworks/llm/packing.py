"""First-fit-decreasing packing of tokenised documents.

Each document is tokenised whole and cut into pieces of ``CAPACITY`` ids and one
rest.  The pieces of a row go to one of the randomised groups of about ``GROUP_DOCS``
rows, by a hash of the row's place in its input split, so that null or repeated ids
are spread like others; inside a group, first-fit decreasing places each piece in the first sequence with room,
found in O(log n) by a tournament tree whose nodes hold the larger remaining
capacity of their two children.  Groups are independent, so packing scales with
their number, and a group's rows are bounded by its documents.

A tokenizer whose normaliser, pattern and model settings are the ones that the chunk
encoder follows is run on cached chunks; any other file's tokenizer is run on whole texts.

Only (doc_id, start, length, checksum) rows are exchanged, never ids or texts.

Defined results: null text counts as empty; every document ends in ``END_ID``, so
an empty one is a single piece of one id; rows that share a doc_id are packed
each; a null doc_id is kept; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts

CAPACITY = 2048
GROUP_DOCS = 1024
END_ID = 1
SEED = 5
#: Entries of one generation of a worker's chunk cache; two generations live.
CACHE = 400_000
_ODD = re.compile("[\x1c-\x1f]|<\\|")
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u024f"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
#: The byte-level alphabet: visible Latin-1 bytes stand for themselves, the others follow from 256 on.
_SEEN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SEEN)}


# The settings of a tokenizer file that the chunk encoder follows.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}


def follows_chunks(settings: dict) -> bool:
    """Whether a tokenizer's ids are its chunks' ids one after another, as ``ChunkEncoder`` makes them."""
    marks = all(t["content"].startswith("<|") and not t["normalized"] for t in settings.get("added_tokens") or ())
    model = {k: settings["model"].get(k) for k in _MODEL}
    cuts = {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTE_LEVEL]}
    return marks and settings.get("normalizer") == _NORMALIZER and settings.get("pre_tokenizer") == cuts and model == _MODEL


class Words(dict):
    """Ids of lower-case pieces from the tokenizer's BPE model, kept like chunks."""

    def __init__(self, bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE // 2:
            self.clear()
        seen = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)
        out = ChunkEncoder.pack([t.id for t in self.bpe.tokenize(seen)])
        if len(word) <= 64:
            self[word] = out
        return out


class ChunkEncoder(dict):
    """Ids of whitespace-delimited chunks as little-endian uint32 bytes.

    The tokenizer's normalisation and its pre-tokenizer never cross white space,
    so a text's ids are its chunks' ids one after another.  Chunks of ASCII and
    composed Latin letters are cut by the tokenizer's own (lower-case) pattern and
    go straight to its BPE model; all others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.by_chunks = follows_chunks(json.loads(self.whole.to_str()))
        self.bpe = self.whole.model
        self.words = Words(self.bpe)
        self.old: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        out = self.old.get(chunk)
        if out is None:
            words, body = self.words, chunk.rstrip(".,")
            if not _PLAIN.fullmatch(chunk):
                out = self.pack(self.whole.encode(chunk, add_special_tokens=False).ids)
            elif body.isalpha():
                out = words[body.lower()] + words[chunk[len(body) :]] if len(body) < len(chunk) else words[body.lower()]
            else:
                out = b"".join([words[w] for w in _PIECES.findall(chunk.lower())])
        if len(chunk) <= 64:
            self[chunk] = out
        return out

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def text(self, text: str) -> bytes:
        if not self.by_chunks or _ODD.search(text):
            return self.pack(self.whole.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.__getitem__, text.split()))


def tokenised(docs: DataFrame, tokenizer: str, each: Callable[[bytes], list[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    """``row``, ``doc_id`` and one row for every tuple that ``each`` makes of a document's ids (as bytes).

    ``row`` numbers the input rows: the split in the high 32 bits, the place in it in the low ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at = ChunkEncoder(tokenizer), TaskContext.get().partitionId() << 32
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows += [(at, doc_id, *r) for r in each(encode.text(text.as_py() or ""))]
                at += 1
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ddl)


def cut(ids: bytes, capacity: int, end_id: int) -> list[tuple[int, int, int, int]]:
    """(start, length, crc32, document length) of a document's pieces; the end id is appended first."""
    ids += struct.pack("<I", end_id)
    n, view = len(ids) // 4, memoryview(ids)
    return [(at, min(capacity, n - at), zlib.crc32(view[at * 4 : (at + capacity) * 4]), n) for at in range(0, n, capacity)]


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of every piece; the longest first, each into the first bin with room."""
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    where: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need, node = lengths[i], 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        where[i] = (node - leaves, capacity - tree[node])
        tree[node] -= need
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return where


_PIECE = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
_PIECE_DDL = "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, end_id: int = END_ID, seed: int = SEED) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` of every piece.

    ``sequence_id`` is the group in its high 32 bits and the sequence in the low ones.
    Null texts are empty ones; null and repeated ids are packed row by row.
    """
    spark = docs.sparkSession
    groups = max(1, -(-docs.count() // group_docs))
    pieces = tokenised(docs, tokenizer, lambda ids: cut(ids, capacity, end_id), _PIECE, _PIECE_DDL)
    # Pieces of one row stay together; the rows of a group are random.
    key = F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(groups)).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        group = None

        def packed() -> Iterator[pa.RecordBatch]:
            if held:
                rows = pa.Table.from_batches(held).combine_chunks()
                where = first_fit_decreasing(rows.column("length").to_pylist(), capacity)
                base = group << 32
                rows = rows.drop_columns(["g", "row"]).append_column("sequence_id", pa.array([base + b for b, _ in where], pa.int64())).append_column("offset", pa.array([o for _, o in where], pa.int64()))
                yield from rows.to_batches()

        for batch in batches:
            g = batch.column(0).to_numpy()
            cuts = [0, *(i + 1 for i in range(len(g) - 1) if g[i] != g[i + 1]), len(g)] if len(g) else [0]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if group is not None and g[a] != group:
                    yield from packed()
                    held = []
                group = int(g[a])
                held.append(batch.slice(a, z - a))
        yield from packed()

    dealt = pieces.select(key.alias("g"), *_PIECE.names).repartition(max(1, min(groups, parts(spark))), "g").sortWithinPartitions("g", "row", "start")
    return dealt.mapInArrow(run, _PIECE_DDL.removeprefix("row long, ") + ", sequence_id long, offset long")


def default_tokenizer() -> str:
    """The tokenizer file that the registered query and the pipeline use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_ffd_packing(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``pack`` of the whole table with the word-level tokenizer; its defined results hold."""
    return pack(docs, tokenizer or default_tokenizer())
