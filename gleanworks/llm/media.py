"""Interleaved document sequences with media resolved by digest.

HTML becomes an ordered array of text and media-reference structs.  Media live in
a store keyed by the SHA-256 of their payload; references find them by an equi-join
on that digest, and position and caption travel with the reference, so they stay
aligned whatever the join does.

Payloads are kept as 8-bit grey images (binary PGM) of 64 samples a row: lossless,
header plus samples.  Features are integer statistics of the samples read back.

Defined results: null text or html counts as empty; an empty payload is one row of
zeros; a reference without a stored payload keeps null media; equal payloads are
described once; rows that share an id are each answered; extra columns are ignored;
empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

ROW = 64
_BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "pre", "blockquote", "article", "section", "br", "tr", "ul", "ol"}
_HIDDEN = {"script", "style", "template", "noscript"}
_MEDIA = {"img", "video", "audio", "source"}
_HEADER = re.compile(rb"P5\n(\d+) (\d+)\n255\n")


class _Sequence(HTMLParser):
    """Collects (kind, text, ref, caption) in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.text: list[str] = []
        self.hidden = 0
        self.figure: int | None = None
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append(["text", text, None, None])

    def handle_starttag(self, tag, attrs):
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag in _MEDIA:
            ref = dict(attrs).get("src")
            if ref:
                self.flush()
                self.items.append(["media", None, ref, dict(attrs).get("alt")])
        elif tag == "figure":
            self.flush()
            self.figure = len(self.items)
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in _BLOCKS:
            self.flush()

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            caption, self.caption = " ".join("".join(self.caption).split()), None
            for item in self.items[self.figure or 0 :]:
                if item[0] == "media":
                    item[3] = caption
        elif tag == "figure":
            self.flush()
            self.figure = None
        elif tag in _BLOCKS:
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def parse_html(html: str) -> list[tuple]:
    """``[(kind, text, ref, caption)]``; a figure's caption belongs to each of its media."""
    parser = _Sequence()
    parser.feed(html)
    parser.close()
    if parser.caption is not None:
        parser.handle_endtag("figcaption")
    parser.flush()
    return [tuple(i) for i in parser.items]


_ITEM = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])


def sequences(pages: DataFrame, key: str, html: str = "html", carry: tuple[str, ...] = ()) -> DataFrame:
    """``(key, *carry, items)``: each page's ordered ``array<struct<pos, kind, text, ref, caption>>``.

    A null page is an empty one and has no items; repeated keys are each answered.
    """
    source = pages.select(key, F.col(html).cast("string").alias("html"), *carry)
    kinds = dict(source.dtypes)
    names = [key, *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[dict(zip(("pos", "kind", "text", "ref", "caption"), (i, *item), strict=True)) for i, item in enumerate(parse_html(h or ""))] for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(rows, pa.list_(_ITEM))], names=[*names, "items"])

    fields = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    return source.mapInArrow(run, f"{fields}, items array<struct<pos:int,kind:string,text:string,ref:string,caption:string>>")


def resolve(seqs: DataFrame, key: str, store: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per media reference ``digest:<sha256>``: ``(key, *carry, pos, caption, digest)`` and the store's columns."""
    media = F.filter("items", lambda i: i["kind"] == "media")
    refs = seqs.select(key, *carry, F.explode(media).alias("i")).select(key, *carry, "i.pos", "i.caption", F.regexp_extract("i.ref", "^digest:([0-9a-f]{64})$", 1).alias("digest"))
    return refs.join(store, "digest", "left")


def interleave(seqs: DataFrame, key: str, store: DataFrame) -> DataFrame:
    """``(key, items)`` with every media item's ``media_bytes`` and ``feature`` beside its caption, at its position.

    Items keep their order; a reference without a stored payload keeps nulls.  Texts stay
    where they are: only digests and what is known of their payloads are exchanged, and
    pages that share a key are matched by a hash of their items too.
    """
    pages = seqs.select(key, "items", F.xxhash64("items").alias("_page"))
    known = resolve(pages, key, store.select("digest", "media_bytes", "feature"), ("_page",))
    held = known.groupBy(F.col(key).alias("_key"), F.col("_page").alias("_p")).agg(F.collect_set(F.struct("pos", "media_bytes", "feature")).alias("_m"))
    both = pages.join(held, pages[key].eqNullSafe(F.col("_key")) & (F.col("_page") == F.col("_p")), "left")

    def item(i: Column) -> Column:
        found = F.get(F.filter("_m", lambda m: m["pos"] == i["pos"]), 0)
        return F.struct(i["pos"].alias("pos"), i["kind"].alias("kind"), i["text"].alias("text"), i["ref"].alias("ref"), i["caption"].alias("caption"), found["media_bytes"].alias("media_bytes"), found["feature"].alias("feature"))

    return both.select(key, F.transform("items", item).alias("items"))


def pad(payload: bytes) -> bytes:
    """The payload with zero bytes up to a positive multiple of ``ROW``."""
    return payload + b"\0" * ((-len(payload)) % ROW if payload else ROW)


def encode(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (ROW, len(payload) // ROW) + payload


def decode(media: bytes) -> bytes:
    head = _HEADER.match(media)
    if not head or len(media) - head.end() != int(head[1]) * int(head[2]):
        raise ValueError("not a stored payload")
    return media[head.end() :]


def feature(payload: bytes) -> str:
    """Integer statistics of the samples: sum, largest, row-to-row change, 16-bin histogram."""
    samples = np.frombuffer(payload, np.uint8)
    rows = samples.reshape(-1, ROW).astype(np.int32)
    change = int(np.abs(np.diff(rows, axis=0)).sum()) if len(rows) > 1 else 0
    return f"{int(samples.sum(dtype=np.int64))}:{int(samples.max())}:{change}:" + ".".join(map(str, np.bincount(samples >> 4, minlength=16)))


def media_store(texts: DataFrame) -> DataFrame:
    """``(digest, media)``: the payloads of ``text`` in their stored form, written to the shared folder.

    A task stores each of its payloads once and nothing is exchanged, so a payload is
    stored at most once per task; ``described`` has one row for it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            digests, media = [], []
            for text in batch.column(0):
                payload = pad((text.as_py() or "").encode())
                digest = hashlib.sha256(payload)
                if digest.digest() not in seen:
                    seen.add(digest.digest())
                    digests.append(digest.hexdigest())
                    media.append(encode(payload))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(media, pa.binary())], names=["digest", "media"])

    return materialise(texts.select(F.col("text").cast("string")).mapInArrow(run, "digest string, media binary"), "media")


_FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def described(store: DataFrame) -> DataFrame:
    """Reads every stored payload back: one row a digest with its sizes, digests, tail checksum and feature."""
    names = [c.split()[0] for c in _FEATURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                payload = decode(media)
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return store.select("digest", "media").mapInArrow(run, _FEATURES).dropDuplicates(["digest"])


def _digest(text: Column) -> Column:
    data = F.coalesce(text, F.lit("")).cast("binary")
    n = F.length(data)
    zeros = F.when(n == 0, ROW).otherwise(F.pmod(-n, F.lit(ROW))).cast("int")
    return F.sha2(F.concat(data, F.unhex(F.repeat(F.lit("00"), zeros))), 256)


def page_of(text: Column, digest: Column, caption: Column) -> Column:
    """A text as HTML: a paragraph a line, and its payload's figure after the first of them."""
    safe = F.replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    figure = F.concat(F.lit('</p><figure><img src="digest:'), digest, F.lit('" alt="payload"><figcaption>'), caption, F.lit("</figcaption></figure><p>"))
    first = F.substring_index(safe, "\n", 1)
    rest = F.substr(safe, F.length(first) + 2)
    return F.concat(F.lit("<article><p>"), first, figure, F.replace(rest, F.lit("\n"), F.lit("</p><p>")), F.lit("</p></article>"))


def op4_media_sequences(docs: DataFrame) -> DataFrame:
    """Each document as a page of its paragraphs and a figure: parse, resolve by digest, report what was read back.

    A null text is an empty payload, repeated rows and null ids are each answered, extra
    columns are ignored, an empty table gives an empty result.
    """
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    pages = docs.select(F.col("doc_id").cast("long").alias("doc_id"), page_of(F.col("text"), _digest(F.col("text")), F.lit("the text's bytes")).alias("html"), n.alias("n_bytes"))
    # The description of a payload is small; written once, either side of the join can be split.
    found = materialise(described(media_store(docs)), "described")
    out = resolve(sequences(pages, "doc_id", carry=("n_bytes",)), "doc_id", found, ("n_bytes",))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
