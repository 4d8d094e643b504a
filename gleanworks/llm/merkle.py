"""Merkle fingerprints of documents, in DataFrame expressions only.

Leaves are runs of words inside a paragraph (line), paragraphs hash their leaves,
sections hash runs of paragraphs, and the root hashes the sections.  A leaf ends
after a word whose hash is divisible by four, or after 16 words, in texts of every
length; a section ends after a paragraph whose own digest is divisible by four.
So an inserted word or paragraph moves no boundary beyond the next such end.  Leaves
keep every character, so equal roots mean equal texts, up to collisions of 64-bit leaf
and paragraph hashes.

A fingerprint is the root, the sections with their paragraphs' digests, and a sketch:
the ``SKETCH`` smallest of the leaves' 32-bit hashes, so its size does not grow with
the leaves.  ``differences`` walks from differing roots to the paragraphs that changed.

Defined results: null text counts as empty; the empty text has a root and no
leaves; rows without doc_id have no neighbour; rows that share a doc_id follow
each other in the order of their texts; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hex_digest

#: On average, words in a leaf and paragraphs in a section.
LEAF_MASK = 4
SECTION_MASK = 4
#: Words after which a leaf ends where no word's hash ends it.
MOST_WORDS = 16
#: Leaf hashes that a fingerprint keeps at most.
SKETCH = 256
#: Counted quantiles of doc_id between which ranges are of equal width.
KNOTS = 1024


def _pieces(text: Column) -> Column:
    """array<array<string>>: the leaves' texts by paragraph."""
    word, leaf = r"[^\x20]++\x20*+|\x20++", r"(?:[^\x20\n]++\x20*+){1,%d}+|\x20++" % MOST_WORDS
    # Lines hold no line feed, so it marks the ends.
    ended = lambda p: F.array_join(F.transform(F.regexp_extract_all(p, F.lit(word), F.lit(0)), lambda w: F.when(F.xxhash64(w) % LEAF_MASK == 0, F.concat(w, F.lit("\n"))).otherwise(w)), "")
    return F.transform(F.split(text, "\n"), lambda p: F.regexp_extract_all(ended(p), F.lit(leaf), F.lit(0)))


def leaf_hashes(text: Column) -> Column:
    """array<array<bigint>>: leaf hashes by paragraph."""
    return F.transform(_pieces(text), lambda p: F.transform(p, lambda w: F.xxhash64(w)))


def _hex(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def fingerprint(leaves: Column) -> Column:
    """``root:section/section``; a section is ``digest=paragraph,paragraph``, digests in hex.

    Every digest is computed from its children's digests alone.
    """
    digests = F.transform(leaves, lambda p: F.xxhash64(F.array_join(F.transform(p, _hex), ".")))
    ended = F.transform(digests, lambda d: F.concat(_hex(d), F.when(d % SECTION_MASK == 0, F.lit("/")).otherwise(F.lit(","))))
    runs = F.split(F.regexp_replace(F.array_join(ended, ""), "[,/]$", ""), "/")
    sections = F.transform(runs, lambda s: F.concat(F.substring(hex_digest(s), 1, 32), F.lit("="), s))
    return F.transform(F.array(sections), lambda every: F.concat(F.substring(hex_digest(F.array_join(F.transform(every, lambda s: F.substring_index(s, "=", 1)), "/")), 1, 32), F.lit(":"), F.array_join(every, "/")))[0]


def sketch(leaves: Column) -> Column:
    """array<int>: the ``SKETCH`` smallest distinct 32-bit leaf hashes, in order."""
    return F.slice(F.array_sort(F.array_distinct(F.transform(F.flatten(leaves), lambda h: F.hash(h)))), 1, SKETCH)


def signed(print_: Column, sketch_: Column) -> Column:
    """A fingerprint with its sketch: ``...#hash.hash``."""
    return F.concat(print_, F.lit("#"), F.array_join(F.transform(sketch_, lambda h: F.lower(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))), "."))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two leaf sets from their sketches; 1 for two empty ones.

    Exact where both texts have at most ``SKETCH`` leaves together; else the share of the
    smallest hashes of the union that both hold estimates it.
    """
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(2.0 * both / (F.size(union) + both))


def differences(a: Column, b: Column) -> Column:
    """array<struct<section, paragraph, digest>>: the paragraphs of fingerprint ``a`` (counted from 0) that changed against ``b``.

    Equal roots end the walk at once; a section whose digest ``b`` holds, as many times
    as ``a`` up to there, is not opened; of the others, the paragraphs that ``b``'s changed
    sections hold as many times are unchanged.  Repeated sections and paragraphs count.
    """
    body = lambda f: F.split(F.substring_index(F.substring_index(f, "#", 1), ":", -1), "/")
    numbered = lambda xs: F.transform(xs, lambda x, i: F.struct(i.alias("i"), x.alias("x"), F.size(F.filter(F.slice(xs, 1, i + 1), lambda y: y == x)).alias("k")))
    keys = lambda rows: F.transform(rows, lambda r: F.struct(r["x"], r["k"]))
    left, right = numbered(body(a)), numbered(body(b))

    def changed(mine: Column, others: Column) -> Column:
        return F.filter(mine, lambda r: ~F.array_contains(keys(others), F.struct(r["x"], r["k"])))

    def paragraphs(sections: Column) -> Column:
        flat = F.flatten(F.transform(sections, lambda s: F.transform(F.split(F.substring_index(s["x"], "=", -1), ","), lambda p, j: F.struct(s["i"].alias("section"), j.alias("paragraph"), p.alias("digest")))))
        return F.transform(flat, lambda p, i: F.struct(p["section"].alias("section"), p["paragraph"].alias("paragraph"), p["digest"].alias("digest"), F.size(F.filter(F.slice(flat, 1, i + 1), lambda q: q["digest"] == p["digest"])).alias("k")))

    mine, others = paragraphs(changed(left, right)), paragraphs(changed(right, left))
    held = F.transform(others, lambda p: F.struct(p["digest"], p["k"]))
    found = F.transform(F.filter(mine, lambda p: ~F.array_contains(held, F.struct(p["digest"], p["k"]))), lambda p: F.struct(p["section"].alias("section"), p["paragraph"].alias("paragraph"), p["digest"].alias("digest")))
    none = F.expr("cast(array() as array<struct<section:int,paragraph:int,digest:string>>)")
    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), none).otherwise(found)


def _range_of(rows: DataFrame, n: int) -> tuple[Column, Column]:
    """(``_k``, the range of a doc_id by it): about ``n`` ranges, of equal width between counted quantiles, so that odd ids crowd none."""
    knots = sorted(set(rows.agg(F.percentile_approx("doc_id", [i / KNOTS for i in range(KNOTS + 1)], 10 * KNOTS)).first()[0] or [0]))
    steps, each = len(knots).bit_length(), max(1, -(-n // max(1, len(knots) - 1)))
    # Quantiles in one literal array, at most KNOTS + 1; the last one that is not larger, by halving.
    edges = F.array(*[F.lit(k).cast("long") for k in knots])
    at = F.aggregate(F.array(*[F.lit(2**i) for i in reversed(range(steps))]), F.lit(0), lambda x, step: F.when(F.coalesce(F.get(edges, x + step) <= F.col("doc_id"), F.lit(False)), x + step).otherwise(x))
    lo, hi = F.get(edges, F.col("_k")), F.coalesce(F.get(edges, F.col("_k") + 1), F.get(edges, F.col("_k")) + 1)
    share = (F.col("doc_id").cast("double") - lo.cast("double")) / F.greatest(hi.cast("double") - lo.cast("double"), F.lit(1.0))
    return at, F.col("_k").cast("long") * each + F.least(F.floor(share * each), F.lit(each - 1)).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, print, sketch, next_text, next_sketch)``: each document beside the next in descending doc_id.

    Ids are cut into about sqrt(rows) ranges; inside one the neighbour is a window's
    ``lag``.  The first document of a range gets its neighbour, the last of the range
    before, as a ghost row, so the text is exchanged once and no task sees all rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, hi = rows.agg(F.count("doc_id"), F.max("doc_id")).first()
    at, bucket = _range_of(rows, max(1, math.isqrt(n or 0)))
    known = rows.where("doc_id IS NOT NULL").withColumn("_k", at).select(bucket.alias("b"), "doc_id", "text")
    edges = known.groupBy("b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    # About sqrt(rows) edges, by construction.
    edges = edges.select("b", "first", F.coalesce(F.lag("last").over(Window.orderBy("b")), F.lit(hi).cast("long")).alias("at"))
    ghosts = known.select("doc_id", "text").join(F.broadcast(edges.select("b", "first", "at")), F.col("doc_id") == F.col("at")).groupBy("b", "first").agg(F.max("text").alias("text"))
    every = known.withColumn("real", F.lit(1)).unionByName(ghosts.select("b", F.col("first").alias("doc_id"), "text", F.lit(0).alias("real")))
    every = _printed(every)
    w = Window.partitionBy("b").orderBy("doc_id", "real", "text")
    near = every.select("doc_id", "real", "text", "print", "sketch", F.lag("text").over(w).alias("next_text"), F.lag("sketch").over(w).alias("next_sketch")).where("real = 1").drop("real")
    alone = _printed(rows.where("doc_id IS NULL")).select("doc_id", "text", "print", "sketch", F.lit("").alias("next_text"), F.expr("cast(array() as array<int>)").alias("next_sketch"))
    return near.unionByName(alone)


def _printed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``print`` and ``sketch`` of their text, whose leaves are cut once."""
    return rows.withColumn("_tree", leaf_hashes(F.col("text"))).withColumns({"print": fingerprint(F.col("_tree")), "sketch": sketch(F.col("_tree"))}).drop("_tree")


def op5_merkle(docs: DataFrame) -> DataFrame:
    """The contract's columns: fingerprints of each text, its edited text and their likeness.

    A null text is an empty one; a row without doc_id has the empty text for its next;
    rows of one doc_id follow each other by text; extra columns are ignored; an empty
    table gives an empty result.
    """
    pairs = with_next(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    cut = "cast(floor(length(text) / 3) as int)"
    pairs = pairs.withColumn("edited", F.concat(F.expr(f"left(text, length(text) - {cut})"), F.expr(f"left(next_text, {cut})")))
    trees = pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"), "edited", "print", "sketch", "next_sketch", leaf_hashes(F.col("edited")).alias("tree"))
    done = trees.select("doc_id", "n_chars", hex_digest(F.col("edited")).alias("edited_sha256"), "print", "sketch", "next_sketch", fingerprint(F.col("tree")).alias("edited_print"), sketch(F.col("tree")).alias("edited_sketch"))
    return done.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        signed(F.col("print"), F.col("sketch")).alias("fingerprint"),
        signed(F.col("edited_print"), F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
