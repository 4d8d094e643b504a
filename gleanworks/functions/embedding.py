"""Vectors of texts.  An embedder is a function from a text column to a column of doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A model plugs in as a function that wraps a vectorised UDF.
Embedder = Callable[[Column], Column]
DIM = 64


def hashed(text: Column, dim: int = DIM) -> Column:
    """A deterministic stand-in for a model: how often words of each hash class occur."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))


def input_text(text: Column | None, units: Column) -> Column:
    """A sample's text, or its units joined where it has none."""
    joined = F.array_join(units, " ")
    return joined if text is None else F.coalesce(F.nullif(text, F.lit("")), joined)
