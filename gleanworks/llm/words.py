"""Vectorised word hashing over Arrow string buffers.

A word is a maximal run of bytes outside space and 0x09-0x0D.  Everything here
works on the UTF-8 bytes of a whole batch at once; no per-word Python objects.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_P = np.uint64(0x9E3779B97F4A7C15)
_S33 = np.uint64(33)
#: Bytes of text handled by one numpy pass; bounds a worker's temporaries.
SLICE_BYTES = 2_000_000


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every other."""
    h = h ^ (h >> _S33)
    h = h * _M1
    h ^= h >> _S33
    h *= _M2
    return h ^ (h >> _S33)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty strings."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_string(column.type):
        kind = np.int32
    elif pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text each."""
    if not batch.num_rows:
        return
    _, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """A copy of the bytes with A-Z lower-cased."""
    out = buf.copy()
    out[(buf >= 65) & (buf <= 90)] |= 0x20
    return out


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and each row's first word (rows + 1 entries)."""
    inside = ~_SPACE[buf]
    first, last = inside.copy(), inside.copy()
    if len(buf) > 1:
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
    filled = offsets[:-1][np.diff(offsets) > 0]
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    first[filled] = inside[filled]
    last[ends] = inside[ends]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def hash_words(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, read eight bytes at a time."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    loads = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    length = (stops - starts).astype(np.int64)
    h = np.full(len(starts), (seed * 0x632BE59BD9B4E019 + 0x27D4EB2F165667C5) & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64) ^ length.astype(np.uint64)
    live, at, left = None, starts, length
    while len(at):
        part = np.minimum(left, 8).astype(np.uint64)
        v = loads[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((np.uint64(8) - part) * np.uint64(8)))
        if live is None:
            h = mix((h ^ v) * _P)
            live = np.flatnonzero(left > 8)
        else:
            h[live] = mix((h[live] ^ v) * _P)
            live = live[left > 8]
        at, left = starts[live] + (length[live] - left[left > 8]) + 8, left[left > 8] - 8
    return h


def hash_runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words (``len - k + 1`` of them), order-sensitive."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    have: dict[int, np.ndarray] = {1: words}
    size = 1
    power = {1: int(_P)}
    while size * 2 <= k:
        a = have[size]
        m = len(a) - size
        have[size * 2] = a[:m] * np.uint64(power[size]) + a[size : size + m]
        power[size * 2] = power[size] ** 2 & 0xFFFFFFFFFFFFFFFF
        size *= 2
    out, done = np.zeros(n, np.uint64), 0
    for bit in sorted(have, reverse=True):
        if k - done >= bit:
            out = out * np.uint64(power[bit]) + have[bit][done : done + n]
            done += bit
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    cur, size = values, 1
    while size * 2 <= width:
        cur = np.minimum(cur[: len(cur) - size], cur[size:])
        size *= 2
    return np.minimum(cur[:n], cur[width - size : width - size + n])
