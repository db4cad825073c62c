"""Vectorised views of Arrow text columns: word boundaries and 64-bit word hashes without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_R = 0x9E3779B97F4A7C15
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of uint64 values (in place on a copy)."""
    x = x.astype(np.uint64, copy=True)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(by)
    x ^= x >> np.uint64(31)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string column; a null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    if len(texts) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each; a longer row has a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = j


def _hash_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        inverse = pow(_R, -1, 1 << 64)
        for base in (_R, inverse):
            a = np.full(BLOCK + 1, base, np.uint64)
            a[0] = 1
            _powers.append(np.multiply.accumulate(a))
    return _powers[0][:n], _powers[1][:n]


def word_spans(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of letters and digits (every byte over 127 is a letter); no word crosses a start of a text."""
    n = len(raw)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = _WORD[raw]
    fresh = np.zeros(n + 1, dtype=bool)
    fresh[starts[starts <= n]] = True
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = inside[:n]
    return np.flatnonzero(inside & (~before | fresh)), np.flatnonzero(before & (~inside | fresh))


def _hash_segment(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin, end = word_spans(raw, starts)
    powers, inverses = _hash_powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(raw.astype(np.uint64) * powers, out=sums[1:])
    return mix((sums[end] - sums[begin]) * inverses[begin]), begin


def _cuts(raw: np.ndarray) -> list[int]:
    """Positions that split a very long text into segments of at most BLOCK bytes, between words wherever there is such a place."""
    at, n = [0], len(raw)
    while n - at[-1] > BLOCK:
        window = raw[at[-1] : at[-1] + BLOCK]
        gaps = np.flatnonzero(~_WORD[window[BLOCK // 2 :]])
        at.append(at[-1] + (BLOCK // 2 + int(gaps[-1]) + 1 if len(gaps) else BLOCK))
    return [*at, n]


def word_hashes(texts: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each block of rows (i, j): the hashes of all their words in order, and j - i + 1 offsets into them by row.

    A single unbroken word of over a million bytes is hashed in pieces of that size; every other text is treated whole.
    """
    if lower:
        texts = pc.utf8_lower(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts)
    raw, offsets = buffers(texts)
    for i, j in blocks(offsets):
        part, base = raw[offsets[i] : offsets[j]], offsets[i]
        if len(part) <= BLOCK:
            hashes, begin = _hash_segment(part, offsets[i:j] - base)
            yield i, j, hashes, np.searchsorted(begin, offsets[i : j + 1] - base).astype(np.int64)
        else:
            cuts = _cuts(part)
            found = [_hash_segment(part[a:b], np.zeros(1, np.int64))[0] for a, b in zip(cuts, cuts[1:])]
            yield i, j, (hashes := np.concatenate(found)), np.array([0, len(hashes)], np.int64)


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i + 1]], 0 where that is empty; rows of a matrix are summed by column."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), np.result_type(values.dtype, np.float64) if values.dtype.kind == "f" else np.int64)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0, dtype=out.dtype)
    return out
