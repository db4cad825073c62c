"""Image tier on decoded gray pictures: quality, rotation, resizing, traces of screens; other detectors are plugins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gray_of(data: bytes, height: int, width: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width)


def laplacian_variance(gray: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian, borders mirrored without their edge."""
    x = np.pad(gray.astype(np.float64), 1, mode="reflect" if min(gray.shape) > 1 else "edge")
    return float((x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:] - 4 * x[1:-1, 1:-1]).var())


def quality(gray: np.ndarray, blur: float = 35.0, white: float = 0.5, black: float = 0.6) -> dict:
    """Sharpness and exposure; the first failing of blur, white and black gives the reason."""
    if gray.size == 0:
        return {"good": False, "blur_score": 0.0, "white_ratio": 0.0, "black_ratio": 0.0, "reason": "empty"}
    score, light, dark = laplacian_variance(gray), float((gray >= 250).mean()), float((gray < 5).mean())
    reason = "blurry" if score < blur else "overexposed" if light > white else "dark" if dark > black else None
    return {"good": reason is None, "blur_score": score, "white_ratio": light, "black_ratio": dark, "reason": reason}


def rotate(gray: np.ndarray, how: str) -> np.ndarray:
    turns = {"rot0": 0, "rot90": -1, "rot180": 2, "rot270": 1}
    if how not in turns:
        raise ValueError(f"no such rotation: {how}")
    return np.rot90(gray, turns[how])


def shrink(gray: np.ndarray, longest: int = 1600) -> np.ndarray:
    """Scale down to the longest side by averaging the area of each new pixel."""
    h, w = gray.shape
    if max(h, w) <= longest:
        return gray
    scale = longest / max(h, w)
    out = gray.astype(np.float64)
    for axis, n in ((0, max(1, round(h * scale))), (1, max(1, round(w * scale)))):
        edges = np.linspace(0, out.shape[axis], n + 1)
        sums = np.concatenate([np.zeros_like(np.take(out, [0], axis)), np.cumsum(out, axis)], axis)
        low = np.minimum(edges.astype(int), out.shape[axis])
        part = edges - low
        shape = [-1 if a == axis else 1 for a in (0, 1)]
        at = np.take(sums, low, axis) + part.reshape(shape) * np.take(out, np.minimum(low, out.shape[axis] - 1), axis)
        out = np.diff(at, axis=axis) / np.diff(edges).reshape(shape)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def ring_ratio(magnitude: np.ndarray, low: int = 40, high: int = 180, step: int = 2) -> float:
    """Largest ratio of a ring's strongest frequency to its mean, of rings of ten pixels or more."""
    h, w = magnitude.shape
    y, x = np.ogrid[:h, :w]
    radius = np.hypot(y - h // 2, x - w // 2)
    ring = np.trunc((radius - low) / step).astype(int)  # the first ring reaches inwards too
    n = (high - low) // step
    inside = (radius > low - step) & (ring < n)
    ring, values = ring[inside], magnitude[inside]
    count = np.bincount(ring, minlength=n)
    mean = np.bincount(ring, values, n) / np.maximum(count, 1)
    top = np.zeros(n)
    np.maximum.at(top, ring, values)
    usable = (count >= 10) & (mean >= 1e-6)
    return float((top[usable] / mean[usable]).max()) if usable.any() else 0.0


def transform_size(n: int) -> int:
    """The least number from n up that has no prime factor but 2, 3 and 5."""
    while True:
        m = n
        for p in (2, 3, 5):
            while m and m % p == 0:
                m //= p
        if m <= 1:
            return n
        n += 1


def screen_trace(gray: np.ndarray, prominent: float = 0.25, ring: float = 1.45) -> dict:
    """Moire of a photographed screen: a prominent middle frequency, or one that stands out of its ring; five strongest peaks.

    The picture is filled up with zeros to sizes that a fast transform likes; frequencies are shares of these sizes.
    """
    none = {"is_recaptured": False, "moire_score": 0.0, "ring_ratio": 0.0, "peaks": []}
    if gray.size == 0:
        return none
    h, w = map(transform_size, gray.shape)
    magnitude = np.log1p(np.abs(np.fft.fftshift(np.fft.fft2(gray.astype(np.float64), (h, w)))))
    if magnitude.max() == 0:
        return none
    m = magnitude / magnitude.max()
    y, x = np.ogrid[:h, :w]
    radius = np.hypot(y - h // 2, x - w // 2)
    band = (radius > min(gray.shape) // 20) & (radius <= min(gray.shape) // 4)
    if not band.any():
        return none
    v = m[band]
    score = float(np.clip(((v.max() - v.mean()) / max(v.std(), 1e-6) - 4) / 8, 0, 1))
    py, px = np.nonzero(band & (m > max(0.55, v.mean() + 4 * v.std())))
    best = np.argsort(-m[py, px], kind="stable")[:5]
    peaks = [[abs(px[k] - w // 2) / w, abs(py[k] - h // 2) / h, float(m[py[k], px[k]])] for k in best]
    ratio = ring_ratio(magnitude)
    return {"is_recaptured": score > prominent or ratio > ring, "moire_score": score, "ring_ratio": ratio, "peaks": peaks}


SCHEMA = "id bigint, good boolean, blur_score double, white_ratio double, black_ratio double, reason string, is_recaptured boolean, moire_score double, ring_ratio double, peaks array<array<double>>"


def analyse(images: DataFrame) -> DataFrame:
    """Quality and screen traces of (id, gray, height, width), gray being the bytes of a picture by rows; nulls give nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, data, h, w in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if data is None:
                    rows.append((i, *[None] * 9))
                    continue
                g = gray_of(data, h, w)
                q, s = quality(g), screen_trace(g)
                rows.append((i, q["good"], q["blur_score"], q["white_ratio"], q["black_ratio"], q["reason"], s["is_recaptured"], s["moire_score"], s["ring_ratio"], s["peaks"]))
            kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string(), "array<array<double>>": pa.list_(pa.list_(pa.float64()))}
            names, types = zip(*(c.split() for c in SCHEMA.split(", ")))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], list(names))

    return images.select(F.col("id").cast("bigint"), "gray", "height", "width").mapInArrow(run, SCHEMA)


def decode_with(files: DataFrame, decoder: Callable[[bytes], np.ndarray]) -> DataFrame:
    """(path, gray, height, width, error) of binary files by a caller's decoder; what can't be decoded has an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    g = decoder(data)
                    row = (path, g.tobytes(), g.shape[0], g.shape[1], None)
                except Exception as bad:  # a decoder may raise anything; the row carries it on
                    row = (path, None, None, None, str(bad) or type(bad).__name__)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.string()))], ["path", "gray", "height", "width", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, gray binary, height int, width int, error string")


def cascade(rows: DataFrame, first: Callable[[DataFrame], DataFrame], second: Callable[[DataFrame], DataFrame], found: str) -> DataFrame:
    """Run a costly stage only on the rows that a cheap one left open: filtered and united, as `when` wouldn't spare the call."""
    done = first(rows)
    rest = second(done.where(~F.coalesce(F.col(found), F.lit(False))))
    return done.where(F.coalesce(F.col(found), F.lit(False))).unionByName(rest)
