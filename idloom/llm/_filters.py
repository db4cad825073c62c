"""Bloom filters of bounded size over the keys of a table, and anti-joins that shuffle no row but those a filter leaves in doubt."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idloom.llm._scratch import unused
from idloom.llm._text import mix

#: A block has 8 KiB; at most 4,096 blocks, 32 MiB, whatever the number of keys.  With more keys than fit more rows are in doubt.
BLOCK_BITS, BLOCKS, PROBES, BITS_PER_KEY = 1 << 16, 1 << 12, 5, 12


def positions(hashes: np.ndarray, blocks: int, block_bits: int = BLOCK_BITS) -> np.ndarray:
    """Bit positions of each 64-bit hash, a column per probe; all of a key lie in one block."""
    a, b = mix(hashes.view(np.uint64)), mix(hashes.view(np.uint64) ^ np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    block = (a >> np.uint64(44)) % np.uint64(blocks) * np.uint64(block_bits)
    return (block[:, None] + ((a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(block_bits - 1))).astype(np.int64)


class KeyFilter:
    """The filter of the hashes in the one column of `keys`.  It holds every one of them, and some others."""

    def __init__(self, keys: DataFrame):
        self.spark = keys.sparkSession
        name = keys.columns[0]
        self.n = keys.count()
        size = self.block_bits = BLOCK_BITS
        blocks = self.blocks = min(BLOCKS, 1 << max(0, (self.n * BITS_PER_KEY - 1) // size).bit_length())

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(blocks * size // 8, np.uint8)
            for batch in batches:
                at = positions(batch.column(0).to_numpy(), blocks, size).ravel()
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
            rows = bits.reshape(blocks, -1)
            for k in np.flatnonzero(rows.any(axis=1)):
                yield pa.RecordBatch.from_arrays([pa.array([int(k)]), pa.array([rows[k].tobytes()])], ["block", "bits"])

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    now = np.frombuffer(bits, np.uint8)
                    held[k] = held[k] | now if k in held else now
            for k, bits in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([bits.tobytes()])], ["block", "bits"])

        shape = "block bigint, bits binary"
        found = keys.select(F.col(name).cast("bigint")).mapInArrow(partial, shape).repartition("block").mapInArrow(merged, shape).toArrow() if self.n else None
        bits = np.zeros((blocks, size // 8), np.uint8)
        for k, row in zip(found.column("block").to_pylist(), found.column("bits").to_pylist()) if found else ():
            bits[k] = np.frombuffer(row, np.uint8)
        self.shared = self.spark.sparkContext.broadcast(bits.ravel())

    def holds(self, hashes: Column, also: KeyFilter | None = None) -> Column:
        """True for every key that the filter was made of, and that `also` holds if given, and for few others.  A null hash isn't held."""
        filters = [self] if also is None else [self, also]
        if not all(f.n for f in filters):
            return F.lit(False)
        held_by = [(f.shared, f.blocks, f.block_bits) for f in filters]

        @F.arrow_udf("boolean")
        def held(keys: pa.Array) -> pa.Array:
            hashed = keys.fill_null(0).to_numpy(zero_copy_only=False)
            out = ~keys.is_null().to_numpy(zero_copy_only=False)
            for shared, blocks, size in held_by:
                bits, at = shared.value, positions(hashed, blocks, size)
                for p in range(PROBES):
                    out &= (bits[at[:, p] >> 3] >> (at[:, p] & 7).astype(np.uint8) & 1).astype(bool)
            return pa.array(out)

        return held(hashes)


def without(docs: DataFrame, keys: Sequence[Column], gone: DataFrame, have: DataFrame | None = None) -> DataFrame:
    """The rows of `docs` whose keys aren't those of a row of `gone`; nulls are equal to each other.

    A first filter has all keys of `gone`.  A second one has the keys in the first that aren't gone, found by an exact join of
    keys alone.  A row in the first and not in the second is surely gone, one not in the first surely stays; only rows in both
    are shuffled, to be joined exactly.  `have` may give the keys of `docs`, if they are at hand.  The plan is the same at any size.
    """
    names = gone.columns
    first = KeyFilter(gone.select(F.xxhash64(*names)))
    if not first.n:
        return docs
    have = docs.select(*[k.alias(n) for k, n in zip(keys, names)]) if have is None else have.toDF(*names)
    met = have.where(first.holds(F.xxhash64(*names))).alias("h")
    same = [F.col(f"h.{n}").eqNullSafe(F.col(f"g.{n}")) for n in names]
    stay = met.join(gone.alias("g"), same, "left_anti")
    second = KeyFilter(stay.select(F.xxhash64(*names).alias("h")).distinct())  # shuffled: no task runs two Python workers
    inner = [unused(f"__key{k}", docs) for k in range(len(names))]
    hashed = F.xxhash64(*keys)
    sure = docs.where(~first.holds(hashed))
    if not second.n:
        return sure
    doubt = docs.withColumns(dict(zip(inner, keys))).where(first.holds(F.xxhash64(*inner), second))
    right = gone.toDF(*[f"{n}_gone" for n in inner]).distinct()
    rest = doubt.join(right, [F.col(n).eqNullSafe(F.col(f"{n}_gone")) for n in inner], "left_anti").drop(*inner)
    return sure.unionByName(rest)
