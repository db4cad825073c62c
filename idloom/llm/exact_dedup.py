"""Exact duplicates through a log-structured merge index of digests, with byte verification of every hit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idloom.llm._filters import KeyFilter, without
from idloom.llm._scratch import Scratch, unused
from idloom.llm._text import mix

#: Entries of a memtable, bits of a run's filter, and about how many entries of all runs a range of digests has.
MEMTABLE, FILTER_BITS, PROBES, RANGE = 16384, 1 << 18, 4, 1 << 19
RUN = "range int, digest binary, smallest binary, known binary, n binary, bits binary"
ENTRY = "digest binary, smallest bigint, n bigint"


def text_digest(text: Column) -> Column:
    """128 bits of SHA-256, made in the JVM."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _halves(digests: list[bytes]) -> np.ndarray:
    """Digests as two big-endian numbers each, so that they sort as bytes do."""
    return np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)


def filter_positions(keys: np.ndarray, bits: int, probes: int = PROBES) -> np.ndarray:
    """Bit positions of each digest, a row per digest."""
    a, b = mix(keys[:, 0]), mix(keys[:, 1]) | np.uint64(1)
    return ((a[:, None] + b[:, None] * np.arange(probes, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


def memtable_runs(batches: Iterator[pa.RecordBatch], entries: int = MEMTABLE, bits: int = FILTER_BITS, ranges: int = 1) -> Iterator[pa.RecordBatch]:
    """Gather digests of 16 bytes in a memtable; at `entries` of them flush a sorted run, a piece for each range of digests.

    The table keeps the smallest id of each digest and the number of rows.  A null id sorts after every other.  Each piece has a
    Bloom filter of its digests.
    """
    table: dict[bytes, list] = {}
    size = max(64, bits // ranges // 64 * 64)

    def flush() -> Iterator[pa.RecordBatch]:
        keys = sorted(table)
        smallest, n = [table[k][0] for k in keys], np.array([table[k][1] for k in keys], np.int64)
        known, low = np.array([s is not None for s in smallest]), np.array([s or 0 for s in smallest], np.int64)
        table.clear()
        halves = _halves(keys)
        where = (halves[:, 0] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
        cuts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1], [True]]))
        for a, b in zip(cuts, cuts[1:]):
            mask = np.zeros(size, dtype=bool)
            mask[filter_positions(halves[a:b], size)] = True
            parts = [b"".join(keys[a:b]), low[a:b].tobytes(), known[a:b].tobytes(), n[a:b].tobytes(), np.packbits(mask).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([int(where[a])], pa.int32()), *[pa.array([p], pa.binary()) for p in parts]], ["range", "digest", "smallest", "known", "n", "bits"])

    for batch in batches:
        for digest, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held = table.get(digest)
            if held is None:
                table[digest] = [key, 1]
                if len(table) >= entries:
                    yield from flush()
            else:
                held[1] += 1
                if key is not None and (held[0] is None or key < held[0]):
                    held[0] = key
    if table:
        yield from flush()


def _merge(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Two sorted runs as one: of equal digests the smallest id, and the rows of both."""
    keys, low, n = (np.concatenate(x) for x in zip(a, b))
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
    return keys[first], np.minimum.reduceat(low[order], first), np.add.reduceat(n[order], first)


NO_ID = np.iinfo(np.int64).max


def compact_range(pieces: list[tuple[bytes, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge the runs' pieces of one range, level by level.  Returns the hits: digests of several rows, smallest ids, rows.

    A digest that occurs once in its run is merged only if another run's filter holds it too: all its bits are set twice.
    """
    filters = [np.unpackbits(np.frombuffer(bits, np.uint8)) for *_, bits in pieces]
    twice = sum((f.astype(np.uint32) for f in filters), np.zeros(len(filters[0]), np.uint32)) > 1
    levels: list[tuple[np.ndarray, ...] | None] = []
    for digest, smallest, known, n, _ in pieces:
        keys, count = np.frombuffer(digest, ">u8").reshape(-1, 2).astype(np.uint64), np.frombuffer(n, np.int64)
        low = np.where(np.frombuffer(known, bool), np.frombuffer(smallest, np.int64), NO_ID)
        keep = twice[filter_positions(keys, len(twice))].all(axis=1) | (count > 1)
        run = (keys[keep], low[keep], count[keep])
        k = 0
        while k < len(levels) and levels[k] is not None and len(run[0]):
            run, levels[k] = _merge(levels[k], run), None
            k += 1
        if len(run[0]):
            levels += [None] * (k + 1 - len(levels))
            levels[k] = run
    held = (np.zeros((0, 2), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    for run in levels:
        if run is not None:
            held = _merge(held, run)
    hit = held[2] > 1
    return held[0][hit], held[1][hit], held[2][hit]


class DigestIndex:
    """Runs in the shared folder, compacted by range of digests: the digest, its smallest id, the number of rows with it."""

    def __init__(self, scratch: Scratch, entries: int = MEMTABLE, bits: int = FILTER_BITS, per_range: int = RANGE):
        self.scratch, self.entries, self.bits, self.per_range = scratch, entries, bits, per_range

    def flush(self, keyed: DataFrame) -> DataFrame:
        """Write the runs of (digest, id).  No shuffle: each task flushes its own memtables, cut into ranges of digests."""
        entries, bits, ranges = self.entries, self.bits, max(1, -(-keyed.count() // self.per_range))
        return self.scratch.table(keyed.mapInArrow(lambda b: memtable_runs(b, entries, bits, ranges), RUN), "runs")

    def compact(self, runs: DataFrame) -> DataFrame:
        """The digests that more than one row has: the hits.  A range's pieces come together in one task: digests, never texts."""

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, pieces = None, []

            def out() -> pa.RecordBatch:
                keys, low, n = compact_range(pieces)
                raw = keys.astype(">u8").tobytes()
                return pa.RecordBatch.from_arrays([pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary()), pa.array(low, mask=low == NO_ID), pa.array(n)], ["digest", "smallest", "n"])

            for batch in batches:
                for k, *piece in zip(*(c.to_pylist() for c in batch.columns)):
                    if k != now and pieces:
                        yield out()
                        pieces = []
                    now = k
                    pieces.append(piece)
            if pieces:
                yield out()

        return self.scratch.table(runs.repartition("range").sortWithinPartitions("range").mapInArrow(merge, ENTRY), "hits")


class Copies:
    """What exact deduplication of a table needs: the key of each row, a filter of the hits, and the groups found by bytes."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, digest, entries: int, bits: int):
        self.docs, self.text, self.id = docs, F.col(text_col), F.col(id_col).cast("bigint")
        self.scratch = scratch = Scratch(docs.sparkSession, "exact")
        #: Digests are 16 bytes long; shorter ones are padded.
        self.digest = F.rpad(digest(self.text), F.lit(16), F.lit(bytearray(1)))
        self.every = scratch.table(docs.select(self.digest.alias("digest"), self.id.alias("id")), "keyed")
        self.keyed = self.every.where("digest is not null")
        index = DigestIndex(scratch, entries, bits)
        hits = index.compact(index.flush(self.keyed))
        self.hits = KeyFilter(hits.select(F.xxhash64("digest")))
        scratch.drop("runs", "hits")
        # One text for each task and hit reaches the shuffle, however often it occurs.
        texts = docs.where(self.text.isNotNull() & self.hits.holds(F.xxhash64(self.digest))).select(self.digest.alias("digest"), self.text.alias("text"), self.id.alias("id"))
        by_bytes = texts.groupBy("digest", "text").agg(F.min("id").alias("kept"), F.count("*").alias("n"))
        self.groups = scratch.table(by_bytes.groupBy("digest").agg(F.count("*").alias("texts"), F.min("kept").alias("kept"), F.sum("n").alias("n")).where("n > 1"), "groups")
        self.rows = self.keyed.where(self.hits.holds(F.xxhash64("digest")))
        self.plain = self.groups.where("texts = 1").select("digest", "kept", "n")

    def mixed(self, digests: DataFrame, name: str) -> DataFrame:
        """The rows with one of these digests, whole: those that bytes must tell apart."""
        some = KeyFilter(digests.select(F.xxhash64("digest")))
        rows = self.docs.where(self.text.isNotNull()).withColumn(name, self.digest).where(some.holds(F.xxhash64(name)))
        return rows.join(digests.select(F.col("digest").alias(name)), name, "left_semi")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=text_digest, entries: int = MEMTABLE, bits: int = FILTER_BITS) -> DataFrame:
    """The rows to keep: one of all that have the same bytes, that of the smallest id.  All columns stay as they are.

    Rows with a null text aren't copies of anything and stay.  Empty texts are copies of each other.  Rows that agree in id
    and text are copies: one stays.  A null id comes after all others.  Equal digests of different bytes stay apart, as hits
    are compared by their bytes.  Texts are read whole, however long.  An empty table gives no rows.

    Shuffled are digests and ids, and for the comparison of bytes one text for each task and hit.  A copy is dropped where it
    is read; only rows that share an id and a digest with the one kept, or a digest with other bytes, are brought together.
    """
    copies = Copies(docs, id_col, text_col, digest, entries, bits)
    name, row = (unused(n, docs) for n in ("__digest", "__row"))
    known = copies.rows.join(copies.plain, "digest")
    again = known.where(F.col("id").eqNullSafe(F.col("kept"))).groupBy("digest").count().where("count > 1").select("digest")
    apart = copies.scratch.table(copies.groups.where("texts > 1").select("digest").unionByName(again), "apart")
    loses = known.where(~F.col("id").eqNullSafe(F.col("kept"))).select("digest", "id")
    gone = copies.scratch.table(loses.unionByName(copies.rows.join(apart, "digest", "left_semi").select("digest", "id")), "gone")
    copies.scratch.drop("groups")
    left = without(docs, [copies.digest, copies.id], gone, copies.every)
    copies.scratch.drop("keyed")
    if apart.isEmpty():
        return left
    first = Window.partitionBy(name, text_col).orderBy(F.col(id_col).asc_nulls_last())
    chosen = copies.mixed(apart, name).withColumn(row, F.row_number().over(first)).where(F.col(row) == 1)
    return left.unionByName(chosen.select(*[F.col(f"`{c}`") for c in docs.columns]))


def duplicate_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=text_digest, entries: int = MEMTABLE, bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, kept_id, copies) for every row with a text: the smallest id with these bytes, and how many rows have them.

    Null texts have no row, null ids have one; an empty table gives no rows.  Shuffled are digests and ids, and for the
    comparison of bytes one text for each task and hit.
    """
    copies = Copies(docs, id_col, text_col, digest, entries, bits)
    one = F.lit(1).cast("bigint")
    hit = copies.hits.holds(F.xxhash64("digest"))
    alone = copies.keyed.where(~hit).select(F.col("id").alias("doc_id"), F.col("id").alias("kept_id"), one.alias("copies"))
    met = copies.rows.join(copies.groups, "digest", "left").where("texts is null or texts = 1")
    out = alone.unionByName(met.select(F.col("id").alias("doc_id"), F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("kept")).alias("kept_id"), F.coalesce("n", one).alias("copies")))
    apart = copies.groups.where("texts > 1").select("digest")
    if apart.isEmpty():
        return out
    group = Window.partitionBy("__digest", "text")
    rows = copies.mixed(apart, "__digest").select("__digest", copies.text.alias("text"), copies.id.alias("doc_id"))
    return out.unionByName(rows.select("doc_id", F.min("doc_id").over(group).alias("kept_id"), F.count("*").over(group).alias("copies")))
