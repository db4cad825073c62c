"""Best-fit packing of documents into training sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idloom.llm._scratch import Scratch

CAPACITIES, SHARD, ITEMS = (1024, 2048, 4096, 8192, 16384), 1 << 26, 1 << 20
OVERHEAD, QUADRATIC = 96.0, 1 / 65536


def bin_cost(capacity: float, overhead: float = OVERHEAD, quadratic: float = QUADRATIC) -> float:
    """Cost of a sequence: a part for each sequence, one for each position, and one for attention between positions."""
    return overhead + capacity + quadratic * capacity * capacity


def pack(lengths: np.ndarray, capacities: Sequence[int] = CAPACITIES, cost=bin_cost) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit of lengths that come in falling order: (bin, offset) of each, and the size of each bin.

    An item goes to the open bin that it leaves least room in, the oldest of equals.  If none has room, a bin is opened, of the
    size with the least cost for each position that can be filled: by the item and by those still to come that are no longer
    than the room beside it.  At the end each bin takes the cheapest size that holds its contents.
    """
    sizes = sorted(capacities)
    price = [cost(c) for c in sizes]
    top = sizes[-1]
    falling = -lengths  # rising, for searches
    to_come = np.concatenate([np.cumsum(lengths[::-1])[::-1], [0]]).tolist()
    from_length = np.searchsorted(falling, -np.arange(top + 1)).tolist()  # the first item of at most that length

    def opened(i: int, n: int) -> int:
        best = None
        for k in range(bisect_left(sizes, n), len(sizes)):
            room = sizes[k] - n
            value = (price[k] / (n + min(room, to_come[max(i + 1, from_length[room])])), sizes[k])
            best = value if best is None or value < best else best
        return best[1]

    by_room: list[list[int]] = [[] for _ in range(top + 1)]  # a queue of bins by room left; `heads` is where each begins
    heads = [0] * (top + 1)
    words = (top >> 6) + 1
    held = [0] * words  # bit r of the map: some bin has room r
    summary = 0
    where, offset, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    room_of: list[int] = []
    for i, n in enumerate(lengths.tolist()):
        w = n >> 6
        here = held[w] >> (n & 63) << (n & 63)
        if not here:
            above = summary >> (w + 1) << (w + 1)
            if above:
                w = (above & -above).bit_length() - 1
                here = held[w]
        if here:
            room = (w << 6) + (here & -here).bit_length() - 1
            queue = by_room[room]
            b = queue[heads[room]]
            heads[room] += 1
            if heads[room] == len(queue):
                by_room[room], heads[room] = [], 0
                held[w] &= ~(1 << (room & 63))
                if not held[w]:
                    summary &= ~(1 << w)
        else:
            b, room = len(used), opened(i, n)
            used.append(0)
            room_of.append(room)
        where[i], offset[i] = b, used[b]
        used[b] += n
        room -= n
        if room:
            by_room[room].append(b)
            held[room >> 6] |= 1 << (room & 63)
            summary |= 1 << (room >> 6)
    cheapest = np.array([sizes[min(range(k, len(sizes)), key=lambda j: (price[j], sizes[j]))] for k in range(len(sizes))])
    return where, offset, cheapest[np.searchsorted(sizes, np.array(used, np.int64))] if used else np.zeros(0, np.int64)


def _pack_shards(capacities: Sequence[int]):
    def out(shard: int, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, null: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((starts, ids, null, -lengths))
        where, offset, size = pack(lengths[order], capacities)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids[order], mask=null[order]),
                pa.array(starts[order]),
                pa.array(lengths[order]),
                pa.array(np.full(len(ids), shard, np.int64)),
                pa.array(where),
                pa.array(offset),
                pa.array(size[where]),
            ],
            ["doc_id", "start", "length", "shard", "bin", "offset", "bin_size"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            shard = batch.column(0).to_numpy()
            cols = (batch.column(1).fill_null(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(1).is_null().to_numpy(zero_copy_only=False))
            cols, shard = tuple(np.repeat(c, batch.column(4).to_numpy()) for c in cols), np.repeat(shard, batch.column(4).to_numpy())
            edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else []
            for a, b in zip(edges, edges[1:]):
                if shard[a] != now and held:
                    yield out(now, *(np.concatenate(x) for x in zip(*held)))
                    held = []
                now = int(shard[a])
                held.append(tuple(c[a:b].copy() for c in cols))
        if held:
            yield out(now, *(np.concatenate(x) for x in zip(*held)))

    return run


def byte_tokens(text: Column) -> Column:
    """Length under a byte-level vocabulary: the bytes of the text and an end mark."""
    return F.octet_length(text) + F.lit(1)


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", length: Column | None = None, text_col: str = "text", capacities: Sequence[int] = CAPACITIES, shard_tokens: int = SHARD, shard_items: int = ITEMS) -> DataFrame:
    """(doc_id, start, length, shard, bin, offset, bin_size): which part of each document lies where in which sequence.

    Length is in tokens, by default those of a byte-level vocabulary.  A document longer than the largest capacity is cut
    into parts of that capacity and a rest, so every token is packed once.  Documents with a null or zero length have no
    parts; the default gives an empty text one token and a null text none.  Repeated rows are packed each.  Rows with a null
    id are packed after the others of their length.  An empty table gives no rows.  A bin is named by shard and bin.

    Documents are dealt to shards of about `shard_tokens` and at most about `shard_items` parts, each packed in falling order
    of length, then by id: only lengths are shuffled, never texts.  Rows that share id and length are counted first and their
    number is split among all shards, so that no shard grows with them.
    """
    spark, top = docs.sparkSession, max(capacities)
    if min(capacities) < 1:
        raise ValueError("capacities must be positive")
    measured = docs.select(F.col(id_col).cast("bigint").alias("id"), (byte_tokens(F.col(text_col)) if length is None else length).cast("bigint").alias("n")).where("n > 0")
    scratch = Scratch(spark, "packing")
    lengths = scratch.table(measured.groupBy("id", "n").agg(F.count("*").alias("times")), "lengths")
    total, items = lengths.agg(F.sum(F.col("n") * F.col("times")), F.sum(F.ceil(F.col("n") / top) * F.col("times"))).first()
    shards = max(1, -(-int(total or 0) // shard_tokens), -(-int(items or 0) // shard_items))
    # Part k of a document begins at k * top; each of the rows that share it goes to the next shard, round and round.
    parts = lengths.select("id", "n", "times", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {top}"))).alias("k"))
    ways = F.least(F.col("times"), F.lit(shards).cast("bigint"))
    dealt = parts.select("id", "n", "times", "k", F.explode(F.sequence(F.lit(0).cast("bigint"), ways - 1)).alias("way"))
    shard = F.pmod(F.pmod(F.xxhash64("id", "n"), F.lit(shards)) + F.col("way"), F.lit(shards))
    copies = F.expr("times div least(times, %dL) + if(way < times %% least(times, %dL), 1, 0)" % (shards, shards))
    dealt = dealt.select(shard.alias("shard"), "id", (F.col("k") * top).alias("start"), F.least(F.col("n") - F.col("k") * top, F.lit(top)).alias("part"), copies.cast("bigint").alias("copies"))
    sorted_ = dealt.repartition("shard").sortWithinPartitions("shard")
    return sorted_.mapInArrow(_pack_shards(tuple(capacities)), "doc_id bigint, start bigint, length bigint, shard bigint, bin bigint, offset bigint, bin_size bigint")
