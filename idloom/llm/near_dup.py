"""Near-duplicate groups: MinHash signatures, banding, signature verification, large-star / small-star components."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.llm._filters import without
from idloom.llm._scratch import Scratch
from idloom.llm._text import mix, word_hashes

HASHES, BANDS, SHINGLE, SIMILAR = 128, 32, 3, 0.5
#: Rows of one bucket that a task compares with each other, and edges that a task merges before the first round.
CELL, EDGES = 1 << 15, 1 << 20


def _family(hashes: int, seed: int = 20240229) -> tuple[np.ndarray, np.ndarray]:
    """Multiply-add-shift family, universal for 32-bit keys: h(x) = (a x + b mod 2^64) >> 32."""
    a, b = np.random.default_rng(seed).integers(0, 1 << 64, (2, hashes), dtype=np.uint64)
    return a | np.uint64(1), b


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words by text; a text of fewer words, if any, is one shingle."""
    counts = np.diff(offsets)
    held = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out = np.zeros(len(held) + 1, np.int64)
    np.cumsum(held, out=out[1:])
    at = np.repeat(offsets[:-1] - out[:-1], held) + np.arange(out[-1])
    last = np.repeat(offsets[1:], held)
    total = np.zeros(len(at), np.uint64)
    for k in range(size):
        i = at + k
        ok = i < last
        total *= np.uint64(0xD6E8FEB86659FD93)
        total[ok] += words[i[ok]]
    return mix(total), out


def signatures(texts: pa.Array, hashes: int = HASHES, size: int = SHINGLE) -> np.ndarray:
    """uint32 matrix of minima, a row per text; rows without words are all ones."""
    a, b = _family(hashes)
    rows = []
    for _, _, words, offsets in word_hashes(texts):
        keys, at = shingle_hashes(words, offsets, size)
        keys >>= np.uint64(32)
        sig = np.full((len(at) - 1, hashes), 0xFFFFFFFF, np.uint32)
        full = np.flatnonzero(np.diff(at))
        if len(full):
            starts, buf = at[:-1][full], np.empty_like(keys)
            for k in range(hashes):
                np.multiply(keys, a[k], out=buf)
                np.add(buf, b[k], out=buf)
                sig[full, k] = (np.minimum.reduceat(buf, starts) >> np.uint64(32)).astype(np.uint32)
        rows.append(sig)
    return np.concatenate(rows) if rows else np.zeros((0, hashes), np.uint32)


def _sign(hashes: int, bands: int, size: int):
    width = hashes // bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = signatures(batch.column(1), hashes, size)
            has = (sig != 0xFFFFFFFF).any(axis=1)
            ids, sig = batch.column(0).filter(pa.array(has)), sig[has]
            keys = np.zeros((len(sig), bands), np.uint64)
            for k in range(width):
                keys = mix(keys * np.uint64(0xFF51AFD7ED558CCD) + sig[:, k::width].astype(np.uint64) + np.uint64(k + 1))
            keys = mix(keys + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            whole = np.zeros((len(sig), 2), np.uint64)
            for k in range(hashes):
                whole = mix(whole * np.uint64(0xC4CEB9FE1A85EC53) + sig[:, k : k + 1] + np.array([3, 5], np.uint64))
            whole = np.ascontiguousarray(whole.view(np.int64))
            low = np.ascontiguousarray(sig.astype(np.uint16))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.cast(pa.int64()),
                    pa.array(whole[:, 0]),
                    pa.array(whole[:, 1]),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(sig) * bands + 1, bands, dtype=np.int32)), pa.array(keys.ravel())),
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * hashes), len(sig), [None, pa.py_buffer(low.tobytes())]).cast(pa.binary()),
                ],
                ["id", "h1", "h2", "bands", "sig"],
            )

    return run


def agreements(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many positions each row of a shares with each row of b; position by position, so that no three-way table is made."""
    out = np.zeros((len(a), len(b)), np.uint16)
    x, y = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    for p, q in zip(x, y):
        out += p[:, None] == q
    return out


def odd_edges(odd: tuple[np.ndarray, np.ndarray], members: tuple[np.ndarray, np.ndarray], need: int, block: int = 512) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges between rows unlike their bucket's first member and members of the bucket, both as (ids, signatures)."""
    found = []
    for i in range(0, len(odd[0]), block):
        for j in range(0, len(members[0]), 8 * block):
            k, m = np.nonzero(agreements(odd[1][i : i + block], members[1][j : j + 8 * block]) >= need)
            a, b = odd[0][i + k], members[0][j + m]
            found.append((a[a != b], b[a != b]))
    return found


def _pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, k]), pa.int64()) for k in (0, 1)], ["a", "b"])


def _matrix(column: pa.Array, hashes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, hashes)


def _compare(need: int, hashes: int):
    """For sorted rows (cell, odd, id, sig): the edges of each cell, whose rows are as many as a cell may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> pa.RecordBatch:
            odd, ids, sig = (np.concatenate(x) for x in zip(*[h[1:] for h in held]))
            return _pairs(odd_edges((ids[odd], sig[odd]), (ids[~odd], sig[~odd]), need))

        for batch in batches:
            cell = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            cols = (cell, batch.column(3).to_numpy(zero_copy_only=False).astype(bool), batch.column(4).to_numpy(), _matrix(batch.column(5), hashes))
            cuts = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]).any(axis=1), [True]])) if len(cell) else []
            for a, b in zip(cuts, cuts[1:]):
                if held and (held[0][0][0] != cell[a]).any():
                    yield out()
                    held = []
                held.append(tuple(c[a:b].copy() for c in cols))
        if held:
            yield out()

    return run


def _alike(hashes: int):
    """How many positions two columns of signatures share."""

    @F.arrow_udf("int")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array((_matrix(a, hashes) == _matrix(b, hashes)).sum(axis=1).astype(np.int32))

    return alike


def bucket_pairs(alone: DataFrame, need: int, hashes: int, scratch: Scratch, cell: int = CELL) -> DataFrame:
    """Edges (a, b) that connect just what comparing all pairs within each bucket would connect.

    Every member of a bucket is compared with its first one, the least (id, h1), and connected through it if alike.  One that
    isn't is compared with the whole bucket; pairs left out lie within one component already.  No task holds a bucket: members
    meet their first one in a join, and the comparisons of the others are dealt to cells of about `cell` rows either way.
    """
    keys = alone.select("id", "h1", F.explode("bands").alias("key"))
    many = keys.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("id", "h1")).alias("first")).where("n > 1")
    members = scratch.table(keys.join(many.select("key", "n", F.col("first.id").alias("first_id"), F.col("first.h1").alias("first_h1")), "key"), "members")
    signed = alone.select("id", "h1", "sig").distinct()
    own = members.join(signed, ["id", "h1"])
    first = members.where("id = first_id and h1 = first_h1").select("key", "id", "h1").distinct().join(signed, ["id", "h1"]).select("key", F.col("sig").alias("first_sig"))
    met = own.where("id <> first_id or h1 <> first_h1").join(first, "key").withColumn("same", _alike(hashes)("sig", "first_sig"))
    met = scratch.table(met.select("key", "n", "id", "h1", "first_id", "same"), "met")
    odd = met.where(F.col("same") < need)
    held = odd.groupBy("key").agg(F.count("*").alias("odd"), F.max("n").alias("n"))
    cells = held.select("key", F.ceil(F.col("odd") / cell).cast("int").alias("across"), F.ceil(F.col("n") / cell).cast("int").alias("down"))
    part = lambda n, salt: F.pmod(F.xxhash64("id", "h1", F.lit(salt)), F.col(n)).cast("bigint")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n).cast("bigint") - 1))
    rows = odd.join(cells, "key").select("key", part("across", 1).alias("x"), "down", "id", "h1", F.lit(True).alias("odd"))
    rows = rows.select("key", "x", every("down").alias("y"), "odd", "id", "h1")
    all_ = members.join(cells, "key").select("key", "across", part("down", 2).alias("y"), "id", "h1", F.lit(False).alias("odd"))
    all_ = all_.select("key", every("across").alias("x"), "y", "odd", "id", "h1")
    dealt = rows.unionByName(all_).join(signed, ["id", "h1"]).select("key", "x", "y", "odd", "id", "sig")
    found = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(_compare(need, hashes), "a bigint, b bigint")
    return found.unionByName(met.where(F.col("same") >= need).select(F.col("first_id").alias("a"), F.col("id").alias("b")))


def star_batches(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Edges with the same components, of `most` edges at a time: each node joined to the least one of its component."""

    def out() -> pa.RecordBatch:
        u, v = (np.concatenate(x) for x in zip(*held))
        names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = at[: len(u)], at[len(u) :]
        root = np.arange(len(names))
        while True:
            low, before = np.minimum(root[a], root[b]), root.copy()
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            root = root[root]
            if (root == before).all() and (root[a] == root[b]).all():
                break
        node = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(names[node]), pa.array(names[root[node]])], ["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= most:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch, most: int = EDGES) -> DataFrame:
    """(id, root) for every node of the edges (a, b): alternate large-star and small-star until the edges no longer change.

    Before the first round every `most` edges are merged where they lie.  Each round's edges are a written table, which cuts
    the lineage.  No edges: no rows.
    """

    def minimum(pairs: DataFrame) -> DataFrame:
        """(u, v, m): m is the least of u and its neighbours.  Aggregates before joining, so a hot node doesn't fill one task."""
        least = pairs.groupBy("u").agg(F.min("v").alias("least"))
        return pairs.join(least, "u").select("u", "v", F.least("u", "least").alias("m"))

    plain = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    parts = max(1, -(-plain.count() // most))
    now = scratch.table(plain.repartition(parts).mapInArrow(lambda b: star_batches(b, most), "u bigint, v bigint").distinct(), "edges0")
    before = None
    for k in itertools.count(1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = minimum(large)
        star = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = scratch.table(star, f"edges{k}")
        scratch.drop(f"edges{k - 1}")
        sums = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if sums == before:
            break
        before = sums
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, hashes: int = HASHES, bands: int = BANDS, size: int = SHINGLE) -> DataFrame:
    """(id, root) of every document that has a near copy; root is the smallest id of its group.

    Two documents are near copies if their signatures agree in at least `similar` of the positions, an estimate of the
    Jaccard similarity of their word shingles (lower case, punctuation left out).  A text shorter than a shingle is one
    shingle.  Texts without words (null, empty, symbols only) and rows without an id have no near copies.  Rows that share
    an id are one document, near to all that any of them is near to.  An empty table gives no rows.  Other columns are
    ignored.  Texts are read whole, however long.  Every document queries every bucket that it falls into, with no cap on members.
    """
    spark, need = docs.sparkSession, int(np.ceil(similar * hashes))
    scratch = Scratch(spark, "neardup")
    plain = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    signed = scratch.table(plain.mapInArrow(_sign(hashes, bands, size), "id bigint, h1 bigint, h2 bigint, bands array<bigint>, sig binary"), "signed")
    # Equal signatures need no banding: their smallest id stands for all of them.
    whole = signed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    copies = scratch.table(signed.select("id", "h1", "h2").join(whole, ["h1", "h2"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), "h1"), "copies")
    alone = scratch.table(without(signed, [F.col("id"), F.col("h1")], copies.select(F.col("b").alias("id"), "h1")), "alone")
    scratch.drop("signed")
    edges = scratch.table(bucket_pairs(alone, need, hashes, scratch).unionByName(copies.select("a", "b")), "edges")
    scratch.drop("copies", "alone", "members", "met")
    groups = connected_components(spark, edges, scratch)
    scratch.drop("edges")
    return groups


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows to keep: of each group of near copies the document of the smallest id.  All columns stay as they are.

    Rows with null or wordless texts, or without an id, stay; an empty table gives no rows.  Texts aren't shuffled: a row that
    goes is dropped where it is read.
    """
    gone = near_duplicate_groups(docs, id_col, text_col, **how).where("id <> root").select("id")
    gone = Scratch(docs.sparkSession, "neardup-gone").table(gone, "gone")
    return without(docs, [F.col(id_col).cast("bigint")], gone)


def group_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """A row per distinct id: its group (its own id if it has no near copy) and whether it is the one kept."""
    groups = near_duplicate_groups(docs, id_col, text_col, **how)
    ids = docs.select(F.col(id_col).cast("bigint").alias("id")).where("id is not null").distinct()
    return ids.join(groups, "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("root", "id").alias("group_id"), F.coalesce(F.col("id") == F.col("root"), F.lit(True)).alias("kept"))
