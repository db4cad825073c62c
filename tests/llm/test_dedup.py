"""Exact and near duplicates against brute force."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from idloom.llm import exact_dedup, near_dup
from idloom.llm._scratch import Scratch

WORDS = [a + b for a in ("an", "be", "co", "de", "fi", "go", "hu") for b in ("ra", "ta", "lo", "mi", "nu", "sk", "x", "th", "ing")]


def corpus(seed: int, groups: int, alone: int) -> list[tuple[int, str]]:
    r, texts = random.Random(seed), []
    for _ in range(groups):
        base = [r.choice(WORDS) for _ in range(r.randint(30, 200))]
        for _ in range(r.randint(2, 9)):
            edited = [r.choice(WORDS) if r.random() < 0.04 else w for w in base]
            texts.append(" ".join(edited))
    texts += [" ".join(r.choice(WORDS) for _ in range(r.randint(20, 200))) for _ in range(alone)]
    texts += ["the same short", "the same short", "the SAME, short!"]
    r.shuffle(texts)
    return list(enumerate(texts))


def shingles(text: str) -> set:
    words = text.lower().replace(",", " ").replace("!", " ").split()
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))}


def test_recall_and_precision_against_all_pairs(spark):
    docs = corpus(1, 40, 150)
    sets = {i: shingles(t) for i, t in docs}
    similar = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in itertools.combinations(sets, 2)}
    roots = {r.id: r.root for r in near_dup.near_duplicate_groups(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    together = lambda i, j: roots.get(i, -1 - i) == roots.get(j, -1 - j)
    want = [p for p, s in similar.items() if s >= near_dup.SIMILAR]
    assert sum(together(*p) for p in want) >= 0.97 * len(want) > 0
    # Pairs that are joined without a chain of similar pairs would be wrong: none is below the threshold less its error.
    chain = {i: i for i, _ in docs}

    def top(i):
        while chain[i] != i:
            i = chain[i]
        return i

    for (i, j), s in similar.items():
        if s >= near_dup.SIMILAR - 0.15:
            chain[max(top(i), top(j))] = min(top(i), top(j))
    assert all(top(i) == top(j) for i, j in roots.items())
    assert all(root == min(k for k, v in roots.items() if v == root) for root in set(roots.values()))


def test_signatures_estimate_jaccard():
    docs = corpus(2, 10, 10)
    sig = near_dup.signatures(pa.array([t for _, t in docs]), 512)
    for (i, a), (j, b) in itertools.combinations(docs, 2):
        x, y = shingles(a), shingles(b)
        assert abs((sig[i] == sig[j]).mean() - len(x & y) / len(x | y)) < 0.12


@pytest.mark.parametrize("cell", [1 << 15, 4])
def test_bucket_edges_connect_as_all_pairs_do(spark, cell):
    """Also where a bucket has many cells."""
    r = np.random.default_rng(3)
    sig = r.integers(0, 3, (160, 8)).astype(np.uint16)
    bands = r.integers(0, 9, (160, 2))
    rows = [(i * 7, int(r.integers(0, 99)), [int(b) for b in bands[i]], sig[i].tobytes()) for i in range(160)]
    alone = spark.createDataFrame(rows, "id bigint, h1 bigint, bands array<bigint>, sig binary")
    found = near_dup.bucket_pairs(alone, 6, 8, Scratch(spark, "test"), cell).collect()
    full = [(i * 7, j * 7) for i in range(160) for j in range(i) if set(bands[i]) & set(bands[j]) and (sig[i] == sig[j]).sum() >= 6]

    def parts(edges):
        at = {i * 7: i * 7 for i in range(160)}
        for a, b in edges:
            old, new = at[b], at[a]
            at = {k: new if v == old else v for k, v in at.items()}
        return sorted(sorted(k for k, v in at.items() if v == root) for root in set(at.values()))

    assert parts([(e.a, e.b) for e in found]) == parts(full) and len(full) > 20
    assert {tuple(sorted((e.a, e.b))) for e in found} <= {tuple(sorted(p)) for p in full}


def test_a_bucket_of_unlike_members_takes_seconds():
    import time

    r = np.random.default_rng(5)
    ids, sig = np.arange(8000), r.integers(0, 1 << 16, (8000, 128)).astype(np.uint16)
    began = time.process_time()
    assert not sum(len(a) for a, _ in near_dup.odd_edges((ids, sig), (ids, sig), 64))
    assert time.process_time() - began < 30


def test_stars_have_the_components_of_the_edges():
    r = np.random.default_rng(6)
    u, v = r.integers(0, 300, (2, 250))

    def least(edges):
        at = list(range(300))
        for a, b in edges:
            old, new = max(at[a], at[b]), min(at[a], at[b])
            at = [new if x == old else x for x in at]
        return at

    batches = [pa.RecordBatch.from_arrays([pa.array(u[i : i + 50]), pa.array(v[i : i + 50])], ["u", "v"]) for i in range(0, 250, 50)]
    for most in (1 << 20, 60):
        stars = pa.Table.from_batches(list(near_dup.star_batches(iter(batches), most)))
        assert least(zip(u, v)) == least(zip(stars["u"].to_pylist(), stars["v"].to_pylist()))


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(i, (i * 7 + 3) % 90) for i in range(90)], [(5, 5), (2, 9), (9, 2), (2, 9)]])
def test_components(spark, edges):
    got = {r.id: r.root for r in near_dup.connected_components(spark, spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "test")).collect()}
    want = {k: k for e in edges for k in e if e[0] != e[1]}
    for _ in want:
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want


def test_collisions_of_a_weak_digest_stay_apart(spark):
    """With a digest of one byte most hits are collisions: only byte verification keeps different texts."""
    docs = [(i, t) for i, (_, t) in enumerate(corpus(4, 30, 100))] + [(900, "same"), (901, "same"), (900, "same")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    weak = lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 2))
    first = {}
    for i, t in docs:
        first[t] = min(i, first.get(t, i))
    for entries, bits in ((16384, 1 << 18), (7, 1 << 10)):
        kept = exact_dedup.exact_dedup(df, digest=weak, entries=entries, bits=bits).collect()
        assert sorted((r.doc_id, r.text) for r in kept) == sorted((i, t) for t, i in first.items())
        table = exact_dedup.duplicate_table(df, digest=weak, entries=entries, bits=bits).collect()
        texts = dict(docs)
        assert len(table) == len(docs) and all(r.kept_id == first[texts[r.doc_id]] for r in table)


def test_ranges_and_filters_only_save_work(spark):
    df = spark.createDataFrame([(i, f"text {i % 37}") for i in range(200)] + [(300 + i, f"alone {i}") for i in range(50)], "doc_id bigint, text string")
    keyed = df.select(exact_dedup.text_digest(F.col("text")).alias("digest"), F.col("doc_id").alias("id"))
    levels = []
    for entries, bits, per_range in ((10, 1 << 12, 1 << 19), (10, 64, 1 << 19), (16384, 1 << 18, 9)):
        index = exact_dedup.DigestIndex(Scratch(spark, "test"), entries, bits, per_range)
        levels.append(sorted((bytes(r.digest), r.smallest, r.n) for r in index.compact(index.flush(keyed)).collect()))
    assert levels[0] == levels[1] == levels[2] and len(levels[0]) == 37 and {n for _, _, n in levels[0]} == {5, 6}


def test_runs_are_sorted_and_small():
    digests = [bytes([k % 50, 7]).ljust(16, b"\0") for k in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(range(300, 0, -1))], ["digest", "id"])
    for ranges in (1, 5):
        rows, seen = 0, 0
        for piece in exact_dedup.memtable_runs(iter([batch]), entries=20, bits=1 << 10, ranges=ranges):
            raw = piece.column("digest")[0].as_py()
            keys = [raw[i : i + 16] for i in range(0, len(raw), 16)]
            assert keys == sorted(set(keys)) and len(keys) <= 20 and {k[0] * ranges >> 8 for k in keys} == {piece.column("range")[0].as_py()}
            rows, seen = rows + int(np.frombuffer(piece.column("n")[0].as_py(), np.int64).sum()), seen + 1
        assert rows == 300 and seen > 14


@pytest.mark.parametrize("blocks, bits", [(1 << 12, 1 << 16), (1, 64)])
def test_rows_without_keys_as_a_plain_anti_join(spark, monkeypatch, blocks, bits):
    """Also with filters so full that every row is in doubt."""
    from idloom.llm import _filters

    monkeypatch.setattr(_filters, "BLOCKS", blocks)
    monkeypatch.setattr(_filters, "BLOCK_BITS", bits)
    rows = [(None if i % 31 == 0 else i % 400, f"t{i}") for i in range(900)]
    docs = spark.createDataFrame(rows, "k bigint, text string")
    gone = spark.createDataFrame([(i,) for i in range(0, 300, 2)] + [(None,)], "g bigint")
    got = sorted(r.text for r in _filters.without(docs, [F.col("k")], gone).collect())
    assert got == sorted(t for k, t in rows if k is not None and not (k < 300 and k % 2 == 0))
    assert _filters.without(docs, [F.col("k")], gone.where("g < 0")).count() == 900


def test_copies_leave_where_they_are_read(spark):
    """No exchange of the result's plan but the one of rows in doubt holds a text, and hardly a row is in doubt."""
    docs = spark.createDataFrame([(i, f"some text {i % 700}") for i in range(2000)], "doc_id bigint, text string")
    out = exact_dedup.exact_dedup(docs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 1 and "Window" not in plan and "Aggregate [text" not in plan
    assert sorted(r.doc_id for r in out.collect()) == list(range(700))
