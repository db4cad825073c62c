"""The whole pipeline on a small table against plain versions of its stages, each on what the plain one before kept."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from idloom.llm import lang_id, near_dup, packing, toxicity

SF = "/root/testdata/sf0.001"


def accepted(text: str | None, model: lang_id.LanguageModel) -> bool:
    """EM over all sets of languages by size, a document at a time; rejected where half the words fit none."""
    if not text:
        return False
    (_, _, likely, _), = lang_id.word_likelihoods(pa.array([text]), model)
    n, k = likely.shape
    if not n:
        return False

    def em(allowed):
        pi = np.isin(np.arange(k), allowed) / len(allowed)
        p = np.exp(likely - likely.max(axis=1, keepdims=True))
        for _ in range(24):
            joint = p * pi
            pi = (joint / np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)).mean(axis=0)
        return pi, np.log(np.maximum((p * pi).sum(axis=1), 1e-300)).sum() + likely.max(axis=1).sum()

    best = int(likely.sum(axis=0).argmax())
    price = lang_id.PENALTY * np.log(max(n, 2))
    value, share = likely[:, best].sum() - price, np.eye(k)[best]
    order = np.argsort(-em(range(k))[0], kind="stable")
    for m in range(2, k + 1 if n > 1 else 2):
        pi, reach = em(order[:m])
        if reach - m * price > value and pi[order[:m]].min() >= lang_id.MIN_SHARE:
            value, share = reach - m * price, pi
    return share[-1] <= 0.5


def toxic(text: str, machine: toxicity.FactorizationMachine) -> bool:
    """The machine's sum over all pairs, one by one."""
    terms = [t for _, _, x, _ in toxicity.distinct_terms(pa.array([text])) for t in x.tolist()]
    rows = [machine.slot[t] for t in terms if machine.slot[t] >= 0]
    if not terms:
        return False
    v = machine.v[rows].astype(float)
    pairs = (v @ v.T)[np.triu_indices(len(rows), 1)].sum() if rows else 0.0
    y = machine.bias + machine.w[rows].astype(float).sum() + pairs
    return round(1 / (1 + np.exp(-np.clip(y, -30, 30))), 6) >= machine.threshold


def near_roots(texts: dict[int, str]) -> dict[int, int]:
    """All pairs: alike in half of the minima and equal in a band."""
    ids = sorted(texts)
    sig = near_dup.signatures(pa.array([texts[i] for i in ids]))
    root = dict(zip(ids, ids))
    width = near_dup.HASHES // near_dup.BANDS
    for a in range(len(ids)):
        same = sig[a] == sig[:a]
        bands = np.stack([same[:, k :: near_dup.BANDS] for k in range(near_dup.BANDS)], axis=1).all(axis=2).any(axis=1) if a else np.zeros(0, bool)
        assert width * near_dup.BANDS == near_dup.HASHES
        words = (sig[a] != 0xFFFFFFFF).any()
        for b in np.flatnonzero(bands & (same.sum(axis=1) >= near_dup.SIMILAR * near_dup.HASHES)) if words else []:
            x, y = root[ids[a]], root[ids[b]]
            root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    return root


def test_the_run_equals_plain_stages(spark, tmp_path):
    r = random.Random(1)
    docs = [(d.doc_id, d.text, d.lang, d.source, d.n_chars) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    some = r.sample(docs, 12)
    docs += [(9000 + k, t, lang, source, n) for k, (_, t, lang, source, n) in enumerate(some)]
    docs += [(9100 + k, t + " changed ending", lang, source, n) for k, (_, t, lang, source, n) in enumerate(some)]
    docs += [(9200, None, None, None, None), (9201, "", "en", None, 0), (None, "a text without an id, which is good English prose about the sea", "en", "s", 10), (9202, "?!", None, None, 2)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    sf = f"file://{tmp_path}"
    frame.write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{sf}/labels.parquet")
    packed = corpus_pipeline.run(spark, sf).collect()

    docs = [(i, t, lang) for i, t, lang, _, _ in docs]
    model = lang_id.fit(frame)
    docs = [d for d in docs if accepted(d[1], model)]
    kept = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    machine = toxicity.fit(kept, spark.read.parquet(f"{SF}/labels.parquet"))
    docs = [d for d in docs if not toxic(d[1], machine)]
    first: dict = {}
    for i, t, _ in docs:
        first[t] = min(first.get(t, (True, 0)), (i is None, i or 0))
    docs = [(None if null else i, t) for t, (null, i) in first.items()]
    root = near_roots({i: t for i, t in docs if i is not None})
    docs = [(i, t) for i, t in docs if i is None or root[i] == i]

    assert len(first) > len(docs) > 50
    sizes: dict = {}
    for row in packed:
        sizes[row.doc_id] = sizes.get(row.doc_id, 0) + row.length
    assert sizes == {i: len(t.encode()) + 1 for i, t in docs}
    bins: dict = {}
    for row in packed:
        bins.setdefault((row.shard, row.bin, row.bin_size), []).append((row.offset, row.length))
    for (_, _, size), parts in bins.items():
        parts.sort()
        assert size in packing.CAPACITIES and sum(n for _, n in parts) <= size and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
    lengths = sorted((row.length for row in packed), reverse=True)
    _, _, want = packing.pack(np.array(lengths))
    assert sorted(want.tolist()) == sorted(size for _, _, size in bins)
