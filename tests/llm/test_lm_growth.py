"""The language model grows with the vocabulary: rare words are told apart, as context and as target."""

import time
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from idloom.llm import lm_score


def test_rare_words_have_features_of_their_own(spark):
    n = 4000
    pairs = [f"k{i}x v{i}x" for i in range(n)]
    common = [" ".join(f"f{j}" for j in range(1200))] * 20
    docs = spark.createDataFrame(list(enumerate(pairs * 4 + common)), "doc_id bigint, text string").coalesce(1)
    model = lm_score.fit(docs, epochs=3)
    crossed = spark.createDataFrame([(i, f"k{i}x v{(i + 1777) % n}x") for i in range(n)], "doc_id bigint, text string")
    true, other = (lm_score.score_documents(d, model).agg(F.avg("log_prob")).first()[0] for d in (docs.where(F.col("doc_id") < n), crossed))
    assert true - other > 1


def test_sizes_follow_the_vocabulary():
    r = np.random.default_rng(5)
    small, large = (lm_score.new_model(r.integers(1, 9, 1 << bits)) for bits in (16, 21))
    assert len(large.by_word) >= 4 * len(small.by_word) and len(large.by_class) >= 4 * len(small.by_class)
    leaves = np.stack([large.symbol.astype(np.int64), large.tree.leaf], axis=1)
    assert len(np.unique(leaves, axis=0)) == 1 << 21


def test_two_splittings_give_like_models(spark):
    """Tasks train apart and are merged three times: split rows give a somewhat weaker model, but the same order of texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    scores = []
    for parts in (1, 4):
        rows = lm_score.score_documents(docs.repartition(parts, "doc_id")).collect()
        scores.append({r.doc_id: r.log_prob / r.n_words for r in rows if r.n_words})
    a, b = (np.array([s[k] for k in sorted(scores[0])]) for s in scores)
    assert np.abs(a - b).mean() < 0.6 and np.corrcoef(a, b)[0, 1] > 0.93


def test_sums_by_row_cost_less_than_sums_by_segment():
    """A training step spends most of its time here: rows of about ten positions each, as those of the nodes are."""
    r = np.random.default_rng(2)
    rows, p = r.permutation(np.repeat(np.arange(3600), 10)), r.random((36000, 32)).astype(np.float32)

    def by_segment():
        order = np.argsort(rows.astype(np.uint16), kind="stable")
        return np.add.reduceat(np.take(p, order, axis=0), np.flatnonzero(np.diff(rows[order], prepend=-1)), axis=0)

    def least(f):
        took = []
        for _ in range(9):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    at, n, g = lm_score._sum_by_row(rows, p)
    assert (n == 10).all() and np.allclose(g[np.argsort(at)], by_segment(), rtol=1e-4)
    assert least(lambda: lm_score._sum_by_row(rows, p)) < 0.8 * least(by_segment)


def test_vocabulary_takes_few_bytes_a_bucket():
    r = np.random.default_rng(6)
    counts = np.where(r.random(1 << 22) < 0.3, r.integers(1, 1000, 1 << 22), 0)
    tracemalloc.start()
    lm_score.vocabulary(counts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 32 * len(counts)


def test_far_scores_have_probabilities():
    """Sums of exponentials beyond what a float holds, and below, are taken off their largest score."""
    table = np.zeros((4, 32), np.float32)
    table[1], table[2], table[3, 5] = 200, -200, 150
    rows = np.array([[0, 1, 2, 3]])
    p = lm_score._softmax(table, rows)
    assert np.allclose(p.sum(axis=1), 1) and np.allclose(p[:3], 1 / 32) and p[3, 5] > 0.999
    assert np.allclose(lm_score._log_p(table, rows, np.array([3, 3, 3, 5])), [-np.log(32)] * 3 + [0], atol=1e-5)
