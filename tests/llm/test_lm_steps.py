"""Steps and scores of the language model: the same results as plain versions, for less work."""

import pickle
import tracemalloc

import numpy as np
import pytest

from idloom.llm import lm_score


def test_a_step_equals_a_plain_version():
    """Rows of one position, of several and of more than 64, and all positions in one row."""
    r = np.random.default_rng(8)
    n = 3000
    rows = np.stack([np.full(n, 7), r.permutation(70000)[:n], r.integers(0, 2000, n), np.minimum(r.zipf(1.4, n), 69999)]).astype(np.intp)
    table, gold, p = r.normal(size=(70000, 32)).astype(np.float32), r.integers(0, 32, n), r.dirichlet(np.ones(32), n).astype(np.float32)
    squares, touched = r.random(70000).astype(np.float32), np.zeros(70000, np.float32)
    want, sums, uses = table.astype(float), squares.astype(float), np.zeros(70000)
    loss = p.astype(float) - np.eye(32)[gold]
    for positions in rows:
        for row in np.unique(positions):
            g = loss[positions == row].sum(axis=0)
            sums[row] += g @ g
            want[row] -= 0.6 / np.sqrt(sums[row] + 1e-6) * g
            uses[row] += (positions == row).sum()
    lm_score._step(table, squares, touched, rows, p, gold, 0.6)
    assert np.allclose(table, want, atol=1e-4) and np.allclose(squares, sums, rtol=1e-4) and (touched == uses).all()


def test_rows_of_one_position_are_not_copied_first():
    r = np.random.default_rng(9)
    n = 1 << 16
    p, rows, gold = r.random((n, 32)).astype(np.float32), np.stack([r.permutation(1 << 17)[:n] for _ in range(3)]), r.integers(0, 32, n)
    table, squares, touched = np.zeros((1 << 17, 32), np.float32), np.zeros(1 << 17, np.float32), np.zeros(1 << 17, np.float32)
    tracemalloc.start()
    lm_score._step(table, squares, touched, rows, p, gold, 0.6)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < p.nbytes


@pytest.mark.parametrize("scale", [1, 19, 50, 200])
def test_scores_by_odds_equal_those_by_logarithms(scale):
    """Products that stay well within what a float holds, that are almost 0, and weights whose products might leave it."""
    r = np.random.default_rng(10)
    model = lm_score.new_model(np.where(r.random(1 << 18) < 0.5, r.integers(0, 90, 1 << 18), 0))
    for table in (model.by_class, model.by_word):
        table[:] = scale * r.uniform(-1, 1, table.shape)
    odds = pickle.loads(pickle.dumps(lm_score.as_odds(model)))
    assert odds.odds == (scale < 20) and not model.odds
    assert odds.by_word.ctypes.data % 128 == 0 and odds.by_class.ctypes.data % 128 == 0
    buckets, offsets = r.integers(0, 1 << 18, 40000), np.arange(0, 40001, 50)
    plain, quick = (lm_score.score(model.symbol[buckets], buckets, offsets, m) for m in (model, odds))
    assert np.isfinite(plain).all() and np.allclose(plain, quick, rtol=1e-5, atol=1e-4)
