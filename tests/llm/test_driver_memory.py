"""Training in the driver holds little, and what it held goes back to the system."""

import tracemalloc

import numpy as np
import psutil

from idloom.llm import _scratch, toxicity


def test_unused_memory_goes_back():
    keep, held = [], []
    for _ in range(2000):
        held.append(np.ones(12000))
        keep.append(np.ones(50))
    full = psutil.Process().memory_info().rss
    del held
    _scratch.release()
    assert full - psutil.Process().memory_info().rss > 100e6


def test_training_bytes_a_term():
    r = np.random.default_rng(0)
    docs = [np.unique(np.minimum(r.zipf(1.3, 300), (1 << 20) - 1)).astype(np.int32) for _ in range(3000)]
    tracemalloc.start()
    toxicity.train(docs, np.array([int(7 in d) for d in docs]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 55 * sum(map(len, docs))
