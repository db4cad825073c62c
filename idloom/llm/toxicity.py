"""Toxicity by a factorization machine over hashed terms: linear weights and learned pairwise interactions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idloom.llm._scratch import below, release
from idloom.llm._text import segment_sum, word_hashes

TERM_BITS, LABELLED, FACTORS = 20, 20000, 8
BATCH, INITIAL, SQUARES, RATE_V = 128, 0.01, 1e-6, 0.3
#: A term's prior is as wide as it can be if the classes differ in it by so many standard errors, or so large a share of documents has it.
TELLING, COMMON, STEEP = 4.0, 0.1, 12


@dataclass(frozen=True)
class FactorizationMachine:
    """slot: the row of each hashed term; those that no training document has are -1, as their weights are 0."""

    slot: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray
    threshold: float

    def score(self, terms: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability by document, of distinct terms: bias + sum w + sum over pairs of <v_i, v_j>; 0 without any term."""
        x = self.slot[terms]
        kept = x >= 0
        at = np.concatenate([[0], np.cumsum(kept)])[offsets]
        x = x[kept]
        v = self.v[x]
        one, two = segment_sum(v, at), segment_sum(v * v, at)
        p = 1 / (1 + np.exp(-np.clip(self.bias + segment_sum(self.w[x], at) + 0.5 * (one * one - two).sum(axis=1), -30, 30)))
        return np.where(np.diff(offsets) > 0, p, 0.0)


def distinct_terms(texts: pa.Array, bits: int = TERM_BITS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """By block of rows: the distinct hashed words of each row, and offsets."""
    for i, j, words, offsets in word_hashes(texts):
        doc = np.repeat(np.arange(j - i, dtype=np.int64), np.diff(offsets))
        both = np.unique((doc << bits) | (words >> np.uint64(64 - bits)).astype(np.int64))
        yield i, j, both & ((1 << bits) - 1), np.searchsorted(both >> bits, np.arange(j - i + 1))


def train(docs: list[np.ndarray], toxic: np.ndarray, factors: int = FACTORS, epochs: int = 8, rate: float = 0.3, decay: float = 3e-4, seed: int = 7) -> FactorizationMachine:
    """Minibatch AdaGrad on the logistic loss.  A fifth of the rows is held out and sets the threshold with the best F1.

    Every term of the rows has a weight and factors, with a prior that is the narrower the less the rows can say on the term.
    With one class only, or no rows, every score is 0 and nothing is toxic.
    """
    size = 1 << TERM_BITS
    if len(docs) == 0 or toxic.min() == toxic.max():
        return FactorizationMachine(np.full(size, -1, np.int32), -30.0, np.zeros(1), np.zeros((1, factors)), 0.5)
    rng = np.random.default_rng(seed)
    part = rng.permutation(len(docs))
    held, used = part[: len(docs) // 5], part[len(docs) // 5 :]
    if toxic[used].min() == toxic[used].max():
        held, used = part[:0], part
    seen, n = np.unique(np.concatenate([docs[i] for i in used]), return_counts=True)
    slot = np.full(size, -1, np.int32)
    slot[seen] = np.arange(len(seen), dtype=np.int32)
    # A row of the table is a term's weight and its factors.
    table = np.concatenate([np.zeros((len(seen), 1)), rng.normal(0, INITIAL, (len(seen), factors))], axis=1).astype(np.float32)
    squares = np.full(table.shape, SQUARES, np.float32)
    rates = np.array([rate] + [RATE_V * rate] * factors, np.float32)
    # The prior acts in every batch, but a term is only looked at in those that it is in.
    toxic_n = np.bincount(slot[np.concatenate([docs[i] for i in used if toxic[i]])], minlength=len(seen))
    m1 = int(toxic[used].sum())
    m0 = len(used) - m1
    pooled = (n + 0.2) / (len(used) + 0.4)
    z = np.abs((toxic_n + 0.1) / (m1 + 0.2) - (n - toxic_n + 0.1) / (m0 + 0.2)) / np.sqrt(pooled * (1 - pooled) * (1 / m0 + 1 / m1))
    evidence = np.maximum(np.minimum(1, z / TELLING) * np.minimum(1, n / 3), np.minimum(1, n / len(used) / COMMON))
    due = (decay / np.maximum(evidence, 1e-3) ** STEEP / np.minimum(1, n * BATCH / len(used))).astype(np.float32)[:, None]
    bias, gb = float(np.log(toxic[used].mean() / (1 - toxic[used].mean()))), 1e-6
    batches = []
    for at in range(0, len(used), BATCH):
        rows = [slot[docs[i]] for i in used[at : at + BATCH].tolist()]
        x, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
        order = np.argsort(x, kind="stable").astype(np.int32)
        first = np.flatnonzero(np.diff(x[order], prepend=-1))
        batches.append((x, np.concatenate([[0], np.cumsum(sizes)]), order, first.astype(np.int32), x[order[first]], toxic[used[at : at + BATCH]]))
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            x, offsets, order, first, at_rows, truth = batches[k]
            if not len(x):
                continue
            doc = np.repeat(np.arange(len(truth), dtype=np.int32), np.diff(offsets))
            own = table[x]
            one = segment_sum(own, offsets)
            two = segment_sum(np.einsum("ij,ij->i", own[:, 1:], own[:, 1:]), offsets)
            y = bias + one[:, 0] + 0.5 * (np.einsum("ij,ij->i", one[:, 1:], one[:, 1:]) - two)
            err = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - truth) / len(truth) * np.where(truth == 1, 2.0, 1.0)
            one[:, 0] = 1
            own[:, 0] = 0
            scaled, err32 = (one * err[:, None]).astype(np.float32), err.astype(np.float32)
            change = scaled[doc]
            change -= own * err32[doc][:, None]
            now = table[at_rows]
            change = np.add.reduceat(change[order], first, axis=0)
            total = squares[at_rows] + change * change
            squares[at_rows] = total
            step = rates / np.sqrt(total)
            table[at_rows] = (now - step * change) / (1 + step * due[at_rows])
            gb += err.sum() ** 2
            bias -= rate * err.sum() / np.sqrt(gb)
    machine = FactorizationMachine(slot, bias, table[:, 0].copy(), table[:, 1:].copy(), 0.5)
    if len(held) and toxic[held].max() == 1:
        parts = [held[at : at + 256] for at in range(0, len(held), 256)]
        s = np.round(np.concatenate([machine.score(np.concatenate([docs[i] for i in p]), np.concatenate([[0], np.cumsum([len(docs[i]) for i in p])])) for p in parts]), 6)
        order = np.argsort(-s, kind="stable")
        hit = np.cumsum(toxic[held][order])
        f1 = 2 * hit / (np.arange(1, len(held) + 1) + toxic[held].sum())
        k = int(f1.argmax())
        low = s[order][k + 1] if k + 1 < len(order) else 0.0
        machine = replace(machine, threshold=float(np.clip((s[order][k] + low) / 2, 0.05, 0.95)))
    return machine


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", labelled: int = LABELLED) -> FactorizationMachine:
    """Train on about `labelled` labelled documents, chosen by the hash of the id.  This bound is the sample's only one.

    Rows with a null id, label or text don't count; an id labelled twice counts as toxic if any label says so.
    """

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, terms, offsets in distinct_terms(batch.column(0)):
                out += [terms[a:b].astype(np.int32) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32())), batch.column(1)], ["terms", "toxic"])

    known = labels.select(F.col(id_col).cast("bigint").alias("__id"), F.col(label_col).cast("int").alias("__toxic")).dropna()
    n = known.count()
    some = known.where(below(labelled / max(n, 1), "__id")).groupBy("__id").agg(F.max("__toxic").alias("__toxic"))
    # The sample's size is bounded by the parameter, so it may be broadcast at any scale.
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(some), "__id")
    table = rows.select("__text", "__toxic").mapInArrow(featurise, "terms array<int>, toxic int").toArrow()
    found, toxic = [np.asarray(t.values) for t in table.column("terms")], table.column("toxic").to_numpy().astype(np.int64)
    keys = sorted(range(len(found)), key=lambda i: (len(found[i]), found[i].tobytes(), toxic[i]))  # the same model in whatever order the rows come
    machine = train([found[i] for i in keys], toxic[keys])
    del table, found
    release()
    return machine


def toxicity(docs: DataFrame, machine: FactorizationMachine, text_col: str = "text") -> Column:
    """Column of probabilities, rounded to 6 places: 0 for a text without words (null, empty, symbols), the bias alone for one without known words."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [shared.value.score(terms, offsets) for _, _, terms, offsets in distinct_terms(texts)]
        return pa.array(np.round(np.concatenate(parts), 6) if parts else [], pa.float64())

    return score(F.col(text_col))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(doc_id, toxicity, toxic) for every row; other columns are left out, so their names can't clash.

    A text is toxic if its probability, as rounded, reaches the model's threshold, ties included; one without words (null, empty,
    symbols) has 0 and isn't.  Texts are read whole, however long.  Repeated rows and null ids stay; an empty table gives no rows.
    """
    machine = fit(docs, labels, id_col, text_col, label_col)
    return docs.select(F.col(id_col).alias("doc_id"), toxicity(docs, machine, text_col).alias("toxicity")).withColumn("toxic", F.col("toxicity") >= machine.threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows that score_toxicity doesn't call toxic, with all their columns as they are; those with a null or empty text stay."""
    machine = fit(docs, labels, id_col, text_col, label_col)
    return docs.where(toxicity(docs, machine, text_col) < machine.threshold)
