"""Language-model scores by a hashed maximum-entropy model: n-gram and skip features, a softmax factored into classes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idloom.llm._text import segment_sum, word_hashes

#: The least sizes of a model: WORD_BITS, CLASS_ROWS and WORD_ROWS grow with the vocabulary, and so does the tree below the last class.
WORD_BITS, CLASSES, SLOTS, CLASS_ROWS, WORD_ROWS = 16, 32, 32, 1 << 13, 1 << 15
EPOCHS, ROUNDS, RATE, BATCH, ROWS_PER_BLOCK, SETTLED = 1, 3, 0.6, 16384, 64, 256.0
#: Buckets treated at once where all of them are gone through.
STRETCH = 1 << 20
OWN, DIGIT, WORDS_PER_ROW = (CLASSES - 1) * SLOTS, SLOTS.bit_length() - 1, 16


@dataclass
class Tree:
    """Leaves of the words below each symbol of the last class: a digit of `leaf` (SLOTS ways) at each of a symbol's `depth` nodes.

    A node's row of `log_prior` has the shares of the counts below its branches; `first` is a symbol's first node of each level.
    """

    leaf: np.ndarray
    depth: np.ndarray
    first: np.ndarray
    log_prior: np.ndarray


@dataclass
class MaxentModel:
    """p(word) = p(class | features) p(symbol | class, features) p(word | symbol, features).

    Words are hashed to buckets, at least two for each distinct word.  The most frequent buckets are symbols of their own; every
    other one seen in training has a leaf of its own in the tree below a symbol of the last class, reached by further choices
    that start from the shares of the counts.  Without a tree these shares alone decide.  A row of `by_class` has a weight per
    class, one of `by_word` a weight per slot or branch; a feature's row in `by_word` depends on the class or node too.
    With `odds`, weights and priors are held as exponentials (see `as_odds`).
    """

    symbol: np.ndarray
    log_within: np.ndarray
    by_class: np.ndarray
    by_word: np.ndarray
    tree: Tree | None = None
    odds: bool = False

    def __setstate__(self, state: dict) -> None:
        # what a broadcast brings begins anywhere
        self.__dict__.update(state, by_class=_aligned(state["by_class"]), by_word=_aligned(state["by_word"]))


def vocabulary(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, Tree]:
    """(symbol, log p(bucket | symbol), tree) of each bucket, from the counts over the whole corpus, one added to each.

    Below the last class the more frequent words have shorter paths.  Leaf 0 of each symbol is that of the buckets not seen.
    """
    found = np.flatnonzero(counts)
    order = found[np.argsort(-counts[found], kind="stable")]
    rest, blank, size = order[OWN:], max(0, OWN - len(order)), len(counts)
    seen = len(rest)
    most = np.repeat([SLOTS - 1, SLOTS**2 - 1, SLOTS**3 - 1, 0], SLOTS // 4)
    most[most == 0] = -(-max(0, seen - int(most.sum())) // int((most == 0).sum()))
    ends = np.minimum(np.cumsum(most), seen)
    starts = np.concatenate([[0], ends[:-1]])
    slot = np.searchsorted(ends, np.arange(seen), side="right")
    # Of the buckets not seen, the first have what symbols are left, and the others take turns below the last class.
    symbol, total, place = np.empty(size, np.int16), np.zeros(CLASSES * SLOTS), 0
    for at in range(0, size, STRETCH):
        gaps = np.flatnonzero(counts[at : at + STRETCH] == 0)
        rank = np.arange(place, place + len(gaps)) - blank
        symbol[at + gaps] = np.where(rank < 0, OWN + rank, OWN + rank % SLOTS)
        place += len(gaps)
    symbol[order[:OWN]] = np.arange(min(OWN, len(order)))
    symbol[rest] = OWN + slot
    leaf = np.zeros(size, np.int32)
    leaf[rest] = np.arange(seen) - starts[slot] + 1
    del found, order, slot
    for at in range(0, size, STRETCH):
        total += np.bincount(symbol[at : at + STRETCH], counts[at : at + STRETCH] + 1.0, CLASSES * SLOTS)
    log_within = np.empty(size, np.float32)
    for at in range(0, size, STRETCH):
        log_within[at : at + STRETCH] = np.log((counts[at : at + STRETCH] + 1.0) / total[symbol[at : at + STRETCH]])
    unseen = np.bincount(np.arange(max(0, place - blank) % SLOTS), minlength=SLOTS) + max(0, place - blank) // SLOTS
    depth, levels = np.zeros(SLOTS, np.int32), []
    for k in range(SLOTS):
        mass, above = np.concatenate([unseen[k : k + 1], counts[rest[starts[k] : ends[k]]] + 1.0]), []
        while len(mass) > 1:
            mass = np.pad(mass, (0, -len(mass) % SLOTS)).reshape(-1, SLOTS)
            total = mass.sum(axis=1)
            with np.errstate(divide="ignore"):
                above.append(np.log(mass / total[:, None]).astype(np.float32))
            mass = total
        depth[k] = len(above)
        levels.append(above[::-1])
    first, at = np.zeros((SLOTS, max(1, depth.max())), np.int64), 0
    for k, level in enumerate(levels):
        for d, rows in enumerate(level):
            first[k, d], at = at, at + len(rows)
    prior = np.concatenate([np.zeros((0, SLOTS), np.float32), *(rows for level in levels for rows in level)])
    return symbol, log_within, Tree(leaf, depth, first, prior)


def new_model(counts: np.ndarray) -> MaxentModel:
    """A model of weights 0; its rows grow with the distinct words."""
    rows = 1 << max(WORD_ROWS.bit_length() - 1, (-(-int((counts > 0).sum()) // WORDS_PER_ROW) - 1).bit_length())
    symbol, log_within, tree = vocabulary(counts)
    return MaxentModel(symbol, log_within, np.zeros((rows * CLASS_ROWS // WORD_ROWS, CLASSES), np.float32), np.zeros((rows, SLOTS), np.float32), tree)


def contexts(symbols: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """What features are made of: a frequent word's symbol, any other word's bucket."""
    return np.where(symbols < OWN, symbols, (1 << 12) + buckets)


def features(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row per feature of the words before each word, hashed: none, the last, the last two, and, skipping one, the last but one."""
    n = len(symbols)
    place = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    back = []
    for k in (1, 2):
        x = np.zeros(n, np.uint64)
        x[k:] = symbols[:-k] + 1 if n > k else 0
        x[place < k] = 0
        back.append(x)
    a, b = back
    raw = [np.zeros(n, np.uint64), a + np.uint64(1 << 12), (a << np.uint64(12) | b & np.uint64(4095)) + (b >> np.uint64(12)) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(2 << 40), b + np.uint64(3 << 40)]
    return np.stack([(x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20) for x in raw])


def _class_rows(keys: np.ndarray, n: int) -> np.ndarray:
    return (keys & np.uint64(n - 1)).astype(np.intp)


def _word_rows(keys: np.ndarray, nodes: np.ndarray, n: int) -> np.ndarray:
    g = ((keys * np.uint64(0xC2B2AE3D27D4EB4F) + nodes.astype(np.uint64) * np.uint64(0x165667B19E3779F9)) >> np.uint64(40)) & np.uint64(n - 1)
    return g.astype(np.intp)


def _aligned(table: np.ndarray) -> np.ndarray:
    """A copy whose rows of 128 bytes begin where a line of the cache does: reading one takes two lines and not three."""
    room = np.empty(table.nbytes + 128, np.uint8)
    out = room[-room.ctypes.data % 128 :][: table.nbytes].view(table.dtype).reshape(table.shape)
    out[...] = table
    return out


def _choices(tree: Tree | None, symbols: np.ndarray, buckets: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray] | None]:
    """(place, node, branch taken, (log priors by node of the tree, that node of each) or None) of every choice below the classes.

    The first len(symbols) are the slots, whose nodes are the classes and which have no prior; those in the tree follow.
    """
    symbols = symbols.astype(np.int64)
    place, node, taken = [np.arange(len(symbols))], [symbols >> DIGIT], [symbols & SLOTS - 1]
    if tree is not None and buckets is not None:
        rare = np.flatnonzero(symbols >= OWN)
        slot, leaf = taken[0].take(rare), tree.leaf.take(buckets.take(rare)).astype(np.int64)
        left = tree.depth.take(slot).astype(np.int64)
        for k in range(int(tree.depth.max())):
            deep = np.flatnonzero(left > 0)
            rare, slot, leaf, left = rare.take(deep), slot.take(deep), leaf.take(deep), left.take(deep) - 1
            place.append(rare)
            node.append(CLASSES + tree.first[:, k].take(slot) + (leaf >> DIGIT * (left + 1)))
            taken.append(leaf >> DIGIT * left & SLOTS - 1)
    place, node, taken = np.concatenate(place), np.concatenate(node), np.concatenate(taken)
    tail = node[len(symbols) :] - CLASSES
    return place, node, taken, (tree.log_prior, tail) if len(tail) else None


def _scores(table: np.ndarray, rows: np.ndarray, prior: tuple[np.ndarray, np.ndarray] | None, joined: np.ufunc = np.add, chunk: int = 4096) -> Iterator[tuple[int, np.ndarray]]:
    """(begin, scores) of the choices, their rows joined in chunks that are used again.  The last choices have the priors."""
    n, width = rows.shape[1], table.shape[1]
    room, more = (np.empty((min(chunk, n), width), np.float32) for _ in range(2))
    begin, same = n - (0 if prior is None else len(prior[1])), bool((rows[0] == rows[0, 0]).all()) if n else False
    for at in range(0, n, chunk):
        score = room[: min(chunk, n - at)]
        table.take(rows[int(same), at : at + chunk], 0, score, "clip")
        if same:
            joined(score, table[rows[0, 0]], out=score)
        for r in rows[1 + same :]:
            joined(score, table.take(r[at : at + chunk], 0, more[: len(score)], "clip"), out=score)
        if prior is not None and at + len(score) > begin:
            k = max(at, begin)
            joined(score[k - at :], prior[0].take(prior[1][k - begin : at + len(score) - begin], 0, more[k - at : len(score)], "clip"), out=score[k - at :])
        yield at, score


def _exp(score: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exponentials, their sums) of each row, as `out`.  Rows of very large or small sums have their largest score taken off, in `score` too."""
    ones = np.ones(score.shape[1], np.float32)
    with np.errstate(over="ignore"):
        total = np.exp(score, out=out) @ ones
    far = np.flatnonzero(~((total > 1e-20) & (total < 1e20)))
    if len(far):
        score[far] -= score[far].max(axis=1, keepdims=True)
        out[far] = np.exp(score[far])
        total[far] = out[far] @ ones
    return out, total


def _softmax(table: np.ndarray, rows: np.ndarray, prior: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Probabilities of the choices at each position."""
    out = np.empty((rows.shape[1], table.shape[1]), np.float32)
    for at, score in _scores(table, rows, prior):
        p, total = _exp(score, out[at : at + len(score)])
        p *= (1 / total)[:, None]
    return out


def _log_p(table: np.ndarray, rows: np.ndarray, taken: np.ndarray, prior: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Log-probability of the choice taken at each position, as float64."""
    out, room = np.empty(rows.shape[1]), None
    for at, score in _scores(table, rows, prior):
        room = np.empty_like(score) if room is None else room[: len(score)]
        _, total = _exp(score, room)
        own = score[np.arange(len(score)), taken[at : at + len(score)]]
        out[at : at + len(score)] = own.astype(np.float64) - np.log(total.astype(np.float64))
    return out


def as_odds(model: MaxentModel, in_place: bool = False, most: float = 20.0) -> MaxentModel:
    """The model with the exponentials of its weights and priors, whose products are the scores: then scoring takes no exponentials.

    A model with a weight over `most` either way is given back as it is: a product of some of four such weights might leave what
    a float holds.  In place, the given model is used up.
    """
    if model.odds or not all(-most <= t.min() and t.max() <= most for t in (model.by_class, model.by_word)):
        return model
    by_class, by_word = (np.exp(t, out=t if in_place else None) for t in (model.by_class, model.by_word))
    tree = model.tree and replace(model.tree, log_prior=np.exp(model.tree.log_prior, out=model.tree.log_prior if in_place else None))
    return MaxentModel(model.symbol, model.log_within, by_class, by_word, tree, True)


def _log_p_by_odds(table: np.ndarray, rows: np.ndarray, taken: np.ndarray, prior: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """As `_log_p`, of a model as odds.  Products that are almost 0 are made again from logarithms."""
    out, ones = np.empty(rows.shape[1]), np.ones(table.shape[1], np.float32)
    begin = len(out) - (0 if prior is None else len(prior[1]))
    for at, score in _scores(table, rows, prior, np.multiply):
        n = np.arange(len(score))
        total, own = score @ ones, score[n, taken[at : at + len(score)]]
        far = at + np.flatnonzero(own < 1e-30)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[at : at + len(score)] = np.log(own.astype(np.float64) / total)
            if len(far):
                z = sum(np.log(table[r[far]].astype(np.float64)) for r in rows)
                if prior is not None:
                    z[far >= begin] += np.log(prior[0][prior[1][far[far >= begin] - begin]].astype(np.float64))
                z -= z.max(axis=1, keepdims=True)
                out[far] = z[np.arange(len(far)), taken[far]] - np.log(np.exp(z).sum(axis=1))
    return out


def _step(table: np.ndarray, squares: np.ndarray, touched: np.ndarray, rows: np.ndarray, p: np.ndarray, gold: np.ndarray, rate: float) -> None:
    """AdaGrad by row on one batch: the gradient of a row is the sum of p - 1[gold] over the positions that use it.

    Most rows are used by one position, whose p is taken as it is.
    """
    p.reshape(-1)[np.arange(len(gold)) * p.shape[1] + gold] -= 1
    lengths = np.einsum("ij,ij->i", p, p)
    for r in rows:
        if r[0] == r[-1] and (r == r[0]).all():
            g = p.sum(axis=0, keepdims=True)
            _descend(table, squares, r[:1], g, np.einsum("ij,ij->i", g, g), rate)
            touched[r[0]] += len(r)
            continue
        order, at, first, n = _by_row(r)
        touched[at] += n.astype(touched.dtype)
        alone, several = np.flatnonzero(n == 1), np.flatnonzero(n > 1)
        own = order.take(first.take(alone))
        _descend(table, squares, at.take(alone), p, lengths.take(own), rate, own)
        if len(several):
            ranked, g = _sums(order, first.take(several), n.take(several), p)
            _descend(table, squares, at.take(several.take(ranked)), g, np.einsum("ij,ij->i", g, g), rate)


def _descend(table: np.ndarray, squares: np.ndarray, at: np.ndarray, g: np.ndarray, lengths: np.ndarray, rate: float, own: np.ndarray | None = None, chunk: int = 4096) -> None:
    """One step of the rows `at`, all distinct, by gradients g (by g[own] if given) of these squared lengths, in chunks that are used again."""
    now = squares.take(at) + lengths
    squares[at] = now
    scale = (rate / np.sqrt(now + 1e-6))[:, None]
    whole = np.dtype((np.void, table.shape[1] * table.itemsize))  # a row is copied at once
    lines, room = table.view(whole)[:, 0], np.empty((2, min(chunk, len(at)), table.shape[1]), table.dtype)
    for k in range(0, len(at), chunk):
        rows = at[k : k + chunk]
        held, change = room[:, : len(rows)]
        np.multiply(g[k : k + chunk] if own is None else g.take(own[k : k + chunk], 0, change, "clip"), scale[k : k + chunk], out=change)
        table.take(rows, 0, held, "clip")
        held -= change
        lines[rows] = held.view(whole)[:, 0]


def _by_row(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(positions ordered by row, distinct rows, where each one's positions begin in that order, how many they are)."""
    bits = len(r).bit_length()
    key = np.sort(r.astype(np.int64) << bits | np.arange(len(r)))  # numbers are sorted faster than they are ranked
    order, key = key & (1 << bits) - 1, key >> bits
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return order, key.take(first), first, np.diff(np.append(first, len(r)))


def _sums(order: np.ndarray, first: np.ndarray, n: np.ndarray, p: np.ndarray, few: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """(ranked, sums of p in that order) of groups of positions, those of more positions first as far as 64.

    The k-th positions of all groups that have so many are added at once; when few groups are left, each of them is summed.
    """
    capped = np.minimum(n, 64)
    most = np.argsort((64 - capped).astype(np.uint8), kind="stable")
    first, n = first[most], n[most]
    total = p.take(order[first], 0, None, "clip")
    having = len(n) - np.cumsum(np.bincount(capped))  # groups of more than k positions
    k, room = 1, np.empty((having[1], p.shape[1]), p.dtype)
    while having[k] > few and k < 63:
        m = having[k]
        total[:m] += p.take(order[first[:m] + k], 0, room[:m], "clip")
        k += 1
    ones = np.ones(int(n.max()), p.dtype)
    for g in range(int((n > k).sum())):
        held = p.take(order[first[g] + k : first[g] + n[g]], 0, None, "clip")
        total[g] += ones[: len(held)] @ held
    return most, total


def _sum_by_row(r: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows, positions of each, sums of their p), rows of more positions first as far as 64."""
    order, at, first, n = _by_row(r)
    ranked, total = _sums(order, first, n, p)
    return at[ranked], n[ranked], total


def symbol_batches(texts: pa.Array, model: MaxentModel) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, buckets, symbols, offsets) by block of rows."""
    for i, j, words, offsets in word_hashes(texts):
        bucket = (words >> np.uint64(65 - len(model.symbol).bit_length())).astype(np.int64)
        yield i, j, bucket, model.symbol[bucket], offsets


class Trainer:
    """Gradient steps on the documents of one task, from the model that all tasks begin with."""

    def __init__(self, model: MaxentModel, rate: float = RATE):
        self.start, self.rate = model, rate
        self.tables = [_aligned(model.by_class), _aligned(model.by_word)]
        self.squares = [np.zeros(len(t), np.float32) for t in self.tables]
        self.touched = [np.zeros(len(t), np.float32) for t in self.tables]

    def learn(self, symbols: np.ndarray, offsets: np.ndarray, buckets: np.ndarray | None = None) -> None:
        keys = features(symbols if buckets is None else contexts(symbols, buckets), offsets)
        for at in range(0, len(symbols), BATCH):
            s = slice(at, at + BATCH)
            k, f = keys[:, s], _class_rows(keys[:, s], len(self.tables[0]))
            place, node, taken, prior = _choices(self.start.tree, symbols[s], None if buckets is None else buckets[s])
            g = _word_rows(k.take(place, 1), node, len(self.tables[1]))
            _step(self.tables[0], self.squares[0], self.touched[0], f, _softmax(self.tables[0], f), symbols[s] // SLOTS, self.rate)
            _step(self.tables[1], self.squares[1], self.touched[1], g, _softmax(self.tables[1], g, prior), taken, self.rate)

    def updates(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(block, counts, changes times counts) for the blocks of rows that the task touched."""
        for k, (table, begun) in enumerate(zip(self.tables, (self.start.by_class, self.start.by_word))):
            for b in range(0, len(table), ROWS_PER_BLOCK):
                n = self.touched[k][b : b + ROWS_PER_BLOCK]
                if n.any():
                    change = (table[b : b + ROWS_PER_BLOCK] - begun[b : b + ROWS_PER_BLOCK]) * n[:, None]
                    yield (k * (len(self.tables[0]) // ROWS_PER_BLOCK) + b // ROWS_PER_BLOCK, n.tobytes(), change.tobytes())


def score(symbols: np.ndarray, buckets: np.ndarray, offsets: np.ndarray, model: MaxentModel) -> np.ndarray:
    """Natural log-probability of each word."""
    log_p_of, as_log = (_log_p_by_odds, np.log) if model.odds else (_log_p, np.asarray)
    keys, out = features(contexts(symbols, buckets), offsets), model.log_within[buckets].astype(np.float64)
    for at in range(0, len(symbols), BATCH):
        s = slice(at, at + BATCH)
        k, f = keys[:, s], _class_rows(keys[:, s], len(model.by_class))
        place, node, taken, prior = _choices(model.tree, symbols[s], buckets[s])
        n, log_p = f.shape[1], log_p_of(model.by_word, _word_rows(k.take(place, 1), node, len(model.by_word)), taken, prior)
        if prior is not None:
            log_p[n:] -= as_log(prior[0][prior[1], taken[n:]])
        out[s] += log_p_of(model.by_class, f, symbols[s] // SLOTS) + np.bincount(place, log_p, n)
    return out


def _more_than_one(n: np.ndarray, squares: np.ndarray, settled: float = SETTLED) -> np.ndarray:
    """By how much the tasks' changes of a row together exceed their mean.

    Of a row that tasks used much, each comes to the same place.  One used little is still on its way: with AdaGrad, k tasks
    together go the square root of k times as far as one.  n: uses of each row by all tasks; squares: of the uses by task.
    """
    tasks = n * n / np.maximum(squares, 1)
    return tasks ** (0.5 / (1 + n / np.maximum(tasks, 1) / settled))


def _counted(seen: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """(word, n) of distinct words from the counts of several blocks."""
    words, at = np.unique(np.concatenate([w for w, _ in seen]), return_inverse=True)
    n = np.bincount(at, np.concatenate([c for _, c in seen]), len(words)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])


def fit(docs: DataFrame, text_col: str = "text", epochs: int = EPOCHS, rate: float = RATE) -> MaxentModel:
    """Train on every text.  Word counts are those of the whole corpus, and the model's sizes follow from them.

    An epoch has ROUNDS rounds, each over another part of the texts.  In a round each task takes gradient steps over its texts
    and sends the changes of the rows that it touched; the mean of each row's changes, weighted by how often tasks used the
    row, and the more raised the less they did, is added to the model that the next round begins with.  Tasks are few enough that a round sends about 2 bytes for each
    word of the corpus.  The counts of the distinct words and the model are collected and broadcast.  Null and empty texts
    add nothing.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col)).where(F.col(text_col).isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = [], 0
        for batch in batches:
            for _, _, words, _ in word_hashes(batch.column(0)):
                seen.append(np.unique(words, return_counts=True))
                held += len(seen[-1][0])
                if held > 1 << 21:
                    yield _counted(seen)
                    seen, held = [], 0
        if seen:
            yield _counted(seen)

    rows = texts.mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    bits = max(WORD_BITS, (2 * len(rows) - 1).bit_length())
    counts, found = np.zeros(1 << bits, np.int64), len(rows)
    for batch in rows.to_batches():
        np.add.at(counts, (batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64), batch.column(1).to_numpy())
    del rows
    model = new_model(counts)
    size = 4 * (model.by_class.size + model.by_word.size + len(model.by_class) + len(model.by_word))
    parallel = spark.sparkContext.defaultParallelism
    tasks = parallel * max(1, int(2 * counts.sum() / size / parallel))
    del counts
    words = spark.sparkContext.broadcast((model.symbol, model.tree))
    for k in range(epochs * ROUNDS if found else 0):
        shared = spark.sparkContext.broadcast((model.by_class, model.by_word))
        part = texts.where(F.pmod(F.xxhash64(text_col), F.lit(ROUNDS)) == k % ROUNDS).coalesce(tasks)

        def train(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            symbol, tree = words.value
            trainer = Trainer(MaxentModel(symbol, np.zeros(0, np.float32), *shared.value, tree), rate)  # log_within is for scores alone
            for batch in batches:
                for _, _, buckets, symbols, offsets in symbol_batches(batch.column(0), trainer.start):
                    trainer.learn(symbols, offsets, buckets)
            for part in trainer.updates():
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in part], ["block", "n", "change"])

        def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                for block, n, change in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    n, change = np.frombuffer(n, np.float32).astype(np.float64), np.frombuffer(change, np.float32).astype(np.float64)
                    if block in sums:
                        for held, more in zip(sums[block], (n, change, n * n)):
                            held += more
                    else:
                        sums[block] = [n, change, n * n]
            for block, (n, change, squares) in sums.items():
                step = change.reshape(len(n), -1) * (_more_than_one(n, squares) / np.maximum(n, 1))[:, None]
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([step.astype(np.float32).tobytes()])], ["block", "change"])

        updates = part.mapInArrow(train, "block bigint, n binary, change binary")
        merged = updates.repartition("block").mapInArrow(mean, "block bigint, change binary").toArrow()
        shared.destroy()
        first = len(model.by_class) // ROWS_PER_BLOCK
        for batch in merged.to_batches():
            for block, change in zip(batch.column(0).to_pylist(), batch.column(1)):
                table, b = (model.by_class, block) if block < first else (model.by_word, block - first)
                table[b * ROWS_PER_BLOCK : (b + 1) * ROWS_PER_BLOCK] += np.frombuffer(change.as_buffer(), np.float32).reshape(ROWS_PER_BLOCK, -1)
        del merged
    words.destroy()
    return model


def score_documents(docs: DataFrame, model: MaxentModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, log_prob, perplexity) of every row, the last two rounded to 4 places.

    The model is trained on the texts themselves if none is given.  Texts without words have a log_prob of 0 and a null
    perplexity; null texts have nulls.  Rows keep null and repeated ids; other columns are left out; an empty table gives no rows.
    Whole texts are scored, however long.
    """
    shared = docs.sparkSession.sparkContext.broadcast(as_odds(fit(docs, text_col), in_place=True) if model is None else as_odds(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            n, log_p = [np.zeros(0, np.int64)], [np.zeros(0)]
            for _, _, buckets, symbols, offsets in symbol_batches(batch.column(1), model):
                n.append(np.diff(offsets))
                log_p.append(segment_sum(score(symbols, buckets, offsets, model), offsets))
            n, log_p = np.concatenate(n), np.concatenate(log_p)
            null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            each = np.round(np.exp(-log_p / np.maximum(n, 1)), 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, mask=null), pa.array(np.round(log_p, 4), mask=null), pa.array(each, mask=null | (n == 0))], ["doc_id", "n_words", "log_prob", "perplexity"])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, "doc_id bigint, n_words bigint, log_prob double, perplexity double")
