"""Token counts under a unigram model by dynamic programming on a trie of the distinct pre-tokens."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idloom.llm.piece_model import BYTE, NORMAL, SPACE, PieceModel

#: Nodes of a trie, and characters of the longest word that goes into it.
NODES, LONG = 800_000, 512


def unigram_scores(model: PieceModel) -> dict[str, float]:
    """Log-probabilities by Zipf's law from the ranks of a published vocabulary; nothing is trained.  Score of a piece: -ln(rank + 2)."""
    plain = [i for i, t in enumerate(model.types) if t == NORMAL and model.scores[i] > -1e8]
    ranked = sorted(plain, key=lambda i: (-model.scores[i], i))
    return {model.pieces[i]: float(-np.log(r + 2)) for r, i in enumerate(ranked)}


class CountingTrie:
    """Each node is a prefix of some pre-token, with the best score of its segmentations and their fewest pieces."""

    def __init__(self, scores: dict[str, float], byte_fallback: bool, nodes: int = NODES):
        self.scores, self.nodes = scores, nodes
        #: Every suffix of a piece, with the score if it is a piece itself: going back stops where no piece can end.
        self.endings: dict[str, float | None] = {p[k:]: None for p in scores for k in range(1, len(p))} | scores
        self.longest = max(map(len, scores), default=0)
        self.unknown = min(scores.values(), default=0.0) - 10.0
        self.byte_fallback = byte_fallback
        self.clear()

    def clear(self) -> None:
        self.edges: dict[int, int] = {}
        self.best, self.count = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def insert(self, word: str) -> int:
        """Follow the prefix that is there, compute the nodes that aren't, and store the word's count.

        Of segmentations of one score that of the fewest pieces counts.  A character that is no piece costs `unknown` and
        counts as its bytes, or as one piece where the vocabulary has no bytes.
        """
        edges, best, count, endings = self.edges, self.best, self.count, self.endings
        node, path = 0, [0]
        for d, c in enumerate(word, 1):
            key = node * 0x110000 + ord(c)
            nxt = edges.get(key)
            if nxt is None:
                nxt = edges[key] = len(best)
                top, least = -1e300, 0
                if endings.get(c) is None:
                    top, least = best[node] + self.unknown, count[node] + (len(c.encode("utf-8", "surrogatepass")) if self.byte_fallback else 1)
                for back in range(d - 1, -1, -1):
                    s = endings.get(word[back:d], 1.0)
                    if s is None:
                        continue
                    if s == 1.0:  # log-probabilities are below 0
                        break
                    at = path[back]
                    s += best[at]
                    if s > top or (s == top and count[at] + 1 < least):
                        top, least = s, count[at] + 1
                best.append(top)
                count.append(least)
            node = nxt
            path.append(node)
        self.terminal[word] = count[node]
        return count[node]

    def count_long(self, word: str) -> int:
        """As insert, of a word that isn't stored: only the prefixes that a piece can still begin at are kept."""
        endings, keep = self.endings, self.longest + 1
        best, count, base = [0.0], [0], 0  # of the prefixes from length `base` on
        for d, c in enumerate(word, 1):
            top, least = -1e300, 0
            if endings.get(c) is None:
                top, least = best[-1] + self.unknown, count[-1] + (len(c.encode("utf-8", "surrogatepass")) if self.byte_fallback else 1)
            for back in range(d - 1, max(base, d - keep) - 1, -1):
                s = endings.get(word[back:d], 1.0)
                if s is None:
                    continue
                if s == 1.0:
                    break
                s += best[back - base]
                if s > top or (s == top and count[back - base] + 1 < least):
                    top, least = s, count[back - base] + 1
            best.append(top)
            count.append(least)
            if len(best) > 1024 + keep:
                del best[:1024], count[:1024]
                base += 1024
        return count[-1]

    def counts(self, words: list[str]) -> int:
        terminal, fresh = self.terminal, set(words).difference(self.terminal)
        if len(self.best) + sum(map(len, fresh)) <= self.nodes:
            for w in fresh:
                self.insert(w)
            return sum([terminal[w] for w in words])
        total = 0
        for w, n in Counter(words).items():
            found = self.terminal.get(w)
            if found is None:
                if len(w) > LONG:
                    found = self.count_long(w)
                else:
                    if len(self.best) + len(w) > self.nodes:  # bounds memory; the counts are the same with an empty trie
                        self.clear()
                    found = self.insert(w)
            total += n * found
        return total


def count_tokens(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) for every row.

    Pre-tokens are the runs between white space, each with the mark of a word's begin.  A text without any, empty or of
    white space, has 0 of both; a null text has nulls.  Rows keep null and repeated ids; other columns are left out; an empty
    table gives no rows.  Texts are counted whole, however long; a word too long for the trie is counted beside it.  No shuffle:
    each task shares the trie among the texts that it reads.
    """
    shared = docs.sparkSession.sparkContext.broadcast((unigram_scores(model), BYTE in model.types))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = CountingTrie(*shared.value)
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1):
                if not text.is_valid:
                    words.append(None)
                    tokens.append(None)
                    continue
                split = text.as_py().split()
                words.append(len(split))
                tokens.append(trie.counts([SPACE + w for w in split]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint")
