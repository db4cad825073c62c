"""SentencePiece encoding whose pieces know the bytes of the source they came from, and decoding."""

from __future__ import annotations

import heapq
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idloom.llm.piece_model import BYTE, CONTROL, NORMAL, SPACE, USER, CharacterMap, PieceModel, character_map, mapped, normalise, squeezed

CACHED, CACHED_CHARS, LONG, NONE = 400_000, 1 << 24, 256, (1 << 31) - 1
_kept: dict[str, PieceEncoder] = {}


class PairMerger:
    """Byte-pair merging of many units in step: in each round every unit joins the neighbours that make its best piece.

    A pair of symbols makes a piece if the piece's two parts are that pair; the first of equal pairs goes first.
    """

    def __init__(self, ids: dict[str, int], rank: dict[str, float]):
        order = sorted(ids, key=lambda p: (rank[p], ids[p]))
        number = dict(ids)
        for c in sorted({c for p in ids for c in p} - ids.keys()):  # characters that only occur within pieces
            number[c] = max(number.values()) + 1
        self.pieces = max(ids.values()) + 1
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, i in number.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        made = [(number[p[:k]], number[p[k:]], i, r) for r, p in enumerate(order) for i in [ids[p]] for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        left, right, piece, at = np.array(made, np.int64).reshape(-1, 4).T
        sort = np.argsort(left << 32 | right, kind="stable")
        self.pairs = np.concatenate([(left << 32 | right)[sort], [np.iinfo(np.int64).max]])
        self.made = np.concatenate([piece[sort], [0]])
        self.order = np.concatenate([at[sort], [0]])

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order and piece of each pair; NONE for those that make no piece."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pairs, key)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.order[at], NONE), self.made[at]

    def merge(self, code: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, tokens by unit) of units given by their characters, at least one each; an id that is no piece stands for its character."""
        symbol, unit = self.of_char[code], np.repeat(np.arange(len(sizes)), sizes)
        order, made = np.full(len(code), NONE, np.int64), np.zeros(len(code), np.int64)
        order[:-1], made[:-1] = self._look_up(symbol[:-1], symbol[1:])
        order[:-1][unit[1:] != unit[:-1]] = NONE
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            starts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            best = np.minimum.reduceat(order << 32 | np.arange(len(order)), starts)
            more = best >> 32 < NONE
            at = best[more] & 0xFFFFFFFF
            symbol[at] = made[at]
            stays = np.repeat(more, np.diff(np.append(starts, len(symbol))))
            done.append((unit[~stays], symbol[~stays]))
            stays[at + 1] = False
            order[at], at = NONE, (np.cumsum(stays) - 1)[at]  # both pairs of the new symbol are looked up below
            symbol, unit, order, made = symbol[stays], unit[stays], order[stays], made[stays]
            for i in (at[at + 1 < len(symbol)], at[at > 0] - 1):
                i = i[unit[i] == unit[i + 1]]
                order[i], made[i] = self._look_up(symbol[i], symbol[i + 1])
        unit, symbol = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64),) * 2
        sort = np.argsort(unit, kind="stable")
        return symbol[sort], np.bincount(unit, minlength=len(sizes))


class PieceEncoder:
    """BPE over a published vocabulary.

    A text is cut before its spaces into units, which neither a rule of the character map nor a piece crosses.  Each distinct
    unit is normalised and encoded once; its ids and the bytes of its source that they stand for are kept and used again.
    """

    def __init__(self, model: PieceModel, cmap: CharacterMap | None = None, squeeze: bool | None = None):
        self.model = model
        self.squeeze = model.squeeze if squeeze is None else squeeze
        self.cmap = character_map(model.charsmap) if cmap is None else cmap
        self.rank = {p: -s for p, s, t in zip(model.pieces, model.scores, model.types) if t in (NORMAL, USER)}
        self.ids = {p: i for i, p in enumerate(model.pieces) if model.types[i] in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(model.pieces) if model.types[i] == BYTE}
        self.user = sorted((p for p, t in zip(model.pieces, model.types) if t == USER), key=lambda p: -len(p))
        #: Pairs of neighbours within pieces: no piece holds any other pair.
        self.pairs = {p[k : k + 2] for p in self.rank for k in range(len(p) - 1)}
        apart = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.rank)
        #: In normalised text, a run of spaces and what follows it.  A piece with a space or line end inside would forbid these cuts.
        self.units = re.compile(rf"[ {SPACE}]*[^ {SPACE}\n]+|\n+|[ {SPACE}]+" if apart else r"(?s).+")
        self.blanks = self.cmap.blanks if self.squeeze else self.cmap.blanks | {SPACE}
        self.strip = "".join(self.blanks)
        quoted = "".join(re.escape(c) for c in sorted(self.blanks))
        self.sources = re.compile(rf"[{quoted}]*[^{quoted}]+|[{quoted}]+" if apart and quoted else r"(?s).+")
        self._forget()
        self.merger = PairMerger(self.ids, self.rank) if apart and not self.user else None
        self.widths = np.array([len(p.replace(SPACE, " ").encode()) for p in model.pieces], np.int64)
        self.surface = [self._bytes_of(i) for i in range(len(model.pieces))]

    def _forget(self) -> None:
        """Empty the table of units: where the tokens of each begin, their ids and ends, and what is known of the unit.

        What is known: bytes of the source, where its first token begins, bytes decoded, whether these are the source's, whether
        it is hard.  A unit is hard if what follows could change it or be changed by it: it is normalised to nothing or ends in
        a space.
        """
        self.later: dict[str, int] = {}
        self.first: dict[str, int] = {}
        self.chars = 0
        self._start, self._ids, self._ends, self._facts = np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros((0, 5), np.int32)

    def _learn(self, units: set[str], first: bool) -> None:
        """Encode units, the first of their texts or later ones, and note their numbers."""
        easy, bodies, leads, rest = [], [], [], []
        plain, strip = self.cmap.plain, self.strip
        for unit in units:
            body = unit.lstrip(strip)
            if self.squeeze and body and len(body) < LONG and SPACE not in body and "\n" not in body and plain(body):
                easy.append(unit)
                bodies.append(body)
                leads.append(unit[: len(unit) - len(body)])
            else:
                rest.append(unit)
        if easy and self.merger:
            rest += self._learn_easy(easy, bodies, leads, first)
        else:
            rest += easy
        if rest:
            table, found = self.first if first else self.later, [self._one(unit, first) for unit in rest]
            for k, unit in enumerate(rest, len(self._facts)):
                table[unit] = k
            self._add([len(ids) for ids, _, _ in found], [i for ids, _, _ in found for i in ids], [e for _, ends, _ in found for e in ends], [facts for _, _, facts in found])
        self.chars += sum(map(len, units))

    def _learn_easy(self, units: list[str], bodies: list[str], leads: list[str], first: bool) -> list[str]:
        """Learn units that no rule changes, all at once.  Returns those that hold a character without a piece."""
        marked = not first or self.model.dummy_prefix  # a later unit begins with a blank
        text = "".join([SPACE + b for b in bodies] if marked else bodies)
        sizes = np.fromiter(map(len, bodies), np.int64, len(bodies)) + marked
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        ids, tokens = self.merger.merge(code, sizes)
        at = np.concatenate([[0], np.cumsum(tokens)])
        odd = np.add.reduceat((ids < 0) | (ids >= self.merger.pieces), at[:-1]) > 0
        bytes_ = np.add.reduceat(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), np.concatenate([[0], np.cumsum(sizes)[:-1]])) - 3 * marked
        lead = np.array([len(x.encode()) for x in leads], np.int64)
        ends = np.cumsum(self.widths[ids])
        ends += np.repeat(lead - marked - np.concatenate([[0], ends])[at[:-1]], tokens)
        same = [x == ("" if first else " ") for x in leads]
        facts = np.stack([bytes_ + lead, lead * first, bytes_ + (not first), same, np.zeros_like(lead)], axis=1)
        keep = np.repeat(~odd, tokens)
        table = self.first if first else self.later
        table.update(zip([u for u, o in zip(units, odd.tolist()) if not o], range(len(self._facts), len(self._facts) + len(units))))
        self._add(tokens[~odd], ids[keep], ends[keep], facts[~odd])
        return [units[k] for k in np.flatnonzero(odd)]

    def _one(self, unit: str, first: bool) -> tuple[list[int], list[int], tuple]:
        """(ids, ends, what is known) of any unit."""
        done, place = mapped(unit, self.cmap)
        hard = not done or done[-1] == 32 or done.endswith(SPACE.encode())
        if self.squeeze and done:
            done, place = squeezed(done, place, first)
        prefix = first and self.model.dummy_prefix
        if prefix and done:
            done, place = b" " + done, np.concatenate([place[:1], place])
        ids, wide = self._encode_normalised(done.decode())
        back, source = b"".join([self.surface[i] for i in ids]), unit.encode()
        if prefix and back[:1] == b" ":
            back = back[1:]
        return ids, place[np.cumsum(wide, dtype=np.int64)].tolist(), (len(source), int(place[0]) if done else 0, len(back), back == source, hard)

    def _add(self, sizes, ids, ends, facts) -> None:
        self._start = np.concatenate([self._start, self._start[-1] + np.cumsum(sizes, dtype=np.int64)])
        self._ids, self._ends = np.concatenate([self._ids, np.asarray(ids, np.int32)]), np.concatenate([self._ends, np.asarray(ends, np.int32)])
        self._facts = np.concatenate([self._facts, np.asarray(facts, np.int32).reshape(-1, 5)])

    def _encode_normalised(self, done: str) -> tuple[list[int], list[int]]:
        units = self.units.findall(done)
        if len(units) == 1:
            return self.encode_unit(units[0])
        ids, wide, seen = [], [], {}
        for u in units:
            if u not in seen:
                seen[u] = self.encode_unit(u)
            ids += seen[u][0]
            wide += seen[u][1]
        return ids, wide

    def _bytes_of(self, i: int) -> bytes:
        kind = self.model.types[i]
        if kind == BYTE:
            return bytes([int(self.model.pieces[i][3:5], 16)])
        if kind == CONTROL:
            return b""
        return " ⁇ ".encode() if i == self.model.unknown else self.model.pieces[i].replace(SPACE, " ").encode()

    def merge(self, symbols: list[str]) -> list[str]:
        """Join the neighbours that make the best piece, the first of equals, until none make one."""
        rank = self.rank
        if len(symbols) < 48:
            none, get = float("inf"), rank.get
            ranks = [get(a + b, none) for a, b in zip(symbols, symbols[1:])]
            while ranks and (best := min(ranks)) != none:
                k = ranks.index(best)
                joined = symbols[k] + symbols[k + 1]
                symbols[k] = joined
                del symbols[k + 1], ranks[k]
                if k:
                    ranks[k - 1] = get(symbols[k - 1] + joined, none)
                if k < len(ranks):
                    ranks[k] = get(joined + symbols[k + 1], none)
            return symbols
        n = len(symbols)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(rank[x], k, x) for k in range(n - 1) if (x := symbols[k] + symbols[k + 1]) in rank]
        heapq.heapify(heap)
        while heap:
            _, k, x = heapq.heappop(heap)
            j = after[k]
            if j < 0 or not symbols[k] or symbols[k] + symbols[j] != x:
                continue
            symbols[k], symbols[j] = x, ""
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for a in (before[k], k):
                if a >= 0 and after[a] >= 0 and (y := symbols[a] + symbols[after[a]]) in rank:
                    heapq.heappush(heap, (rank[y], a, y))
        return [s for s in symbols if s]

    def _pieces(self, symbols: list[str]) -> list[str]:
        """As merge; long units are cut where no piece can cross."""
        if len(symbols) <= LONG:
            return self.merge(symbols)
        out, begin, pairs = [], 0, self.pairs
        for k in range(1, len(symbols) + 1):
            if k == len(symbols) or symbols[k - 1][-1] + symbols[k][0] not in pairs:
                out += self.merge(symbols[begin:k]) if k > begin + 1 else symbols[begin:k]
                begin = k
        return out

    def _symbols(self, marked: str) -> list[str]:
        if not self.user:
            return list(marked)
        return re.findall("|".join([*map(re.escape, self.user), "(?s:.)"]), marked)

    def encode_unit(self, unit: str) -> tuple[list[int], list[int]]:
        """Ids, and the bytes of the normalised text that each id covers.  Bytes of unknown characters have an id each."""
        pieces, ids = self._pieces(self._symbols(unit.replace(" ", SPACE))), self.ids
        if unit.isascii() and all(map(ids.__contains__, pieces)):
            return [ids[p] for p in pieces], [len(p) for p in pieces]
        out, wide, at = [], [], 0
        for piece in pieces:
            part = unit[at : at + len(piece)].encode()
            at += len(piece)
            if piece in ids:
                out.append(ids[piece])
                wide.append(len(part))
            elif self.bytes:
                marked = piece.encode()
                out += [self.bytes[b] for b in marked]
                wide += [1] * len(part) if len(part) == len(marked) else [0] * (len(marked) - 1) + [len(part)]
            elif out and out[-1] == self.model.unknown:
                wide[-1] += len(part)
            else:
                out.append(self.model.unknown)
                wide.append(len(part))
        return out, wide

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(offsets by text, ids, begins, ends, same) of a block of texts.

        Begins and ends are bytes of the source; same tells by text whether decoding gives the source again.
        """
        if len(self._facts) > CACHED or self.chars > CACHED_CHARS:
            self._forget()
        found, tail = [self.sources.findall(text) for text in texts], []
        for units in found:
            tail.append(self.squeeze and bool(units) and units[-1][-1] in self.blanks)
            if tail[-1]:
                units.pop()
        counts, first, later = [len(u) for u in found], self.first, self.later
        if fresh := {u[0] for u in found if u}.difference(first):
            self._learn(fresh, True)
        if fresh := set(chain.from_iterable([u[1:] for u in found])).difference(later):
            self._learn(fresh, False)
        which: list[int] = []
        for units in found:
            if units:
                which.append(first[units[0]])
                which += map(later.__getitem__, units[1:])
        units, by_text = np.asarray(which, np.int64), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        first, sizes = self._start[units], self._start[units + 1] - self._start[units]
        before = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(first - before[:-1], sizes) + np.arange(before[-1])
        offsets, ids, facts = before[by_text], self._ids[at], self._facts[units]
        wide = np.concatenate([[0], np.cumsum(facts[:, 0], dtype=np.int64)])
        ends = self._ends[at] + np.repeat((wide[:-1] - np.repeat(wide[by_text[:-1]], counts)).astype(np.int32), sizes)
        begins = np.concatenate([np.zeros(1, np.int32), ends[:-1]])[: len(ends)]  # a token begins where the last one ends
        full, some = np.array(counts, bool), np.diff(offsets) > 0
        begins[offsets[:-1][some]] = facts[by_text[:-1][full], 1][some[full]]
        decoded, equal, hard, moved = np.diff(np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(np.column_stack([facts[:, 2:], facts[:, 0] != facts[:, 2]]), axis=0)])[by_text], axis=0).T
        same = (equal == counts) & ~np.array(tail, bool)
        again = np.flatnonzero((hard > 0) | ~same & (moved > 0) & (decoded == [len(t.encode()) for t in texts]))
        tokens = np.stack([ids, begins, ends]) if (hard > 0).any() else None
        parts = np.split(tokens, offsets[1:-1], axis=1) if tokens is not None else []
        for k in again.tolist():
            if hard[k]:
                parts[k] = self._whole(texts[k])
            same[k] = self.decode((parts[k][0] if parts else ids[offsets[k] : offsets[k + 1]]).tolist()) == texts[k]
        if parts:
            ids, begins, ends = np.concatenate(parts, axis=1)
            offsets = np.concatenate([[0], np.cumsum([p.shape[1] for p in parts])])
        return offsets, ids, begins, ends, same

    def _whole(self, text: str) -> np.ndarray:
        """Ids, begins and ends of a text with a hard unit, normalised in one piece."""
        done, place = normalise(text, self.cmap, self.model.dummy_prefix, self.squeeze)
        ids, wide = self._encode_normalised(done)
        ends = np.cumsum(wide, dtype=np.int64)
        return np.array([ids, place[ends - wide], place[ends]], np.int32) if ids else np.zeros((3, 0), np.int32)

    def decode(self, ids) -> str:
        """The text of the ids, without the added prefix; bytes that aren't UTF-8 become U+FFFD."""
        surface = self.surface
        data = b"".join([surface[i] for i in ids])
        if self.model.dummy_prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


def kept_encoder(key: str, *how) -> PieceEncoder:
    """One encoder per Python worker and call: a worker that runs several tasks goes on with the units that it knows."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = PieceEncoder(*how)
    return _kept[key]


def published_map(name: str = "nmt_nfkc") -> bytes:
    """The compiled character map of that name which the SentencePiece library carries."""
    import sentencepiece

    return PieceModel.parse(sentencepiece.SentencePieceNormalizer(rule_name=name).serialized_model_proto()).charsmap


def load(path: str) -> PieceModel:
    with open(path, "rb") as f:
        return PieceModel.parse(f.read())


RESULT = "doc_id bigint, ids array<int>, begins array<int>, ends array<int>, round_trip boolean"


def encode_documents(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text", charsmap: bytes | None = None, squeeze: bool | None = None) -> DataFrame:
    """(doc_id, ids, begins, ends, round_trip) for every row: token k stands for the source's bytes from begins[k] to ends[k].

    Each text is normalised by the model's character map, the longest prefix first, or by `charsmap` if given.  A piece from
    within a replacement spans all of what was replaced that begins in it, and may be empty.  round_trip tells whether
    decoding gives the source again; it need not where normalisation changes the text.  Null texts have null arrays, empty
    ones empty arrays.  Rows keep null and repeated ids; other columns are left out; an empty table gives no rows.  Texts are read
    whole, however long.
    """
    key = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast((model, character_map(model.charsmap if charsmap is None else charsmap), squeeze))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_encoder(key, *shared.value)
        for batch in batches:
            texts, size, start = batch.column(1).to_pylist(), 0, 0
            for k in range(len(texts) + 1):
                if k == len(texts) or size > 1 << 20:
                    if k > start:
                        yield one(encoder, batch.column(0).slice(start, k - start), texts[start:k])
                    start, size = k, 0
                if k < len(texts):
                    size += len(texts[k] or "")

    def one(encoder: PieceEncoder, keys: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        offsets, ids, begins, ends, same = encoder.encode([t or "" for t in texts])
        null = np.array([t is None for t in texts])
        at = pa.array(np.append(offsets[:-1], offsets[-1]).astype(np.int32), mask=np.append(null, False))
        lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (ids, begins, ends)]
        return pa.RecordBatch.from_arrays([keys, *lists, pa.array(same, mask=null)], ["doc_id", "ids", "begins", "ends", "round_trip"])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, RESULT)


def decode_documents(encoded: DataFrame, model: PieceModel, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of every row of ids.  Null arrays give null texts; an id outside the vocabulary decodes as unknown."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(shared.value)
        n, unknown = len(encoder.surface), encoder.model.unknown
        for batch in batches:
            out = [None if ids is None else encoder.decode([i if i is not None and 0 <= i < n else unknown for i in ids]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("bigint"), F.col(ids_col).cast("array<int>")).mapInArrow(run, "doc_id bigint, text string")
