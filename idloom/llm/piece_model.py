"""Reader of SentencePiece model files, and normalisation by a compiled character map with source alignment."""

from __future__ import annotations

import functools
import struct
from dataclasses import dataclass, field

import numpy as np

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            width = 4 if kind == 5 else 8
            value, at = data[at : at + width], at + width
        yield key >> 3, value


@dataclass
class PieceModel:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    unknown: int = 0

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        out = cls()
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                out.pieces.append(piece.get(1, b"").decode("utf-8"))
                out.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                out.types.append(piece.get(3, NORMAL))
            elif number == 3:
                out.normaliser(value)
        out.unknown = out.types.index(UNKNOWN) if UNKNOWN in out.types else 0
        return out

    def normaliser(self, spec: bytes) -> None:
        found = dict(_fields(spec))
        self.charsmap, self.dummy_prefix, self.squeeze = found.get(2, b""), bool(found.get(3, 1)), bool(found.get(4, 1))


class CharacterMap:
    """Double-array trie from source strings to replacements; the longest prefix that it holds is replaced at each place."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.rules: dict[str, str] = {}
        if size:
            self._walk(np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64), blob[4 + size :])
        self.longest = max(map(len, self.rules), default=0)
        self.one = one = {k for k in self.rules if len(k) == 1}
        more = [k for k in self.rules if len(k) > 1]
        self.second = {k[1] for k in more}
        inner = {c for k in more for c in k[1:]}
        #: Characters that become spaces alone and that no rule holds after its first one: a text can be cut before them.
        self.blanks = {k for k in one if self.rules[k] and not self.rules[k].strip(" ") and k not in inner} | {" "} - inner

    def _walk(self, units: np.ndarray, texts: bytes) -> None:
        """All keys, by blocks of nodes, the deepest first."""
        every = np.arange(1, 256)
        open_ = [(np.array([(int(units[0]) >> 10) << ((int(units[0]) & 512) >> 6)]), [b""])]
        while open_:
            base, keys = open_.pop()
            if len(base) > 2048:
                open_.append((base[2048:], keys[2048:]))
            child = base[:2048, None] ^ every
            there = (child < len(units)) & ((units[np.minimum(child, len(units) - 1)] & 0x800000FF) == every)
            row, col = np.nonzero(there)
            if not len(row):
                continue
            keys = [keys[r] + bytes([c + 1]) for r, c in zip(row.tolist(), col.tolist())]
            unit = units[child[row, col]]
            base = child[row, col] ^ ((unit >> 10) << ((unit & 512) >> 6))
            ends = np.flatnonzero(unit >> 8 & 1)
            for k, start in zip(ends.tolist(), (units[base[ends]] & 0x7FFFFFFF).tolist()):
                self.rules[keys[k].decode("utf-8", "surrogateescape")] = texts[start : texts.index(b"\0", start)].decode("utf-8")
            open_.append((base, keys))

    def plain(self, text: str) -> bool:
        """True if no rule can apply: the text has neither a character with a rule nor a second one of a longer rule."""
        return self.one.isdisjoint(text) and self.second.isdisjoint(text)

    def apply(self, text: str) -> list[tuple[str, str]]:
        """(source, replacement) of consecutive parts of the text; equal parts are unchanged."""
        out, at, one, second = [], 0, self.one, self.second
        for i in [i for i, (c, d) in enumerate(zip(text, text[1:] + "\0")) if c in one or d in second]:
            if i < at:
                continue
            for k in range(min(self.longest, len(text) - i), 0, -1):
                if (put := self.rules.get(text[i : i + k])) is not None:
                    if i > at:
                        out.append((text[at:i], text[at:i]))
                    out.append((text[i : i + k], put))
                    at = i + k
                    break
        if at < len(text):
            out.append((text[at:], text[at:]))
        return out


def mapped(text: str, cmap: CharacterMap) -> tuple[bytes, np.ndarray]:
    """The text after replacement, spaces not yet squeezed, and for each of its bytes, and its end, the byte of the source."""
    if cmap.plain(text):
        done = text.encode()
        return done, np.arange(len(done) + 1)
    parts, sources, at = [], [], 0
    for source, put in cmap.apply(text):
        width, made = len(source.encode()), put.encode()
        parts.append(made)
        sources.append(np.arange(at, at + width) if source == put else np.full(len(made), at))
        at += width
    return b"".join(parts), np.concatenate([*sources, [at]]).astype(np.int64)


def squeezed(done: bytes, place: np.ndarray, begins: bool) -> tuple[bytes, np.ndarray]:
    """Runs of spaces become their first one.  Those at the end go, and those at the begin if the text begins here."""
    if b"  " not in done and done[:1] != b" " and done[-1:] != b" ":
        return done, place
    raw = np.frombuffer(done, np.uint8)
    blank = raw == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[0] |= not begins
    keep[0] &= not (begins and blank[0])
    if (held := np.flatnonzero(keep)).size and blank[held[-1]]:
        keep[held[-1]] = False
        end = place[held[-1]]
    else:
        end = place[held[-1] + 1] if held.size else place[-1]
    return raw[keep].tobytes(), np.append(place[:-1][keep], end)


def normalise(text: str, cmap: CharacterMap, dummy_prefix: bool, squeeze: bool) -> tuple[str, np.ndarray]:
    """The normalised text, spaces not yet marked, and for each of its bytes, and its end, the byte of the source it stems from.

    All bytes of a replacement point to the begin of what was replaced.  With `squeeze`, spaces at both ends go and runs of
    them become one.  The added prefix points to the begin of the text that is left.
    """
    done, place = mapped(text, cmap)
    if squeeze:
        done, place = squeezed(done, place, True)
    if dummy_prefix and done:
        done, place = b" " + done, np.concatenate([place[:1], place])
    return done.decode(), place


@functools.lru_cache(maxsize=2)
def character_map(blob: bytes) -> CharacterMap:
    """The map of a compiled blob; reading one with 200,000 rules takes seconds, so it is kept."""
    return CharacterMap(blob)
