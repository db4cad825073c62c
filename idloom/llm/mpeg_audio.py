"""MPEG audio in media columns: frames found again after damage, tags, variable-bitrate tables, checksums, durations, offsets."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 25: (11025, 12000, 8000)}
_KBPS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_KBPS[2, 3] = _KBPS[2, 2]
_TAGS = {b"TIT2": "title", b"TPE1": "artist", b"TALB": "album", b"TT2": "title", b"TP1": "artist", b"TAL": "album"}


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    kbps: int
    rate: int
    padding: int
    mode: int
    extension: int

    @property
    def channels(self) -> int:
        return 1 if self.mode == 3 else 2

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 576 if self.layer == 3 and self.version != 1 else 1152

    def size(self, free: int = 0) -> int:
        """Bytes of the frame; a free-format frame has `free` bytes before padding."""
        slot = 4 if self.layer == 1 else 1
        if not self.kbps:
            return free + self.padding * slot if free else 0
        return (self.samples // 8 // slot * self.kbps * 1000 // self.rate + self.padding) * slot

    def like(self, other: Header) -> bool:
        """Frames of one stream agree in these; all else may change from frame to frame."""
        return (self.version, self.layer, self.rate, self.channels, not self.kbps) == (other.version, other.layer, other.rate, other.channels, not other.kbps)


_headers: dict[int, Header | None] = {}


def header(data: bytes, at: int) -> Header | None:
    """The frame header at that place, or None if there is none."""
    if at < 0 or at + 4 > len(data) or data[at] != 255 or data[at + 1] < 224:
        return None
    key = int.from_bytes(data[at + 1 : at + 4])
    if key not in _headers:
        _headers[key] = _header(*key.to_bytes(3))
    return _headers[key]


def _header(b: int, c: int, d: int) -> Header | None:
    version, layer = (25, 0, 2, 1)[b >> 3 & 3], (0, 3, 2, 1)[b >> 1 & 3]
    if not version or not layer or c >> 4 == 15 or c >> 2 & 3 == 3 or d & 3 == 2:
        return None
    return Header(version, layer, not b & 1, _KBPS[1 if version == 1 else 2, layer][c >> 4], _RATES[version][c >> 2 & 3], c >> 1 & 1, d >> 6, d >> 4 & 3)


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
        table.append(crc)
    return table


_CRC = _crc_table()


def crc16(data: bytes, bits: int | None = None, crc: int = 0xFFFF) -> int:
    """CRC with polynomial 0x8005 over the first `bits` bits, all by default."""
    bits = 8 * len(data) if bits is None else bits
    for byte in data[: bits // 8]:
        crc = (crc << 8 & 0xFFFF) ^ _CRC[crc >> 8 ^ byte]
    for k in range(bits % 8):
        top = (crc >> 15) ^ (data[bits // 8] >> (7 - k) & 1)
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return crc


def side_bytes(h: Header) -> int:
    """Bytes of side information of a layer III frame."""
    return (17 if h.channels == 1 else 32) if h.version == 1 else (9 if h.channels == 1 else 17)


def _allocation(h: Header) -> list[int]:
    """Layer II: bits of the allocation field of each subband."""
    if h.version != 1:
        return [4] * 4 + [3] * 7 + [2] * 19
    each = h.kbps // h.channels
    if h.kbps and each <= 48:
        return [4] * 2 + [3] * (10 if h.rate == 32000 else 6)
    if each <= 80 and h.kbps or h.rate == 48000:
        return [4] * 11 + [3] * 12 + [2] * 4
    return [4] * 11 + [3] * 12 + [2] * 7


def protected_bits(h: Header, body: bytes) -> int:
    """How many bits after the checksum it covers, besides the last two bytes of the header."""
    if h.layer == 3:
        return 8 * side_bytes(h)
    limit = 4 * (h.extension + 1) if h.mode == 1 else 32
    if h.layer == 1:
        joint = min(limit, 32)
        return 4 * (32 if h.channels == 1 else 2 * joint + 32 - joint)
    at = selected = 0
    value = int.from_bytes(body[:64].ljust(64, b"\0"))
    for band, width in enumerate(_allocation(h)):
        shared = h.channels == 2 and band >= limit
        for _ in range(1 if h.channels == 1 or shared else 2):
            if value >> (512 - at - width) & ((1 << width) - 1):
                selected += 2 * (2 if shared else 1)
            at += width
    return at + selected


def checksum_holds(data: bytes, at: int, h: Header) -> bool:
    """Whether the checksum of a protected frame is right."""
    body = data[at + 6 : at + 6 + 260]
    bits = protected_bits(h, body)
    if 8 * len(body) < bits:
        return False
    return crc16(body, bits, crc16(data[at + 2 : at + 4])) == int.from_bytes(data[at + 4 : at + 6])


def _syncsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def _text(raw: bytes) -> str:
    if not raw:
        return ""
    how = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0], "latin-1")
    try:
        return raw[1:].decode(how, "replace").split("\0")[0]
    except UnicodeError:
        return raw[1:].decode("latin-1").split("\0")[0]


def read_id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Read a tag that begins there into `tags`, unless they have the name already; returns where it ends, or `at`."""
    if data[at : at + 3] != b"ID3" or at + 10 > len(data) or data[at + 3] == 255 or any(b > 127 for b in data[at + 6 : at + 10]):
        return at
    major, flags, size = data[at + 3], data[at + 5], _syncsafe(data[at + 6 : at + 10])
    end = at + 10 + size + (10 if flags & 16 else 0)
    body = data[at + 10 : at + 10 + size]
    if flags & 128 and major < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    k = 0
    if flags & 64 and major > 2 and len(body) >= 4:
        k = _syncsafe(body[:4]) if major == 4 else 4 + int.from_bytes(body[:4])
    wide = 10 if major > 2 else 6
    while k + wide <= len(body) and body[k]:
        name = body[k : k + 4] if major > 2 else body[k : k + 3]
        length = _syncsafe(body[k + 4 : k + 8]) if major == 4 else int.from_bytes(body[k + 4 : k + 8] if major > 2 else body[k + 3 : k + 6])
        value = body[k + wide : k + wide + length]
        if major == 4 and body[k + 9] & 2:
            value = value.replace(b"\xff\x00", b"\xff")
        if (to := _TAGS.get(name)) and to not in tags:
            tags[to] = _text(value)
        k += wide + length
    return min(end, len(data))


@dataclass
class Audio:
    version: int | None = None
    layer: int | None = None
    sample_rate: int | None = None
    channels: int | None = None
    samples: int = 0
    playable_samples: int = 0
    frames: list[int] = field(default_factory=list)
    min_kbps: int | None = None
    max_kbps: int | None = None
    checked: int = 0
    wrong: int = 0
    resyncs: int = 0
    junk_bytes: int = 0
    truncated: bool = False
    table: str | None = None
    declared_frames: int | None = None
    declared_bytes: int | None = None
    toc: list[int] | None = None
    tags: dict[str, str] = field(default_factory=dict)


def _free_size(data: bytes, at: int, h: Header, end: int) -> int:
    """Bytes of a free-format frame before padding: up to the next header of the same stream."""
    nxt = at + 24
    while (nxt := data.find(b"\xff", nxt, end)) >= 0:
        other = header(data, nxt)
        if other and h.like(other):
            return nxt - at - h.padding * (4 if h.layer == 1 else 1)
        nxt += 1
    return 0


def _starts(data: bytes, at: int, end: int, stream: Header | None, lost: bool) -> tuple[Header, int] | None:
    """(header, free size) if a frame begins there.  Unless the last frame ended there, another of its stream, or the end, must follow."""
    h = header(data, at)
    if h is None or stream is not None and not h.like(stream):
        return None
    free = 0 if h.kbps else _free_size(data, at, h, end)
    size = h.size(free)
    if not size:
        return None
    if stream is not None and not lost:
        return h, free
    if at + size >= end:
        # The last frame: whole, or cut off within a stream that is known.
        return (h, free) if at + size == end or stream is not None else None
    follows = header(data, at + size)
    return (h, free) if follows and h.like(follows) or data[at + size : at + size + 3] in (b"ID3", b"TAG") else None


def vbr_table(data: bytes, at: int, h: Header, out: Audio) -> tuple[int, int] | None:
    """Read a Xing, Info or VBRI table in the first frame; returns the encoder's (delay, padding), or None if there is none."""
    if h.layer != 3:
        return None
    k = at + 4 + side_bytes(h) + (2 if h.protected else 0)
    for place in {k, at + 4 + side_bytes(h)}:
        name = data[place : place + 4]
        if name in (b"Xing", b"Info") and place + 8 <= len(data):
            flags, k = int.from_bytes(data[place + 4 : place + 8]), place + 8
            out.table = name.decode()
            if flags & 1:
                out.declared_frames, k = int.from_bytes(data[k : k + 4]), k + 4
            if flags & 2:
                out.declared_bytes, k = int.from_bytes(data[k : k + 4]), k + 4
            if flags & 4:
                out.toc, k = list(data[k : k + 100]), k + 100
            if flags & 8:
                k += 4
            three = data[k + 21 : k + 24]
            if len(three) == 3 and data[k : k + 4] in (b"LAME", b"Lavf", b"Lavc"):
                both = int.from_bytes(three)
                return both >> 12, both & 4095
            return 0, 0
    place = at + 36
    if data[place : place + 4] == b"VBRI" and place + 26 <= len(data):
        out.table = "VBRI"
        out.declared_bytes, out.declared_frames, entries, scale, width, _ = struct.unpack_from(">IIHHHH", data, place + 10)
        toc = data[place + 26 : place + 26 + entries * width]
        out.toc = [int.from_bytes(toc[i : i + width]) * scale for i in range(0, len(toc), width)] if width in (1, 2, 3, 4) else None
        return 0, 0
    return None


def parse(data: bytes) -> Audio:
    """All of a stream.  The duration is exact: samples of the frames found, over the sample rate of the first."""
    out, end, at = Audio(), len(data), 0
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
    if end >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size = int.from_bytes(data[end - 20 : end - 16], "little") + (32 if data[end - 9] & 128 else 0)
        end = max(0, end - size)
    stream, edges, lost, count = None, None, False, 0
    while at < end:
        after = read_id3v2(data, at, out.tags)
        if after != at:
            at = after
            continue
        found = _starts(data, at, end, stream, lost)
        if found is None:
            if not lost:
                out.resyncs += count > 0
                lost = True
            nxt = data.find(b"\xff", at + 1, end)
            tag = data.find(b"ID3", at + 1, end if nxt < 0 else nxt)
            nxt = min(x for x in (nxt, tag, end) if x >= 0)
            out.junk_bytes += nxt - at
            at = nxt
            continue
        lost = False
        h, free = found
        size = h.size(free)
        if at + size > end:
            out.truncated = True
            out.junk_bytes += end - at
            break
        if h.protected:
            out.checked += 1
            out.wrong += not checksum_holds(data, at, h)
        if stream is None:
            stream = h
            out.version, out.layer, out.sample_rate, out.channels = h.version, h.layer, h.rate, h.channels
            edges = vbr_table(data, at, h, out)
            if edges is not None:
                at += size
                count += 1
                continue
        out.frames.append(at)
        out.samples += h.samples
        kbps = h.kbps or size * 8 * h.rate // (h.samples * 1000)
        out.min_kbps = kbps if out.min_kbps is None else min(out.min_kbps, kbps)
        out.max_kbps = kbps if out.max_kbps is None else max(out.max_kbps, kbps)
        at, count = at + size, count + 1
    if data[-128:-125] == b"TAG" and len(data) >= 128:
        for name, a, b in (("title", -125, -95), ("artist", -95, -65), ("album", -65, -35)):
            if name not in out.tags and (value := data[a:b].split(b"\0")[0].decode("latin-1").strip()):
                out.tags[name] = value
    out.playable_samples = max(0, out.samples - sum(edges or (0, 0)))
    return out


RESULT = "id bigint, version double, layer int, sample_rate int, channels int, n_frames bigint, samples bigint, playable_samples bigint, duration double, min_kbps int, max_kbps int, checked bigint, wrong bigint, resyncs bigint, junk_bytes bigint, truncated boolean, vbr_table string, declared_frames bigint, declared_bytes bigint, toc array<int>, title string, artist string, album string, offsets array<bigint>"


def rows_of(keys: list, blobs: Iterator[bytes | None]) -> pa.RecordBatch:
    """A row per blob, of RESULT."""
    rows = []
    for key, blob in zip(keys, blobs):
        a = Audio() if blob is None else parse(blob)
        seconds = a.samples / a.sample_rate if a.sample_rate else None
        known = blob is not None
        rows.append(
            (key, {25: 2.5}.get(a.version, a.version), a.layer, a.sample_rate, a.channels, len(a.frames) if known else None, a.samples if known else None, a.playable_samples if known else None, seconds, a.min_kbps, a.max_kbps)
            + ((a.checked, a.wrong, a.resyncs, a.junk_bytes, a.truncated) if known else (None,) * 5)
            + (a.table, a.declared_frames, a.declared_bytes, a.toc, a.tags.get("title"), a.tags.get("artist"), a.tags.get("album"), np.array(a.frames, np.int64) if known else None)
        )
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}
    names, types = zip(*(x.split() for x in RESULT.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], list(names))


def parse_audio(media: DataFrame, id_col: str = "id", data_col: str = "data") -> DataFrame:
    """A row per row of media: format, exact duration in samples and seconds, checksums, damage, tags, frame seek offsets.

    Null data have nulls, empty data and data without frames no format, 0 frames and all their bytes as junk.  A frame counts
    if it begins where one of its stream ended, or if another of its stream, a tag or the end follows it.  The frame of a variable-bitrate table isn't audio.  Rows keep
    null and repeated ids; other columns are left out.  Data are parsed whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield rows_of(part.column(0).to_pylist(), (x.as_py() for x in part.column(1)))

    return media.select(F.col(id_col).cast("bigint"), F.col(data_col).cast("binary")).mapInArrow(run, RESULT)


def frame_bytes(version: int, layer: int, rate_index: int, kbps_index: int, mode: int, protected: bool, padding: int, payload: bytes) -> bytes:
    """A frame with that payload, cut or filled to its size, and a right checksum."""
    b = 0xE0 | {1: 3, 2: 2, 25: 0}[version] << 3 | {1: 3, 2: 2, 3: 1}[layer] << 1 | (not protected)
    head = bytes([255, b, kbps_index << 4 | rate_index << 2 | padding << 1, mode << 6])
    h = _header(*head[1:])
    room = h.size() - (6 if protected else 4)
    body = payload[:room].ljust(room, b"\0")
    if protected:
        head += crc16(body, protected_bits(h, body), crc16(head[2:4])).to_bytes(2)
    return head + body


def synthetic_stream(key: int, payload: bytes) -> tuple[bytes, dict]:
    """A stream that carries the payload, and what a parser should find; the key decides on format, tags and damage.

    For tests and the query: the tables have no audio.  Payloads must hold no byte 255.
    """
    r = (key & 0xFFFFFFFF) * 0x9E3779B97F4A7C15 >> 8 & 0xFFFFFFFFFFFF
    version, layer = (1, 2, 25)[r % 3], (3, 3, 3, 2, 1)[r // 3 % 5]
    rate, mode, protected, table, vary = r // 16 % 3, (0, 3)[r // 64 % 2], r // 128 % 2 == 0, layer == 3 and r // 256 % 3 == 0, r // 1024 % 2 == 0
    title = f"page {key}"
    tag = b"TIT2" + (len(title) + 1).to_bytes(4) + b"\0\0\3" + title.encode()
    out = [b"ID3\3\0\0" + bytes(len(tag) >> s & 127 for s in (21, 14, 7, 0)) + tag]
    at, frames, junk, resyncs, wrong, samples = len(out[0]), [], 0, 0, 0, 0
    spent = 0
    make = lambda index, body, pad=0: frame_bytes(version, layer, rate, index, mode, protected, pad, body)
    if table:
        h = _header(*make(9, b"")[1:4])
        body = bytes(side_bytes(h)) + b"Xing" + (1).to_bytes(4) + (7).to_bytes(4)
        out.append(make(9, body))
        at += len(out[-1])
    k = 0
    while spent < len(payload) or k < 3:
        if k and k % 97 == 50 and spent < len(payload):
            noise = b"noise\xff\xfb\x90 not a frame"[: 12 + k % 11]
            out.append(noise)
            at, junk, resyncs = at + len(noise), junk + len(noise), resyncs + 1
        frame = make(9 if not vary else 4 + (k * 7 + r) % 9, payload[spent : spent + 2000], k % 2)
        room = len(frame) - (6 if protected else 4)
        spent += room
        if protected and k % 61 == 60:
            frame, wrong = frame[:4] + bytes([frame[4] ^ 1]) + frame[5:], wrong + 1
        frames.append(at)
        samples += _header(*frame[1:4]).samples
        out.append(frame)
        at, k = at + len(frame), k + 1
    h = _header(*out[-1][1:4])
    return b"".join(out), {"frames": frames, "junk_bytes": junk, "resyncs": resyncs, "wrong": wrong, "samples": samples, "sample_rate": h.rate, "layer": layer, "title": title, "checked": (len(frames) + table) * protected}


def page_media(pages: DataFrame, id_col: str = "page_id", data_col: str = "html") -> DataFrame:
    """(id, data): a synthetic stream per page with the page's bytes as payload.  Null pages have null data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys, data = part.column(0), part.column(1).to_pylist()
                made = [None if d is None else synthetic_stream(k or 0, d.encode())[0] for k, d in zip(keys.to_pylist(), data)]
                yield pa.RecordBatch.from_arrays([keys, pa.array(made, pa.binary())], ["id", "data"])

    return pages.select(F.col(id_col).cast("bigint"), F.col(data_col)).mapInArrow(run, "id bigint, data binary")
