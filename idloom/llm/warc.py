"""WARC archives with one Zstandard frame per record and a dictionary, built from the archive's records, in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = 0x184D2A5D
ARCHIVE_BYTES, DICTIONARY_BYTES, LEVEL, DATE, STEP = 16 << 20, 64 << 10, 6, "2024-01-01T00:00:00Z", 16 << 10
RESULT = "page_id bigint, archive string, member int, offset bigint, length bigint, frame binary"


def _uri(url: str | None, page_id: int | None) -> str:
    """The URL with white space and controls percent-encoded; a row without one gets a name by its id."""
    if not url:
        return f"urn:page:{page_id if page_id is not None else 'none'}"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, html: str | bytes | None, date: str = DATE) -> bytes:
    """A resource record.  Equal rows give equal records: the record id derives from the page id, the URI and the block."""
    block = b"" if html is None else html if isinstance(html, bytes) else html.encode("utf-8", "surrogatepass")
    sha, uri = hashlib.sha1(block).digest(), _uri(url, page_id)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {uri} {sha.hex()}")
    lines = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Block-Digest: sha1:{base64.b32encode(sha).decode()}"]
    lines += [f"X-Page-ID: {page_id}"] * (page_id is not None) + ["X-Null-Block: true"] * (html is None)
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def info_record(archive: str, date: str = DATE) -> bytes:
    block = b"format: WARC File Format 1.1\r\nsoftware: idloom\r\n"
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"warcinfo {archive}")
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {date}\r\nWARC-Filename: {archive}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes | None:
    """A dictionary from all the records, or None where they are too few or too short to build one."""
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, records)) // 8)), records, k=256, d=8, f=20, accel=1).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return None


def dictionary_frame(dictionary: bytes) -> bytes:
    """The skippable frame; its content is the dictionary, compressed without one."""
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return MAGIC.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed


def compress_archive(archive: str, records: list[bytes], size: int = DICTIONARY_BYTES, level: int = LEVEL) -> list[bytes]:
    """Frames in the order of the file: the dictionary's (empty if there is none), the warcinfo record's, each record's."""
    dictionary = build_dictionary(records, size)
    if dictionary is None:
        coder = zstandard.ZstdCompressor(level=level, write_checksum=True)
    else:
        data = zstandard.ZstdCompressionDict(dictionary)
        data.precompute_compress(level=level)
        coder = zstandard.ZstdCompressor(level=level, dict_data=data, write_checksum=True)
    return [dictionary_frame(dictionary) if dictionary else b"", *map(coder.compress, [info_record(archive), *records])]


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a file.  Raises ValueError where a record isn't whole or its digest is wrong."""
    at, how = 0, {}
    if int.from_bytes(data[:4], "little") == MAGIC:
        at = 8 + int.from_bytes(data[4:8], "little")
        held = data[8:at]
        if held[:4] == b"\x28\xb5\x2f\xfd":
            held = zstandard.ZstdDecompressor().decompress(held)
        how["dict_data"] = zstandard.ZstdCompressionDict(held)
    coder = zstandard.ZstdDecompressor(**how)
    view = memoryview(data)
    while at < len(data):
        stream, begin, parts = coder.decompressobj(), at, []
        while not stream.eof:
            if at >= len(data):
                raise ValueError(f"the frame at {begin} isn't whole")
            parts.append(stream.decompress(view[at : at + STEP]))
            at += STEP
        at = min(at, len(data)) - len(stream.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block = rest[: int(headers["Content-Length"])]
        if rest[len(block) :] != b"\r\n\r\n":
            raise ValueError("a record has no end")
        if (sha := headers.get("WARC-Block-Digest")) and sha != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
            raise ValueError("a block's digest is wrong")
        yield headers, block


def archive_frames(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES, dictionary_bytes: int = DICTIONARY_BYTES, level: int = LEVEL) -> DataFrame:
    """(page_id, archive, member, offset, length, frame): the frames of one archive in order are the bytes of its file.

    Member 0 is the dictionary's frame, 1 the warcinfo record, and the pages follow.  Every row has a record, repeated rows
    too; a null document has an empty block and a mark, a null URL a name by the id.  Archives hold about `archive_bytes` of
    records, of one input split, so that nothing is shuffled; a longer record is whole.  Where the records are too few for a
    dictionary, member 0 is left out.  Other columns are left out.  An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, made, records, keys, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            name = f"part-{split:06d}-{made:05d}.warc.zst"
            frames = compress_archive(name, records, dictionary_bytes, level)
            rows, at = [], 0
            for k, (key, frame) in enumerate(zip([None, None, *keys], frames)):
                if frame:
                    rows.append((key, name, k, at, len(frame), frame))
                    at += len(frame)
            for k in range(0, len(rows), 1000):
                cols = list(zip(*rows[k : k + 1000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["page_id", "archive", "member", "offset", "length", "frame"])

        for batch in batches:
            for key, url, html in zip(*(batch.column(k) for k in range(3))):
                made_record = record(key.as_py(), url.as_py(), html.as_py())
                if records and size + len(made_record) > archive_bytes:
                    yield from flush()
                    made, records, keys, size = made + 1, [], [], 0
                records.append(made_record)
                keys.append(key.as_py())
                size += len(made_record)
        if records:
            yield from flush()

    return pages.select(F.col(id_col).cast("bigint"), F.col(url_col).cast("string"), F.col(html_col)).mapInArrow(run, RESULT)


def write_archives(frames: DataFrame, folder: str) -> DataFrame:
    """Write each archive of `archive_frames` as a file in a folder that all executors reach; returns (archive, members, bytes).

    A file appears under its name only when it is whole: a task that runs again, after a lost executor, replaces it by the
    same bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        now, out, done = None, None, []

        def close() -> None:
            out.close()
            store.move(f"{root}/.{now}.{token}", f"{root}/{now}")

        token = uuid.uuid4().hex
        for batch in batches:
            for name, frame in zip(batch.column(1).to_pylist(), batch.column(5).to_pylist()):
                if name != now:
                    if out:
                        close()
                    now, out = name, store.open_output_stream(f"{root}/.{name}.{token}")
                    done.append([name, 0, 0])
                out.write(frame)
                done[-1][1] += 1
                done[-1][2] += len(frame)
        if out:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["archive", "members", "bytes"])

    whole = frames.repartition("archive").sortWithinPartitions("archive", "member")
    return whole.mapInArrow(run, "archive string, members bigint, bytes bigint")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, html) of every resource record of the files at `path`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = [(int(h["X-Page-ID"]) if "X-Page-ID" in h else None, h["WARC-Target-URI"], None if "X-Null-Block" in h else block.decode("utf-8", "replace")) for h, block in read_archive(data.as_py()) if h["WARC-Type"] == "resource"]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))], ["page_id", "url", "html"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "page_id bigint, url string, html string")
