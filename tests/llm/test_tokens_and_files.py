"""Token counts, SentencePiece, packing, WARC and audio against independent versions and round trips."""

import io
import random

import numpy as np
import pytest
import sentencepiece
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from idloom.llm import mpeg_audio, packing, piece_model, sentence_pieces, token_counts, warc
from idloom.llm.queries import VOCABULARY

MODEL = sentence_pieces.load(VOCABULARY)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
ENCODER = sentence_pieces.PieceEncoder(MODEL)
TRICKY = ["", " ", "  a  b ", "\n\nThat\n ñandú 漢字 🎉 x▁y ▁▁ \t\x00 z", "é" * 50 + "a" * 100, "0123 4.5\n", "trail  ", "é ﬁ Ａ"]


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + TRICKY


def test_pieces_equal_the_library(texts):
    offsets, ids, begins, ends, same = ENCODER.encode(texts)
    for text, a, b in zip(texts, offsets, offsets[1:]):
        assert ids[a:b].tolist() == LIBRARY.encode(text)
        assert ENCODER.decode(ids[a:b]) == LIBRARY.decode(ids[a:b].tolist())
        raw = text.encode()
        spans = list(zip(begins[a:b].tolist(), ends[a:b].tolist()))
        assert [x for x, _ in spans[1:]] == [y for _, y in spans[:-1]] and (not spans or (spans[0][0], spans[-1][1]) == (0, len(raw)))
        for i, (x, y) in zip(ids[a:b], spans):
            if MODEL.types[i] == piece_model.NORMAL:
                assert raw[x:y].replace("▁".encode(), b" ") in (ENCODER.surface[i], ENCODER.surface[i].removeprefix(b" "))


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab \n▁éñ漢🎉é0.") | st.characters(exclude_categories=["Cs"]), max_size=40))
def test_any_text_as_the_library(text):
    _, ids, _, _, same = ENCODER.encode([text])
    assert same[0] == (ENCODER.decode(ids) == text)
    assert ids.tolist() == LIBRARY.encode(text)
    if "▁" not in text:
        assert ENCODER.decode(ids) == text


RULES = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
MAP = piece_model.CharacterMap(piece_model.PieceModel.parse(RULES.serialized_model_proto()).charsmap)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ﬁＡéがが½㍿ \t\n​ﷺaz") | st.characters(exclude_categories=["Cs"]), max_size=30))
def test_character_map_as_the_library(text):
    done, place = piece_model.normalise(text, MAP, True, True)
    assert done.replace(" ", "▁") == RULES.normalize(text).replace(" ", "▁")
    raw = text.encode()
    assert len(place) == len(done.encode()) + 1 and (np.diff(place) >= 0).all() and 0 <= place[0] <= place[-1] <= len(raw)


def test_spans_through_the_character_map():
    encoder = sentence_pieces.PieceEncoder(MODEL, MAP, squeeze=True)
    text = "ﬁne  Ａpple"
    _, ids, begins, ends, _ = encoder.encode([text])
    raw = text.encode()
    assert b"".join(encoder.surface[i] for i in ids) == b" fine Apple"
    assert raw[begins[0] : ends[0]].decode() in ("ﬁ", "ﬁn", "ﬁne") and ends[-1] == len(raw)


def varint(n: int) -> bytes:
    return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])


def mapped_library() -> sentencepiece.SentencePieceProcessor:
    """The published vocabulary with the map nmt_nfkc and squeezing: a later normaliser overrides fields of the first."""
    charsmap = sentence_pieces.published_map()
    spec = b"\x12" + varint(len(charsmap)) + charsmap + b"\x18\x01\x20\x01"
    with open(VOCABULARY, "rb") as f:
        return sentencepiece.SentencePieceProcessor(model_proto=f.read() + b"\x1a" + varint(len(spec)) + spec)


MAPPED, MAPPED_ENCODER = mapped_library(), sentence_pieces.PieceEncoder(MODEL, MAP, squeeze=True)


def plain_spans(text: str, ids: list[int]) -> list[tuple[int, int]]:
    """Spans by a walk over the text: the longest rule at each place, squeezing byte by byte, then the widths of the pieces."""
    done, at, k = [], 0, 0
    while k < len(text):
        n = next((n for n in range(MAP.longest, 0, -1) if k + n <= len(text) and text[k : k + n] in MAP.rules), 0)
        source = text[k : k + max(n, 1)]
        put = MAP.rules[source] if n else source
        done += [(b, at + (0 if n and put != source else i)) for i, b in enumerate(put.encode())]
        at, k = at + len(source.encode()), k + max(n, 1)
    end = at
    while done and done[0][0] == 32:
        done.pop(0)
    while done and done[-1][0] == 32:
        end = done.pop()[1]
    done = [x for i, x in enumerate(done) if x[0] != 32 or done[i - 1][0] != 32]
    if done:
        done.insert(0, (32, done[0][1]))
    places, out, k = [p for _, p in done] + [end], [], 0
    for i in ids:
        n = 1 if MODEL.types[i] == piece_model.BYTE else len(MODEL.pieces[i].replace("▁", " ").encode())
        out.append((places[k], places[k + n]))
        k += n
    return out


def check_mapped(texts: list[str]) -> None:
    offsets, ids, begins, ends, same = MAPPED_ENCODER.encode(texts)
    for k, (text, a, b) in enumerate(zip(texts, offsets, offsets[1:])):
        assert ids[a:b].tolist() == MAPPED.encode(text)
        assert list(zip(begins[a:b].tolist(), ends[a:b].tolist())) == plain_spans(text, ids[a:b].tolist())
        assert same[k] == (MAPPED_ENCODER.decode(ids[a:b]) == text)


def test_mapped_pieces_and_spans_equal_the_library_and_a_plain_walk(texts):
    check_mapped(texts)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("ﬁＡéがが½㍿´ \t\n\u200b\x01\xa0▁ﷺaz漢🎉"), max_size=12), max_size=6))
def test_any_mapped_text_as_the_library(texts):
    check_mapped(texts)


def test_long_units_are_cut_where_no_piece_crosses():
    r = random.Random(3)
    text = "".join(r.choice("abcdeqxz01+/é漢") for _ in range(20_000)) + "a" * 3000
    assert MAPPED_ENCODER.encode([text])[1].tolist() == MAPPED.encode(text)


def test_query_encodes_as_the_library_with_the_map(spark):
    from idloom.llm.queries import op10_sentencepiece

    want = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = op10_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(want)
    for r in rows:
        assert r.ids == MAPPED.encode(want[r.doc_id]) and list(zip(r.begins, r.ends)) == plain_spans(want[r.doc_id], r.ids)


def plain_count(word: str, scores: dict) -> tuple[float, int]:
    """Best score and fewest pieces, by a table over all ends."""
    unknown = min(scores.values()) - 10
    best = [(0.0, 0)]
    for d in range(1, len(word) + 1):
        ways = [(best[k][0] + scores[word[k:d]], -(best[k][1] + 1)) for k in range(d) if word[k:d] in scores]
        if word[d - 1] not in scores:
            ways.append((best[d - 1][0] + unknown, -(best[d - 1][1] + len(word[d - 1].encode()))))
        top = max(s for s, _ in ways)
        best.append((top, -max(n for s, n in ways if s == top)))
    return best[-1]


def test_counts_equal_a_plain_version_and_a_library(texts):
    from tokenizers import Tokenizer, models, pre_tokenizers

    scores = token_counts.unigram_scores(MODEL)
    pieces = [("<unk>", min(scores.values())), *scores.items(), *[(f"<0x{b:02X}>", -1000.0) for b in range(256)]]
    library = Tokenizer(models.Unigram(pieces, 0, True))
    library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(prepend_scheme="always")])
    tries = [token_counts.CountingTrie(scores, True, nodes) for nodes in (800_000, 500)]
    for text in texts:
        words = ["▁" + w for w in text.split()]
        counts = {trie.counts(words) for trie in tries}
        assert len(counts) == 1
        if "\x00" not in text and "▁" not in text and "́" not in text:
            assert counts == {len(library.encode(text).ids)}
    for word in {"▁" + w for t in texts[:40] for w in t.split()} | {"▁漢z🎉", "▁ñandú", "▁▁"}:
        assert tries[0].insert(word) == plain_count(word, scores)[1]


def plain_pack(lengths, sizes, cost):
    """Best fit by looking at every open bin."""
    bins = []
    for i, n in enumerate(lengths):
        fits = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= n]
        if fits:
            room = min(fits)[0]
            k = min((k for r, k in fits if r == room), key=lambda k: bins[k]["order"][-1])
        else:
            fill = lambda c: n + min(c - n, sum(m for m in lengths[i + 1 :] if m <= c - n))  # noqa: B023, E731
            size = min((c for c in sizes if c >= n), key=lambda c: (cost(c) / fill(c), c))
            bins.append({"room": size, "used": 0, "order": []})
            k = len(bins) - 1
        bins[k]["room"] -= n
        bins[k]["used"] += n
        bins[k]["order"].append(sum(len(b["order"]) for b in bins))
    return [(b["used"], min((c for c in sizes if c >= b["used"]), key=lambda c: (cost(c), c))) for b in bins]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60), st.sampled_from([(64,), (16, 64), (8, 24, 40, 64)]))
def test_packing_equals_a_plain_version(lengths, sizes):
    lengths = sorted(lengths, reverse=True)
    cost = lambda c: 5 + c + c * c / 90
    where, offset, size = packing.pack(np.array(lengths, np.int64), sizes, cost)
    used = np.bincount(where, lengths, len(size)).astype(int) if lengths else np.zeros(0, int)
    assert sorted(zip(used.tolist(), size.tolist())) == sorted(plain_pack(lengths, sizes, cost))
    for b in range(len(size)):
        items = sorted((o, n) for w, o, n in zip(where, offset, lengths) if w == b)
        assert [o for o, _ in items] == np.cumsum([0, *[n for _, n in items]])[:-1].tolist() and used[b] <= size[b]


def test_packing_query_places_every_token_once(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.best_fit_packing(docs, shard_tokens=500_000).toPandas()
    want = docs.select("doc_id", (F.octet_length("text") + 1).alias("n")).toPandas().set_index("doc_id").n
    assert (rows.groupby("doc_id").length.sum() == want).all() and rows["shard"].nunique() > 1
    bins = rows.groupby(["shard", "bin"]).agg(used=("length", "sum"), size=("bin_size", "first"))
    assert (bins.used <= bins["size"]).all() and bins["size"].isin(packing.CAPACITIES).all() and bins.used.sum() / bins["size"].sum() > 0.9
    spans = rows.sort_values(["doc_id", "start"])
    assert (spans.groupby("doc_id").start.first() == 0).all()


def test_rows_that_share_id_and_length_are_split(spark):
    docs = spark.createDataFrame([(None, "x" * 9)] * 3000 + [(7, "y" * 40)] * 500 + [(8, "z" * 99)], "doc_id bigint, text string")
    rows = packing.best_fit_packing(docs, capacities=(16, 64), shard_items=200).toPandas()
    assert (rows.length.sum(), len(rows)) == (3000 * 10 + 500 * 41 + 100, 3502) and rows.groupby("shard").size().max() < 260
    bins = rows.groupby(["shard", "bin"]).agg(used=("length", "sum"), size=("bin_size", "first"))
    assert (bins.used <= bins["size"]).all() and rows.doc_id.isna().sum() == 3000
    spans = rows.sort_values(["shard", "bin", "offset"])
    begin = spans.groupby(["shard", "bin"]).length.cumsum() - spans.length
    assert (begin == spans.offset).all()


def test_a_small_size_is_opened_where_nothing_else_fits():
    _, _, size = packing.pack(np.array([1000] * 3), (1024, 2048), packing.bin_cost)
    assert sorted(size.tolist()) == [1024, 2048]
    where, _, size = packing.pack(np.array([1500, 1024]), (1024, 2048), packing.bin_cost)
    assert where.tolist() == [0, 1] and size.tolist() == [2048, 1024]


def test_an_unbroken_word_of_megabytes_takes_little_memory():
    import tracemalloc

    scores = token_counts.unigram_scores(MODEL)
    trie = token_counts.CountingTrie(scores, True, nodes=2000)
    r = random.Random(4)
    word = "▁" + "".join(r.choice("abcdefghijklmnopqrstuvwxyz0189+/漢é") for _ in range(3000))
    assert trie.count_long(word) == plain_count(word, scores)[1] == token_counts.CountingTrie(scores, True).insert(word)
    assert trie.counts([word, "▁a", word, *["▁" + word[k : k + 40] for k in range(1, 2500, 40)]]) == token_counts.CountingTrie(scores, True).counts([word, "▁a", word, *["▁" + word[k : k + 40] for k in range(1, 2500, 40)]])
    long = word * 300
    tracemalloc.start()
    assert trie.counts([long]) > 300_000
    assert tracemalloc.get_traced_memory()[1] < 20 << 20
    tracemalloc.stop()


def test_reading_an_archive_is_linear():
    import time

    data = b"".join(warc.compress_archive("x", [warc.record(k, f"http://a/{k}", random.Random(k).randbytes(3000)) for k in range(2500)]))
    began = time.process_time()
    assert len(list(warc.read_archive(data))) == 2501 and time.process_time() - began < 3


def test_archives_read_as_plain_zstandard(spark):
    rows = warc.archive_frames(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), archive_bytes=300_000).orderBy("archive", "member").collect()
    want = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    files = {}
    for r in rows:
        assert r.offset == len(files.get(r.archive, b"")) and r.length == len(r.frame)
        files[r.archive] = files.get(r.archive, b"") + bytes(r.frame)
    assert len(files) > 1
    seen = []
    for data in files.values():
        assert data[:4] == bytes.fromhex("5d2a4d18")
        for headers, block in warc.read_archive(data):
            if headers["WARC-Type"] == "resource":
                page = want[int(headers["X-Page-ID"])]
                assert block.decode() == page.html and headers["WARC-Target-URI"] == page.url
                seen.append(page.page_id)
    assert sorted(seen) == sorted(want)
    # Each member alone, with the dictionary of the first frame and nothing of this library.
    first = [r for r in rows if r.archive == rows[0].archive]
    held = zstandard.ZstdDecompressor().decompress(bytes(first[0].frame)[8:])
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held)).stream_reader(io.BytesIO(bytes(first[2].frame)))
    assert reader.read().startswith(b"WARC/1.1\r\n")
    plain = sum(len(zstandard.ZstdCompressor(level=warc.LEVEL).compress(warc.record(r.page_id, r.url, r.html))) for r in want.values())
    assert sum(map(len, files.values())) < plain


def test_damaged_archives_are_told():
    frames = warc.compress_archive("x", [warc.record(k, f"http://a/{k}", f"<p>{k}" * 50) for k in range(30)])
    data = b"".join(frames)
    assert len(list(warc.read_archive(data))) == 31
    for bad in (data[:-3], data[:-20] + b"\0" + data[-19:]):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.read_archive(bad))


def test_audio_streams_are_found_as_made():
    r = random.Random(1)
    for key in range(400):
        data, want = mpeg_audio.synthetic_stream(key, bytes(r.randrange(254) for _ in range(r.randrange(60_000 if key % 40 == 0 else 3000))))
        got = mpeg_audio.parse(data)
        assert (got.frames, got.junk_bytes, got.resyncs, got.wrong, got.checked) == (want["frames"], want["junk_bytes"], want["resyncs"], want["wrong"], want["checked"])
        assert (got.samples, got.sample_rate, got.layer, got.tags["title"]) == (want["samples"], want["sample_rate"], want["layer"], want["title"])


def plain_crc(bits: str) -> int:
    crc = 0xFFFF
    for b in bits:
        top = (crc >> 15) ^ int(b)
        crc = ((crc << 1) & 0xFFFF) ^ (0x8005 if top else 0)
    return crc


def test_checksums_bit_by_bit():
    r = random.Random(2)
    for n in (1, 7, 8, 30, 272):
        data = bytes(r.randrange(256) for _ in range(40))
        assert mpeg_audio.crc16(data, n) == plain_crc("".join(f"{b:08b}" for b in data)[:n])


def test_tables_tags_and_cuts():
    make = lambda body, k=9: mpeg_audio.frame_bytes(1, 3, 0, k, 0, False, 0, body)
    lame = b"LAME3.100" + bytes(12) + ((576 << 12) | 1000).to_bytes(3)
    xing = bytes(32) + b"Xing" + (15).to_bytes(4) + (3).to_bytes(4) + (9999).to_bytes(4) + bytes(range(100)) + bytes(4) + lame
    frames = [make(xing), make(b"a", 5), make(b"b", 12), make(b"c", 9)]
    tail = b"TAG" + b"Song".ljust(30, b"\0") + b"Band".ljust(30, b"\0") + bytes(65)
    got = mpeg_audio.parse(b"".join(frames) + tail)
    assert got.table == "Xing" and got.declared_frames == 3 and got.declared_bytes == 9999 and got.toc == list(range(100))
    assert got.samples == 3 * 1152 and got.playable_samples == 3 * 1152 - 1576 and (got.min_kbps, got.max_kbps) == (64, 224)
    assert got.tags == {"title": "Song", "artist": "Band"} and got.frames[0] == len(frames[0]) and got.junk_bytes == 0
    cut = mpeg_audio.parse(b"".join(frames)[:-10])
    assert cut.truncated and len(cut.frames) == 2 and cut.samples == 2 * 1152
    vbri = bytes(32) + b"VBRI" + b"\0\1\0\0\0\x4b" + (5000).to_bytes(4) + (3).to_bytes(4) + b"\0\2\0\1\0\2\0\1" + b"\1\2\3\4"
    got = mpeg_audio.parse(make(vbri) + b"".join(frames[1:]))
    assert got.table == "VBRI" and (got.declared_frames, got.declared_bytes, got.toc) == (3, 5000, [258, 772])


def test_free_format_frames():
    head = bytes([255, 0xFB, 0 << 4 | 0 << 2, 0])
    data = b"".join(head + bytes([k]) * 300 for k in range(1, 6))
    got = mpeg_audio.parse(data)
    assert got.frames[:4] == [0, 304, 608, 912] and got.layer == 3
