"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from idloom.llm import exact_dedup, lang_id, lm_score, mpeg_audio, near_dup, packing, sentence_pieces, token_counts, toxicity, warc
from idloom.llm.queries import VOCABULARY

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "the hat and the onder " * 60_000
ROWS = [
    (1, "the ander of onble and thering was that", "en", "a", 1),
    (1, "the ander of onble and thering was that", "en", "a", 1),
    (2, "the ander of onble and thering was that", "en", "b", 1),
    (3, "", "en", "a", 0),
    (4, "", "en", "a", 0),
    (5, None, "en", "a", None),
    (None, "der die und einer von den keit", "de", None, 3),
    (6, "der die und einer von den keit", None, "c", 3),
    (7, LONG, "en", "a", 9),
    (8, "### %%% 1234", "de", "a", 2),
    (9, "x" * 300_000, "fr", "a", 2),
    (None, None, None, None, None),
]
CLASH = ["id", "root", "sig", "key", "toxicity", "languages", "__digest", "__hit", "shard", "part", "n", "h1", "bands", "frame", "rep"]


@pytest.fixture(scope="module")
def docs(spark):
    """Awkward rows, with columns whose names the operators use inside."""
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3, "lang")
    for c in CLASH:
        df = df.withColumn(c, F.lit(f"clash {c}"))
    return df.persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 1), (2, 1, 0), (6, 0, 0), (7, 0, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")


def test_token_counts(docs, empty):
    model = sentence_pieces.load(VOCABULARY)
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, model).where("doc_id is not null").collect()}
    assert got[3].n_tokens == 0 and got[3].n_words == 0 and got[5].n_tokens is None
    assert got[7].n_words == 300_000 and got[9].n_words == 1 and got[1].n_tokens == got[2].n_tokens
    assert token_counts.count_tokens(docs, model).count() == len(ROWS)
    assert token_counts.count_tokens(empty, model).count() == 0


def test_language_id(docs, empty):
    rows = lang_id.identify_languages(docs).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(ROWS)
    assert got[1].language == "en" and got[6].language == "de" and got[7].language == "en"
    assert not got[3].accepted and got[3].languages == [] and not got[5].accepted and not got[8].accepted
    assert lang_id.identify_languages(empty).count() == 0
    kept = lang_id.accept_languages(docs)
    assert kept.columns == docs.columns
    assert lang_id.accept_languages(empty).count() == 0


def test_toxicity(docs, empty, labels):
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.toxicity <= 1 for r in rows)
    assert toxicity.score_toxicity(empty, labels).count() == 0
    none = labels.where("false")
    assert toxicity.drop_toxic(docs, none).count() == len(ROWS)
    assert toxicity.drop_toxic(docs, none).columns == docs.columns


def test_exact_dedup(docs, empty):
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, k) for k in (1, 3, 5, 6, 7, 8, 9)] + [(True, 0)]
    assert exact_dedup.exact_dedup(empty).count() == 0
    rows = exact_dedup.duplicate_table(docs).collect()
    assert len(rows) == len(ROWS) - 2
    assert {(r.doc_id, r.kept_id, r.copies) for r in rows} >= {(1, 1, 3), (2, 1, 3), (4, 3, 2), (None, 6, 2), (6, 6, 2), (7, 7, 1)}
    assert exact_dedup.duplicate_table(empty).count() == 0


def test_near_dedup(docs, empty):
    kept = near_dup.near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 1, 3, 4, 5, 6, 7, 8, 9]
    table = {r.doc_id: r for r in near_dup.group_table(docs).collect()}
    assert len(table) == 9 and table[2].group_id == 1 and not table[2].kept and table[3].group_id == 3
    assert near_dup.near_dedup(empty).count() == 0 and near_dup.group_table(empty).count() == 0


def test_packing(docs, empty):
    rows = packing.best_fit_packing(docs).collect()
    total = sum(len(t.encode()) + 1 for _, t, *_ in ROWS if t is not None)
    assert sum(r.length for r in rows) == total
    assert packing.best_fit_packing(empty).count() == 0
    assert packing.best_fit_packing(docs, length=F.lit(0)).count() == 0


def test_lm_scores(docs, empty):
    rows = lm_score.score_documents(docs).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(ROWS)
    assert got[3].n_words == 0 and got[3].log_prob == 0 and got[3].perplexity is None and got[5].n_words is None
    assert got[7].n_words == 300_000 and got[9].n_words == 1
    assert lm_score.score_documents(empty).count() == 0


def test_sentencepiece(docs, empty):
    model = sentence_pieces.load(VOCABULARY)
    rows = sentence_pieces.encode_documents(docs, model).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(ROWS) and got[5].ids is None and got[3].ids == [] and all(r.round_trip for r in rows if r.ids is not None)
    back = {r.doc_id: r.text for r in sentence_pieces.decode_documents(sentence_pieces.encode_documents(docs, model), model).collect()}
    assert back[7] == LONG and back[9] == "x" * 300_000 and back[5] is None
    assert sentence_pieces.encode_documents(empty, model).count() == 0


def test_warc(spark, docs, empty, tmp_path):
    pages = docs.select("doc_id", F.col("lang").alias("url"), "text", "frame", "key")
    frames = warc.archive_frames(pages, "doc_id", "url", "text")
    assert frames.where("member > 1").count() == len(ROWS)
    folder = f"file://{tmp_path}/archives"
    assert warc.write_archives(frames, folder).count() >= 1
    back = warc.read_archives(spark, folder).collect()
    assert sorted((r.page_id or 0, r.html or "") for r in back) == sorted((k or 0, t or "") for k, t, *_ in ROWS)
    assert sum(r.html is None for r in back) == 2
    assert warc.archive_frames(empty, "doc_id", "lang", "text").count() == 0


def test_audio(spark, empty):
    stream, found = mpeg_audio.synthetic_stream(5, b"payload " * 900)
    rows = [(1, stream), (1, stream), (2, None), (None, b""), (3, b"no audio" * 9), (4, b"\xff" * 70_000)]
    df = spark.createDataFrame(rows, "id bigint, data binary").withColumn("offsets", F.lit("clash")).withColumn("n_frames", F.lit(1))
    out = mpeg_audio.parse_audio(df).collect()
    got = {r.id: r for r in out}
    assert len(out) == len(rows) and got[1].offsets == found["frames"] and got[2].n_frames is None
    assert got[None].n_frames == 0 and got[3].junk_bytes == 72 and got[3].duration is None and got[4].n_frames == 0
    assert mpeg_audio.parse_audio(mpeg_audio.page_media(empty, "doc_id", "text")).count() == 0


def test_stages(spark, docs, empty, labels, tmp_path):
    import corpus_pipeline

    labels.write.parquet(f"{tmp_path}/labels.parquet")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for table in (plain, empty):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, str(tmp_path))
            out.write.parquet(path := f"{tmp_path}/{name}-{table.count()}")
            if name != "packing":
                assert out.columns == plain.columns
                now = spark.read.parquet(path)
    assert empty.count() == 0
    assert {r.doc_id for r in now.collect()} == set()
