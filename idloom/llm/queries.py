"""Queries of the operators of this subpackage over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from idloom.llm import exact_dedup, lang_id, lm_score, mpeg_audio, near_dup, packing, sentence_pieces, token_counts, toxicity, warc

#: Published vocabulary of the tokenizing queries; the operators take any model.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), sentence_pieces.load(VOCABULARY))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify_languages(_read(spark, sf_dir, "documents"))


def op3_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_frames(_read(spark, sf_dir, "pages"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(_read(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.group_table(_read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no audio: each page's bytes travel as the payload of a stream made for it, with tags and damage."""
    return mpeg_audio.parse_audio(mpeg_audio.page_media(_read(spark, sf_dir, "pages")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_table(_read(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(_read(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary's own normaliser is the identity: texts are normalised by the library's compiled map nmt_nfkc."""
    return sentence_pieces.encode_documents(_read(spark, sf_dir, "documents"), sentence_pieces.load(VOCABULARY), charsmap=sentence_pieces.published_map(), squeeze=True)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_language_id, op3_warc_writer, op4_lm_scoring, op5_minhash_near_dedup, op6_toxicity, op7_mpeg_audio, op8_exact_dedup, op9_best_fit_packing, op10_sentencepiece, pipeline)}

SQL = {
    "op8_exact_dedup": """
        SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept_id, count(*) OVER (PARTITION BY text) AS copies
        FROM documents WHERE text IS NOT NULL""",
}
