"""Files in and out: landing of uploads, JSON results, corrections, policies, archives of evaluations, settings."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORRECTION = "document_id string, doc_type string, field_name string, original_value string, corrected_value string, reviewer string, image_uri string, extraction_path string"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; a local session without one gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="idloom-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_blobs(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of a landing folder on any file system that Spark reads, S3 included."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def put_bytes(spark: SparkSession, root: str, job_id: str, blob: bytes) -> str:
    """Write one upload as input.bin of its job's folder; returns its address."""
    fs, at = _file_system(spark, f"{root}/{job_id}/input.bin")
    out = fs.create(at, True)
    try:
        out.write(bytearray(blob))
    finally:
        out.close()
    return fs.makeQualified(at).toString()


def write_json(df: DataFrame, path: str) -> None:
    """Overwrite as a whole: written beside the path and renamed over it, so that a failed write leaves the old files.

    Between the two renames nothing is at the path; the old files are then beside it, at path.old.
    """
    made, old = f"{path}.tmp", f"{path}.old"
    df.write.mode("overwrite").json(made)
    fs, at = _file_system(df.sparkSession, path)
    new, aside = (df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (made, old))
    fs.delete(aside, True)
    if fs.exists(at) and not fs.rename(at, aside):
        raise OSError(f"can't move {path} aside")
    if not fs.rename(new, at):
        raise OSError(f"can't rename {made}")
    fs.delete(aside, True)


def read_json_if_exists(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """No rows where there is nothing at the path."""
    fs, at = _file_system(spark, path)
    if not fs.exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def append_corrections(df: DataFrame, path: str) -> None:
    df.select(*[c.split()[0] for c in CORRECTION.split(", ")]).write.mode("append").json(path)


def read_corrections(spark: SparkSession, path: str, doc_type: str | None = None, limit: int | None = 1000) -> DataFrame:
    """Corrections, of one type if named; the limit is the reader's page size, None for all."""
    df = spark.read.schema(CORRECTION).json(path)
    df = df if doc_type is None else df.where(F.col("doc_type") == doc_type)
    return df if limit is None else df.limit(limit)


def export_training(df: DataFrame, path: str) -> int:
    """Write corrections as JSON lines and return how many, counted while writing."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def read_eval_set(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Samples of one JSON document per file, with the file's name."""
    return spark.read.schema(schema).option("multiLine", "true").json(f"{folder}/*.json").withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def read_results(spark: SparkSession, path: str, item: str) -> DataFrame:
    """Items of a file that holds {"results": [...]} or a bare list."""
    raw = spark.read.text(path, wholetext=True)
    wrapped = F.from_json("value", f"struct<results:array<{item}>>")["results"]
    bare = F.from_json("value", f"array<{item}>")
    return raw.select(F.explode(F.when(F.ltrim("value").startswith("["), bare).otherwise(wrapped)).alias("r")).select("r.*")


def read_policies(spark: SparkSession, folder: str) -> DataFrame:
    """(source_file, text) of Markdown files."""
    raw = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return raw.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source_file"), F.col("value").alias("text"))


def write_vectors(chunks: DataFrame, path: str) -> int:
    """Replace the index of chunks and vectors; returns the count, taken while writing."""
    from pyspark.sql import Observation

    seen = Observation()
    chunks.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    return seen.get["n"]


def input_manifest(blobs: DataFrame) -> DataFrame:
    """(path, sha256, bytes) of an evaluation's inputs."""
    return blobs.select("path", F.sha2("content", 256).alias("sha256"), F.length("content").alias("bytes"))


def write_eval(folder: str, manifest: DataFrame, results: DataFrame, metrics: DataFrame, summary: DataFrame) -> None:
    """metadata, results and metrics as JSON, the summary as CSV with a header."""
    for name, df in (("metadata", manifest), ("results", results), ("metrics", metrics)):
        df.write.mode("overwrite").json(f"{folder}/{name}")
    summary.write.mode("overwrite").option("header", "true").csv(f"{folder}/summary")


def save_reviews(reviews: DataFrame, folder: str, corrections: str) -> None:
    """Reviews as JSON lines with their file-safe id, and a correction per corrected field with an empty original.

    All reviews of a batch share its files: a folder for each of them would be millions.
    """
    from idloom.operators.learn import correction_rows

    reviews.withColumn("safe_id", F.translate("job_id", "\\/", "__")).write.mode("append").json(folder)
    rows = correction_rows(reviews)
    append_corrections(rows.select(F.col("job_id").alias("document_id"), F.lit("unknown").alias("doc_type"), "field_name", "original_value", "corrected_value", "reviewer", F.lit(None).cast("string").alias("image_uri"), F.lit("review").alias("extraction_path")), corrections)


def write_report(rows: DataFrame, path: str, title: str) -> None:
    """A table as a Markdown report, a line per row in the order given, written as one text file folder."""
    names = rows.columns
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names]), F.lit(" |"))
    head = rows.sparkSession.createDataFrame([(f"# {title}",), ("",), ("| " + " | ".join(names) + " |",), ("|" + "-|" * len(names),)], "value string").coalesce(1)
    head.unionByName(rows.select(line.alias("value"))).coalesce(1).write.mode("overwrite").text(path)


def load_settings(path: str | None = None, defaults: Mapping[str, str] | None = None, required: tuple[str, ...] = (), environ: Mapping[str, str] | None = None, prefix: str = "IDLOOM_") -> dict:
    """Settings of a YAML file, by argument, then environment, then none, over the defaults; each field may come from the environment.

    All missing fields are named in one error.
    """
    environ = os.environ if environ is None else environ
    found = dict(defaults or {})
    if path := path or environ.get(f"{prefix}SETTINGS"):
        import yaml

        with open(path) as f:
            found |= yaml.safe_load(f) or {}
    for key in {*found, *required}:
        if (value := environ.get(prefix + key.upper())) is not None:
            found[key] = value
    if missing := sorted(k for k in required if found.get(k) in (None, "")):
        raise ValueError("missing settings: " + ", ".join(missing))
    return found
