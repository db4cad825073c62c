"""Queries that write a table through a sink, or run it through a stream, and read it back; with their equivalents in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.plans.tables import SQL as TABLES_SQL
from idloom.plans.tables import fixture, read
from idloom.sources import files
from idloom.streaming import cases

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__], SQL[fn.__name__] = fn, sql
        return fn

    return add


@query("SELECT r_name AS job, octet_length(encode(r_name || '!')) AS bytes, sha256(r_name || '!') AS digest FROM region")
def src_put_bytes(spark, sf_dir):
    """One upload for each region, of which there are five: this sink takes one blob at a time."""
    root = files.shared_folder(spark, "uploads")
    for row in read(spark, sf_dir, "region").select("r_name").toLocalIterator():
        files.put_bytes(spark, root, row.r_name, f"{row.r_name}!".encode())
    found = files.read_blobs(spark, root, "input.bin")
    return found.select(F.element_at(F.split("path", "/"), -2).alias("job"), "length", F.sha2("content", 256).alias("digest")).withColumnRenamed("length", "bytes")


QUERIES["src_get_bytes"], SQL["src_get_bytes"] = src_put_bytes, SQL["src_put_bytes"]


@query("SELECT p_partkey, p_name, p_brand FROM part")
def sink_json_atomic(spark, sf_dir):
    path = f"{files.shared_folder(spark, 'json')}/parts"
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    files.write_json(parts.where("false"), path)
    files.write_json(parts, path)
    return files.read_json_if_exists(spark, path, "p_partkey bigint, p_name string, p_brand string")


@query("SELECT p_partkey FROM part")
def src_json_opt(spark, sf_dir):
    """What was written, and nothing where nothing is."""
    root = files.shared_folder(spark, "json")
    files.write_json(read(spark, sf_dir, "part").select("p_partkey"), f"{root}/parts")
    return files.read_json_if_exists(spark, f"{root}/parts", "p_partkey bigint").unionByName(files.read_json_if_exists(spark, f"{root}/none", "p_partkey bigint"))


def _corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("c_custkey") % 2 == 0, "pan").otherwise("aadhaar")
    text = lambda v: F.lit(v)
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("document_id"), kind.alias("doc_type"), text("name").alias("field_name"), F.col("c_name").alias("original_value"), F.upper("c_name").alias("corrected_value"), text("r").alias("reviewer"), text("u").alias("image_uri"), text("yolo").alias("extraction_path"))


@query("SELECT cast(c_custkey AS string) AS document_id, c_name AS original_value, upper(c_name) AS corrected_value FROM customer")
def sink_corrections(spark, sf_dir):
    path = files.shared_folder(spark, "corrections")
    files.append_corrections(_corrections(spark, sf_dir), path)
    return files.read_corrections(spark, path, limit=None).select("document_id", "original_value", "corrected_value")


@query("SELECT cast(c_custkey AS string) AS document_id FROM customer WHERE c_custkey % 2 = 0")
def src_corrections(spark, sf_dir):
    """The corrections of one type."""
    path = files.shared_folder(spark, "corrections")
    files.append_corrections(_corrections(spark, sf_dir), path)
    return files.read_corrections(spark, path, doc_type="pan", limit=None).select("document_id")


@query("SELECT count(*) AS told, count(*) AS written FROM customer")
def sink_training(spark, sf_dir):
    path = files.shared_folder(spark, "training")
    told = files.export_training(_corrections(spark, sf_dir), path)
    return spark.read.schema(files.CORRECTION).json(path).agg(F.lit(told).cast("bigint").alias("told"), F.count("*").alias("written"))


@query("SELECT vec_id, len(embedding) AS size FROM embeddings")
def sink_vector(spark, sf_dir):
    path = files.shared_folder(spark, "vectors")
    files.write_vectors(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), path)
    return spark.read.parquet(path).select("vec_id", F.size("embedding").cast("bigint").alias("size"))


@query("SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' AS line FROM region UNION ALL SELECT unnest(['# Regions', '', '| key | name |', '|-|-|'])")
def sink_report(spark, sf_dir):
    path = files.shared_folder(spark, "report")
    files.write_report(read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")), path, "Regions")
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(TABLES_SQL["led_append"])
def str_ledger(spark, sf_dir):
    """The events of led_append as a stream: each case is chained as its events come."""
    root = files.shared_folder(spark, "ledger")
    events = fixture(spark, sf_dir, "turns")
    events.write.json(f"{root}/in")
    stream = spark.readStream.schema(events.schema).json(f"{root}/in")
    cases.append_sink(cases.streaming_ledger(stream), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(cases.CHAIN).parquet(f"{root}/out").withColumn("sequence", F.col("sequence").cast("int"))
