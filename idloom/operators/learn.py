"""Corrections of reviewers, triggers of retraining, checks for regression, the registry of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def error_distribution(corrections: DataFrame) -> DataFrame:
    """(grouping, key, n) by field, by type and by both, in one pass with grouping sets."""
    f, t = F.coalesce("field_name", F.lit("unknown")), F.coalesce("doc_type", F.lit("unknown"))
    rows = corrections.select(f.alias("f"), t.alias("t"))
    counts = rows.groupingSets([["f"], ["t"], ["t", "f"]], "f", "t").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    g = F.col("g")
    return counts.select(F.when(g == 1, "field").when(g == 2, "doc_type").otherwise("pair").alias("grouping"), F.when(g == 1, F.col("f")).when(g == 2, F.col("t")).otherwise(F.concat_ws(":", "t", "f")).alias("key"), "n")


def retrain_triggers(corrections: DataFrame, current_f1: float | None = None, baseline_f1: float | None = None, volume: int = 100, drop: float = 0.02) -> DataFrame:
    """One row: total, the reasons, and whether to retrain."""
    fell = current_f1 is not None and baseline_f1 is not None and baseline_f1 - current_f1 >= drop
    pairs = error_distribution(corrections).where("grouping = 'pair'").agg(F.max("n").alias("worst"))
    total = corrections.agg(F.count("*").alias("total"))
    reasons = F.array_compact(F.array(F.when(F.col("total") >= volume, "correction_volume"), F.when(F.lit(fell), "f1_drop"), F.when(F.col("worst") >= volume // 2, "concentrated_errors")))
    return total.crossJoin(pairs).select("total", reasons.alias("reasons"), (F.size(reasons) > 0).alias("should_retrain"))


def regressions(new: DataFrame, baseline: DataFrame, limit: float = 0.02) -> DataFrame:
    """Fields whose F1 fell by more than the limit, of those that both have."""
    both = baseline.select("field", F.col("f1").alias("baseline_f1")).join(new.select("field", F.col("f1").alias("new_f1")), "field")
    return both.withColumn("drop", F.col("baseline_f1") - F.col("new_f1")).where(F.col("drop") > limit)


def regression_verdict(new: DataFrame, baseline: DataFrame, new_f1: float, baseline_f1: float, limit: float = 0.02) -> DataFrame:
    fields = regressions(new, baseline, limit).agg(F.count("*").alias("fields"))
    bad = (F.col("fields") > 0) | F.lit(baseline_f1 - new_f1 > limit)
    return fields.select("fields", F.lit(baseline_f1 - new_f1).alias("overall_drop"), F.when(bad, "ROLLBACK").otherwise("PROMOTE").alias("recommendation"))


def register(versions: DataFrame, model: str, version: str, weights: str) -> DataFrame:
    """Add a version, or overwrite the one of that name where it stands.  Rows: (model, place, version, weights, status)."""
    mine = F.col("model") == model
    place = versions.where(mine).agg(F.coalesce(F.max(F.when(F.col("version") == version, F.col("place"))), F.max("place") + 1, F.lit(0)).alias("place"))
    new = place.select(F.lit(model).alias("model"), "place", F.lit(version).alias("version"), F.lit(weights).alias("weights"), F.lit("registered").alias("status"))
    return versions.where(~(mine & (F.col("version") == version))).unionByName(new)


def promote(versions: DataFrame, model: str, version: str) -> DataFrame:
    """Activate a version; others that are active or registered retire.  Raises ValueError for an unknown version."""
    mine = F.col("model") == model
    if versions.where(mine & (F.col("version") == version)).isEmpty():
        raise ValueError(f"{model} has no version {version}")
    status = F.when(~mine, F.col("status")).when(F.col("version") == version, "active").when(F.col("status").isin("active", "registered"), "retired").otherwise(F.col("status"))
    return versions.withColumn("status", status)


def rollback_target(versions: DataFrame, model: str) -> DataFrame:
    """(version) to return to: the one registered before the active one, else the last retired; no rows if there is none."""
    rows = versions.where(F.col("model") == model)
    w = Window.partitionBy("model").orderBy("place")
    before = rows.withColumn("previous", F.lag("version").over(w)).where("status = 'active'")
    one = rows.agg(F.max_by("version", F.when(F.col("status") == "retired", F.col("place"))).alias("retired")).crossJoin(before.agg(F.min_by("previous", "place").alias("previous")))
    return one.select(F.coalesce("previous", "retired").alias("version")).where("version is not null")


def rollback(versions: DataFrame, model: str) -> DataFrame:
    target = rollback_target(versions, model).first()
    return versions if target is None else promote(versions, model, target.version)


def active_models(versions: DataFrame) -> DataFrame:
    return versions.where("status = 'active'").select("model", "version", "weights")


def to_reload(active: DataFrame, loaded: DataFrame) -> DataFrame:
    """(model, version) of active models whose weights are there and whose version isn't the one loaded."""
    held = loaded.select("model", F.col("version").alias("held"))
    stale = (F.coalesce("weights", F.lit("")) != "") & ~F.col("version").eqNullSafe(F.col("held"))
    return active.join(held, "model", "left").where(stale).select("model", "version")


def training_rows(reviews: DataFrame, images: DataFrame) -> DataFrame:
    """Reviewed documents with a picture of the same file name, and a type inferred from the corrected fields."""
    from idloom.operators.extraction import infer_type

    base = lambda c: F.regexp_extract(c, r"([^/\\]*)\z", 1)
    keyed = reviews.withColumn("file", base(F.col("job_id")))
    return keyed.join(images.select(base(F.col("path")).alias("file"), "path"), "file").select("file", "path", "correction", infer_type(F.map_keys("correction")).alias("doc_type"))


def correction_rows(reviews: DataFrame) -> DataFrame:
    """One row per corrected field; the original value is unknown here and empty."""
    return reviews.select("job_id", "reviewer", F.explode("correction").alias("field_name", "corrected_value")).withColumn("original_value", F.lit(""))


def first_by_name(reviews: DataFrame, pictures: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Reviews with the first picture of their file's name; of several roots the first in order wins."""
    w = Window.partitionBy(name).orderBy(*order)
    return reviews.join(pictures.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place"), name)
