"""Calibrated decisions, overrides, statuses of documents, jobs and cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idloom.functions.text import clamp, temperature

WEIGHTS = {"extraction": 0.35, "forensics": 0.25, "policy": 0.25, "cross_doc": 0.15}
SPOOF_REJECT, SPOOF_OVERRIDE, SPOOF_REVIEW = 0.7, 0.5, 0.4


def calibrated(extraction: Column, spoof: Column, policy: Column, cross_doc: Column, t: float = 1.5) -> Column:
    parts = (extraction, 1 - spoof, policy, cross_doc)
    weighted = [clamp(p) * w for p, w in zip(parts, WEIGHTS.values())]
    return temperature(weighted[0] + weighted[1] + weighted[2] + weighted[3], t)


def recommendation(confidence: Column) -> Column:
    return F.when(confidence >= 0.92, "AUTO_CLEAR").when(confidence >= 0.7, "REVIEW").otherwise("REJECT")


def overridden(first: Column, spoof: Column, compliant: Column, critical: Column, quality: Column) -> Column:
    """struct<final, rules>: the hard rules in their order, and those that applied."""
    final = F.when((spoof > SPOOF_OVERRIDE) | ~quality, "REJECT").when((first == "AUTO_CLEAR") & (~compliant | (critical > 0)), "REVIEW").otherwise(first)
    rules = F.array_compact(F.array(F.when(spoof > SPOOF_OVERRIDE, "spoof_threshold"), F.when(~compliant, "policy_non_compliant"), F.when(critical > 0, "critical_contradictions"), F.when(~quality, "quality_failed")))
    return F.struct(final.alias("final"), rules.alias("rules"))


def policy_value(compliant: Column) -> Column:
    return F.when(F.coalesce(compliant, F.lit(True)), 1.0).otherwise(0.3)


def decisions(cases: DataFrame) -> DataFrame:
    """Adds confidence, recommendation, overrides and status.

    Needs quality_passed, attempt_rescue, spoof, is_valid, critical_fields, score, compliant, cross_doc, critical.
    """
    confidence = calibrated(F.col("score"), F.col("spoof"), policy_value(F.col("compliant")), F.coalesce("cross_doc", F.lit(1.0)))
    known = F.coalesce("compliant", F.lit(True))
    over = overridden(F.col("recommendation"), F.col("spoof"), known, F.coalesce("critical", F.lit(0)), F.col("quality_passed"))
    good = F.col("is_valid")
    ended = F.col("o.final")
    later = F.when(ended == "REJECT", "REJECTED_CALIBRATION").when(F.col("spoof") > SPOOF_REVIEW, "REVIEW_SPOOF").when(good & (ended == "AUTO_CLEAR"), "AUTO_CLEARED").when(good & (ended == "REVIEW"), "REVIEW").otherwise(F.when(good, "SUCCESS").otherwise("PARTIAL_SUCCESS"))
    status = (
        F.when(~F.col("quality_passed"), "REJECTED_QUALITY")
        .when(F.col("spoof") > SPOOF_REJECT, "REJECTED_SPOOF")
        .when(~good & (F.col("critical_fields") < 2), "REJECTED_CONTENT")
        .when(F.col("attempt_rescue") & ~good, "REJECTED_QUALITY")
        .otherwise(later)
    )
    out = cases.withColumn("confidence", confidence).withColumn("recommendation", recommendation(F.col("confidence"))).withColumn("o", over)
    return out.withColumn("status", status).withColumns({"final_recommendation": F.col("o.final"), "overrides": F.col("o.rules")}).drop("o")


def manual_outcome(c: Column) -> Column:
    """The outcome of a reviewer, or null if it isn't one."""
    return F.when(c.isin("APPROVED", "REJECTED", "REQUIRES_INFO"), c)


def queue_state(c: Column) -> Column:
    return F.when(c.isin("PENDING", "RECEIVED", "RETRY"), "QUEUED").when(c == "STARTED", "RUNNING").when(c == "SUCCESS", "SUCCEEDED").when(c.isin("FAILURE", "REVOKED"), "FAILED").otherwise("UNKNOWN")


def ui_status(status: Column, ok: Column, is_valid: Column, reason: Column, message: Column) -> Column:
    """struct<status, error> for the review desk; a cleared document's own validity counts, whatever the transport said."""
    shown = F.when(status.isin("REJECTED_QUALITY", "REJECTED_CONTENT", "REJECTED_SPOOF", "REJECTED_CALIBRATION"), "REJECTED").when(status.isin("REVIEW", "REVIEW_SPOOF"), "INVALID").when(status == "AUTO_CLEARED", F.when(is_valid, "VALID").otherwise("INVALID")).otherwise(F.when(ok & is_valid, "VALID").otherwise("INVALID"))
    why = F.when(status == "REJECTED_QUALITY", F.coalesce(reason, F.lit("Unknown Quality Issue"))).when(status == "REJECTED_CONTENT", "Back side or Empty Content").otherwise(F.concat(F.lit("Rejected: "), F.lower(F.regexp_replace(status, "REJECTED_", ""))))
    return F.struct(shown.alias("status"), F.when(shown == "REJECTED", why).otherwise(message).alias("error"))


def failure_reason(ok: Column, error: Column, is_valid: Column, message: Column) -> Column:
    """Why an item failed; the first wording that fits counts."""
    m = F.lower(F.trim(F.coalesce(message, F.lit(""))))
    return (
        F.when(~ok, F.concat(F.lit("transport:"), F.coalesce(error, F.lit("unknown"))))
        .when(is_valid, "valid")
        .when(m == "", "invalid:unknown")
        .when(m.contains("does not match"), "invalid:regex_mismatch")
        .when(m.contains("is not one of"), "invalid:enum")
        .when(m.contains("missing"), "invalid:missing")
        .otherwise("invalid:other")
    )


def batch_status(jobs: DataFrame, by: str = "batch_id", state: str = "state") -> DataFrame:
    """Counts of states per batch and its own: completed when all have ended, else running if any runs, else pending."""
    n = {s.lower(): F.count_if(F.col(state) == s).alias(s.lower()) for s in ("QUEUED", "RUNNING", "SUCCEEDED", "FAILED", "UNKNOWN")}
    return jobs.groupBy(by).agg(F.count(state).alias("total"), *n.values()).withColumn("status", F.when(F.col("succeeded") + F.col("failed") == F.col("total"), "COMPLETED").when(F.col("running") > 0, "RUNNING").otherwise("PENDING"))


def case_status(docs: DataFrame, by: str = "case_id", state: str = "celery_state") -> DataFrame:
    return docs.groupBy(by).agg(F.count(state).alias("documents"), F.when(F.coalesce(F.bool_and(F.when(F.col(state).isNotNull(), F.col(state).isin("SUCCESS", "FAILURE"))), F.lit(True)), "COMPLETED").otherwise("PROCESSING").alias("status"))


def batch_details(batches: DataFrame, meta: DataFrame, results: DataFrame) -> DataFrame:
    """(batch_id, position, job_id, filename, status) of arrays of job ids, with what is known of each."""
    jobs = batches.select("batch_id", F.posexplode("job_ids").alias("position", "job_id"))
    return jobs.join(meta, "job_id", "left").join(results, "job_id", "left")


def unreviewed(jobs: DataFrame, reviewed: DataFrame, wanted: str = "ALL") -> DataFrame:
    """Jobs whose file-safe id hasn't been reviewed, of the wanted status."""
    rest = jobs.join(reviewed.select(F.col("safe_id").alias("__done")), F.translate(F.col("job_id"), "\\/", "__") == F.col("__done"), "left_anti")
    return rest if wanted == "ALL" else rest.where(F.col("status") == wanted)


def search_cases(cases: DataFrame, status: str | None, needle: str) -> DataFrame:
    """The dashboard's filter: equal status, and the text in id, file name or type in whatever case; running ones first."""
    hit = F.lower("job_id").contains(needle.lower()) | F.lower("filename").contains(needle.lower()) | F.lower("doc_type").contains(needle.lower())
    order = F.when(F.col("state").isin("RUNNING", "STARTED"), 0).when(F.col("state") == "QUEUED", 1).when(F.col("state") == "SUCCEEDED", 2).when(F.col("state") == "FAILED", 3).otherwise(4)
    return cases.where(hit if status is None else hit & (F.col("state") == status)).withColumn("sort_key", order)


def upload_types(files: Column, types: Column) -> Column:
    """Array of types, one per file: the comma list, padded with auto."""
    given = F.transform(F.split(F.coalesce(types, F.lit("")), ","), lambda t: F.trim(t))
    return F.transform(files, lambda _, i: F.coalesce(F.nullif(F.get(given, i), F.lit("")), F.lit("auto")))


def api_user(key: Column, valid: Column) -> Column:
    """Who asks: 'anonymous' where no keys are set, the key if it is one of them, else null, which is a refusal."""
    return F.when(F.size(valid) == 0, "anonymous").when((F.coalesce(key, F.lit("")) != "") & F.array_contains(valid, key), key)
