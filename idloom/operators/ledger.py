"""Hash-chained audit log: append, verification, replay, difference between two points."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64


def event_hash(previous: Column, payload: Column) -> Column:
    return F.sha2(F.concat(previous, F.lit("||"), payload), 256)


def append(events: DataFrame, by: str = "case_id", order: str = "ordinal") -> DataFrame:
    """Chain each case's events: (case, sequence, event_type, payload, event_hash, prev_hash).

    Payloads are canonical JSON strings and stay as they are; after a null one the rest of its case has no hashes.  The events of
    a task's cases stream by in order, with only the last hash kept, so that a case may be of any length.
    """

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        case, n, head, begun = None, 0, GENESIS, False
        for batch in batches:
            places, new, old = [], [], []
            for key, payload in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if not begun or key != case:
                    case, n, head, begun = key, 0, GENESIS, True
                places.append(n)
                old.append(head)
                head = None if head is None or payload is None else hashlib.sha256(f"{head}||{payload}".encode()).hexdigest()
                new.append(head)
                n += 1
            made = [pa.array(places, pa.int32()), batch.column(1), batch.column(2), pa.array(new, pa.string()), pa.array(old, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], [by, "sequence", "event_type", "payload", "event_hash", "prev_hash"])

    kind = events.schema[by].dataType.simpleString()
    rows = events.repartition(by).sortWithinPartitions(by, order, "event_type", "payload").select(by, "event_type", "payload")
    return rows.mapInArrow(chain, f"`{by}` {kind}, sequence int, event_type string, payload string, event_hash string, prev_hash string")


def verify(chain: DataFrame, by: str = "case_id") -> DataFrame:
    """Per case: valid, length, broken_at, reason.  Every link is checked by itself, as each row holds the hash before it.

    The first break counts; at one place a wrong previous hash comes before a wrong hash.
    """
    w = Window.partitionBy(by).orderBy("sequence")
    linked = chain.withColumn("before", F.lag("event_hash", 1, GENESIS).over(w)).withColumn("place", F.row_number().over(w) - 1)
    reason = F.when(~F.col("prev_hash").eqNullSafe(F.col("before")), "prev_hash mismatch").when(~F.col("event_hash").eqNullSafe(event_hash(F.col("before"), F.col("payload"))), "event_hash mismatch")
    per = linked.withColumn("reason", reason).groupBy(by).agg(F.count("*").alias("length"), F.min(F.when(F.col("reason").isNotNull(), F.struct("place", "reason"))).alias("bad"))
    return per.select(by, F.col("bad").isNull().alias("valid"), "length", F.col("bad.place").alias("broken_at"), F.col("bad.reason").alias("reason"))


#: Which parts of a payload become which fields of the state.
BUILDERS = {
    "quality_check": {"quality_passed": "passed", "quality_meta": "details"},
    "classification": {"doc_type": "doc_type", "rotation_hint": "rotation"},
    "extraction": {"extraction_path": "path", "yolo_confidence": "yolo_confidence", "vlm_confidence": "vlm_confidence"},
    "validation": {"schema_valid": "valid", "validation_score": "score"},
    "forensics": {"spoof_score": "spoof_score", "forensics_result": "details"},
    "policy_check": {"policy_compliant": "compliant"},
    "cross_doc_check": {"cross_doc_consistency": "consistency_score"},
    "decision": {"decision": "outcome", "final_confidence": "final_confidence"},
    "review": {"review_outcome": "outcome", "reviewer": "reviewer", "review_notes": "notes"},
}
_DEFAULTS = {"passed": "false", "details": "{}", "yolo_confidence": "0.0", "vlm_confidence": "0.0", "valid": "false", "score": "0.0", "spoof_score": "0.0", "compliant": "true", "consistency_score": "1.0", "final_confidence": "0.0", "notes": ""}


def replay(chain: DataFrame, by: str = "case_id", up_to: int | None = None) -> DataFrame:
    """Per case the state (map of strings), the corrections in order and the types replayed, of the first `up_to` events.

    The last event of a type decides, so no fold over rows is needed; unknown types are only recorded.
    """
    rows = chain if up_to is None else chain.where(F.col("sequence") < up_to)
    last = rows.groupBy(by, "event_type").agg(F.max_by("payload", "sequence").alias("payload"))
    entries = F
    for kind, parts in BUILDERS.items():
        made = [F.struct(F.lit(k).alias("key"), F.coalesce(F.get_json_object("payload", f"$.{p}"), F.lit(_DEFAULTS.get(p))).alias("value")) for k, p in parts.items()]
        entries = entries.when(F.col("event_type") == kind, F.array(*made))
    state = last.select(by, F.explode(entries).alias("e")).groupBy(by).agg(F.map_from_entries(F.collect_list("e")).alias("state"))
    fields = {"field": "field_name", "original": "original_value", "corrected": "corrected_value", "reviewer": "reviewer"}
    correction = F.when(F.col("event_type") == "correction", F.struct("sequence", *[F.get_json_object("payload", f"$.{p}").alias(k) for k, p in fields.items()]))
    seen = rows.groupBy(by).agg(F.array_sort(F.collect_list(correction)).alias("corrections"), F.transform(F.array_sort(F.collect_list(F.struct("sequence", "event_type"))), lambda x: x["event_type"]).alias("events_replayed"))
    return seen.join(state, by, "left").select(by, F.coalesce("state", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("state"), "corrections", "events_replayed")


def diff(chain: DataFrame, a: int, b: int, by: str = "case_id") -> DataFrame:
    """(case, key, before, after) of what differs between the states after `a` and after `b` events."""

    def entries(up_to: int, name: str) -> DataFrame:
        r = replay(chain, by, up_to)
        fixed = r.select(by, F.explode("state").alias("key", name))
        moved = r.where(F.size("corrections") > 0).select(by, F.lit("corrections").alias("key"), F.to_json("corrections").alias(name))
        return fixed.unionByName(moved)

    both = entries(a, "before").join(entries(b, "after"), [by, "key"], "full_outer")
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


_SHORT = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r", 34: '"', 92: "\\"}


def json_string(c: Column) -> Column:
    """A JSON string of ASCII: quotes, backslashes, controls and all beyond ASCII are escaped, in lower-case hexadecimal."""
    code = lambda ch: F.ascii(ch)
    four = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def escaped(ch: Column) -> Column:
        n = code(ch)
        out = F.when(n > 0xFFFF, F.concat(four(F.shiftright(n - 0x10000, 10) + 0xD800), four((n - 0x10000).bitwiseAND(0x3FF) + 0xDC00)))
        for k, letter in _SHORT.items():
            out = out.when(n == k, F.lit("\\" + letter))
        return out.when((n < 32) | (n > 126), four(n)).otherwise(ch)

    s = c.cast("string")
    return F.concat(F.lit('"'), F.when(s.rlike(r'^[ !#-\[\]-~]*\z'), s).otherwise(F.array_join(F.transform(F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0)), escaped), "")), F.lit('"'))


def canonical_json(pairs: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys from columns of strings, or, as (column, True), of numbers and booleans; nulls are null."""

    def value(c: Column) -> Column:
        return F.coalesce(json_string(c), F.lit("null"))

    parts = []
    for k in sorted(pairs):
        c, raw = pairs[k] if isinstance(pairs[k], tuple) else (pairs[k], False)
        parts.append(F.concat(F.lit(f'"{k}":'), F.coalesce(c.cast("string"), F.lit("null")) if raw else value(c)))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def events_of_state(state: DataFrame, by: str = "case_id") -> DataFrame:
    """(case, ordinal, event_type, payload): the events that a finished case logs, in a fixed order, each only if there is something to log.

    Needs quality_passed, quality_reason, doc_type, rotation, extraction_path, field_count, is_valid, score, message,
    spoof_score, compliant, consistency_score, contradictions, cross_doc_recommendation, decision, confidence.
    """
    raw = lambda c: (F.col(c), True)
    made = [
        ("quality_check", F.col("quality_passed").isNotNull(), {"passed": raw("quality_passed"), "details": F.col("quality_reason")}),
        ("classification", F.coalesce("doc_type", F.lit("")) != "", {"doc_type": F.col("doc_type"), "rotation": F.coalesce("rotation", F.lit("rot0"))}),
        ("extraction", F.col("field_count") > 0, {"path": F.coalesce("extraction_path", F.lit("yolo")), "field_count": raw("field_count")}),
        ("validation", F.col("is_valid").isNotNull(), {"valid": raw("is_valid"), "score": raw("score"), "message": F.col("message")}),
        ("forensics", F.col("spoof_score").isNotNull(), {"spoof_score": raw("spoof_score")}),
        ("policy_check", F.col("compliant").isNotNull(), {"compliant": raw("compliant")}),
        ("cross_doc_check", F.col("consistency_score").isNotNull(), {"consistency_score": raw("consistency_score"), "contradictions": raw("contradictions"), "recommendation": F.col("cross_doc_recommendation")}),
        ("decision", F.coalesce("decision", F.lit("")) != "", {"outcome": F.col("decision"), "final_confidence": raw("confidence")}),
    ]
    entries = [F.when(when, F.struct(F.lit(k).alias("event_type"), canonical_json(parts).alias("payload"))) for k, when, parts in made]
    return state.select(by, F.posexplode(F.array_compact(F.array(*entries))).alias("ordinal", "e")).select(by, "ordinal", "e.*")
