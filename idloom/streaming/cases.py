"""Progress of cases as streams: completion of documents, a ledger that grows, windows of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from idloom.operators.ledger import GENESIS

PROGRESS = "case_id string, event string, done bigint, expected bigint"


def case_progress(events: DataFrame, timeout_ms: int = 120_000) -> DataFrame:
    """A stream of (case_id, event, done, expected): started, document_complete, case_complete or timeout.

    events: (case_id, job_id, expected).  A job that ends twice counts once; after completion a case's state goes.  A case
    that isn't complete `timeout_ms` after its last event times out.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def row(event: str, done: int, expected: int) -> pd.DataFrame:
            return pd.DataFrame({"case_id": [key[0]], "event": [event], "done": [done], "expected": [expected]})

        if state.hasTimedOut:
            jobs, expected = state.get
            state.remove()
            yield row("timeout", len([j for j in jobs.split("\n") if j]), expected)
            return
        jobs, expected = state.get if state.exists else ("", 0)
        seen, fresh = {j for j in jobs.split("\n") if j}, not state.exists
        for pdf in batches:
            if fresh and len(pdf):
                fresh = False
                yield row("started", 0, int(pdf.expected.max()))
            for job, n in sorted(zip(pdf.job_id, pdf.expected)):
                expected = max(expected, int(n))
                if job is not None and job not in seen:
                    seen.add(job)
                    yield row("document_complete", len(seen), expected)
        if expected and len(seen) >= expected:
            if state.exists:
                state.remove()
            yield row("case_complete", len(seen), expected)
        else:
            state.update(("\n".join(sorted(seen)), expected))
            state.setTimeoutDuration(timeout_ms)

    return events.groupBy("case_id").applyInPandasWithState(step, PROGRESS, "jobs string, expected bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


CHAIN = "case_id string, sequence bigint, event_type string, payload string, event_hash string, prev_hash string"


def streaming_ledger(events: DataFrame) -> DataFrame:
    """Chain each case's events as they come; the state of a case is its length and last hash.

    events: (case_id, ordinal, event_type, payload).  Events of one batch are chained by ordinal.
    """
    import hashlib

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, head = state.get if state.exists else (0, GENESIS)
        rows = pd.concat(list(batches)).sort_values("ordinal", kind="stable")
        out = []
        for kind, payload in zip(rows.event_type, rows.payload):
            new = hashlib.sha256(f"{head}||{payload}".encode()).hexdigest()
            out.append((key[0], n, kind, payload, new, head))
            n, head = n + 1, new
        state.update((n, head))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHAIN.split(", ")])

    return events.groupBy("case_id").applyInPandasWithState(step, CHAIN, "n bigint, head string", "append", GroupStateTimeout.NoTimeout)


def append_sink(stream: DataFrame, path: str, checkpoint: str, until_empty: bool = True):
    """Append each batch of a stream as Parquet, once, and return the running query.

    With until_empty it ends when the source has no more.  `case_progress` has timeouts by the clock, for which batches go on
    without data: it needs until_empty=False, and runs until it is stopped.
    """
    out = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if until_empty else out.trigger(processingTime="1 second")).start()


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type, with a watermark; works on tables too."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("begin"), "event_type", "n", "total")
