"""The buffer of observations against the reference's loop."""

import pytest

from idloom.plans import tables


@pytest.mark.parametrize("n", [60, 10000, 10001, 12000, 15001, 15002])
def test_buffer_keeps_what_the_loop_keeps(spark, n):
    held = []
    for i in range(n):
        held.append(i)
        if len(held) > 10000:
            held = held[-5000:]
    events = spark.range(n).selectExpr("'a' AS event_type", "id AS event_id", "id AS ts")
    assert sorted(r.event_id for r in tables.retained(events).collect()) == held
