"""How many parts a table's rows are in."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of a part, by the optimiser's estimate, which goes by the files and is less than the rows take in memory.
PART = 4 << 20


def least_parts(rows: DataFrame) -> int:
    """Several parts for each core."""
    context = rows.sparkSession
    return max(4 * context.sparkContext.defaultParallelism, int(context.conf.get("spark.sql.shuffle.partitions")))


def many(rows: DataFrame) -> int:
    """Several parts for each core, and more where the rows are many, so that no task's share grows with the table.

    The estimate of a join's rows may be far too high: at most forty times as many parts.
    """
    least = least_parts(rows)
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, min(40 * least, size // PART))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows in many parts by their keys: a small file is one task else, however long each row takes."""
    return rows.repartition(many(rows), *keys)
