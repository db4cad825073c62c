"""SQL names for the scalar operators, and pluggable models."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from idloom.functions import similarity


def register(spark: SparkSession) -> list[str]:
    """Make the similarities callable from SQL as id_<name>; the other functions are expressions of builtins."""
    made = []
    for name, fn in {"seq_ratio": similarity.seq_ratio_of, "jaro_winkler": similarity.jaro_winkler_of}.items():
        spark.udf.register(f"id_{name}", similarity._pairwise(fn))
        made.append(f"id_{name}")
    return made


@dataclass
class Plugins:
    """Models that a caller brings: functions over batches of Python values, run as Arrow functions.

    Each has the inputs and the Spark type of its result.  A missing plugin gives nulls, so that a stage without its model is
    skipped as in a deployment that has none.
    """

    models: dict[str, tuple[Callable, str]] = field(default_factory=dict)

    def add(self, name: str, fn: Callable, returns: str) -> Plugins:
        self.models[name] = (fn, returns)
        return self

    def call(self, name: str, *columns: Column, returns: str = "string") -> Column:
        if name not in self.models:
            return F.lit(None).cast(returns)
        fn, kind = self.models[name]

        def run(*arrays: pa.Array) -> pa.Array:
            return pa.array([fn(*row) for row in zip(*(a.to_pylist() for a in arrays))])

        if len(columns) == 1:
            return F.arrow_udf(lambda a: run(a), kind)(*columns)
        return F.arrow_udf(lambda a, b: run(a, b), kind)(*columns)
