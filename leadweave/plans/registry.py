"""The query registry: one Spark function and, where possible, one SQL text per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadweave.plans.inputs import Inputs, duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_DUCK_TYPES = {"long": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def query(key: str, out: str, sql: str | None = None) -> Callable:
    """Register a query. ``out`` ('name type, ...') fixes the column types of both sides."""
    columns = [tuple(part.split()) for part in out.split(",")]

    def register(function: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(Inputs(spark, folder)).select(*[F.col(n).cast(t).alias(n) for n, t in columns])

        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = run
        if sql is not None:
            casts = ", ".join(f"CAST({n} AS {_DUCK_TYPES[t]}) AS {n}" for n, t in columns)
            ORACLES[key] = f"SELECT {casts} FROM (\n{duck(sql)}\n) AS result"
        return function

    return register
