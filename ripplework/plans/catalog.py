"""Registry of queries over the given tables, each with its equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplework.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output: rounded doubles without NaN, whole numbers as BIGINT."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(F.when(~F.isnan(c), c), digits)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.DecimalType)):
            c = c.cast("bigint")
        out.append(c.alias(field.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register ``fn(spark, sf_dir)`` under ``name``, with the SQL it must agree with."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return tidy(fn(spark, sf_dir), digits)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register
