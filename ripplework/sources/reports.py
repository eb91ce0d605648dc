"""Dated result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(result: DataFrame, path: str, run_date: str) -> None:
    """Write one run's result under ``run_date=..``; rerunning a date replaces only that date."""
    (
        result.withColumn("run_date", F.lit(run_date))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_date")
        .parquet(path)
    )
