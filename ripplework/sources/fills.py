"""Decoded on-chain fills: explicit schema, decode, relative times and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the money leg's asset id and the number of decimals of both legs
MONEY_ASSET_ID = "0"
DECIMALS = 6

FILL_SCHEMA = T.StructType(
    [
        T.StructField("market", T.StringType()),
        T.StructField("fill_id", T.LongType()),
        T.StructField("block_time", T.LongType()),
        T.StructField("makerAssetId", T.StringType()),
        T.StructField("takerAssetId", T.StringType()),
        T.StructField("makerAmountFilled", T.DecimalType(38, 0)),
        T.StructField("takerAmountFilled", T.DecimalType(38, 0)),
    ]
)


def read_fills(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(FILL_SCHEMA).load(path)


def decode_fills(fills: DataFrame, *, strict: bool = True) -> DataFrame:
    """Add ``usdc``, ``shares`` and ``price``; a fill without a money leg raises when strict."""
    on_maker = F.col("makerAssetId") == MONEY_ASSET_ID
    on_taker = F.col("takerAssetId") == MONEY_ASSET_ID
    no_leg = (
        F.raise_error(F.concat(F.lit("neither leg is money: "), F.to_json(F.struct("*"))))
        if strict
        else F.lit(None)
    ).cast("decimal(38,0)")
    maker, taker = F.col("makerAmountFilled"), F.col("takerAmountFilled")
    usdc = F.when(on_maker, maker).when(on_taker, taker).otherwise(no_leg)
    shares = F.when(on_maker, taker).when(on_taker, maker)
    scale = F.lit(10.0**DECIMALS)
    return fills.withColumns(
        {"_usdc_units": usdc, "usdc": usdc.cast("double") / scale, "shares": shares.cast("double") / scale}
    ).withColumn("price", F.try_divide(F.col("usdc"), F.col("shares")))


def fill_times(decoded: DataFrame) -> DataFrame:
    """Seconds since the market's first fill, with the market's horizon; ties are kept."""
    span = decoded.groupBy("market").agg(
        F.min("block_time").alias("_t0"),
        (F.max("block_time") - F.min("block_time")).cast("double").alias("horizon"),
    )
    return (
        decoded.join(span, "market")
        .withColumn("t", (F.col("block_time") - F.col("_t0")).cast("double"))
        .drop("_t0")
    )


def reconcile(decoded: DataFrame, reported: DataFrame) -> DataFrame:
    """Traded money per market against its reported volume; ratio is NULL for zero volume."""
    totals = decoded.groupBy("market").agg(
        # whole units are summed exactly, in any order
        (F.sum("_usdc_units").cast("double") / F.lit(10.0**DECIMALS)).alias("notional"), F.count(F.lit(1)).alias("n_events")
    )
    return totals.join(reported, "market", "left").withColumn(
        "reconciliation_ratio", F.try_divide("notional", F.col("reported_volume"))
    )
