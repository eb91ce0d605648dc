"""The given tables in the roles of the data model: streams, messages, fills, forests, cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplework.operators.cascades import bin_width, quiet_time_cascades
from ripplework.operators.sequence import arrange, has_hot_group
from ripplework.operators.shape import relative_times, stream_spans
from ripplework.sources.capture import TRADE_TYPE, parse_capture, trades
from ripplework.sources.fills import decode_fills

HOUR = 3.6e9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros() -> F.Column:
    return F.unix_micros(F.col("ts").cast("timestamp"))


def events_by(spark: SparkSession, sf_dir: str, key: str = "user_id", unit: float = HOUR) -> DataFrame:
    """``events(stream_id, event_id, t)`` with time in hours since the stream's first event."""
    rows = table(spark, sf_dir, "events").select(
        F.col(key).cast("string").alias("stream_id"), "event_id", "user_id", "event_type", "value",
        micros().alias("us"),
    )
    return relative_times(rows, "us", unit)


def is_hot(spark: SparkSession, sf_dir: str, key: str = "user_id") -> bool:
    """One cheap look at the source, so that everything derived from it need not look again."""
    return has_hot_group(table(spark, sf_dir, "events").select(key), [key])


def user_streams(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = events_by(spark, sf_dir).select("stream_id", "event_id", "t")
    return events, stream_spans(events)


def type_streams(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = events_by(spark, sf_dir, "event_type").select("stream_id", "event_id", "t")
    return events, stream_spans(events)


def capture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture lines made of the events, some of them broken in every way the reader must survive."""
    asset = F.concat(F.lit("m"), (F.col("user_id") % 20).cast("string"))
    us = F.col("us")
    # times on a 100 s grid, so that markets have ties
    ts_ms = F.floor(us / 100_000_000) * 100_000
    tx = F.concat(
        F.lit("h"),
        F.when(F.col("user_id") % 5 == 0, F.floor(F.col("event_id") / 40)).otherwise(F.col("event_id")).cast("string"),
    )
    kind = F.when(F.col("event_type") == "signup", "book").otherwise(TRADE_TYPE)
    price = F.floor(F.col("value") / 25).cast("string")
    stamp = F.when(F.col("event_id") % 79 == 3, "1e999").otherwise(ts_ms.cast("string"))
    recv = us / 1e6 + (F.col("event_id") % 3) * 0.25
    msg = F.struct(
        kind.alias("event_type"), asset.alias("asset_id"), stamp.alias("timestamp"), price.alias("price"),
        tx.alias("transaction_hash"),
    )
    listed = F.struct(
        kind.alias("event_type"), F.array(asset).alias("asset_id"), stamp.alias("timestamp"), price.alias("price"),
    )
    eid = F.col("event_id")
    line = (
        F.when(eid % 97 == 0, F.lit("{broken"))
        .when(eid % 89 == 1, F.to_json(F.struct(recv.alias("recv_ts"))))
        .when(eid % 83 == 2, F.to_json(F.struct(recv.alias("recv_ts"), listed.alias("msg"))))
        .otherwise(F.to_json(F.struct(recv.alias("recv_ts"), msg.alias("msg"))))
    )
    return table(spark, sf_dir, "events").withColumn("us", micros()).select(
        line.alias("line"), eid.alias("pos")
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = trades(parse_capture(capture_lines(spark, sf_dir)))
    return parsed.select("asset_id", "pos", "ts_ms", "price", "recv_ts", "transaction_hash")


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as fills: the line status chooses the money leg, the supplier is the market."""
    raw = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("market"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fill_id"),
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("block_time"),
        F.round(F.col("l_extendedprice") * 1e6).cast("decimal(38,0)").alias("_usdc"),
        F.round(F.col("l_quantity") * 1e6).cast("decimal(38,0)").alias("_shares"),
        (F.col("l_linestatus") == "F").alias("_on_maker"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("_asset"),
    )
    return raw.select(
        "market", "fill_id", "block_time",
        F.when(F.col("_on_maker"), F.lit("0")).otherwise(F.col("_asset")).alias("makerAssetId"),
        F.when(F.col("_on_maker"), F.col("_asset")).otherwise(F.lit("0")).alias("takerAssetId"),
        F.when(F.col("_on_maker"), F.col("_usdc")).otherwise(F.col("_shares")).alias("makerAmountFilled"),
        F.when(F.col("_on_maker"), F.col("_shares")).otherwise(F.col("_usdc")).alias("takerAmountFilled"),
    )


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_fills(fills(spark, sf_dir))


def reported_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the order totals a supplier takes part in, zero for every tenth supplier."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    total = lines.join(orders, "l_orderkey").groupBy("l_suppkey").agg(
        F.sum("o_totalprice").alias("_total")
    )
    return total.select(
        F.col("l_suppkey").cast("string").alias("market"),
        F.when(F.col("l_suppkey") % 10 == 0, 0.0).otherwise(F.col("_total") / 4).alias("reported_volume"),
    )


def forest(spark: SparkSession, sf_dir: str, key: str = "user_id") -> DataFrame:
    """``labeled_events``: every fifth event starts a tree, others reply up to three events back in it."""
    events = events_by(spark, sf_dir, key)
    hot = is_hot(spark, sf_dir, key)
    seq = arrange(events, ["stream_id"], ["t", "event_id"], blocked=hot).add(rn="_rn")
    seq = seq.transform(
        lambda d: d.withColumn(
            "_root", ((F.col("event_id") % 5 == 0) | (F.col("_rn") == 1)).cast("bigint")
        )
    ).add(sums={"_tree": "_root"})
    rows = seq.rows()
    roots = rows.where("_root = 1").select("stream_id", "_tree", F.col("_rn").alias("_root_rn"))
    rows = rows.join(roots, ["stream_id", "_tree"])
    parent = F.greatest(F.col("_root_rn"), F.col("_rn") - 1 - F.col("event_id") % 3)
    return rows.select(
        "stream_id",
        (F.col("_rn") - 1).alias("idx"),
        "t",
        F.when(F.col("_root") == 0, parent - 1).alias("parent_idx"),
        (F.col("_root_rn") - 1).alias("root_idx"),
        F.col("event_type").isin("click", "purchase").alias("is_update"),
        "event_id",
        "value",
    )


def cascades(spark: SparkSession, sf_dir: str, k: float = 1.0) -> DataFrame:
    """Quiet-time cascades of every user, with the set they are studied in and a censoring flag."""
    events, _ = user_streams(spark, sf_dir)
    hot = is_hot(spark, sf_dir)
    found = quiet_time_cascades(events, bin_width(events, k, blocked=hot), blocked=hot)
    return found.withColumns(
        {
            "set_id": F.concat(F.lit("s"), (F.col("stream_id").cast("bigint") % 2).cast("string")),
            "censored": (F.col("cascade_id") + F.col("stream_id").cast("bigint")) % 9 == 0,
        }
    )


def set_cascades(spark: SparkSession, sf_dir: str, k: float = 1.0) -> DataFrame:
    """Cascades of each set; user and number together name a cascade."""
    return cascades(spark, sf_dir, k).select(
        "set_id",
        F.concat_ws(":", "stream_id", F.col("cascade_id").cast("string")).alias("cascade_id"),
        "size", "duration", "censored",
    )
