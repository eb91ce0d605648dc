"""From messages to per-market event sequences and their feed diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplework.operators.sequence import arrange, group_quantiles, has_hot_group
from ripplework.session import checkpointed

EVENT_UNITS = ("fill", "match", "transaction")


def market_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n_events"))


def at_least(rows: DataFrame, keys: list[str], floor: int) -> DataFrame:
    """Rows of the groups that hold at least ``floor`` rows (semi join on the group counts)."""
    kept = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= floor)
    return rows.join(kept.select(*keys), keys, "left_semi")


def tie_diagnostics(messages: DataFrame) -> DataFrame:
    """Largest number of messages in one millisecond and number of messages in shared ones."""
    per_ms = messages.groupBy("asset_id", "ts_ms").agg(F.count(F.lit(1)).alias("_c"))
    return per_ms.groupBy("asset_id").agg(
        F.max("_c").alias("max_ms_multiplicity"),
        F.sum(F.when(F.col("_c") > 1, F.col("_c")).otherwise(0)).alias("n_tied_events"),
    )


def to_event_unit(messages: DataFrame, unit: str = "fill") -> DataFrame:
    """``fill`` keeps every message; ``match`` keeps one per (asset, ms); ``transaction`` one per hash."""
    if unit not in EVENT_UNITS:
        raise ValueError(f"event unit must be one of {EVENT_UNITS}, got {unit!r}")
    if unit == "fill":
        return messages
    if unit == "match":
        return messages.select("asset_id", "ts_ms").distinct()
    return messages.groupBy("asset_id", "transaction_hash").agg(F.min("ts_ms").alias("ts_ms"))


def market_times(messages: DataFrame) -> DataFrame:
    """Seconds since the market's first message, with its horizon and origin."""
    span = messages.groupBy("asset_id").agg(
        F.min("ts_ms").alias("_t0"), F.max("ts_ms").alias("_t1")
    )
    return (
        messages.join(span, "asset_id")
        .withColumns(
            {
                "t": (F.col("ts_ms") - F.col("_t0")) / F.lit(1000.0),
                "horizon": (F.col("_t1") - F.col("_t0")) / F.lit(1000.0),
                "t0_unix_s": F.col("_t0") / F.lit(1000.0),
            }
        )
        .drop("_t0", "_t1")
    )


def repeated_prices(messages: DataFrame, *, blocked: bool | None = None) -> DataFrame:
    """Messages whose price equals the one before; ties in time keep the file order (``pos``)."""
    seq = arrange(messages, ["asset_id"], ["ts_ms", "pos"], blocked=blocked)
    rows = seq.add(lags={"_prev": "price"}).rows()
    return rows.groupBy("asset_id").agg(
        F.count_if(F.col("price") == F.col("_prev")).alias("n_dup_price_consecutive")
    )


#: a time range of one level holds ``2 ** RANGE_BITS`` of those below it; ``RANGE_LEVELS`` of them cover all of a long
RANGE_BITS = 16
RANGE_LEVELS = 4


def _numbered(buckets: DataFrame, gap_s: float, bits: int, levels: int) -> DataFrame:
    """``buckets(_id, _first, _last, _n)`` with ``run_id``, the number of gaps above ``gap_s`` before each.

    A range of times is summed up by its first and last time and the gaps inside, and neighbouring ranges
    combine to the same three. Going up, ranges become the rows of larger ranges; going down, each learns the last
    time and the gaps before it. A window holds at most the ``2 ** bits`` rows of one range.
    """
    inside = Window.partitionBy("_up").orderBy("_id")
    wide = F.lit(float(gap_s))
    up = F.shiftright("_id", bits).alias("_up")

    def broken(before):
        return F.coalesce(F.col("_first") - before > wide, F.lit(False)).cast("bigint")

    tables = [buckets.withColumn("_breaks", F.lit(0).cast("bigint"))]
    for _ in range(levels - 1):
        rows = tables[-1].select("*", up).withColumn("_gap", broken(F.lag("_last").over(inside)))
        summed = rows.groupBy("_up").agg(
            F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.sum(F.col("_breaks") + F.col("_gap")).alias("_breaks")
        )
        tables.append(summed.withColumnRenamed("_up", "_id"))
    # the ranges of the highest level lie side by side in one window
    top = tables.pop()
    rows = top.withColumns({"_up": F.lit(0), "_before": F.lit(None).cast("double"), "_runs": F.lit(0).cast("bigint")})
    while True:
        rows = rows.withColumn("_before", F.coalesce(F.lag("_last").over(inside), "_before"))
        rows = rows.withColumn("_gap", broken(F.col("_before")))
        rows = rows.withColumn("_start", F.col("_runs") + F.sum(F.col("_gap") + F.col("_breaks")).over(inside) - F.col("_breaks"))
        if not tables:
            return rows.withColumnRenamed("_start", "run_id")
        # the gap that opens a range is counted by the first row inside
        known = rows.select(F.col("_id").alias("_up"), "_before", (F.col("_start") - F.col("_gap")).alias("_runs"))
        rows = tables.pop().select("*", up).join(known, "_up")


def receive_runs(messages: DataFrame, gap_s: float, *, bits: int = RANGE_BITS, levels: int = RANGE_LEVELS) -> DataFrame:
    """Capture-wide runs of receive times without a gap above ``gap_s``.

    Two times in one bucket of width ``gap_s`` cannot be further apart than the gap, so runs are
    found on one row per bucket, and buckets are numbered range by range: no task holds the whole feed.
    """
    buckets = (
        messages.where(F.col("recv_ts").isNotNull())
        .groupBy(F.floor(F.col("recv_ts") / F.lit(float(gap_s))).alias("_id"))
        .agg(
            F.min("recv_ts").cast("double").alias("_first"),
            F.max("recv_ts").cast("double").alias("_last"),
            F.count(F.lit(1)).alias("_n"),
        )
    )
    return (
        _numbered(checkpointed(buckets), gap_s, bits, levels)
        .groupBy("run_id")
        .agg(
            F.min("_first").alias("run_start"),
            F.max("_last").alias("run_end"),
            F.sum("_n").alias("n_events"),
        )
    )


def outage_filter(messages: DataFrame, gap_s: float) -> DataFrame:
    """Keep the run with most messages (earliest on ties); keep all when nothing has a receive time."""
    best = (
        receive_runs(messages, gap_s)
        .orderBy(F.desc("n_events"), F.asc("run_start"))
        .limit(1)
        .select("run_start", "run_end")
    )
    bounds = best.agg(F.first("run_start").alias("_lo"), F.first("run_end").alias("_hi"))
    inside = F.col("recv_ts").between(F.col("_lo"), F.col("_hi"))
    return (
        messages.join(F.broadcast(bounds))  # exactly one row
        .where(F.col("_lo").isNull() | inside)
        .drop("_lo", "_hi")
    )


def clean_stream(messages: DataFrame) -> DataFrame:
    """Per market: are transaction hashes present and one to one with messages."""
    per_hash = messages.groupBy("asset_id", "transaction_hash").agg(F.count(F.lit(1)).alias("_c"))
    return per_hash.groupBy("asset_id").agg(
        F.sum("_c").alias("n_messages"),
        ((F.max("_c") == 1) & (F.count_if(F.col("transaction_hash").isNull()) == 0)).alias("clean"),
    )


def market_stats(messages: DataFrame, unit: str = "fill", *, blocked: bool | None = None) -> DataFrame:
    """One row per market; diagnostics stay at message level whatever the event unit."""
    times = market_times(to_event_unit(messages, unit))
    base = times.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.first("horizon").alias("horizon"),
        F.first("t0_unix_s").alias("t0_unix_s"),
    )
    return base.join(tie_diagnostics(messages), "asset_id").join(
        repeated_prices(messages, blocked=blocked), "asset_id"
    )


def feed_quality(messages: DataFrame, *, blocked: bool | None = None) -> DataFrame:
    """Messages per transaction, gap variation, and how equal-price neighbours behave."""
    if blocked is None:
        blocked = has_hot_group(messages, ["asset_id"])
    seq = arrange(messages, ["asset_id"], ["ts_ms", "pos"], blocked=blocked)
    rows = seq.add(
        lags={"_ts": "ts_ms", "_price": "price", "_hash": "transaction_hash"}
    ).rows()
    same = F.col("price") == F.col("_price")
    rows = rows.withColumns(
        {
            "_gap": (F.col("ts_ms") - F.col("_ts")) / F.lit(1000.0),
            "_same_gap": F.when(same, (F.col("ts_ms") - F.col("_ts")) / F.lit(1000.0)),
        }
    )
    per_hash = messages.groupBy("asset_id", "transaction_hash").agg(F.count(F.lit(1)).alias("_c"))
    per_tx = per_hash.where(F.col("transaction_hash").isNotNull()).groupBy("asset_id").agg(
        F.sum("_c").alias("_with_hash"),
        F.count(F.lit(1)).alias("n_transactions"),
        F.max("_c").alias("max_per_transaction"),
    )
    base = rows.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.try_divide(F.stddev_pop("_gap"), F.avg("_gap")).alias("gap_cv"),
        F.count_if(same & (F.col("transaction_hash") == F.col("_hash"))).alias("n_same_price_same_tx"),
        F.count_if(same).alias("n_same_price"),
    )
    medians = group_quantiles(
        rows, ["asset_id"], "_same_gap", {"same_price_gap_median": 0.5}, blocked=blocked
    )
    return (
        base.join(per_tx, "asset_id", "left")
        .join(medians, "asset_id", "left")
        .withColumn("messages_per_transaction", F.try_divide("_with_hash", "n_transactions"))
        .drop("_with_hash")
    )


def order_preservation(messages: DataFrame, *, blocked: bool | None = None) -> DataFrame:
    """Does the server-time order match the receive order, and how fine are the gaps."""
    if blocked is None:
        blocked = has_hot_group(messages, ["asset_id"])
    received = messages.where(F.col("recv_ts").isNotNull())
    seq = arrange(received, ["asset_id"], ["recv_ts", "pos"], blocked=blocked)
    rows = seq.add(lags={"_ts": "ts_ms"}).rows()
    rows = rows.withColumn("_gap", F.col("ts_ms") - F.col("_ts"))
    sub = F.pmod(F.col("ts_ms"), F.lit(1000))
    frames = (
        received.groupBy("asset_id", "recv_ts")
        .agg(F.count(F.lit(1)).alias("_c"))
        .groupBy("asset_id")
        .agg(F.max("_c").alias("max_per_frame"))
    )
    base = rows.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.min(sub).alias("subsecond_min_ms"),
        F.max(sub).alias("subsecond_max_ms"),
        F.count_if(F.col("_gap") < 0).alias("n_inversions"),
        F.min(F.when(F.col("_gap") >= 0, F.col("_gap"))).alias("gap_min_ms"),
        F.avg((F.col("_gap") < 2000).cast("double")).alias("share_under_2s"),
    )
    medians = group_quantiles(rows, ["asset_id"], "_gap", {"gap_median_ms": 0.5}, blocked=blocked)
    return base.join(frames, "asset_id").join(medians, "asset_id", "left")
