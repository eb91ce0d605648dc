"""Structured Streaming forms: ingest, duplicate removal, live counts, windows, outages, intensity."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ripplework.functions.kernels import Kernel
from ripplework.functions.numeric import decayed_sums, stream_gaps
from ripplework.operators.excite import stack_kernels
from ripplework.sources.capture import parse_capture, trades


def capture_stream(spark: SparkSession, path: str, *, max_files: int | None = None) -> DataFrame:
    """Trade messages from a growing folder of capture files, with event and receive timestamps."""
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return with_event_time(trades(parse_capture(reader.load(path).withColumnRenamed("value", "line"))))


def with_event_time(messages: DataFrame) -> DataFrame:
    return messages.withColumns(
        {
            "event_time": F.timestamp_millis("ts_ms"),
            "recv_time": F.timestamp_micros((F.col("recv_ts") * 1_000_000).cast("bigint")),
        }
    )


def append_messages(messages: DataFrame, path: str, checkpoint: str, *, fmt: str = "parquet") -> StreamingQuery:
    """Append trades to ``path``; a restart with the same checkpoint loses and repeats nothing."""
    return (
        messages.writeStream.format(fmt)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def drop_repeats(messages: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """One message per transaction hash; state is dropped once the watermark passes."""
    return messages.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(
        ["asset_id", "transaction_hash"]
    )


def running_counts(messages: DataFrame, floor: int = 16_000) -> DataFrame:
    """Events, observed hours, rate and hours to the floor per market (update mode).

    Counts are merged per market from map-side partial sums, so a hot market costs one state row.
    """
    counts = messages.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.min("recv_ts").alias("_first"), F.max("recv_ts").alias("_last")
    )
    hours = (F.col("_last") - F.col("_first")) / 3600.0
    rate = F.try_divide(F.col("n_events").cast("double"), hours)
    missing = F.greatest(F.lit(floor) - F.col("n_events"), F.lit(0))
    return counts.select(
        "asset_id",
        "n_events",
        hours.alias("elapsed_hours"),
        rate.alias("rate_per_hour"),
        F.when(missing == 0, F.lit(0.0)).otherwise(F.try_divide(missing, rate)).alias("hours_to_floor"),
    )


def window_counts(messages: DataFrame, width: str, delay: str = "1 minute") -> DataFrame:
    """Events per market and tumbling window, emitted when the watermark closes the window."""
    return (
        messages.withWatermark("event_time", delay)
        .groupBy("asset_id", F.window("event_time", width).alias("w"))
        .agg(F.count(F.lit(1)).alias("cnt"))
        .select("asset_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "cnt")
    )


def closed_window_measures(windows: DataFrame, width_seconds: float) -> DataFrame:
    """Rate, Fano factor and mean-variance estimate over closed windows, quiet windows included."""
    span = F.unix_timestamp(F.max("window_end")) - F.unix_timestamp(F.min("window_start"))
    sums = windows.groupBy("asset_id").agg(
        F.round(span / F.lit(width_seconds)).cast("bigint").alias("n_windows"),
        F.sum("cnt").alias("_s1"),
        F.sum(F.col("cnt") * F.col("cnt")).alias("_s2"),
        F.max("cnt").alias("max_count"),
    )
    nb, s1, s2 = F.col("n_windows"), F.col("_s1"), F.col("_s2")
    mean = F.try_divide(s1.cast("double"), nb)
    var_pop = F.try_divide((nb * s2 - s1 * s1).cast("double"), nb * nb)
    var_samp = F.try_divide((nb * s2 - s1 * s1).cast("double"), nb * (nb - 1))
    return sums.select(
        "asset_id",
        "n_windows",
        (mean / F.lit(width_seconds / 3600.0)).alias("rate_per_hour"),
        F.when(nb >= 2, F.try_divide(var_pop, mean)).alias("fano"),
        F.when((nb >= 15) & (mean >= 5) & (var_samp > mean), 1.0 - F.sqrt(F.try_divide(mean, var_samp))).alias("n_hat"),
    )


def receive_sessions(messages: DataFrame, gap_s: float, delay: str = "1 minute") -> DataFrame:
    """Runs of receive times without ``gap_s`` seconds of silence over the whole capture.

    There is one session key, the capture. On a busy feed set
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` so that every partition
    merges its messages into sessions before the shuffle.
    """
    return (
        messages.withWatermark("recv_time", delay)
        .groupBy(
            F.col("asset_id").isNull().alias("capture"),  # the same for every trade
            F.session_window("recv_time", f"{int(gap_s * 1000)} milliseconds").alias("w"),
        )
        .agg(F.count(F.lit(1)).alias("n_events"), F.min("recv_ts").alias("run_start"), F.max("recv_ts").alias("run_end"))
        .select("run_start", "run_end", "n_events")
    )


class _Intensity(StatefulProcessor):
    """Carries (last time, decayed sums, events) per market between batches."""

    def __init__(self, rates: list[float], weights: list[list[float]]):
        self._rates, self._weights = rates, weights

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("state", "last_ms bigint, sums array<double>, n bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("ts_ms", kind="stable")
        rates, weights = np.asarray(self._rates), np.asarray(self._weights)
        ms = pdf["ts_ms"].to_numpy("int64")
        last_ms, carry, n = self._state.get() if self._state.exists() else (None, None, 0)
        late = np.zeros(ms.size, bool) if last_ms is None else ms < last_ms
        if late.any():
            # its place in the sums is past: shown as late, never moved to another time
            yield pd.DataFrame({"asset_id": key[0], "ts_ms": ms[late], "n_seen": None, "excitation": None, "late": True})
        ms = ms[~late]
        if not ms.size:
            return
        origin = int(ms[0]) if last_ms is None else int(last_ms)
        t = (ms - origin) / 1000.0
        label = np.zeros(t.size)
        gap = stream_gaps(label, t, None if last_ms is None else 0.0, 0.0)
        sums, last = decayed_sums(gap, rates, weights, None if carry is None else np.asarray(carry, float))
        self._state.update((int(ms[-1]), last.tolist(), int(n) + t.size))
        yield pd.DataFrame(
            {"asset_id": key[0], "ts_ms": ms, "n_seen": int(n) + 1 + np.arange(t.size), "excitation": sums[:, 0], "late": False}
        )

    def close(self) -> None:
        pass


def live_excitation(messages: DataFrame, kernel: Kernel) -> DataFrame:
    """Decayed self-excitation at every message, with state kept between batches.

    A message older than what its market has reached in an earlier batch is given back with ``late``
    set and without values; all others equal the batch result over the messages that were in time.

    Needs the RocksDB state store provider. Batches of one market arrive together, so the trigger
    bounds how much of a hot market one task sees.
    """
    rates, weights = stack_kernels([kernel])
    return messages.groupBy("asset_id").transformWithStateInPandas(
        statefulProcessor=_Intensity(rates.tolist(), weights.tolist()),
        outputStructType="asset_id string, ts_ms bigint, n_seen bigint, excitation double, late boolean",
        outputMode="Append",
        timeMode="None",
    )
