"""Queries that drive the streaming forms over capture files made of the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplework.functions.kernels import exponential
from ripplework.plans import frames as fr
from ripplework.plans.catalog import query
from ripplework.plans.ingest_queries import _ISLANDS, OUTAGE_GAP_S
from ripplework.plans.sql import MESSAGES, r, with_
from ripplework.session import scratch_path
from ripplework.streaming import live

WINDOW_HOURS = 12


def capture_files(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "feed")
    fr.capture_lines(spark, sf).select("line").write.text(path)
    return path


def drain(stream: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    """Run a stream over everything present and return what it wrote."""
    out = scratch_path(spark, "drained")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/_batch={batch_id}")  # a repeated batch replaces itself

    running = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", scratch_path(spark, "offsets"))
        .trigger(availableNow=True)
        .foreachBatch(keep)
        .start()
    )
    running.awaitTermination()
    return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, _batch int").parquet(out)


@query(
    "str01_continuous_ingest",
    with_(MESSAGES) + "SELECT asset_id, count(*) AS n_messages, min(ts_ms) AS first_ms FROM msg GROUP BY 1",
)
def _(spark, sf):
    out = scratch_path(spark, "ingested")
    feed = live.capture_stream(spark, capture_files(spark, sf))
    live.append_messages(feed, out, scratch_path(spark, "offsets")).awaitTermination()
    return spark.read.schema(feed.schema).parquet(out).groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("n_messages"), F.min("ts_ms").alias("first_ms")
    )


@query(
    "str02_drop_repeats",
    with_(MESSAGES) + "SELECT asset_id, count(DISTINCT transaction_hash) AS n_transactions FROM msg GROUP BY 1",
)
def _(spark, sf):
    feed = live.capture_stream(spark, capture_files(spark, sf))
    kept = drain(live.drop_repeats(feed, "60 days").select("asset_id", "transaction_hash"), spark)
    return kept.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n_transactions"))


@query(
    "str03_running_counts",
    with_(MESSAGES, "c AS (SELECT asset_id, count(*) AS n, (max(recv_ts) - min(recv_ts)) / 3600.0 AS h FROM msg GROUP BY 1)")
    + f"""SELECT asset_id, n AS n_events, {r('h', 'elapsed_hours', 4)}, {r('n / h', 'rate_per_hour', 4)},
    {r('CASE WHEN n >= 16000 THEN 0.0 ELSE (16000 - n) / (n / h) END', 'hours_to_floor', 4)} FROM c""",
    digits=4,
)
def _(spark, sf):
    feed = live.capture_stream(spark, capture_files(spark, sf))
    seen = drain(live.running_counts(feed), spark, "update")
    latest = F.max_by(F.struct("n_events", "elapsed_hours", "rate_per_hour", "hours_to_floor"), "_batch")
    return seen.groupBy("asset_id").agg(latest.alias("b")).select("asset_id", "b.*")


@query(
    "str04_window_measures",
    with_(
        MESSAGES,
        f"""w AS (SELECT asset_id, ts_ms // {WINDOW_HOURS * 3600 * 1000} AS w, count(*) AS c FROM msg GROUP BY 1, 2),
        closed AS (SELECT * FROM w WHERE (w + 1) * {WINDOW_HOURS * 3600 * 1000} <= (SELECT max(ts_ms) FROM msg) - 60000),
        m AS (SELECT asset_id, max(w) - min(w) + 1 AS nb, sum(c) AS s1, sum(c * c) AS s2 FROM closed GROUP BY 1)""",
    )
    + f"""SELECT asset_id, nb AS n_windows, {r(f's1 / nb / {WINDOW_HOURS}', 'rate_per_hour')},
    {r('CASE WHEN nb >= 2 THEN (nb * s2 - s1 * s1) / (nb * s1)::DOUBLE END', 'fano')} FROM m""",
)
def _(spark, sf):
    feed = live.capture_stream(spark, capture_files(spark, sf))
    windows = drain(live.window_counts(feed, f"{WINDOW_HOURS} hours"), spark).drop("_batch")
    return live.closed_window_measures(windows, WINDOW_HOURS * 3600.0).drop("n_hat")


@query(
    "str05_outage_sessions",
    with_(MESSAGES, _ISLANDS)
    + f"""SELECT {r('run_start', 'run_start', 3)}, {r('run_end', 'run_end', 3)}, n_events FROM isl
    WHERE run_end + {OUTAGE_GAP_S} <= (SELECT max(recv_ts) FROM msg) - 60""",
    digits=3,
)
def _(spark, sf):
    feed = live.capture_stream(spark, capture_files(spark, sf))
    return drain(live.receive_sessions(feed, OUTAGE_GAP_S), spark).drop("_batch")


@query(
    "str06_live_excitation",
    with_(
        MESSAGES,
        """o AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY ts_ms, pos) AS rn FROM msg),
        x AS (SELECT i.asset_id, i.rn, coalesce(sum(0.0001 * exp(-0.0001 * (i.ts_ms - j.ts_ms) / 1000.0)), 0.0) AS s
          FROM o i LEFT JOIN o j ON i.asset_id = j.asset_id AND j.rn < i.rn GROUP BY 1, 2)""",
    )
    + f"SELECT asset_id, rn AS n_seen, {r('s', 'excitation')} FROM x",
)
def _(spark, sf):
    previous = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    try:
        feed = live.capture_stream(spark, capture_files(spark, sf))
        seen = drain(live.live_excitation(feed, exponential(0.0001)), spark)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", previous)
    return seen.where("NOT late").select("asset_id", "n_seen", "excitation")


