"""Queries over messages, fills and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplework.operators import ingest, validate
from ripplework.operators.cascades import bin_width
from ripplework.operators.shape import first_events, quantize, tie_fraction, time_slice
from ripplework.plans import frames as fr
from ripplework.plans.catalog import query
from ripplework.session import checkpointed, scratch_path
from ripplework.plans.sql import CASCADES, EV, FILLS, FOREST, MESSAGES, RANKED, r, with_
from ripplework.sources.capture import line_report, parse_capture
from ripplework.sources.fills import fill_times, read_fills, reconcile
from ripplework.sources.reports import write_report

OUTAGE_GAP_S = 1200.0


@query("src01_line_report", with_(MESSAGES) + "SELECT status, count(*) AS n_lines FROM lines GROUP BY 1")
def _(spark, sf):
    return line_report(parse_capture(fr.capture_lines(spark, sf)))


@query(
    "src01_trade_messages",
    with_(MESSAGES) + f"SELECT asset_id, pos, ts_ms, price, {r('recv_ts', 'recv_ts', 3)}, transaction_hash FROM msg",
    digits=3,
)
def _(spark, sf):
    return fr.messages(spark, sf)


@query(
    "src02_market_transactions",
    with_(MESSAGES)
    + """SELECT asset_id, count(*) AS n_messages, count(DISTINCT transaction_hash) AS n_hashes
    FROM msg GROUP BY 1""",
)
def _(spark, sf):
    return fr.messages(spark, sf).groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("n_messages"), F.countDistinct("transaction_hash").alias("n_hashes")
    )


@query(
    "src03_read_fills",
    with_(FILLS)
    + """SELECT market, count(*) AS n_fills, min(block_time) AS first_block, max(block_time) AS last_block
    FROM fills GROUP BY 1""",
)
def _(spark, sf):
    path = scratch_path(spark, "fills")
    fr.fills(spark, sf).write.parquet(path)
    return read_fills(spark, path).groupBy("market").agg(
        F.count(F.lit(1)).alias("n_fills"),
        F.min("block_time").alias("first_block"),
        F.max("block_time").alias("last_block"),
    )


@query(
    "snk01_append_capture",
    with_(MESSAGES) + "SELECT asset_id, count(*) AS n_messages, min(ts_ms) AS first_ms FROM msg GROUP BY 1",
)
def _(spark, sf):
    from ripplework.sources.capture import read_capture_lines, trades, write_capture

    path = scratch_path(spark, "capture")
    rows = fr.messages(spark, sf).select(
        "recv_ts",
        F.struct(
            F.lit("last_trade_price").alias("event_type"), "asset_id",
            F.col("ts_ms").cast("string").alias("timestamp"), "price", "transaction_hash",
        ).alias("msg"),
    )
    write_capture(rows, path)
    back = trades(parse_capture(read_capture_lines(spark, path)))
    return back.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n_messages"), F.min("ts_ms").alias("first_ms"))


@query(
    "snk02_dated_report",
    with_(MESSAGES) + "SELECT asset_id, count(*) AS n_events, '2024-02-01' AS run_date FROM msg GROUP BY 1",
)
def _(spark, sf):
    path = scratch_path(spark, "report")
    write_report(ingest.market_counts(fr.messages(spark, sf)), path, "2024-02-01")
    return spark.read.parquet(path).withColumn("run_date", F.col("run_date").cast("string"))


@query(
    "prj01_market_times",
    with_(MESSAGES)
    + f"""SELECT asset_id, pos, {r('(ts_ms - min(ts_ms) OVER w) / 1000.0', 't', 3)},
    {r('(max(ts_ms) OVER w - min(ts_ms) OVER w) / 1000.0', 'horizon', 3)}
    FROM msg WINDOW w AS (PARTITION BY asset_id)""",
    digits=3,
)
def _(spark, sf):
    return ingest.market_times(fr.messages(spark, sf)).select("asset_id", "pos", "t", "horizon")


@query(
    "prj02_fill_values",
    with_(FILLS)
    + f"SELECT market, fill_id, {r('usdc', 'usdc')}, {r('shares', 'shares')}, {r('usdc / shares', 'price', 8)} FROM fills",
    digits=8,
)
def _(spark, sf):
    return fr.decoded(spark, sf).select("market", "fill_id", "usdc", "shares", "price")


@query(
    "prj03_fill_times",
    with_(FILLS)
    + f"""SELECT market, fill_id, {r('CAST(block_time - min(block_time) OVER w AS DOUBLE)', 't')},
    {r('CAST(max(block_time) OVER w - min(block_time) OVER w AS DOUBLE)', 'horizon')},
    {r('shares', 'shares')}, {r('usdc / shares', 'price', 8)} FROM fills WINDOW w AS (PARTITION BY market)""",
    digits=8,
)
def _(spark, sf):
    return fill_times(fr.decoded(spark, sf)).select("market", "fill_id", "t", "horizon", "shares", "price")


@query(
    "flt01_belief_updates",
    with_(EV, RANKED, FOREST) + f"SELECT stream_id, idx, {r('t', 't')} FROM forest WHERE is_update",
)
def _(spark, sf):
    from ripplework.operators.cascades import belief_updates

    return belief_updates(fr.forest(spark, sf)).select("stream_id", "idx", "t")


@query(
    "flt02_uncensored_cascades",
    "WITH " + CASCADES + " SELECT set_id, cascade_id, size, duration FROM clean",
)
def _(spark, sf):
    from ripplework.operators.scaling import uncensored

    return uncensored(fr.set_cascades(spark, sf)).drop("censored")


@query(
    "flt03_event_floor",
    with_(EV)
    + f"""SELECT stream_id, event_id, {r('t', 't')} FROM ev
    WHERE stream_id IN (SELECT stream_id FROM st WHERE n_events >= 70)""",
)
def _(spark, sf):
    events, _ = fr.user_streams(spark, sf)
    return ingest.at_least(events, ["stream_id"], 70)


@query(
    "flt04_first_events",
    with_(EV, RANKED) + f"SELECT stream_id, event_id, rn, {r('t', 't')} FROM rk WHERE rn <= 40",
)
def _(spark, sf):
    events, _ = fr.user_streams(spark, sf)
    return first_events(events, 40)


@query(
    "flt05_time_slices",
    with_(
        EV,
        """parts AS (SELECT stream_id, j AS slice_id, j * horizon / 3.0::DOUBLE AS lo,
        (j + 1) * horizon / 3.0::DOUBLE AS hi FROM st, (VALUES (0), (1), (2)) v(j)),
        cut AS (SELECT e.stream_id, p.slice_id, e.event_id, e.t FROM ev e JOIN parts p
          ON e.stream_id = p.stream_id AND e.t >= p.lo AND e.t < p.hi),
        span AS (SELECT stream_id, slice_id, min(t) AS t0, max(t) AS t1, count(*) AS n_events FROM cut GROUP BY 1, 2)""",
    )
    + f"""SELECT stream_id, slice_id, event_id, n_events,
    {r('CASE WHEN n_events >= 20 THEN t - t0 END', 't')}, {r('CASE WHEN n_events >= 20 THEN t1 - t0 END', 'horizon')}
    FROM cut JOIN span USING (stream_id, slice_id)""",
)
def _(spark, sf):
    events, streams = fr.user_streams(spark, sf)
    slices = streams.withColumn("slice_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(
        "stream_id",
        "slice_id",
        (F.col("slice_id") * F.col("horizon") / 3.0).alias("lo"),
        ((F.col("slice_id") + 1) * F.col("horizon") / 3.0).alias("hi"),
    )
    return time_slice(events, slices, min_events=20).select(
        "stream_id", "slice_id", "event_id", "n_events", "t", "horizon"
    )


@query(
    "val01_stream_rules",
    with_(
        EV,
        """gridded AS (SELECT stream_id, event_id, floor(t / 2.0) * 2.0::DOUBLE AS t FROM ev),
        ends AS (SELECT stream_id, 0.9 * horizon AS horizon FROM st),
        prior AS (SELECT *, lag(t) OVER (PARTITION BY stream_id ORDER BY t, event_id) AS prev FROM gridded)""",
    )
    + f"""SELECT stream_id, event_id, {r('t', 't')},
    CASE WHEN t <= prev THEN 'not_increasing' ELSE 'outside_horizon' END AS rule
    FROM prior JOIN ends USING (stream_id) WHERE t <= prev OR t > horizon""",
)
def _(spark, sf):
    events, streams = fr.user_streams(spark, sf)
    gridded = events.withColumn("t", quantize(F.col("t"), 2.0))
    return validate.stream_violations(
        gridded, streams.select("stream_id", (F.lit(0.9) * F.col("horizon")).alias("horizon"))
    )


@query(
    "val02_cascade_rules",
    "WITH " + CASCADES
    + """ SELECT set_id, cascade_id, size - 1 AS size, duration - 1 AS duration,
    CASE WHEN size - 1 < 1 THEN 'size_below_one' ELSE 'duration_below_one' END AS rule
    FROM clean WHERE size - 1 < 1 OR duration - 1 < 1""",
)
def _(spark, sf):
    from ripplework.operators.scaling import uncensored

    shifted = uncensored(fr.set_cascades(spark, sf)).drop("censored").withColumns(
        {"size": F.col("size") - 1, "duration": F.col("duration") - 1}
    )
    return validate.cascade_violations(shifted)


_TAMPERED = """
tampered AS (SELECT stream_id, idx, CASE WHEN event_id % 31 = 7 THEN idx + 1 ELSE parent_idx END AS parent_idx,
  CASE WHEN event_id % 37 = 5 THEN root_idx + 1 ELSE root_idx END AS root_idx FROM forest),
judged AS (SELECT c.*, CASE
  WHEN c.parent_idx IS NOT NULL AND c.parent_idx >= c.idx THEN 'parent_not_earlier'
  WHEN c.parent_idx IS NOT NULL AND p.root_idx IS NULL THEN 'parent_missing'
  WHEN c.parent_idx IS NULL AND c.root_idx <> c.idx THEN 'root_not_own'
  WHEN c.parent_idx IS NOT NULL AND c.root_idx <> p.root_idx THEN 'root_differs_from_parent' END AS rule
  FROM tampered c LEFT JOIN tampered p ON p.stream_id = c.stream_id AND p.idx = c.parent_idx)"""


@query(
    "val03_forest_rules",
    with_(EV, RANKED, FOREST, _TAMPERED)
    + "SELECT stream_id, idx, parent_idx, root_idx, rule FROM judged WHERE rule IS NOT NULL",
)
def _(spark, sf):
    eid = F.col("event_id")
    labeled = fr.forest(spark, sf).withColumns(
        {
            "parent_idx": F.when(eid % 31 == 7, F.col("idx") + 1).otherwise(F.col("parent_idx")),
            "root_idx": F.when(eid % 37 == 5, F.col("root_idx") + 1).otherwise(F.col("root_idx")),
        }
    )
    return validate.forest_violations(labeled)


@query(
    "val04_width_rules",
    with_(
        EV,
        """coarse AS (SELECT stream_id, event_id, floor(t / 24.0) * 24.0::DOUBLE AS t FROM ev),
        g AS (SELECT *, t - lag(t) OVER (PARTITION BY stream_id ORDER BY t, event_id) AS gap FROM coarse),
        w AS (SELECT stream_id, count(*) AS n_events, median(gap) AS dt FROM g GROUP BY 1)""",
    )
    + f"SELECT stream_id, n_events, {r('dt', 'dt')}, 'width_not_positive' AS rule FROM w WHERE dt <= 0",
)
def _(spark, sf):
    events, _ = fr.user_streams(spark, sf)
    return validate.width_violations(bin_width(events.withColumn("t", quantize(F.col("t"), 24.0)), 1.0))


@query(
    "val05_window_rules",
    with_(EV)
    + f"""SELECT stream_id, {r('horizon', 'horizon')}, w AS window_size, 'window_not_positive' AS rule
    FROM st, (VALUES (24.0::DOUBLE), (0.0::DOUBLE), (-1.0::DOUBLE)) v(w) WHERE w <= 0 AND horizon > 0""",
)
def _(spark, sf):
    _, streams = fr.user_streams(spark, sf)
    return validate.window_violations(streams, [24.0, 0.0, -1.0])


@query(
    "val06_clean_streams",
    with_(MESSAGES)
    + """SELECT asset_id, count(*) AS n_messages,
    count(DISTINCT transaction_hash) = count(*) AND count(*) FILTER (WHERE transaction_hash IS NULL) = 0 AS clean
    FROM msg GROUP BY 1""",
)
def _(spark, sf):
    return ingest.clean_stream(fr.messages(spark, sf))


@query("agg01_market_counts", with_(MESSAGES) + "SELECT asset_id, count(*) AS n_events FROM msg GROUP BY 1")
def _(spark, sf):
    return ingest.market_counts(fr.messages(spark, sf))


@query(
    "agg02_tie_diagnostics",
    with_(MESSAGES, "per AS (SELECT asset_id, ts_ms, count(*) AS c FROM msg GROUP BY 1, 2)")
    + """SELECT asset_id, max(c) AS max_ms_multiplicity,
    CAST(sum(CASE WHEN c > 1 THEN c ELSE 0 END) AS BIGINT) AS n_tied_events FROM per GROUP BY 1""",
)
def _(spark, sf):
    return ingest.tie_diagnostics(fr.messages(spark, sf))


@query(
    "agg03_match_units",
    with_(MESSAGES)
    + """SELECT asset_id, count(*) AS n_fills, count(DISTINCT ts_ms) AS n_matches,
    count(DISTINCT transaction_hash) AS n_transactions FROM msg GROUP BY 1""",
)
def _(spark, sf):
    msgs = checkpointed(fr.messages(spark, sf).select("asset_id", "ts_ms", "transaction_hash"))  # lines are parsed once
    out = None
    for unit, name in (("fill", "n_fills"), ("match", "n_matches"), ("transaction", "n_transactions")):
        counts = ingest.market_counts(ingest.to_event_unit(msgs, unit)).withColumnRenamed("n_events", name)
        out = counts if out is None else out.join(counts, "asset_id")
    return out


@query(
    "agg04_reconciliation",
    with_(
        FILLS,
        """totals AS (SELECT market, sum(usdc) AS notional, count(*) AS n_events FROM fills GROUP BY 1),
        reported AS (SELECT CAST(l_suppkey AS VARCHAR) AS market,
          CASE WHEN l_suppkey % 10 = 0 THEN 0.0 ELSE sum(o_totalprice) / 4 END AS reported_volume
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey)""",
    )
    + f"""SELECT market, {r('notional', 'notional', 2)}, n_events, {r('reported_volume', 'reported_volume', 2)},
    {r('CASE WHEN reported_volume <> 0 THEN notional / reported_volume END', 'reconciliation_ratio', 2)}
    FROM totals LEFT JOIN reported USING (market)""",
    digits=2,
)
def _(spark, sf):
    return reconcile(fr.decoded(spark, sf), fr.reported_volume(spark, sf))


@query(
    "win02_repeated_prices",
    with_(
        MESSAGES,
        "o AS (SELECT *, lag(price) OVER (PARTITION BY asset_id ORDER BY ts_ms, pos) AS prev FROM msg)",
    )
    + "SELECT asset_id, count(*) FILTER (WHERE price = prev) AS n_dup_price_consecutive FROM o GROUP BY 1",
)
def _(spark, sf):
    return ingest.repeated_prices(fr.messages(spark, sf))


_ISLANDS = f"""
o AS (SELECT recv_ts, CASE WHEN recv_ts - lag(recv_ts) OVER (ORDER BY recv_ts) > {OUTAGE_GAP_S} THEN 1 ELSE 0 END AS f FROM msg),
n AS (SELECT recv_ts, CAST(sum(f) OVER (ORDER BY recv_ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM o),
isl AS (SELECT run_id, min(recv_ts) AS run_start, max(recv_ts) AS run_end, count(*) AS n_events FROM n GROUP BY 1)"""


@query(
    "win03_receive_runs",
    with_(MESSAGES, _ISLANDS)
    + f"SELECT run_id, {r('run_start', 'run_start', 3)}, {r('run_end', 'run_end', 3)}, n_events FROM isl",
    digits=3,
)
def _(spark, sf):
    return ingest.receive_runs(fr.messages(spark, sf), OUTAGE_GAP_S)


@query(
    "win03_outage_filter",
    with_(MESSAGES, _ISLANDS, "best AS (SELECT * FROM isl ORDER BY n_events DESC, run_start LIMIT 1)")
    + "SELECT asset_id, pos, ts_ms FROM msg, best WHERE recv_ts BETWEEN run_start AND run_end",
)
def _(spark, sf):
    return ingest.outage_filter(fr.messages(spark, sf), OUTAGE_GAP_S).select("asset_id", "pos", "ts_ms")


@query(
    "dst09_feed_quality",
    with_(
        MESSAGES,
        """o AS (SELECT *, (ts_ms - lag(ts_ms) OVER w) / 1000.0::DOUBLE AS gap, lag(price) OVER w = price AS same,
          lag(transaction_hash) OVER w = transaction_hash AS same_tx
          FROM msg WINDOW w AS (PARTITION BY asset_id ORDER BY ts_ms, pos)),
        h AS (SELECT asset_id, transaction_hash, count(*) AS c FROM msg GROUP BY 1, 2),
        hh AS (SELECT asset_id, count(*) AS n_transactions, max(c) AS max_per_transaction,
          sum(c) / count(*) AS messages_per_transaction FROM h GROUP BY 1),
        g AS (SELECT asset_id, count(*) AS n_messages, stddev_pop(gap) / avg(gap) AS gap_cv,
          count(*) FILTER (WHERE same AND same_tx) AS n_same_price_same_tx, count(*) FILTER (WHERE same) AS n_same_price,
          median(CASE WHEN same THEN gap END) AS same_price_gap_median FROM o GROUP BY 1)""",
    )
    + f"""SELECT asset_id, n_messages, {r('gap_cv', 'gap_cv')}, n_same_price_same_tx, n_same_price, n_transactions,
    max_per_transaction, {r('same_price_gap_median', 'same_price_gap_median')},
    {r('messages_per_transaction', 'messages_per_transaction')} FROM g JOIN hh USING (asset_id)""",
)
def _(spark, sf):
    return ingest.feed_quality(fr.messages(spark, sf))


@query(
    "dst10_order_preservation",
    with_(
        MESSAGES,
        """o AS (SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY asset_id ORDER BY recv_ts, pos) AS gap FROM msg),
        f AS (SELECT asset_id, max(c) AS max_per_frame FROM
          (SELECT asset_id, recv_ts, count(*) AS c FROM msg GROUP BY 1, 2) GROUP BY 1),
        g AS (SELECT asset_id, count(*) AS n_messages, min(ts_ms % 1000) AS subsecond_min_ms,
          max(ts_ms % 1000) AS subsecond_max_ms, count(*) FILTER (WHERE gap < 0) AS n_inversions,
          min(CASE WHEN gap >= 0 THEN gap END) AS gap_min_ms,
          avg(CASE WHEN gap < 2000 THEN 1.0 WHEN gap IS NOT NULL THEN 0.0 END) AS share_under_2s,
          median(gap) AS gap_median_ms FROM o GROUP BY 1)""",
    )
    + f"""SELECT asset_id, n_messages, subsecond_min_ms, subsecond_max_ms, n_inversions, gap_min_ms,
    {r('share_under_2s', 'share_under_2s')}, max_per_frame, {r('gap_median_ms', 'gap_median_ms')} FROM g JOIN f USING (asset_id)""",
)
def _(spark, sf):
    return ingest.order_preservation(fr.messages(spark, sf))


@query(
    "agg03_market_stats",
    with_(
        MESSAGES,
        """per AS (SELECT asset_id, ts_ms, count(*) AS c FROM msg GROUP BY 1, 2),
        d AS (SELECT asset_id, max(c) AS max_ms_multiplicity,
          CAST(sum(CASE WHEN c > 1 THEN c ELSE 0 END) AS BIGINT) AS n_tied_events,
          count(*) AS n_events, (max(ts_ms) - min(ts_ms)) / 1000.0::DOUBLE AS horizon, min(ts_ms) / 1000.0::DOUBLE AS t0_unix_s
          FROM per GROUP BY 1),
        o AS (SELECT *, lag(price) OVER (PARTITION BY asset_id ORDER BY ts_ms, pos) AS prev FROM msg),
        p AS (SELECT asset_id, count(*) FILTER (WHERE price = prev) AS n_dup_price_consecutive FROM o GROUP BY 1)""",
    )
    + f"""SELECT asset_id, n_events, {r('horizon', 'horizon', 3)}, {r('t0_unix_s', 't0_unix_s', 3)},
    max_ms_multiplicity, n_tied_events, n_dup_price_consecutive FROM d JOIN p USING (asset_id)""",
    digits=3,
)
def _(spark, sf):
    return ingest.market_stats(fr.messages(spark, sf), "match")


@query(
    "scl07_json_fields",
    with_(MESSAGES)
    + "SELECT asset_id, count(*) AS n, count(DISTINCT price) AS n_prices, min(price) AS low, max(price) AS high FROM msg GROUP BY 1",
)
def _(spark, sf):
    return fr.messages(spark, sf).groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("price").alias("n_prices"),
        F.min("price").alias("low"),
        F.max("price").alias("high"),
    )


@query(
    "dst08_fill_ties",
    with_(
        FILLS,
        """g AS (SELECT market, fill_id, floor((block_time - min(block_time) OVER (PARTITION BY market)) / 172800.0::DOUBLE) * 172800.0 AS t FROM fills),
        d AS (SELECT market, t - lag(t) OVER (PARTITION BY market ORDER BY t, fill_id) AS gap FROM g)""",
    )
    + f"""SELECT market AS stream_id, {r('coalesce(avg(CASE WHEN gap = 0 THEN 1.0 WHEN gap IS NOT NULL THEN 0.0 END), 0.0)', 'tie_fraction')}
    FROM d GROUP BY 1""",
)
def _(spark, sf):
    timed = fill_times(fr.decoded(spark, sf)).select(
        F.col("market").alias("stream_id"), F.col("fill_id").alias("event_id"), quantize(F.col("t"), 172800.0).alias("t")
    )
    return tie_fraction(timed)


@query(
    "ver03_data_validity",
    with_(
        FILLS,
        """m AS (SELECT market, count(*) AS n, sum(usdc) AS usdc,
          (max(block_time) - min(block_time)) / count(*)::DOUBLE AS resolvable_timescale FROM fills GROUP BY 1),
        v AS (SELECT market, resolvable_timescale, 400000.0::DOUBLE AS t_threshold,
          usdc / (n * 25000.0::DOUBLE) AS ratio, CASE WHEN CAST(market AS BIGINT) % 13 = 0 THEN 'quota' END AS blocker FROM m)""",
    )
    + """SELECT market, CASE WHEN blocker IS NOT NULL THEN 'blocked'
      WHEN resolvable_timescale >= t_threshold AND abs(ratio - 1.0) <= 0.3 THEN 'feasible' ELSE 'inadequate' END AS status,
    CASE WHEN blocker IS NULL THEN resolvable_timescale >= t_threshold END AS granularity_ok,
    CASE WHEN blocker IS NULL THEN abs(ratio - 1.0) <= 0.3 END AS reconciliation_ok FROM v""",
)
def _(spark, sf):
    per = fill_times(fr.decoded(spark, sf)).groupBy("market").agg(
        (F.first("horizon") / F.count(F.lit(1))).alias("resolvable_timescale"),
        (F.sum("usdc") / (F.count(F.lit(1)) * 25000.0)).alias("reconciliation_ratio"),
    )
    rows = per.withColumns(
        {
            "t_threshold": F.lit(400000.0),
            "expected_ratio": F.lit(1.0),
            "tolerance": F.lit(0.3),
            "blocker": F.when(F.col("market").cast("bigint") % 13 == 0, "quota"),
            "blocker_category": F.when(F.col("market").cast("bigint") % 13 == 0, "cost"),
        }
    )
    return validate.data_validity(rows).select("market", "status", "granularity_ok", "reconciliation_ok")


