import json
import random

import pytest
from pyspark.sql import functions as F

from ripplework.operators import ingest, validate
from ripplework.sources.capture import line_report, parse_capture, read_capture_lines, trades
from ripplework.sources.fills import FILL_SCHEMA, decode_fills, fill_times, reconcile

START = 1_650_000_000_000


def message(at=0, *, market="m1", price=0.25, kind="last_trade_price", seen=1.0, **other):
    """One capture line with times relative to ``START``."""
    body = {"price": str(price), "timestamp": str(START + at), "event_type": kind, "asset_id": market} | other
    return json.dumps({"msg": body, "recv_ts": seen})


def captured(spark, folder, lines, newline="\n"):
    file = folder / "lines.jsonl"
    with open(file, "w", newline="") as out:
        out.writelines(line + newline for line in lines)
    return parse_capture(read_capture_lines(spark, str(file)))


LINES = [
    ("trade", message()),
    ("trade", message(50, market="m2", seen=None)),
    ("skipped", message(kind="price_change")),
    ("skipped", '{"note": "heartbeat"}'),
    ("bad", message(asset_id=["m1"])),
    ("bad", message(timestamp="-inf")),
    ("bad", "not a line of json"),
    ("bad", "[" + message() + "]"),
    ("bad", '{"recv_ts": 3, "msg": 7}'),
    ("trade", message(10, price=0.75)),
    ("bad", message(timestamp="1e400")),
]


def test_every_line_is_read_skipped_or_counted_bad(spark, tmp_path):
    for newline in ("\n", "\r\n"):
        parsed = captured(spark, tmp_path, [line for _, line in LINES], newline)
        want = {kind: sum(k == kind for k, _ in LINES) for kind in ("trade", "skipped", "bad")}
        assert {r.status: r.n_lines for r in line_report(parsed).collect()} == want
        assert sorted(float(r.price) for r in trades(parsed).collect()) == [0.25, 0.25, 0.75]


def test_times_ties_and_units(spark, tmp_path):
    lines = [message(5, market="m2"), *[message()] * 3, message(2000)]
    good = trades(captured(spark, tmp_path, lines))
    by_unit = {unit: {r.asset_id: r for r in ingest.market_stats(good, unit).collect()} for unit in ("fill", "match")}
    one, other = by_unit["fill"]["m1"], by_unit["fill"]["m2"]
    assert (one.n_events, one.max_ms_multiplicity, one.n_tied_events, one.horizon) == (4, 3, 3, 2.0)
    assert other.horizon == 0.0
    assert (by_unit["match"]["m1"].n_events, by_unit["match"]["m1"].max_ms_multiplicity) == (2, 3)
    with pytest.raises(ValueError):
        ingest.to_event_unit(good, "batch")


def test_repeated_price_keeps_file_order(spark, tmp_path):
    good = trades(captured(spark, tmp_path, [message(price=0.5), message(price=0.5), message(1, price=0.6)]))
    for blocked in (False, True):
        assert ingest.repeated_prices(good, blocked=blocked).first().n_dup_price_consecutive == 1


@pytest.mark.parametrize(
    "recv, gap, kept",
    [([0, 1, 2, 100, 101, 102, 103, 104, 300, 301], 50, (100, 104)), ([10, 11, 12, 13], 50, (10, 13)), ([0, 1, 500, 501, 502], 60, (500, 502))],
)
def test_outage_guard(spark, recv, gap, kept):
    rows = spark.createDataFrame([(float(r),) for r in recv], "recv_ts double")
    out = ingest.outage_filter(rows, float(gap)).agg(F.min("recv_ts"), F.max("recv_ts")).first()
    assert tuple(out) == kept
    nothing = spark.createDataFrame([(None,)], "recv_ts double")
    assert ingest.outage_filter(nothing, 5.0).count() == 1


def test_receive_runs_over_many_ranges(spark):
    """Ranges of 2 and 16 buckets against a loop, with gaps inside, between and across several ranges."""
    draw, times, at = random.Random(5), [], -4000.0
    for _ in range(3000):
        at += draw.choice([0.0, 0.25, 1.0, 4.0, 5.0, 5.25, 9.0, 40.0])
        times.append(at)
    times += [at + 1e6, at + 1e6]
    rows = spark.createDataFrame([(t,) for t in draw.sample(times, len(times))] + [(None,)], "recv_ts double")
    want = [[times[0], times[0], 0]]
    for before, t in zip([times[0], *times], times):
        if t - before > 5.0:
            want.append([t, t, 0])
        want[-1][1:] = t, want[-1][2] + 1
    for bits in (1, 4, ingest.RANGE_BITS):
        runs = ingest.receive_runs(rows, 5.0, bits=bits)
        got = sorted(tuple(r) for r in runs.select("run_id", "run_start", "run_end", "n_events").collect())
        assert got == [(i, *w) for i, w in enumerate(want)]
    assert len(want) > 200 and (times[-1] - times[0]) / 5.0 / 16 > 200
    assert ingest.receive_runs(rows.where("recv_ts IS NULL"), 5.0).count() == 0


def test_fills(spark):
    rows = [("m", 1, 1000, "0", "7", 60_000_000, 100_000_000), ("m", 2, 1006, "9", "0", 50_000_000, 30_000_000)]
    fills = spark.createDataFrame([(a, b, c, d, e, f, g) for a, b, c, d, e, f, g in rows],
                                  "market string, fill_id long, block_time long, makerAssetId string, takerAssetId string, m long, t long")
    fills = fills.select("market", "fill_id", "block_time", "makerAssetId", "takerAssetId",
                         F.col("m").cast("decimal(38,0)").alias("makerAmountFilled"), F.col("t").cast("decimal(38,0)").alias("takerAmountFilled"))
    assert [f.name for f in FILL_SCHEMA] == fills.columns
    got = {r.fill_id: (r.usdc, r.shares, r.price, r.t, r.horizon) for r in fill_times(decode_fills(fills)).collect()}
    assert got == {1: (60.0, 100.0, 0.6, 0.0, 6.0), 2: (30.0, 50.0, 0.6, 6.0, 6.0)}
    volume = spark.createDataFrame([("m", 90.0)], "market string, reported_volume double")
    assert reconcile(decode_fills(fills), volume).first().reconciliation_ratio == 1.0
    with pytest.raises(Exception, match="neither leg"):
        decode_fills(fills.withColumn("makerAssetId", F.lit("5")).withColumn("takerAssetId", F.lit("6"))).collect()


def test_data_validity(spark):
    base = dict(resolvable_timescale=8.0, t_threshold=2.0, reconciliation_ratio=1.0, expected_ratio=1.0, tolerance=0.05, blocker=None, blocker_category=None)
    schema = "resolvable_timescale double, t_threshold double, reconciliation_ratio double, expected_ratio double, tolerance double, blocker string, blocker_category string"

    def status(**change):
        return validate.data_validity(spark.createDataFrame([{**base, **change}], schema)).first()

    assert status().status == "feasible"
    assert status(resolvable_timescale=1.0).status == "inadequate" and "coarse" in status(resolvable_timescale=1.0).reasons
    assert status(reconciliation_ratio=1.4).status == "inadequate"
    assert status(blocker="x", blocker_category="cost").status == "blocked"
    with pytest.raises(Exception, match="not allowed"):
        status(blocker="x", blocker_category="infeasible")


def test_late_messages_are_given_back_as_late(spark, tmp_path):
    from ripplework.functions.kernels import exponential
    from ripplework.streaming import live

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    feed, out = tmp_path / "feed", str(tmp_path / "out")
    feed.mkdir()
    try:
        for n, times in enumerate([(0, 1000, 5000), (3000, 6000)]):
            (feed / f"{n}.jsonl").write_text("".join(message(t) + "\n" for t in times))
            stream = live.live_excitation(live.capture_stream(spark, str(feed)), exponential(0.5))
            sink = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state"))
            sink.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    rows = {r.ts_ms - START: r for r in spark.read.parquet(out).collect()}
    assert rows[3000].late and rows[3000].excitation is None
    timely = [t for t, r in rows.items() if not r.late]
    assert sorted(timely) == [0, 1000, 5000, 6000]
    for t in timely:
        want = sum(0.5 * 2.718281828459045 ** (-0.5 * (t - u) / 1000.0) for u in timely if u < t)
        assert rows[t].excitation == pytest.approx(want, abs=1e-9)
    assert rows[6000].n_seen == 4
