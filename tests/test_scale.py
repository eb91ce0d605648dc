"""Steps whose cost must follow the rows, not the number of streams."""

import time

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from ripplework.functions import concave
from ripplework.functions import moments as mo
from ripplework.functions.kernels import exponential, power_law
from ripplework.operators import cascades as ca
from ripplework.operators import excite as ex
from ripplework.operators import fit as fi
from ripplework.operators import goodness as go
from ripplework.operators.shape import stream_spans
from ripplework.plans import QUERIES
from ripplework.sources.capture import line_report, parse_capture, trades


def test_horizon_mass_of_many_streams_takes_whole_batches(spark):
    rows = spark.range(200_000).select(
        (F.col("id") % 50_000).cast("string").alias("stream_id"), (F.col("id") / 50_000).cast("double").alias("t")
    )
    streams = rows.select("stream_id", F.lit(5.0).alias("horizon")).distinct()
    start = time.monotonic()
    found = ex.horizon_mass(rows, streams, [exponential(0.5), exponential(2.0)])
    got = {r.kernel_idx: r for r in found.groupBy("kernel_idx").agg(F.count("cc").alias("n"), F.sum("cc").alias("cc")).collect()}
    taken = time.monotonic() - start
    left = 5.0 - np.arange(200_000) / 50_000
    for i, beta in enumerate((0.5, 2.0)):
        assert got[i].n == 50_000
        assert np.isclose(got[i].cc, (-np.expm1(-beta * left)).sum(), rtol=1e-9)
    assert taken < 15  # a frame for every stream of a batch takes over a minute


def test_counted_bins_are_not_joined_to_what_was_swept_from_them(spark):
    """A table of counted bins packs into few bytes however many rows it has, so a join would bring them all to the driver."""
    rows = [("a", i, 0.3 * i) for i in range(200)] + [("b", i, 0.1 * (i // 4)) for i in range(120)]
    events = spark.createDataFrame(rows, "stream_id string, event_id long, t double")
    rates = go._binned_rates(events, stream_spans(events), 0.5, [0.2, 1.0])
    joins = [x for x in rates._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert len(joins) == 1  # with the number of bins of each stream
    got = {(r.stream_id, r.bin): r.cnt for r in rates.where("beta = 1.0").collect()}
    want = {}
    for s, _, t in rows:
        last = -(-max(x[2] for x in rows if x[0] == s) // 0.5) - 1
        want[s, min(t // 0.5, last)] = want.get((s, min(t // 0.5, last)), 0) + 1
    assert got == want
    for blocked in (False, True):
        counted = spark.createDataFrame([("a", i, float(i), 2 * i + 1) for i in range(30)], "stream_id string, event_id long, t double, n long")
        swept = ex.decay_scan(counted, *ex.stack_kernels([exponential(1.0)]), blocked=blocked, count="n")
        assert {(r.event_id, r[ex.COUNT]) for r in swept.collect()} == {(i, 2 * i + 1) for i in range(30)}


def test_short_streams_are_fitted_side_by_side(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pdf = pd.concat(
        [
            pd.DataFrame({"stream_id": f"s{i:03d}", "event_id": np.arange(n), "t": np.sort(rng.uniform(0, 40, n)), "horizon": 40.0, "n_center": 0.0, "n_scale": 1.0})
            for i, n in enumerate(rng.integers(1, 60, 300))
        ]
    )
    kernels = [exponential(0.3), exponential(2.0)]
    rates, weights = ex.stack_kernels(kernels)
    _, masses = ex.stack_kernels(kernels, integrated=True)
    calls = []
    real = fi.maximise_many
    monkeypatch.setattr(fi, "maximise_many", lambda *a: calls.append(1) or real(*a))
    for ns in (None, [0.3, 0.9]):
        run = lambda rows: pd.concat(fi._fit_streams(rows, None, kernels, "step", ns, rates, weights, masses))
        calls.clear()
        keys = ["stream_id", "kernel_idx", "n"] if ns else ["stream_id", "kernel_idx"]
        together = run(pdf).sort_values(keys)
        assert 0 < len(calls) < 20  # not once a stream
        alone = pd.concat([run(x) for _, x in pdf.groupby("stream_id")]).sort_values(keys)
        assert np.allclose(together["ll"], alone["ll"], atol=1e-8) and np.allclose(together["n"], alone["n"], atol=1e-5)
        assert (together["converged"].to_numpy() == alone["converged"].to_numpy()).all() and len(together) == 300 * len(kernels) * (len(ns) if ns else 1)


def test_steps_of_large_fits_leave_the_events_where_they_are(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [("x", i, float(t)) for i, t in enumerate(np.sort(rng.uniform(0, 50, 120)))]
    events = spark.createDataFrame(rows, "stream_id string, event_id long, t double")
    plans = []
    real = fi.checkpointed
    monkeypatch.setattr(fi, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().toString()) or real(df))
    fits = fi.fit_cells(events, stream_spans(events), [exponential(1.0)], ks=[1, 3], max_rows=10).toPandas()
    assert fits["converged"].all() and len(fits) == 2
    # after edges, design and start state come the steps
    assert len(plans) > 4 and not any("CoGroup" in p for p in plans[3:])


def test_distance_of_large_streams_stays_packed(spark):
    """Increments are counted in bins: both forms agree, ties included, and no plan sorts a row for every event and fit."""
    rng = np.random.default_rng(21)
    rows = [("x", i, float(x)) for i, x in enumerate(np.sort(np.round(rng.uniform(0, 60, 400), 1)))]
    rows += [("y", i, float(x)) for i, x in enumerate(np.cumsum(rng.exponential(0.5, 300)))]
    events = spark.createDataFrame(rows, "stream_id string, event_id long, t double").repartition(5)
    for basis in ("step", "linear"):
        fits = fi.fit_cells(events, stream_spans(events), [power_law(0.4, 0.5), power_law(1.1, 2.0)], basis=basis, ks=[1, 4])
        run = lambda blocked: go.ks_of_fits(events, fits, [(0.4, 0.5), (1.1, 2.0)], basis=basis, extra=["k"], blocked=blocked)
        plain = run(False).toPandas().sort_values(["stream_id", "k", "kernel_idx"])
        spark.conf.set(fi.FIT_MAX_ROWS_KEY, "350")  # x alone is large
        try:
            packed = run(None)
            plan, packed = packed._jdf.queryExecution().toString(), packed.toPandas().sort_values(["stream_id", "k", "kernel_idx"])
        finally:
            spark.conf.unset(fi.FIT_MAX_ROWS_KEY)
        assert "MapInPandas chosen" in plan and len(packed) == 8
        assert (plain["n_increments"].to_numpy() == packed["n_increments"].to_numpy()).all()
        assert np.allclose(plain["ks"], packed["ks"], atol=1e-9)


def test_sums_of_placed_events_equal_sums_over_columns():
    rng = np.random.default_rng(4)
    edges = np.array([0.0, 3.0, 3.0, 7.5, 10.0])
    t, s = np.sort(rng.uniform(0, 10, 500)), rng.exponential(1.0, (500, 2))
    seg, weight = concave.segment_places(t, edges)
    kernel = np.array([0, 1, 1])
    for kind, columns in (("step", 4), ("linear", 5)):
        h = concave.basis_matrix(kind, seg, weight, 4)
        theta = rng.uniform(0.1, 1.0, (3, columns + 1))
        for n in (None, np.array([0.2, 0.5, 0.9])):
            at = theta if n is None else theta[:, :-1]
            for a, b in zip(concave.partial_sums(h, s[:, kernel], at, n), concave.placed_sums(kind, seg, weight, s, kernel, at, n)):
                assert np.allclose(a, b, rtol=1e-10)


def test_moments_by_bin_give_the_sums_over_events():
    rng = np.random.default_rng(6)
    x = np.r_[0.0, 1e-30, 1e-19, -1e-6, rng.exponential(1.0, 3000) * 10 ** rng.uniform(-8, 3, 3000)]
    bins, moments = mo.merged_moments([mo.moments_by_bin(part) for part in np.array_split(x, 3)])
    assert bins.size < 1300 and moments[:, 0].sum() == x.size
    for mu, n in ((1e-3, 0.5), (0.3, 0.7), (5.0, 1e-9)):
        for theta, fixed in ((np.array([[mu, n]]), None), (np.array([[mu]]), np.array([n]))):
            plain = concave.partial_sums(np.ones((x.size, 1)), x[:, None], theta, fixed)
            for a, b in zip(plain, mo.binned_sums(bins, moments, theta, fixed)):
                assert np.allclose(a, b, rtol=1e-12)


def test_constant_fits_of_large_streams_pass_over_the_events_once(spark, monkeypatch):
    """No step touches the events: nothing is written but a row a stream and the fits, which equal those of whole streams."""
    rng = np.random.default_rng(9)
    rows = [("x", i, float(t)) for i, t in enumerate(np.sort(np.round(rng.uniform(0, 90, 300), 1)))]
    rows += [("y", i, float(t)) for i, t in enumerate(np.cumsum(rng.exponential(0.5, 200)))]
    events = spark.createDataFrame(rows, "stream_id string, event_id long, t double").repartition(3)
    streams = stream_spans(events).withColumn("t_scale", F.lit(0.5))
    written = []
    real = fi.checkpointed
    monkeypatch.setattr(fi, "checkpointed", lambda df: written.append(1) or real(df))
    for ns in (None, [0.2, 0.8]):
        run = lambda most: fi.fit_cells(events, streams, [exponential(1.0), power_law(0.4, 0.5)], ns=ns, max_rows=most).toPandas().sort_values(["stream_id", "kernel_idx", "n"])
        whole = run(1000)
        written.clear()
        binned = run(10)
        assert len(written) <= 2 and len(binned) == len(whole) == 4 * (len(ns) if ns else 1) and binned["converged"].all()
        for c in ("ll", "cc", "n"):
            assert np.allclose(whole[c], binned[c], rtol=1e-7)
        assert np.allclose(np.vstack(whole["theta"]), np.vstack(binned["theta"]), rtol=1e-5)


def test_ladders_share_one_layout_of_the_events(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [("x", i, float(t)) for i, t in enumerate(np.cumsum(rng.exponential(1.0, 150)))]
    events = spark.createDataFrame(rows, "stream_id string, event_id long, t double")
    laid = []
    real = fi.arrange
    for module in (fi, ex):
        monkeypatch.setattr(module, "arrange", lambda *a, **k: laid.append(1) or real(*a, **k))
    whole, binned = (fi.fit_exponential(events, stream_spans(events), rounds=1, max_rows=most).collect()[0] for most in (1000, 10))
    assert len(laid) == 1
    assert np.allclose([whole.mu, whole.n, whole.beta, whole.ll], [binned.mu, binned.n, binned.beta, binned.ll], rtol=1e-5)


def test_blocks_and_row_groups_of_large_fits_are_bounded(spark, monkeypatch):
    """What a task holds must not follow the events divided by the partitions that are set, nor 100 packed rows."""
    rng = np.random.default_rng(12)
    rows = [("x", i, float(t)) for i, t in enumerate(np.cumsum(rng.exponential(1.0, 1200)))]
    events = spark.createDataFrame(rows, "stream_id string, event_id long, t double")
    streams = stream_spans(events)
    kernels = [power_law(0.4, 0.5), exponential(1.0)]
    fit = lambda most: fi.fit_cells(events, streams, kernels, basis="linear", ks=[4], max_rows=most)
    whole = fit(10_000)
    monkeypatch.setattr(ex, "SCAN_NUMBERS", 200)  # 100 events of two kernels
    monkeypatch.setattr(ex, "PACKED_NUMBERS", 20)
    written, laid = [], []
    for module in (fi, go):
        monkeypatch.setattr(module, "checkpointed_wide", lambda df, n, real=module.checkpointed_wide: written.append(real(df, n)) or written[-1])
    arrange = ex.arrange
    monkeypatch.setattr(ex, "arrange", lambda *a, **k: laid.append(arrange(*a, **k)) or laid[-1])
    fits = fit(100)
    spark.conf.set(fi.FIT_MAX_ROWS_KEY, "100")
    try:
        ks = go.ks_of_fits(events, fits, [(0.4, 0.5), (1.1, 2.0)], basis="linear").toPandas()
    finally:
        spark.conf.unset(fi.FIT_MAX_ROWS_KEY)
    assert len(written) == len(laid) == 2 and len(ks) == 2
    for df in laid:
        sizes = [r["count"] for r in df.df.groupBy(df.df.columns[-1]).count().collect()]
        assert len(sizes) > 8 and max(sizes) < 300
    for df in written:
        files = [pq.ParquetFile(x.removeprefix("file://")).metadata for x in df.inputFiles()]
        assert df.count() > 100
        assert max(m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)) <= ex.PACKED_GROUP
    whole, large = (f.toPandas().sort_values("kernel_idx") for f in (whole, fits))
    assert np.allclose(whole["ll"], large["ll"], atol=1e-6) and np.allclose(whole["n"], large["n"], atol=1e-6)


def test_lines_are_parsed_once(spark):
    lines = spark.createDataFrame([('{"recv_ts": 1.0, "msg": {"event_type": "last_trade_price", "asset_id": "a", "timestamp": "5"}}', 0), ("  ", 1), (None, 2), ("{", 3)], "line string, pos long")
    found = trades(parse_capture(lines))
    assert found._jdf.queryExecution().executedPlan().toString().lower().count("parsejson(") == 1
    assert [(r.pos, r.asset_id, r.ts_ms) for r in found.collect()] == [(0, "a", 5)]
    assert {r.status: r.n_lines for r in line_report(parse_capture(lines)).collect()} == {"trade": 1, "bad": 1}


def test_units_are_counted_on_parsed_messages(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:{i % 50:02d}", i % 4, "click", 30.0) for i in range(200)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double")
    events.withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/events.parquet")
    found = QUERIES["agg03_match_units"](spark, str(tmp_path))
    assert "parsejson" not in found._jdf.queryExecution().toString().lower()
    assert sum(r.n_fills for r in found.collect()) > 0


def test_calibration_shuffles_events_not_their_cells(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(s, i, float(x), int(i - i % 5)) for s in ("x", "y") for i, x in enumerate(np.cumsum(rng.exponential(1.0, 120)))]
    labeled = spark.createDataFrame(rows, "stream_id string, idx long, t double, root_idx long")
    plans = []
    real = ca.checkpointed
    monkeypatch.setattr(ca, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    plain = ca.calibrate_width(labeled, min_events=50, blocked=False)
    found = plain.toPandas().sort_values("k")
    assert not any("hashpartitioning" in line and "bin" in line for line in plans[-1].split("\n"))
    assert "Window" not in plain._jdf.queryExecution().toString()  # the means are read twice, not worked out twice
    blocked = ca.calibrate_width(labeled, min_events=50, blocked=True).toPandas().sort_values("k")
    assert np.allclose(found["mean_ari"], blocked["mean_ari"]) and (found["used_streams"] == 2).all()
    untimed = spark.createDataFrame([("x", 500 + i, None, 7) for i in range(9)], labeled.schema)
    more = ca.calibrate_width(labeled.unionByName(untimed), min_events=50, blocked=False).toPandas().sort_values("k")
    assert np.allclose(found["mean_ari"], more["mean_ari"])


def test_grid_of_short_streams_takes_steps_together(spark):
    rng = np.random.default_rng(12)
    hess = np.zeros((40, 6, 6))
    on, off = np.arange(6), np.arange(5)
    hess[:, on, on] = rng.uniform(2.0, 3.0, (40, 6))
    hess[:, off, off + 1] = hess[:, off + 1, off] = rng.uniform(0.1, 0.9, (40, 5))
    theta, grad = rng.choice([concave.FLOOR, 0.5], (40, 6)), rng.normal(size=(40, 6))
    assert np.allclose(concave._newton(theta, grad, hess)[0], concave._newton_banded(theta, grad, hess)[0], rtol=1e-9)
    streams, alone = [], []
    theta0, cost, n = np.full((6, 3), 0.5), np.tile([2.0, 4.0, 2.0], (6, 1)), np.tile([0.3, 0.9], 3)
    for size in (12, 40, 25):
        t = np.sort(rng.uniform(0, 8, size))
        h = concave.basis_matrix("linear", *concave.segment_places(t, np.array([0.0, 4.0, 8.0])), 2)
        streams.append((h, rng.exponential(1.0, (size, 2))))
        alone.append(concave.maximise(*streams[-1], cost[:2], theta0[:2], n[:2]))
    run = concave.maximise_each(streams, cost, theta0, n, np.repeat([12, 40, 25], 2))
    assert np.allclose(run.value, np.concatenate([a.value for a in alone]), atol=1e-10) and (run.gap < 1e-6).all()
    events = spark.createDataFrame([("s", i, float(i)) for i in range(30)], "stream_id string, event_id long, t double")
    assert "theta" not in fi.fit_cells(events, stream_spans(events), [exponential(1.0)], ns=[0.5], lean=True).columns
