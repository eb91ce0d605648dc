import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplework.functions import concave
from ripplework.functions.kernels import exponential, fine_power_law, kernel_table, kernels_from_table, power_law
from ripplework.operators import excite as ex
from ripplework.operators import fit as fi
from ripplework.operators import gate as ga
from ripplework.operators import goodness as go
from ripplework.operators.shape import segment_edges, stream_spans, with_segment, with_segments


def hawkes(n, horizon, mu, beta, seed):
    """Cluster construction with exponential delays."""
    rng = np.random.default_rng(seed)
    times = list(rng.uniform(0, horizon, rng.poisson(mu * horizon)))
    queue = list(times)
    while queue:
        p = queue.pop()
        for d in rng.exponential(1 / beta, rng.poisson(n)):
            if p + d < horizon:
                times.append(p + d)
                queue.append(p + d)
    return np.sort(times)


@pytest.fixture(scope="module")
def events(spark):
    streams = {"a": hawkes(0.6, 1500, 0.4, 1.0, 1), "b": hawkes(0.3, 800, 0.5, 1.0, 2)}
    streams["a"][10] = streams["a"][11]
    rows = [(s, i, float(t)) for s, ts in streams.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "stream_id string, event_id long, t double").cache()


def brute(t, g):
    return np.array([sum(g(t[i] - t[j]) for j in range(i)) for i in range(t.size)])


@pytest.mark.parametrize("blocked", [False, True])
def test_scan_equals_history_sum(spark, events, blocked):
    few = events.where("event_id < 150")
    k = power_law(0.4, 0.5)
    got = ex.self_excitation(few, [k, fine_power_law(0.4, 0.5)], blocked=blocked).toPandas()
    a, b = np.array(k.a), np.array(k.beta)
    for sid, part in got.groupby("stream_id"):
        part = part.sort_values("prior")
        t, s = part["t"].to_numpy(), np.vstack(part["sums"])
        assert np.allclose(s[:, 0], brute(t, lambda d: (a * np.exp(-b * d)).sum()), atol=1e-10)
        assert np.allclose(s[:, 1], brute(t, lambda d: 0.4 * 0.5**0.4 / (d + 0.5) ** 1.4), atol=1e-9)
        assert (part["prior"].to_numpy() == np.arange(len(part))).all()


def test_kernels(spark):
    assert abs(power_law(0.02, 0.5).mass - 1) < 1e-12 and exponential(3.0).mass == 1.0
    back = kernels_from_table(kernel_table(spark, [power_law(0.4, 0.5), exponential(2.0)]))
    assert {k.kernel_id for k in back} == {"pow(0.4,0.5)", "exp(2)"}
    bad = spark.createDataFrame([("k", 0, 2.0, 1.0)], "kernel_id string, comp int, a double, beta double")
    with pytest.raises(ValueError, match="mass"):
        kernels_from_table(bad)


def test_recovers_planted_branching(spark, events):
    fits = {r.stream_id: r for r in fi.fit_exponential(events, stream_spans(events)).collect()}
    assert abs(fits["a"].n - 0.6) < 0.12 and 0.6 < fits["a"].beta < 1.6
    interval = {r.stream_id: r for r in fi.profile_interval(events, stream_spans(events), fi.fit_exponential(events, stream_spans(events))).collect()}
    for sid, true in (("a", 0.6), ("b", 0.3)):
        row = interval[sid]
        assert row.lo < row.n < row.hi and row.lo - 0.05 < true < row.hi + 0.05 and row.hi_crossed


@pytest.mark.parametrize("basis, ns", [("step", None), ("linear", [0.3, 0.9])])
def test_distributed_fit_equals_grouped(spark, events, basis, ns):
    streams = stream_spans(events)
    run = lambda rows: fi.fit_cells(events, streams, [power_law(0.4, 0.5), exponential(1.0)], basis=basis, ks=[1, 3], ns=ns, max_rows=rows).toPandas().sort_values(["stream_id", "k", "kernel_idx", "n"])
    small, big = run(10**6), run(10)
    assert len(small) == len(big)
    assert np.allclose(small["ll"], big["ll"], atol=1e-5) and np.allclose(small["n"], big["n"], atol=1e-4)


def test_optimum_satisfies_first_order_conditions(spark, events):
    streams = stream_spans(events)
    for basis in ("step", "linear"):
        fits = fi.fit_cells(events, streams, [power_law(0.4, 0.5)], basis=basis, ks=[4])
        value, gradient = ex.baseline_likelihood(events, streams, fits, power_law(0.4, 0.5), basis=basis)
        lls = {r.stream_id: r.ll for r in fits.collect()}
        for row in value.collect():
            assert abs(row.ll - lls[row.stream_id]) < 1e-6 and abs(row.grad_n) < 1e-2
        theta = {r.stream_id: r.theta for r in fits.collect()}
        for row in gradient.collect():
            at_floor = theta[row.stream_id][row.param] <= 1e-8
            assert row.grad <= 1e-2 if at_floor else abs(row.grad) < 1e-2


def test_goodness_of_fit(spark, events):
    fits = fi.fit_exponential(events, stream_spans(events)).cache()
    good = go.ks_unit_exponential(go.exponential_residuals(events, fits), ["stream_id"])
    poor = go.ks_unit_exponential(go.exponential_residuals(events, fits.withColumn("n", F.lit(0.01)).withColumn("mu", F.lit(0.3))), ["stream_id"])
    a, b = ({r.stream_id: r for r in d.withColumn("p", go.kolmogorov_p(F.col("ks"), F.col("n_increments"))).collect()} for d in (good, poor))
    assert a["a"].p > 0.05 and a["a"].ks < b["a"].ks and b["a"].p < 0.01


def test_calibrated_p(spark):
    observed = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", None)], "stream_id string, ks double")
    nulls = spark.createDataFrame(
        [("a", i, 0.1) for i in range(19)] + [("b", i, 0.1) for i in range(9)] + [("b", 99, None)] + [("c", i, 0.1) for i in range(12)],
        "stream_id string, replicate int, d double",
    )
    got = {r.stream_id: r for r in go.calibrated_p(observed, nulls).collect()}
    assert got["a"].p_boot == 1 / 20 and not got["a"].passed
    assert got["b"].p_boot is None and got["b"].b_eff == 9 and got["c"].p_boot is None


def test_gate_tie_and_migration_rules(spark):
    rows = [("s", n, e, 1.0, ll) for n, e, ll in [(0.6, 0.4, 5.0), (0.9, 0.4, 5.0), (1.2, 0.4, 1.0), (0.6, 0.02, 2.0), (0.9, 0.02, 3.0), (1.2, 0.02, 9.0)]]
    ll = spark.createDataFrame(rows, "stream_id string, n double, eps double, c double, ll double")
    v = ga.gate_verdict(ll).first()
    assert (v.peak_closed, v.peak, v.peak_capped, v.identified) == (0.6, 1.2, 0.6, False)


def test_binned_fit_equals_a_loop_over_bins(spark, events):
    """The best cell of the whole grid, with expected offspring of earlier bins taken from bin middles."""
    width, betas = 2.0, [0.5, 1.0]
    streams = stream_spans(events)
    got = {r.stream_id: r for r in go.binned_fit(events, streams, width, betas).collect()}
    horizon = {r.stream_id: r.horizon for r in streams.collect()}
    times = events.toPandas().groupby("stream_id")["t"]
    assert set(got) == set(horizon) == {"a", "b"}
    for sid, t in times:
        bins = {r.n_bins for r in go._binned_rows(events, streams.where(F.col("stream_id") == sid), width, 1.0).collect()}
        (size,) = bins
        assert abs(size - horizon[sid] / width) <= 1
        counts = np.bincount(np.minimum((t.to_numpy() // width).astype(int), size - 1), minlength=size)
        cells = []
        for beta in betas:
            decay, half = np.exp(-beta * width), np.exp(-0.5 * beta * width)
            excited, carried = np.zeros(size), 0.0
            for k in range(size):
                excited[k] = carried * half * (1 - decay)
                carried = carried * decay + counts[k]
            later = (counts * half * (1 - decay ** (size - 1 - np.arange(size)))).sum()
            full = counts > 0
            for n in go.BINNED_N_GRID:
                mu = (counts.sum() - n * later) / size
                if mu > 0:
                    cells.append(((counts[full] * np.log(mu + n * excited[full])).sum() - counts.sum(), n, beta))
        ll, n, beta = max(cells, key=lambda c: (c[0], -c[1], -c[2]))
        assert (got[sid].n, got[sid].beta) == (n, beta) and got[sid].ll == pytest.approx(ll, rel=1e-9)


def test_rows_that_stand_for_many_events_are_swept_as_the_events_are(spark):
    rng = np.random.default_rng(2)
    rows = [(s, i, i * 0.25, int(rng.integers(1, 50))) for s in ("a", "b") for i in sorted(rng.choice(400, 150, replace=False).tolist())]
    counted = spark.createDataFrame(rows, "stream_id string, event_id long, t double, cnt long").repartition(3)
    each = [(s, 1000 * i + k, t) for s, i, t, c in rows for k in range(c)]
    kernels = ex.stack_kernels([exponential(0.3), exponential(2.0)])
    plain = ex.decay_scan(spark.createDataFrame(each, "stream_id string, event_id long, t double"), *kernels)
    want = {(r.stream_id, r.event_id // 1000): r.sums for r in plain.where("event_id % 1000 = 0").collect()}
    for blocked in (False, True):
        got = ex.decay_scan(counted, *kernels, blocked=blocked, count="cnt").collect()
        assert len(got) == len(want) == 300
        for r in got:
            assert r.sums == pytest.approx(want[r.stream_id, r.event_id], rel=1e-9, abs=1e-12)


def test_every_stream_keeps_a_row_in_fits(spark):
    rows = [("nine", i, float(i)) for i in range(9)] + [("one", 0, 1.0)] + [("many", i, i * 0.5) for i in range(40)]
    events = spark.createDataFrame(rows, "stream_id string, event_id long, t double")
    streams = stream_spans(events).unionByName(
        spark.createDataFrame([("none", 0, 5.0)], "stream_id string, n_events long, horizon double"), allowMissingColumns=True
    )
    constant = {r.stream_id: r for r in fi.fit_constant(events, streams, power_law(0.4, 0.5)).collect()}
    assert set(constant) == {"nine", "one", "many", "none"}
    assert constant["nine"].n is not None and constant["none"].n is None and constant["none"].reason == "no_events"
    free = {r.stream_id: r for r in fi.fit_exponential(events, streams, rounds=1).collect()}
    assert set(free) == set(constant) and free["many"].n is not None
    assert {k: r.reason for k, r in free.items() if r.n is None} == {"nine": "too_few_events", "one": "too_few_events", "none": "no_events"}


def test_segment_arrays_equal_segment_rows(spark):
    """All segment counts of the sweep, for few and many events, ties and boundaries at one half included."""
    rng = np.random.default_rng(6)
    rows = []
    for n in (2, 3, 7, 31, 82, 100, 174, 300):
        rows += [(f"even{n}", i, float(i + 1)) for i in range(n)]
        rows += [(f"tied{n}", i, float(x)) for i, x in enumerate(np.sort(rng.integers(0, max(2, n // 3), n)))]
    events = spark.createDataFrame(rows, "stream_id string, event_id long, t double")
    edges = segment_edges(events, stream_spans(events), fi.K_SWEEP).cache()
    long = with_segment(events, edges).select("stream_id", "event_id", "k", "seg", F.coalesce("weight", F.lit(0.0)).alias("w"))
    want = {tuple(r)[:3]: tuple(r)[3:] for r in long.collect()}
    for r in with_segments(events, edges).collect():
        for k, seg, weight in zip(fi.K_SWEEP, r.segs, r.weights):
            assert want[r.stream_id, r.event_id, k] == (seg, weight)
    at = {(r.stream_id, r.k): r.edges for r in edges.collect()}
    for n in (82, 100):
        for k in fi.K_SWEEP:
            i = [min(max(round(j * n / k), 1), n - 1) for j in range(1, k)]
            assert at[f"even{n}", k][1:-1] == [x + 0.5 for x in i]


@pytest.mark.parametrize("basis", ["step", "linear"])
def test_sweep_is_the_same_grouped_and_distributed_and_certified(spark, basis):
    rng = np.random.default_rng(8)
    rows = [(s, i, float(x)) for s, n in (("x", 100), ("y", 61)) for i, x in enumerate(np.sort(rng.uniform(0, 50, n)))]
    events = spark.createDataFrame(rows, "stream_id string, event_id long, t double")
    run = lambda rows: fi.fit_cells(events, stream_spans(events), [power_law(0.4, 0.5)], basis=basis, ks=[1, 4, 20, 24], max_rows=rows).toPandas().sort_values(["stream_id", "k"])
    small, big = run(10**6), run(10)
    assert small["converged"].all() and big["converged"].all() and (small["gap"] < 1e-6).all()
    assert [list(e) for e in small["edges"]] == [list(e) for e in big["edges"]]
    assert np.allclose(small["ll"], big["ll"], atol=1e-7) and np.allclose(small["n"], big["n"], atol=1e-6)


def test_gap_bounds_what_other_parameters_reach():
    rng = np.random.default_rng(2)
    h = np.zeros((200, 3))
    h[np.arange(200), rng.integers(0, 3, 200)] = 1.0
    s = rng.exponential(1.0, (200, 1))
    for n in (None, np.array([0.7])):
        cost = np.array([[20.0, 30.0, 25.0, 150.0]])[:, : 3 + (n is None)]
        value = lambda x: np.log(h @ x[:3] + (x[3] if n is None else n[0]) * s[:, 0]).sum() - cost[0] @ x
        best = concave.maximise(h, s, cost, np.full(cost.shape, 0.5), n)
        assert best.gap[0] < 1e-7
        top = value(best.theta[0])
        for _ in range(300):
            x = rng.exponential(1.0, cost.shape[1])
            _, sums, _ = concave.partial_sums(h, s, x[None], n)
            gap = concave.optimality_gap(x[None], sums, cost, 200)[0]
            assert value(x) <= top + 1e-9 and top <= value(x) + gap + 1e-9
