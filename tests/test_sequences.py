import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplework.functions.columns import with_binomial_upper
from ripplework.operators import cascades as ca
from ripplework.operators import scaling as sc
from ripplework.operators import shape as sh
from ripplework.operators import tail as ta
from ripplework.operators.sequence import MAX_ROWS_KEY, arrange, group_quantiles, has_hot_group


def events_of(spark, streams: dict):
    rows = [(s, i, float(t)) for s, ts in streams.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "stream_id string, event_id long, t double")


@pytest.fixture(scope="module")
def skewed(spark):
    """One stream holds most rows, with ties."""
    rng = np.random.default_rng(5)
    streams = {"hot": np.round(np.sort(rng.uniform(0, 400, 1500)), 1)}
    streams |= {f"s{i}": np.sort(rng.uniform(0, 100, 20)) for i in range(5)}
    return events_of(spark, streams).withColumn("v", F.when(F.col("event_id") % 7 > 0, F.col("event_id") % 5)).cache()


def test_blocks_agree_with_plain_windows(spark, skewed):
    def run(blocked):
        seq = arrange(skewed, ["stream_id"], ["t", "event_id"], blocked=blocked)
        return seq.add(rn="rn", lags={"before": "v"}, leads={"after": "v"}, sums={"total": "v"}).rows().toPandas().sort_values(["stream_id", "event_id"]).reset_index(drop=True)

    plain, blocks = run(False), run(True)
    assert plain[["rn", "before", "after", "total"]].equals(blocks[["rn", "before", "after", "total"]])


def test_hot_group_is_measured(spark, skewed):
    assert not has_hot_group(skewed, ["stream_id"])
    spark.conf.set(MAX_ROWS_KEY, "1000")
    try:
        assert has_hot_group(skewed, ["stream_id"])
        assert arrange(skewed, ["stream_id"], ["t", "event_id"]).blocked
    finally:
        spark.conf.unset(MAX_ROWS_KEY)


def test_quantiles_agree(spark, skewed):
    probs = {"a": 0.5, "b": 0.025, "c": 0.9}
    plain = group_quantiles(skewed, ["stream_id"], "t", probs, blocked=False).toPandas().sort_values("stream_id")
    blocks = group_quantiles(skewed, ["stream_id"], "t", probs, blocked=True).toPandas().sort_values("stream_id")
    assert np.allclose(plain[["a", "b", "c"]], blocks[["a", "b", "c"]], atol=1e-12)


def test_burstiness_and_fano(spark):
    rng = np.random.default_rng(2)
    clumps = np.sort(np.concatenate([rng.normal(20, 0.5, 200), rng.normal(80, 0.5, 200)]))
    ev = events_of(spark, {"even": range(100), "poisson": np.sort(rng.uniform(0, 100, 2000)), "clumps": clumps, "two": [0, 1]})
    b = {r.stream_id: r.burstiness for r in sh.burstiness(ev).collect()}
    assert b["even"] == -1.0 and abs(b["poisson"]) < 0.05 and b["clumps"] > 0.5 and b["two"] is None
    streams = sh.stream_spans(ev).withColumn("horizon", F.lit(100.0))
    f = {(r.stream_id, r.window_size): r.fano for r in sh.fano_profile(ev, streams, [5.0, 60.0]).collect()}
    assert abs(f["poisson", 5.0] - 1) < 0.6 and f["clumps", 5.0] > 5 and f["clumps", 60.0] is None
    assert f["even", 5.0] == 0.0


def test_equal_count_segments(spark):
    ev = events_of(spark, {"a": [0.1, 0.2, 5, 9, 9.1, 9.2]})
    streams = sh.stream_spans(ev).withColumn("horizon", F.lit(10.0))
    edges = sh.segment_edges(ev, streams, [3])
    row = edges.first()
    assert row.edges[0] == 0.0 and row.edges[3] == 10.0
    counts = sh.with_segment(ev, edges).groupBy("seg").count().collect()
    assert sorted(r["count"] for r in counts) == [2, 2, 2]


def test_quiet_time_runs(spark):
    ev = events_of(spark, {"x": [0, 1, 2, 100, 101], "merge": [0, 1, 2, 3], "split": [0, 1, 11, 12]})
    dt = spark.createDataFrame([("x", 3.0), ("merge", 2.0), ("split", 2.0)], "stream_id string, dt double")
    for blocked in (False, True):
        got = ca.quiet_time_cascades(ev, dt, blocked=blocked).collect()
        sizes = {}
        for row in got:
            sizes.setdefault(row.stream_id, []).append(row["size"])
        assert sorted(sizes["x"]) == [2, 3] and sizes["merge"] == [4] and sorted(sizes["split"]) == [2, 2]
    bad = dt.withColumn("dt", F.lit(float("nan")))
    with pytest.raises(Exception, match="finite"):
        ca.quiet_time_cascades(ev, bad).collect()
    with pytest.raises(NotImplementedError):
        ca.quiet_time_cascades(ev, dt, ca.MergePolicy(single_membership=False))


def forest(spark, parents, roots):
    rows = [("s", i, float(i), p if p >= 0 else None, r) for i, (p, r) in enumerate(zip(parents, roots))]
    return spark.createDataFrame(rows, "stream_id string, idx long, t double, parent_idx long, root_idx long")


def test_reply_trees(spark):
    got = ca.reply_tree_cascades(forest(spark, [-1, 0, 1, -1], [0, 0, 0, 3])).collect()
    assert sorted((r["size"], r.duration) for r in got) == [(1, 1), (3, 3)]
    deep = forest(spark, [-1, *range(0, 149)], [0] * 150)
    assert ca.reply_tree_cascades(deep).first().duration == 150
    with pytest.raises(Exception, match="breaks its rules"):
        ca.reply_tree_cascades(forest(spark, [-1, 0, 1, -1], [0, 0, 3, 3])).collect()


def test_adjusted_rand(spark):
    rows = spark.createDataFrame([(0, 0, 0), (0, 0, 1), (1, 1, 0), (1, 1, 1)], "a int, same int, other int").withColumn("cnt", F.lit(1))
    assert ca.adjusted_rand(rows, [], "a", "same").first().ari == 1.0
    assert ca.adjusted_rand(rows, [], "a", "other").first().ari < 0.5


def zipf(n, seed, a=2.5):
    return np.random.default_rng(seed).zipf(a, n)


def histogram(spark, name, x):
    v, c = np.unique(x, return_counts=True)
    return spark.createDataFrame([(name, int(i), int(j)) for i, j in zip(v, c)], "set_id string, value long, cnt long")


def test_tail_recovers_and_rejects(spark):
    cut = zipf(8000, 1, 2.0)
    hist = histogram(spark, "pure", zipf(5000, 3)).unionByName(histogram(spark, "cut", cut[cut < 40])).unionByName(histogram(spark, "one", np.ones(50)))
    got = {r.set_id: r for r in ta.tail_verdict(hist, ["set_id"]).collect()}
    assert 2.3 < got["pure"].alpha < 2.75 and got["pure"].passes
    assert got["cut"].r_truncated_power_law < 0 and got["cut"].p_truncated_power_law < 0.05 and not got["cut"].passes
    assert got["one"].alpha is None and got["one"].passes is False


def test_bootstrap_is_reproducible_and_whole(spark):
    hist = histogram(spark, "pure", zipf(3000, 3))
    fits = ta.fit_tail(hist, ["set_id"])
    a = ta.bootstrap_tails(hist, fits, ["set_id"], 5, seed=1).groupBy("replicate").agg(F.sum("cnt").alias("n")).collect()
    assert {r.n for r in a} == {3000} and len(a) == 5
    p1 = ta.bootstrap_p(hist, fits, ["set_id"], 10, seed=1).first().p_boot
    p2 = ta.bootstrap_p(hist.repartition(3), fits, ["set_id"], 10, seed=1).first().p_boot
    assert p1 == p2 and p1 >= 0.1


def planted_cascades(spark, n=20000):
    """Durations with tail 2, sizes growing as duration squared."""
    rng = np.random.default_rng(4)
    d = np.minimum(np.floor((1 - rng.random(n)) ** -1.0), 500).astype(int)
    s = np.maximum(1, np.round(0.5 * d**2 * rng.uniform(0.8, 1.2, n))).astype(int)
    rows = [("p", i, int(a), int(b)) for i, (a, b) in enumerate(zip(s, d))]
    return spark.createDataFrame(rows, "set_id string, cascade_id long, size long, duration long")


def test_scaling_and_shuffle(spark):
    cas = planted_cascades(spark).withColumn("censored", F.col("cascade_id") % 3 == 0).cache()
    cells = sc.cascade_cells(cas, ["set_id"])
    assert cells.agg(F.sum("cnt")).first()[0] == cas.where("NOT censored").count()
    slope = sc.binned_slope(cells, ["set_id"]).first().binned_slope
    assert 1.7 < slope < 2.3
    mixed = sc.shuffle_pairing(cas, ["set_id"]).cache()
    kept = cas.where("NOT censored")
    for c in ("size", "duration"):
        assert sorted(r[0] for r in mixed.select(c).collect()) == sorted(r[0] for r in kept.select(c).collect())
    assert abs(mixed.agg(F.corr("size", "duration")).first()[0]) < 0.1
    blocked = sc.shuffle_pairing(cas, ["set_id"], blocked=True)
    assert blocked.exceptAll(mixed.select(*blocked.columns)).isEmpty()


def test_resampling_keeps_the_total(spark):
    cells = sc.cascade_cells(planted_cascades(spark, 3000), ["set_id"])
    n = sc.resample_cells(cells, ["set_id"], 4, seed=2).groupBy("replicate").agg(F.sum("cnt").alias("n")).collect()
    assert [r.n for r in n] == [3000] * 4


def test_labels_of_residuals(spark):
    def label(samples, resolution=None):
        rows = spark.createDataFrame([("x", i, float(v)) for i, v in enumerate(samples)], "set_id string, replicate int, delta double")
        return sc.corroboration(sc.replicate_interval(rows, ["set_id"]), resolution).first().label

    assert label([-0.08, -0.02, 0, 0.03, 0.07]) == "not-grossly-violated"
    assert label([1.9, 1.95, 2.0, 2.05, 2.1]) == "grossly-violated"
    assert label([0.3, 0.35, 0.4, 0.45, 0.5], F.lit(0.5)) == "not-grossly-violated"
    assert label([0.3, 0.35, 0.4, 0.45, 0.5], F.lit(0.05)) == "grossly-violated"


def test_binomial_bound(spark):
    rows = spark.createDataFrame([(0, 40), (5, 5)], "k int, n int")
    got = {r.k: r.u for r in with_binomial_upper(rows, "k", "n", "u").collect()}
    assert abs(got[0] - (1 - 0.05 ** (1 / 40))) < 1e-9 and got[5] == 1.0


def test_exponents_keep_every_set(spark):
    from ripplework.operators.scaling import exponents

    cells = [("equal", 4, 2, 30)] + [("plain", s, d, 60 // s) for s in range(1, 30) for d in (1, 2 + s // 3)]
    out = {r.set_id: r for r in exponents(spark.createDataFrame(cells, "set_id string, size long, duration long, cnt long"), ["set_id"]).collect()}
    assert set(out) == {"equal", "plain"}
    assert out["equal"].tau is None and out["equal"].delta is None and out["plain"].tau is not None


@pytest.mark.parametrize("block_rows", [None, 3])
def test_shuffled_gaps_keep_gaps_and_span(spark, block_rows):
    rows = [(f"s{i % 3}", i, float((i * i) % 97) + i / 8) for i in range(60)] + [("one", 1, 4.0)]
    events = spark.createDataFrame(rows, "stream_id string, event_id long, t double")
    spark.conf.set(MAX_ROWS_KEY, str(block_rows or 2_000_000))
    try:
        found = sh.shuffled_gaps(events).collect()
    finally:
        spark.conf.unset(MAX_ROWS_KEY)
    assert len(found) == len(rows)
    for stream in ("s0", "s1", "s2", "one"):
        old, new = sorted(r[2] for r in rows if r[0] == stream), sorted(r["t"] for r in found if r["stream_id"] == stream)
        assert new[0] == 0 and new[-1] == pytest.approx(old[-1] - old[0])
        gaps = [sorted(b - a for a, b in zip(x, x[1:])) for x in (old, new)]
        assert gaps[0] == pytest.approx(gaps[1])
    assert {(r["stream_id"], r["t"]) for r in sh.shuffled_gaps(events, seed=1).collect()} != {(r["stream_id"], r["t"]) for r in found}


def test_replies_as_a_share_of_all_events(spark):
    rows = [("a", 0, None), ("a", 1, 0), ("a", 2, 1), ("a", 3, None), ("b", 0, None)]
    forest = spark.createDataFrame(rows, "stream_id string, idx long, parent_idx long")
    assert {r["stream_id"]: r["n_true"] for r in ca.reply_share(forest).collect()} == {"a": 0.5, "b": 0.0}


def test_a_left_out_group_changes_only_its_own_replicate(spark):
    cells = [("x", g, s, d, 40 + 7 * g + s) for g in range(3) for d in range(1, 8) for s in (d, d * d, d * d + 2)]
    table = spark.createDataFrame(cells, "set_id string, own int, size long, duration long, cnt long")
    found = {r["replicate"]: r["delta"] for r in sc.leave_out_residuals(table, ["set_id"], "own", 3, min_count=20).collect()}
    assert sorted(found) == [0, 1, 2] and None not in found.values()
    for g in found:
        rest = table.where(f"own <> {g}").groupBy("set_id", "size", "duration").agg(F.sum("cnt").alias("cnt"))
        assert sc.exponents(rest, ["set_id"], min_count=20).first()["delta"] == pytest.approx(found[g])
