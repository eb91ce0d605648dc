"""Queries over event sequences and cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplework.operators import cascades as ca
from ripplework.operators import shape as sh
from ripplework.operators.sequence import arrange
from ripplework.plans import frames as fr
from ripplework.plans.catalog import query
from ripplework.plans.sql import DEPTH, EV, EV_TYPE, FOREST, RANKED, TREES, quiet_cte, r, with_

GRID_H = 24.0
FANO_WIDTHS = (12.0, 48.0, 144.0)


def bursty_cascades(spark, sf) -> DataFrame:
    events, streams = fr.user_streams(spark, sf)
    hot = fr.is_hot(spark, sf)
    found = ca.quiet_time_cascades(events, ca.bin_width(events, 1.0, blocked=hot), blocked=hot)
    sizes = found.groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("n_cascades"),
        F.max("size").alias("max_size"),
        F.avg("size").alias("mean_size"),
        F.max("duration").alias("max_duration"),
    )
    fano = sh.fano_profile(events, streams, [48.0]).select("stream_id", "fano")
    return sh.burstiness(events, blocked=hot).join(sizes, "stream_id").join(fano, "stream_id")


_BURST = """
burst AS (SELECT stream_id, count(*) AS n_events, CASE WHEN count(*) >= 3 THEN
  (stddev_pop(gap) - avg(gap)) / (stddev_pop(gap) + avg(gap)) END AS burstiness FROM rk GROUP BY 1)"""


def _fano_cte(widths) -> str:
    values = ", ".join(f"({w}::DOUBLE)" for w in widths)
    return f"""
wins AS (SELECT stream_id, w AS window_size, CAST(floor(horizon / w) AS BIGINT) AS n_windows FROM st, (VALUES {values}) v(w)),
filled AS (SELECT stream_id, window_size, n_windows, unnest(generate_series(0, n_windows - 1)) AS bin FROM wins WHERE n_windows >= 2),
hits AS (SELECT e.stream_id, w.window_size, least(CAST(floor(e.t / w.window_size) AS BIGINT), w.n_windows - 1) AS bin, count(*) AS c
  FROM ev e JOIN wins w USING (stream_id) WHERE e.t <= w.n_windows * w.window_size GROUP BY 1, 2, 3),
fano AS (SELECT stream_id, window_size, var_pop(coalesce(c, 0)) / avg(coalesce(c, 0)) AS fano
  FROM filled LEFT JOIN hits USING (stream_id, window_size, bin) GROUP BY 1, 2)"""


@query(
    "flagship_bursty_cascades",
    with_(EV, RANKED, quiet_cte(), _BURST, _fano_cte([48.0]))
    + f"""SELECT stream_id, b.n_events, {r('burstiness', 'burstiness')}, count(*) AS n_cascades, max(size) AS max_size,
    {r('avg(size)', 'mean_size')}, max(duration) AS max_duration, {r('any_value(fano)', 'fano')}
    FROM burst b JOIN quiet USING (stream_id) JOIN fano USING (stream_id) GROUP BY stream_id, b.n_events, burstiness""",
)
def _(spark, sf):
    return bursty_cascades(spark, sf)


@query(
    "agg06_bin_counts",
    with_(
        EV,
        f"""nb AS (SELECT stream_id, CAST(ceil(horizon / {GRID_H}) AS BIGINT) AS nb FROM st),
        hit AS (SELECT e.stream_id, least(CAST(floor(e.t / {GRID_H}) AS BIGINT), nb - 1) AS bin, count(*) AS c
          FROM ev e JOIN nb USING (stream_id) GROUP BY 1, 2),
        frame AS (SELECT stream_id, unnest(generate_series(0, nb - 1)) AS bin FROM nb)""",
    )
    + "SELECT stream_id, bin, coalesce(c, 0) AS cnt FROM frame LEFT JOIN hit USING (stream_id, bin)",
)
def _(spark, sf):
    events, streams = fr.user_streams(spark, sf)
    return sh.bin_counts(events, streams, GRID_H)


@query(
    "dst01_burstiness",
    with_(EV, RANKED, _BURST) + f"SELECT stream_id, n_events, {r('burstiness', 'burstiness')} FROM burst",
)
def _(spark, sf):
    events, _ = fr.user_streams(spark, sf)
    return sh.burstiness(events)


@query(
    "dst02_fano_profile",
    with_(EV, _fano_cte(FANO_WIDTHS))
    + f"SELECT stream_id, window_size, n_windows, {r('fano', 'fano')} FROM wins LEFT JOIN fano USING (stream_id, window_size)",
)
def _(spark, sf):
    events, streams = fr.user_streams(spark, sf)
    return sh.fano_profile(events, streams, FANO_WIDTHS)


def _mean_variance_cte(frame: str) -> str:
    return f"""
frame AS ({frame}),
sized AS (SELECT *, CAST(floor(span / width + 1e-9) AS BIGINT) AS n_windows FROM frame),
filled AS (SELECT stream_id, window_id, unnest(generate_series(0, n_windows - 1)) AS bin FROM sized),
hits AS (SELECT e.stream_id, f.window_id, least(CAST(floor(e.t / f.width) AS BIGINT), f.n_windows - 1) AS bin, count(*) AS c
  FROM ev e JOIN sized f USING (stream_id) WHERE e.t <= f.n_windows * f.width AND e.t <= f.span GROUP BY 1, 2, 3),
mom AS (SELECT stream_id, window_id, avg(coalesce(c, 0)) AS m, var_samp(coalesce(c, 0)) AS v
  FROM filled LEFT JOIN hits USING (stream_id, window_id, bin) GROUP BY 1, 2),
mv AS (SELECT stream_id, window_id, width, n_windows, m AS mean_count,
  CASE WHEN n_windows >= 15 AND m >= 5 AND v > m THEN 1 - sqrt(m / v) END AS n_hat
  FROM sized LEFT JOIN mom USING (stream_id, window_id))"""


_LADDER = """SELECT stream_id, j AS window_id, horizon AS span,
  horizon / (800.0::DOUBLE * pow(15.0::DOUBLE / 800.0, j / 9.0::DOUBLE)) AS width FROM st, generate_series(0, 9) g(j)"""
_MIDDLE = """SELECT stream_id, j AS window_id, CASE WHEN j = 0 THEN horizon ELSE horizon / 3.0::DOUBLE END AS span,
  horizon / 120.0::DOUBLE AS width FROM st, (VALUES (0), (1)) v(j)"""


@query(
    "dst03_mean_variance",
    with_(EV_TYPE, _mean_variance_cte(_LADDER))
    + f"""SELECT stream_id, window_id, {r('width', 'width')}, n_windows, {r('mean_count', 'mean_count')}, {r('n_hat', 'n_hat')} FROM mv""",
)
def _(spark, sf):
    events, streams = fr.type_streams(spark, sf)
    return sh.mean_variance_n(events, sh.window_ladder(streams))


@query(
    "dst04_mean_variance_rise",
    with_(
        EV_TYPE,
        _mean_variance_cte(_LADDER),
        "ends AS (SELECT stream_id, arg_min(n_hat, window_id) AS a, arg_max(n_hat, window_id) AS b FROM mv WHERE n_hat IS NOT NULL GROUP BY 1)",
        _mean_variance_cte(_MIDDLE).replace("frame AS", "frame2 AS").replace("FROM frame)", "FROM frame2)")
        .replace("sized", "sized2").replace("filled", "filled2").replace("hits", "hits2").replace("mom", "mom2").replace("mv AS", "mv2 AS"),
        """thirds AS (SELECT stream_id, max(CASE WHEN window_id = 0 THEN n_hat END) AS n_whole,
          max(CASE WHEN window_id = 1 THEN n_hat END) AS n_first_third FROM mv2 GROUP BY 1)""",
    )
    + f"""SELECT stream_id, {r('n_whole', 'n_whole')}, {r('n_first_third', 'n_first_third')}, {r('a', 'n_small_window')},
    {r('b', 'n_large_window')}, {r('b - a', 'rise')} FROM thirds LEFT JOIN ends USING (stream_id)""",
)
def _(spark, sf):
    events, streams = fr.type_streams(spark, sf)
    return sh.mean_variance_rise(events, streams)


_RATES = """
hit AS (SELECT e.stream_id, CAST(least(floor(e.t * 8.0 / st.horizon), 7) AS BIGINT) AS window_id, count(*) AS c
  FROM ev e JOIN st USING (stream_id) GROUP BY 1, 2),
rates AS (SELECT st.stream_id, g.j AS window_id, coalesce(c, 0) AS cnt, coalesce(c, 0) * 8.0::DOUBLE / st.horizon AS rate
  FROM st CROSS JOIN generate_series(0, 7) g(j) LEFT JOIN hit ON hit.stream_id = st.stream_id AND hit.window_id = g.j)"""


@query(
    "dst05_rate_swing",
    with_(EV, _RATES)
    + f"""SELECT stream_id, {r('max(CASE WHEN cnt > 0 THEN rate END) / min(CASE WHEN cnt > 0 THEN rate END)', 'swing')},
    {r('max(rate) / greatest(min(rate), 1e-9)', 'swing_with_empty')} FROM rates GROUP BY 1""",
)
def _(spark, sf):
    events, streams = fr.user_streams(spark, sf)
    return sh.rate_swing(events, streams)


@query(
    "dst06_rate_trajectory",
    with_(EV, _RATES) + f"SELECT stream_id, window_id, cnt, {r('rate', 'rate')} FROM rates",
)
def _(spark, sf):
    events, streams = fr.user_streams(spark, sf)
    return sh.window_rates(events, streams)


@query(
    "dst07_quarter_ratio",
    with_(EV)
    + f"""SELECT stream_id, {r('count(*) FILTER (WHERE t >= horizon - horizon / 4.0::DOUBLE) / greatest(count(*) FILTER (WHERE t < horizon / 4.0::DOUBLE), 1)::DOUBLE', 'quarter_ratio')}
    FROM ev JOIN st USING (stream_id) GROUP BY 1""",
)
def _(spark, sf):
    events, streams = fr.user_streams(spark, sf)
    return sh.quarter_ratio(events, streams)


@query(
    "dst08_tie_fraction",
    with_(
        EV,
        f"""q AS (SELECT stream_id, event_id, floor(t / {GRID_H}) * {GRID_H}::DOUBLE AS t FROM ev),
        d AS (SELECT stream_id, t - lag(t) OVER (PARTITION BY stream_id ORDER BY t, event_id) AS gap FROM q)""",
    )
    + f"""SELECT stream_id, {r('coalesce(avg(CASE WHEN gap = 0 THEN 1.0 WHEN gap IS NOT NULL THEN 0.0 END), 0.0)', 'tie_fraction')} FROM d GROUP BY 1""",
)
def _(spark, sf):
    events, _ = fr.user_streams(spark, sf)
    return sh.tie_fraction(events.withColumn("t", sh.quantize(F.col("t"), GRID_H)))


@query(
    "win01_gaps",
    with_(EV, RANKED) + f"SELECT stream_id, event_id, rn, {r('gap', 'gap')} FROM rk",
)
def _(spark, sf):
    events, _ = fr.user_streams(spark, sf)
    return sh.gaps(events).select("stream_id", "event_id", "rn", "gap")


@query(
    "win04_run_labels",
    with_(EV, RANKED, quiet_cte()) + "SELECT stream_id, bin, cnt, run_id FROM runs",
)
def _(spark, sf):
    events, _ = fr.user_streams(spark, sf)
    hot = fr.is_hot(spark, sf)
    bins = ca.occupied_bins(events, ca.bin_width(events, 1.0, blocked=hot))
    return ca.bin_runs(bins, ["stream_id"], blocked=hot).select(
        "stream_id", "bin", "cnt", "run_id"
    )


_EDGES = """
pieces AS (SELECT st.stream_id, k, j, horizon, greatest(least(CAST(round_even(j * n_events / k::DOUBLE, 0) AS BIGINT), n_events - 1), 1) AS i
  FROM st, (VALUES (4), (6)) v(k), generate_series(0, 6) g(j) WHERE j <= k),
edges AS (SELECT p.stream_id, k, j, CASE WHEN j = 0 THEN 0.0 WHEN j = k THEN any_value(horizon) ELSE 0.5 * sum(r.t) END AS edge
  FROM pieces p JOIN rk r ON r.stream_id = p.stream_id AND (r.rn = p.i OR r.rn = p.i + 1) GROUP BY 1, 2, 3)"""

_SEGMENTED = """
segs AS (SELECT r.stream_id, e.k, r.event_id, any_value(r.t) AS t,
  greatest(least(count(*) FILTER (WHERE e.edge <= r.t) - 1, e.k - 1), 0) AS seg
  FROM rk r JOIN edges e USING (stream_id) GROUP BY 1, 2, 3),
placed AS (SELECT s.*, a.edge AS seg_lo, b.edge AS seg_hi FROM segs s
  JOIN edges a ON a.stream_id = s.stream_id AND a.k = s.k AND a.j = s.seg
  JOIN edges b ON b.stream_id = s.stream_id AND b.k = s.k AND b.j = s.seg + 1)"""


@query(
    "win05_segment_edges",
    with_(EV, RANKED, _EDGES) + f"SELECT stream_id, k, j, {r('edge', 'edge')} FROM edges",
)
def _(spark, sf):
    events, streams = fr.user_streams(spark, sf)
    edges = sh.segment_edges(events, streams, [4, 6])
    return edges.select("stream_id", "k", F.posexplode("edges").alias("j", "edge"))


@query(
    "joi03_segment_lookup",
    with_(EV, RANKED, _EDGES, _SEGMENTED) + "SELECT stream_id, k, event_id, seg FROM placed",
)
def _(spark, sf):
    events, streams = fr.user_streams(spark, sf)
    rows = sh.with_segment(events, sh.segment_edges(events, streams, [4, 6]))
    return rows.select("stream_id", "k", "event_id", "seg")


@query(
    "scl09_segment_weight",
    with_(EV, RANKED, _EDGES, _SEGMENTED)
    + f"""SELECT stream_id, k, event_id, {r('(t - seg_lo) / (seg_hi - seg_lo)', 'weight')},
    {r('1.0 + 2.0 * (t - seg_lo) / (seg_hi - seg_lo)', 'baseline')} FROM placed""",
)
def _(spark, sf):
    events, streams = fr.user_streams(spark, sf)
    rows = sh.with_segment(events, sh.segment_edges(events, streams, [4, 6]))
    # baseline rising from 1 to 3 inside every segment
    level = (1.0 - F.col("weight")) * 1.0 + F.col("weight") * 3.0
    return rows.select("stream_id", "k", "event_id", "weight", level.alias("baseline"))


@query(
    "scl01_quantize",
    with_(EV) + f"SELECT stream_id, event_id, {r('floor(t / 2.0) * 2.0::DOUBLE', 't')} FROM ev",
)
def _(spark, sf):
    events, _ = fr.user_streams(spark, sf)
    return events.withColumn("t", sh.quantize(F.col("t"), 2.0))


@query(
    "top01_time_order",
    with_(
        EV,
        f"""q AS (SELECT stream_id, event_id, floor(t / {GRID_H}) * {GRID_H}::DOUBLE AS t FROM ev)""",
    )
    + "SELECT stream_id, event_id, row_number() OVER (PARTITION BY stream_id ORDER BY t, event_id) AS place FROM q",
)
def _(spark, sf):
    events, _ = fr.user_streams(spark, sf)
    tied = events.withColumn("t", sh.quantize(F.col("t"), GRID_H))
    return arrange(tied, ["stream_id"], ["t", "event_id"]).add(rn="place").rows().select("stream_id", "event_id", "place")


@query(
    "set01_dense_ids",
    with_(
        EV,
        f"q AS (SELECT DISTINCT stream_id, CAST(floor(t / {GRID_H}) AS BIGINT) AS bin FROM ev)",
    )
    + "SELECT stream_id, bin, row_number() OVER (PARTITION BY stream_id ORDER BY bin) - 1 AS dense_id FROM q",
)
def _(spark, sf):
    events, _ = fr.user_streams(spark, sf)
    bins = events.select("stream_id", F.floor(F.col("t") / GRID_H).alias("bin")).distinct()
    ranked = arrange(bins, ["stream_id"], ["bin"]).add(rn="_rn").rows()
    return ranked.select("stream_id", "bin", (F.col("_rn") - 1).alias("dense_id"))


@query(
    "cas02_bin_width",
    with_(EV, RANKED)
    + f"SELECT stream_id, count(*) AS n_events, {r('0.75::DOUBLE * median(gap)', 'dt')} FROM rk GROUP BY 1",
)
def _(spark, sf):
    events, _ = fr.user_streams(spark, sf)
    return ca.bin_width(events, 0.75)


_UPDATES = """
upd AS (SELECT stream_id, idx AS event_id, t FROM forest WHERE is_update)"""


@query(
    "cas03_quiet_time_cascades",
    with_(EV, RANKED, FOREST, _UPDATES, quiet_cte(2.0, "upd")) + "SELECT stream_id, cascade_id, size, duration FROM quiet",
)
def _(spark, sf):
    labeled = fr.forest(spark, sf).drop("event_id").withColumnRenamed("idx", "event_id")
    hot = fr.is_hot(spark, sf)
    return ca.quiet_time_cascades(
        ca.belief_updates(labeled), ca.bin_width(labeled, 2.0, blocked=hot), blocked=hot
    )


@query(
    "cas04_merge_policy",
    with_(EV, RANKED, quiet_cte(3.0)) + "SELECT stream_id, count(*) AS n_cascades, max(size) AS max_size FROM quiet GROUP BY 1",
)
def _(spark, sf):
    events, _ = fr.user_streams(spark, sf)
    policy = ca.MergePolicy(single_membership=True, bin_edge="left-closed")
    found = ca.quiet_time_cascades(events, ca.bin_width(events, 3.0), policy)
    return found.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n_cascades"), F.max("size").alias("max_size"))


@query(
    "win11_event_depth",
    with_(EV, RANKED, FOREST, DEPTH, recursive=True) + "SELECT stream_id, idx, depth FROM walk",
)
def _(spark, sf):
    return ca.event_depth(fr.forest(spark, sf)).select("stream_id", "idx", "depth")


@query(
    "joi04_parent_lookup",
    with_(EV, RANKED, FOREST)
    + f"""SELECT c.stream_id, c.idx, c.parent_idx, {r('c.t - p.t', 'reply_delay')} FROM forest c
    LEFT JOIN forest p ON p.stream_id = c.stream_id AND p.idx = c.parent_idx""",
)
def _(spark, sf):
    labeled = fr.forest(spark, sf).select("stream_id", "idx", "parent_idx", "t")
    parent = labeled.select("stream_id", F.col("idx").alias("parent_idx"), F.col("t").alias("_pt"))
    return labeled.join(parent, ["stream_id", "parent_idx"], "left").select(
        "stream_id", "idx", "parent_idx", (F.col("t") - F.col("_pt")).alias("reply_delay")
    )


@query(
    "cas01_reply_trees",
    with_(EV, RANKED, FOREST, DEPTH, TREES, recursive=True) + "SELECT stream_id, cascade_id, size, duration FROM tree_cascades",
)
def _(spark, sf):
    return ca.reply_tree_cascades(fr.forest(spark, sf))


@query(
    "agg05_conversation_trees",
    """SELECT CAST(conv_id AS VARCHAR) AS stream_id, 0 AS cascade_id, count(*) AS size, count(*) AS duration
    FROM conversations GROUP BY 1""",
)
def _(spark, sf):
    turns = fr.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").alias("event_id"), F.col("turn").cast("double").alias("t")
    )
    ranked = arrange(turns, ["stream_id"], ["t", "event_id"]).add(rn="_rn").rows()
    chain = ranked.select(
        "stream_id",
        (F.col("_rn") - 1).alias("idx"),
        F.when(F.col("_rn") > 1, F.col("_rn") - 2).alias("parent_idx"),
        F.lit(0).cast("bigint").alias("root_idx"),
    )
    return ca.reply_tree_cascades(chain)


@query(
    "agg07_structural_branching",
    with_(EV, RANKED, FOREST, DEPTH, TREES, recursive=True)
    + f"SELECT stream_id, {r('1.0 - count(*) / sum(size)', 'n_struct')} FROM tree_cascades GROUP BY 1",
)
def _(spark, sf):
    return ca.structural_branching(ca.reply_tree_cascades(fr.forest(spark, sf)))


@query(
    "agg08_generative_branching",
    with_(EV)
    + f"""SELECT stream_id, {r('count(*) FILTER (WHERE value > 30) / count(*)::DOUBLE', 'n_tree')} FROM ev GROUP BY 1""",
)
def _(spark, sf):
    events = fr.events_by(spark, sf)
    counters = events.groupBy("stream_id").agg(F.count_if(F.col("value") > 30).alias("successes"))
    return ca.generative_branching(sh.stream_spans(events), counters)


@query(
    "agg09_trajectory_variance",
    with_(EV) + f"SELECT stream_id, {r('var_pop(value)', 'chi', 4)} FROM ev GROUP BY 1",
    digits=4,
)
def _(spark, sf):
    return ca.trajectory_variance(fr.events_by(spark, sf).select("stream_id", "value"))


_RAND = """
cells AS (SELECT quality AS a, toxic AS b, count(*) AS c FROM labels GROUP BY 1, 2),
sums AS (SELECT (SELECT sum(c * (c - 1) / 2) FROM cells) AS sab,
  (SELECT sum(x * (x - 1) / 2) FROM (SELECT sum(c) AS x FROM cells GROUP BY a)) AS sa,
  (SELECT sum(x * (x - 1) / 2) FROM (SELECT sum(c) AS x FROM cells GROUP BY b)) AS sb,
  (SELECT sum(c) FROM cells) AS n)"""


@query(
    "cas05_adjusted_rand",
    with_(_RAND)
    + f"""SELECT CAST(n AS BIGINT) AS n_events, {r('(sab - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2))', 'ari')} FROM sums""",
)
def _(spark, sf):
    cells = fr.table(spark, sf, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("cnt"))
    return ca.adjusted_rand(cells, [], "quality", "toxic")


@query(
    "joi05_contingency",
    with_(EV, RANKED, FOREST, quiet_cte())
    + """SELECT f.stream_id, u.run_id, f.root_idx, count(*) AS cnt FROM forest f
    JOIN widths w USING (stream_id) JOIN runs u ON u.stream_id = f.stream_id AND u.bin = CAST(floor(f.t / w.dt) AS BIGINT)
    GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    labeled = fr.forest(spark, sf).drop("event_id").withColumn("event_id", F.col("idx"))
    hot = fr.is_hot(spark, sf)
    cells = ca.occupied_bins(labeled, ca.bin_width(labeled, 1.0, blocked=hot), extra=["root_idx"])
    runs = ca.bin_runs(cells.select("stream_id", "bin").distinct(), ["stream_id"], blocked=hot)
    return cells.join(runs, ["stream_id", "bin"]).groupBy("stream_id", "run_id", "root_idx").agg(F.sum("cnt").alias("cnt"))


_CALIBRATE = """
ks AS (SELECT * FROM (VALUES (0.25::DOUBLE), (0.5), (0.75), (1.0), (1.5), (2.0), (3.0), (5.0)) v(k)),
widths AS (SELECT stream_id, median(gap) AS g FROM rk GROUP BY 1 HAVING count(*) >= 50),
ub AS (SELECT f.stream_id, k, CAST(floor(f.t / (g * k)) AS BIGINT) AS bin, root_idx, count(*) AS c
  FROM forest f JOIN widths USING (stream_id), ks GROUP BY 1, 2, 3, 4),
ob AS (SELECT DISTINCT stream_id, k, bin FROM ub),
fl AS (SELECT *, CASE WHEN bin - lag(bin) OVER (PARTITION BY stream_id, k ORDER BY bin) > 1 THEN 1 ELSE 0 END AS f FROM ob),
rl AS (SELECT *, sum(f) OVER (PARTITION BY stream_id, k ORDER BY bin) AS run FROM fl),
cl AS (SELECT stream_id, k, run, root_idx, sum(c) AS c FROM ub JOIN rl USING (stream_id, k, bin) GROUP BY 1, 2, 3, 4),
pab AS (SELECT stream_id, k, sum(c * (c - 1) / 2) AS ab, sum(c) AS n FROM cl GROUP BY 1, 2),
pa AS (SELECT stream_id, k, sum(x * (x - 1) / 2) AS a FROM (SELECT stream_id, k, run, sum(c) AS x FROM cl GROUP BY 1, 2, 3) GROUP BY 1, 2),
pb AS (SELECT stream_id, k, sum(x * (x - 1) / 2) AS b FROM (SELECT stream_id, k, root_idx, sum(c) AS x FROM cl GROUP BY 1, 2, 3) GROUP BY 1, 2),
ari AS (SELECT stream_id, k, CASE WHEN (a + b) / 2 = a * b / (n * (n - 1) / 2) THEN 1.0
  ELSE (ab - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)) END AS ari
  FROM pab JOIN pa USING (stream_id, k) JOIN pb USING (stream_id, k)),
means AS (SELECT k, avg(ari) AS mean_ari, count(*) AS used_streams FROM ari GROUP BY 1)"""


@query(
    "cal01_width_calibration",
    with_(EV, RANKED, FOREST, _CALIBRATE)
    + f"""SELECT k, {r('mean_ari', 'mean_ari')}, used_streams, k = (SELECT k FROM means ORDER BY mean_ari DESC, k LIMIT 1) AS is_best,
    (SELECT max(mean_ari) FROM means) >= 0.9 AS cleared FROM means""",
)
def _(spark, sf):
    labeled = fr.forest(spark, sf).drop("event_id")
    return ca.calibrate_width(labeled, min_events=50, blocked=fr.is_hot(spark, sf))


@query(
    "agg10_replicate_means",
    with_(EV, RANKED, FOREST, _CALIBRATE)
    + f"SELECT k, {r('mean_ari', 'mean_ari')}, used_streams FROM means WHERE used_streams > 0",
)
def _(spark, sf):
    labeled = fr.forest(spark, sf).drop("event_id")
    return ca.calibrate_width(labeled, min_events=50, blocked=fr.is_hot(spark, sf)).select("k", "mean_ari", "used_streams")
