"""Queries over self-excitation, likelihoods, fits, the gate and goodness of fit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplework.functions.concave import CONVERGED_GAP
from ripplework.functions.kernels import exponential, fine_power_law, kernel_table, kernels_from_table, power_law
from ripplework.operators import excite as ex
from ripplework.operators import fit as fi
from ripplework.operators import gate as ga
from ripplework.operators import goodness as go
from ripplework.operators import ingest
from ripplework.operators.cascades import reply_share
from ripplework.operators.shape import (
    fano_profile,
    gaps,
    mean_variance_n,
    segment_edges,
    stream_spans,
    time_slice,
    window_ladder,
    shuffled_gaps,
)
from ripplework.plans import frames as fr
from ripplework.plans.catalog import query
from ripplework.plans.shape_queries import _EDGES, _LADDER, _SEGMENTED, _mean_variance_cte
from ripplework.session import checkpointed
from ripplework.plans.sql import EV, EV_TYPE, FIT, FOREST, RANKED, decay_cte, kernel_values, r, stepwise_decay_cte, with_

EPS, C = fi.SHAPE_EPS, fi.SHAPE_C
BETA = 0.5
MU, N = 0.05, 0.4
POINTS = [(0.05, 0.2), (0.05, 0.6), (0.1, 0.4)]
_PTS = "pts(mu, n) AS (VALUES " + ", ".join(f"({m}::DOUBLE, {n}::DOUBLE)" for m, n in POINTS) + ")"

# exact power-law sums by meeting every event with all earlier events of its stream
_EXACT = f"""
exact AS (SELECT i.stream_id, i.event_id, any_value(i.t) AS t, any_value(i.rn) AS rn,
  coalesce(sum({EPS} * pow({C}, {EPS}) / pow(i.t - j.t + {C}, 1 + {EPS})), 0.0) AS g,
  coalesce(sum(1 - pow({C} / ({C} + i.t - j.t), {EPS})), 0.0) AS big_g
  FROM rk i LEFT JOIN rk j ON i.stream_id = j.stream_id AND j.rn < i.rn GROUP BY 1, 2)"""


@query(
    "joi01_power_law_intensity",
    with_(EV, RANKED, _EXACT) + f"SELECT stream_id, event_id, {r(f'{MU} + {N} * g', 'intensity')} FROM exact",
)
def _(spark, sf):
    events, _ = fr.user_streams(spark, sf)
    rows = ex.self_excitation(events, [fine_power_law(EPS, C)])
    return rows.select("stream_id", "event_id", (MU + N * F.get("sums", F.lit(0))).alias("intensity"))


@query(
    "joi02_power_law_compensator",
    with_(EV, RANKED, _EXACT) + f"SELECT stream_id, event_id, {r(f'{MU} * t + {N} * big_g', 'compensator')} FROM exact",
)
def _(spark, sf):
    events, _ = fr.user_streams(spark, sf)
    rows = ex.self_compensator(events, [fine_power_law(EPS, C)])
    return rows.select(
        "stream_id", "event_id", (MU * F.col("t") + N * F.get("sums", F.lit(0))).alias("compensator")
    )


@query(
    "win06_exponential_memory",
    with_(EV, RANKED, decay_cte([exponential(BETA)]))
    + f"SELECT stream_id, event_id, rn - 1 AS prior, {r(f's / {BETA}', 'memory')} FROM s",
)
def _(spark, sf):
    events, _ = fr.user_streams(spark, sf)
    rows = ex.self_excitation(events, [exponential(BETA)])
    return rows.select("stream_id", "event_id", "prior", (F.get("sums", F.lit(0)) / BETA).alias("memory"))


@query(
    "win07_weighted_memory",
    with_(EV, RANKED, decay_cte([power_law(EPS, C)])) + f"SELECT stream_id, event_id, {r('s', 'excitation')} FROM s",
)
def _(spark, sf):
    events, _ = fr.user_streams(spark, sf)
    rows = ex.self_excitation(events, [power_law(EPS, C)])
    return rows.select("stream_id", "event_id", F.get("sums", F.lit(0)).alias("excitation"))


_EXP_LAMBDA = f"""
lam AS (SELECT stream_id, event_id, rn, {MU} * t + {N} * (rn - 1 - s / {BETA}) AS lam FROM s),
inc AS (SELECT *, lam - lag(lam) OVER (PARTITION BY stream_id ORDER BY rn) AS dl FROM lam)"""


def fixed_exponential(spark, sf):
    events, streams = fr.user_streams(spark, sf)
    fits = streams.select("stream_id", F.lit(MU).alias("mu"), F.lit(N).alias("n"), F.lit(BETA).alias("beta"))
    return go.exponential_residuals(events, fits)


@query(
    "win08_exponential_compensator",
    with_(EV, RANKED, decay_cte([exponential(BETA)]), _EXP_LAMBDA)
    + f"SELECT stream_id, event_id, {r('lam', 'compensator')}, {r('dl', 'increment')} FROM inc",
)
def _(spark, sf):
    return fixed_exponential(spark, sf).select(
        "stream_id", "event_id", F.col("Lambda").alias("compensator"), F.col("dl").alias("increment")
    )


def fixed_baseline(spark, sf, basis: str):
    """Four segments with baseline parameters 0.05, 0.06, ... and one branching ratio."""
    events, streams = fr.user_streams(spark, sf)
    edges = segment_edges(events, streams, [4])
    count = F.size("edges") - (2 if basis == "step" else 1)
    theta = F.transform(F.sequence(F.lit(0), count), lambda j: 0.05 + 0.01 * j.cast("double"))
    return events, streams, edges.select(
        "stream_id", "k", "edges", theta.alias("theta"), F.lit(N).alias("n"), F.lit(0).alias("kernel_idx")
    )


_STEP_AREA = """
area AS (SELECT p.stream_id, p.event_id, sum((0.05 + 0.01 * a.j) * (CASE WHEN a.j = p.seg THEN p.t - a.edge ELSE b.edge - a.edge END)) AS area
  FROM placed p JOIN edges a ON a.stream_id = p.stream_id AND a.k = p.k AND a.j <= p.seg
  JOIN edges b ON b.stream_id = a.stream_id AND b.k = a.k AND b.j = a.j + 1 WHERE p.k = 4 GROUP BY 1, 2)"""

_LINEAR_AREA = """
area AS (SELECT p.stream_id, p.event_id, sum(CASE WHEN a.j = p.seg
    THEN (p.t - a.edge) * (0.05 + 0.01 * a.j + 0.005 * (p.t - a.edge) / (b.edge - a.edge))
    ELSE (b.edge - a.edge) * (0.055 + 0.01 * a.j) END) AS area
  FROM placed p JOIN edges a ON a.stream_id = p.stream_id AND a.k = p.k AND a.j <= p.seg
  JOIN edges b ON b.stream_id = a.stream_id AND b.k = a.k AND b.j = a.j + 1 WHERE p.k = 4 GROUP BY 1, 2)"""


def _register_baseline_compensator(name: str, basis: str, area: str) -> None:
    sql = (
        with_(EV, RANKED, _EXACT, _EDGES, _SEGMENTED, area)
        + f"SELECT stream_id, event_id, {r(f'area + {N} * big_g', 'compensator')} FROM exact JOIN area USING (stream_id, event_id)"
    )

    @query(name, sql)
    def _(spark, sf):
        events, _, fits = fixed_baseline(spark, sf, basis)
        rows = go.compensator(events, fits, [fine_power_law(EPS, C)], basis=basis)
        return rows.select("stream_id", "event_id", F.col("Lambda").alias("compensator"))


_register_baseline_compensator("win09_step_compensator", "step", _STEP_AREA)
_register_baseline_compensator("win10_linear_compensator", "linear", _LINEAR_AREA)


def _likelihood_sql(kernels) -> str:
    return (
        with_(EV, RANKED, decay_cte(kernels), _PTS)
        + f"""SELECT s.stream_id, s.kernel_idx, mu, n,
        {r('sum(ln(mu + n * s.s)) - mu * any_value(st.horizon) - n * any_value(cc.cc)', 'll', 4)}
        FROM s CROSS JOIN pts JOIN st USING (stream_id) JOIN cc ON cc.stream_id = s.stream_id AND cc.kernel_idx = s.kernel_idx
        GROUP BY 1, 2, 3, 4"""
    )


def _register_likelihood(name: str, kernels, sql: str) -> None:
    @query(name, sql, digits=4)
    def _(spark, sf):
        events, streams = fr.user_streams(spark, sf)
        return ex.log_likelihood(events, streams, kernels, POINTS)


_register_likelihood("lik01_exponential_likelihood", [exponential(BETA)], _likelihood_sql([exponential(BETA)]))
_register_likelihood("lik02_power_law_likelihood", [power_law(EPS, C)], _likelihood_sql([power_law(EPS, C)]))
_register_likelihood(
    "joi06_data_by_grid",
    [exponential(0.1), exponential(0.5), exponential(2.0)],
    _likelihood_sql([exponential(0.1), exponential(0.5), exponential(2.0)]),
)
_register_likelihood(
    "lik03_exact_likelihood",
    [fine_power_law(EPS, C)],
    with_(EV, RANKED, _EXACT, _PTS)
    + f"""SELECT stream_id, 0 AS kernel_idx, mu, n, {r(f'''sum(ln(mu + n * g)) - mu * any_value(horizon)
      - n * sum(1 - pow({C} / ({C} + horizon - t), {EPS}))''', 'll', 4)}
    FROM exact JOIN st USING (stream_id) CROSS JOIN pts GROUP BY 1, 2, 3, 4""",
)


@query(
    "lik04_horizon_mass",
    with_(EV, RANKED, decay_cte([power_law(EPS, C), power_law(1.1, 2.0)]))
    + f"SELECT stream_id, kernel_idx, {r('cc', 'cc')} FROM cc",
)
def _(spark, sf):
    events, streams = fr.user_streams(spark, sf)
    return ex.horizon_mass(events, streams, [power_law(EPS, C), power_law(1.1, 2.0)])


def _baseline_sql(basis: str) -> str:
    if basis == "step":
        level = "0.05 + 0.01 * p.seg"
        area = "sum((0.05 + 0.01 * a.j) * (b.edge - a.edge))"
    else:
        level = "0.05 + 0.01 * p.seg + 0.01 * (p.t - p.seg_lo) / (p.seg_hi - p.seg_lo)"
        area = "sum((0.055 + 0.01 * a.j) * (b.edge - a.edge))"
    return (
        with_(
            EV, RANKED, decay_cte([power_law(EPS, C)]), _EDGES, _SEGMENTED,
            f"""tot AS (SELECT a.stream_id, {area} AS area FROM edges a JOIN edges b
              ON b.stream_id = a.stream_id AND b.k = a.k AND b.j = a.j + 1 WHERE a.k = 4 GROUP BY 1),
            lam AS (SELECT p.stream_id, s.s, {level} + {N} * s.s AS lam FROM placed p JOIN s USING (stream_id, event_id) WHERE p.k = 4)""",
        )
        + f"""SELECT stream_id, 4 AS k, {r(f'sum(ln(lam)) - any_value(area) - {N} * any_value(cc)', 'll', 4)},
        {r('sum(s / lam) - any_value(cc)', 'grad_n', 4)} FROM lam JOIN tot USING (stream_id) JOIN cc USING (stream_id) GROUP BY 1"""
    )


def _register_baseline_likelihood(name: str, basis: str) -> None:
    @query(name, _baseline_sql(basis), digits=4)
    def _(spark, sf):
        events, streams, fits = fixed_baseline(spark, sf, basis)
        return ex.baseline_likelihood(events, streams, fits, power_law(EPS, C), basis=basis)[0]


_register_baseline_likelihood("lik05_step_likelihood", "step")
_register_baseline_likelihood("lik06_linear_likelihood", "linear")

BIN_H = 6.0


@query(
    "lik07_binned_likelihood",
    with_(
        EV, _PTS,
        f"""nb AS (SELECT stream_id, CAST(ceil(horizon / {BIN_H}) AS BIGINT) AS nb FROM st),
        hit AS (SELECT stream_id, least(CAST(floor(t / {BIN_H}) AS BIGINT), nb - 1) AS bin, count(*) AS c FROM ev JOIN nb USING (stream_id) GROUP BY 1, 2),
        frame AS (SELECT stream_id, unnest(generate_series(0, nb - 1)) AS bin FROM nb),
        seen AS (SELECT f.stream_id, f.bin, coalesce(sum(h.c * exp(-{BETA * BIN_H / 2}) * exp(-{BETA * BIN_H} * (f.bin - 1 - h.bin))), 0.0) AS big_s
          FROM frame f LEFT JOIN hit h ON h.stream_id = f.stream_id AND h.bin < f.bin GROUP BY 1, 2),
        lam AS (SELECT s.stream_id, mu, n, coalesce(h.c, 0) AS c, mu * {BIN_H} + n * (1 - exp(-{BETA * BIN_H})) * big_s AS lam
          FROM seen s LEFT JOIN hit h USING (stream_id, bin) CROSS JOIN pts)""",
    )
    + f"SELECT stream_id, mu, n, {r('sum(c * ln(lam) - lam)', 'll', 4)} FROM lam GROUP BY 1, 2, 3",
    digits=4,
)
def _(spark, sf):
    events, streams = fr.user_streams(spark, sf)
    return go.binned_likelihood(events, streams, BIN_H, BETA, POINTS)


# ---- kernels as tables --------------------------------------------------------------------------

_USER_KERNEL = [(0, 0.6, 1.0), (1, 0.02, 0.05)]


def kernel_activity(spark, sf, table):
    """Mean weight each kernel component gives to the gaps of the data."""
    events, _ = fr.user_streams(spark, sf)
    found = gaps(events).where("gap IS NOT NULL").select("gap")
    comps = [(k.kernel_id, i, a, b) for k in kernels_from_table(table) for i, (a, b) in enumerate(zip(k.a, k.beta))]
    rows = found.select("gap", F.inline(F.array(*[
        F.struct(F.lit(i).alias("kernel_no"), F.lit(c[1]).alias("comp"), F.lit(c[2]).alias("a"), F.lit(c[3]).alias("beta"))
        for i, c in enumerate(comps)
    ])))
    return rows.groupBy("comp").agg(
        F.count(F.lit(1)).alias("n_gaps"), F.avg(F.col("a") * F.exp(-F.col("beta") * F.col("gap"))).alias("activity")
    )


def _activity_sql(kernel) -> str:
    return (
        with_(EV, RANKED, kernel_values([kernel]))
        + f"""SELECT comp, count(*) AS n_gaps, {r('avg(a * exp(-beta * gap))', 'activity')}
        FROM rk CROSS JOIN kern WHERE gap IS NOT NULL GROUP BY 1"""
    )


def _register_kernel(name: str, kernel) -> None:
    @query(name, _activity_sql(kernel))
    def _(spark, sf):
        return kernel_activity(spark, sf, kernel_table(spark, [kernel]))


_register_kernel("udx01_exponential_kernel", exponential(BETA))
_register_kernel("udx02_power_law_kernel", power_law(EPS, C))
_register_kernel("udx02_positive_tail_kernel", power_law(0.2, 1.0, signed_tail=False))


@query(
    "udx03_user_kernel",
    with_(EV, RANKED, "kern(comp, a, beta) AS (VALUES (0, 0.6::DOUBLE, 1.0::DOUBLE), (1, 0.02::DOUBLE, 0.05::DOUBLE))")
    + f"""SELECT comp, count(*) AS n_gaps, {r('avg(a * exp(-beta * gap))', 'activity')}
    FROM rk CROSS JOIN kern WHERE gap IS NOT NULL GROUP BY 1""",
)
def _(spark, sf):
    table = spark.createDataFrame([("user", *c) for c in _USER_KERNEL], "kernel_id string, comp int, a double, beta double")
    return kernel_activity(spark, sf, table)


# ---- fits ---------------------------------------------------------------------------------------


@query(
    "fit03_constant_fit",
    with_(EV, RANKED, decay_cte([power_law(EPS, C)]), FIT, recursive=True)
    + f"SELECT stream_id, n_events, {r('mu', 'mu', 4)}, {r('n', 'n', 4)} FROM fit",
    digits=4,
)
def _(spark, sf):
    events, streams = fr.user_streams(spark, sf)
    return fi.fit_constant(events, streams, power_law(EPS, C)).select("stream_id", "n_events", "mu", "n")


@query("fit01_exponential_fit", digits=3)
def _(spark, sf):
    events, streams = fr.user_streams(spark, sf)
    return fi.fit_exponential(events, streams).select("stream_id", "n_events", "n", "mu", "ll")


@query("fit02_profile_interval", digits=3)
def _(spark, sf):
    events, streams = fr.type_streams(spark, sf)
    return fi.profile_interval(events, streams, fi.fit_exponential(events, streams))


def _edges_cte(ks) -> str:
    return f"""
pieces AS (SELECT st.stream_id, k, j, horizon, greatest(least(CAST(round_even(j * n_events / k::DOUBLE, 0) AS BIGINT), n_events - 1), 1) AS i
  FROM st, (VALUES {", ".join(f"({k})" for k in ks)}) v(k), generate_series(0, {max(ks)}) g(j) WHERE j <= k),
edges AS MATERIALIZED (SELECT p.stream_id, k, j, CASE WHEN j = 0 THEN 0.0 WHEN j = k THEN any_value(horizon) ELSE 0.5 * sum(r.t) END AS edge
  FROM pieces p JOIN rk r ON r.stream_id = p.stream_id AND (r.rn = p.i OR r.rn = p.i + 1) GROUP BY 1, 2, 3)"""


def baseline_fit_cte(basis: str, ks, ns=None) -> str:
    """``best(pid, stream_id, k, kernel_idx, z, n, ll, gap, ...)``: the fits of every stream, segment count, kernel and (if given) fixed ``n``.

    Newton steps on the knots of one colour (all pieces of a step baseline, or every other knot of a linear one) together
    with ``n``: given ``n`` they don't touch each other, so a step is a division. Steps are damped by their own length,
    which keeps every intensity positive, and a problem leaves the recursion once two steps in a row are tiny.
    """
    linear = basis == "linear"
    colours = 2 if linear else 1
    level = "th[seg + 1] * (1 - w) + th[least(seg + 2, len(th))] * w" if linear else "th[seg + 1]"
    pick = f"CASE WHEN seg % 2 = it % 2 THEN seg ELSE seg + 1 END AS j, CASE WHEN seg % 2 = it % 2 THEN 1 - w ELSE w END" if linear else "seg AS j, 1.0"
    both = "unnest([{'j': seg, 'a': 1 - w}, {'j': seg + 1, 'a': w}])" if linear else "unnest([{'j': seg, 'a': 1.0}])"
    halves = "SELECT stream_id, k, j, len / 2 AS c FROM lens UNION ALL SELECT stream_id, k, j + 1, len / 2 FROM lens" if linear else "SELECT stream_id, k, j, len AS c FROM lens"
    fixed = ns is not None
    free_n = "0.0" if fixed else "CASE WHEN (n <= 1e-9 AND gs <= cc) OR es - schur <= 1e-300 THEN 0.0 ELSE (gs - cc - shared) / (es - schur) END"
    grid = f"(VALUES {', '.join(f'({x}::DOUBLE)' for x in ns)}) v(z)" if fixed else "(VALUES (0.5::DOUBLE)) v(z)"
    return f"""
segs AS (SELECT r.stream_id, e.k, r.event_id, any_value(r.t) AS t, greatest(least(count(*) FILTER (WHERE e.edge <= r.t) - 1, e.k - 1), 0) AS seg
  FROM rk r JOIN edges e USING (stream_id) GROUP BY 1, 2, 3),
lens AS (SELECT a.stream_id, a.k, a.j, a.edge, b.edge - a.edge AS len FROM edges a JOIN edges b ON b.stream_id = a.stream_id AND b.k = a.k AND b.j = a.j + 1),
places AS (SELECT s.stream_id, s.event_id, s.k, s.seg, CASE WHEN l.len > 0 THEN (s.t - l.edge) / l.len ELSE 0.0 END AS w
  FROM segs s JOIN lens l ON l.stream_id = s.stream_id AND l.k = s.k AND l.j = s.seg),
costs AS (SELECT stream_id, k, list(c ORDER BY j) AS c FROM (SELECT stream_id, k, j, sum(c) AS c FROM ({halves}) GROUP BY 1, 2, 3) GROUP BY 1, 2),
prob AS MATERIALIZED (SELECT row_number() OVER () AS pid, st.stream_id, k, cc.kernel_idx, z, c, cc.cc, n_events,
  list_transform(c, lambda x: greatest(0.5 * n_events / horizon, 1e-6)) AS th FROM st JOIN costs USING (stream_id) JOIN cc USING (stream_id), {grid}),
dsg AS MATERIALIZED (SELECT p.pid, CAST(l.seg AS INTEGER) AS seg, l.w, s.s FROM prob p JOIN places l ON l.stream_id = p.stream_id AND l.k = p.k
  JOIN s ON s.stream_id = l.stream_id AND s.event_id = l.event_id AND s.kernel_idx = p.kernel_idx),
f AS (SELECT 0 AS it, pid, th, z AS n, 1e9::DOUBLE AS moved, 1e9::DOUBLE AS moved0 FROM prob
  UNION ALL
  SELECT it + 1, pid, list_transform(range(len(th)), lambda j: CASE WHEN j % {colours} <> it % {colours} THEN th[j + 1]
      WHEN len(list_filter(up, lambda u: u.j = j)) = 0 THEN CASE WHEN c[j + 1] > 0 THEN 1e-9 ELSE th[j + 1] END
      ELSE greatest(1e-9, th[j + 1] + damp * list_filter(up, lambda u: u.j = j)[1].d) END),
    {"n" if fixed else "greatest(1e-9, n + damp * dn)"}, size, moved
  FROM (SELECT *, CASE WHEN size > 0.25 THEN 1 / (1 + size) ELSE 1.0 END AS damp
    FROM (SELECT *, sqrt(greatest(0, list_sum(list_transform(up, lambda u: u.g * u.d)) + dn * (gs - cc))) AS size
      FROM (SELECT *, list_transform(parts, lambda p: {{'j': p.j, 'g': p.g, 'd': CASE WHEN p.held THEN 0.0 ELSE (p.g - p.b * dn) / p.d END}}) AS up
        FROM (SELECT *, {free_n} AS dn
          FROM (SELECT q.pid, any_value(it) AS it, any_value(q.th) AS th, any_value(n) AS n, any_value(moved) AS moved, any_value(c) AS c, any_value(cc) AS cc,
              sum(gs) AS gs, sum(es) AS es, list({{'j': j, 'g': g - c[j + 1], 'd': d, 'b': b, 'held': q.th[j + 1] <= 1e-9 AND g <= c[j + 1]}}) AS parts,
              coalesce(sum(b * b / d) FILTER (q.th[j + 1] > 1e-9 OR g > c[j + 1]), 0) AS schur,
              coalesce(sum(b * (g - c[j + 1]) / d) FILTER (q.th[j + 1] > 1e-9 OR g > c[j + 1]), 0) AS shared
            FROM (SELECT pid, j, any_value(it) AS it, any_value(th) AS th, any_value(n) AS n, any_value(moved) AS moved,
                sum(a / lam) AS g, greatest(sum(a * a / (lam * lam)), 1e-300) AS d, sum(a * s / (lam * lam)) AS b, sum(s / lam) AS gs, sum(s * s / (lam * lam)) AS es
              FROM (SELECT f.*, s, {pick} AS a, {level} + n * s AS lam FROM f JOIN dsg USING (pid) WHERE it < 2000 AND greatest(moved, moved0) > 1e-9)
              GROUP BY pid, j) q JOIN prob USING (pid) GROUP BY q.pid)))))),
last AS MATERIALIZED (SELECT pid, arg_max(th, it) AS th, arg_max(n, it) AS n FROM f GROUP BY 1),
lik AS (SELECT pid, sum(ln({level} + n * s)) AS logs, sum(s / ({level} + n * s)) AS gs FROM last JOIN dsg USING (pid) GROUP BY 1),
sums AS (SELECT pid, p.j AS j, sum(p.a / lam) AS g FROM (SELECT pid, {level} + n * s AS lam, {both} AS p FROM last JOIN dsg USING (pid)) GROUP BY 1, 2),
ratio AS (SELECT pid, max(CASE WHEN g > 0 THEN g / c[j + 1] ELSE 0 END) AS top, sum(g * last.th[j + 1]) AS xg FROM sums JOIN prob USING (pid) JOIN last USING (pid) GROUP BY 1),
bound AS (SELECT p.pid, stream_id, k, kernel_idx, z, n, logs, cc, n_events, list_sum(list_transform(range(len(c)), lambda j: c[j + 1] * l.th[j + 1])) AS xc,
  {"top" if fixed else "greatest(top, gs / cc)"} AS top, {"n_events - xg" if fixed else "0.0"} AS rest
  FROM prob p JOIN last l USING (pid) JOIN lik USING (pid) JOIN ratio USING (pid)),
best AS MATERIALIZED (SELECT *, logs - xc - n * cc AS ll, n_events * ln(greatest(top, rest / n_events)) - n_events + rest / greatest(top, rest / n_events)
  + xc{"" if fixed else " + n * cc"} AS gap FROM bound)"""


def _criteria(basis: str) -> str:
    p = "k + 2" if basis == "linear" else "k + 1"
    return f"{r(f'2 * ({p}) - 2 * ll', 'aic', 3)}, {r(f'({p}) * ln(n_events) - 2 * ll', 'bic', 3)}"


def _segment_fit_sql(basis: str) -> str:
    return (
        with_(EV, RANKED, decay_cte([power_law(EPS, C)]), _edges_cte(fi.K_SWEEP), baseline_fit_cte(basis, fi.K_SWEEP), recursive=True)
        + f"SELECT stream_id, k, {r('n', 'n', 3)}, {r('ll', 'll', 3)}, {_criteria(basis)}, gap <= {CONVERGED_GAP} AS converged FROM best"
    )


@query("fit04_step_fit", _segment_fit_sql("step"), digits=3)
def _(spark, sf):
    events, streams = fr.user_streams(spark, sf)
    return fi.fit_step(events, streams, power_law(EPS, C), fi.K_SWEEP).select("stream_id", "k", "n", "ll", "aic", "bic", "converged")


@query("fit05_linear_fit", _segment_fit_sql("linear"), digits=3)
def _(spark, sf):
    events, streams = fr.user_streams(spark, sf)
    return fi.fit_linear(events, streams, power_law(EPS, C), fi.K_SWEEP).select("stream_id", "k", "n", "ll", "aic", "bic", "converged")


@query(
    "scl08_information_criteria",
    with_(
        EV, RANKED, decay_cte([power_law(EPS, C)]), FIT,
        "lls AS (SELECT s.stream_id, any_value(f.n_events) AS n_events, sum(ln(f.mu + f.n * s.s)) - any_value(f.mu * f.horizon) - any_value(f.n * f.cc) AS ll FROM s JOIN fit f USING (stream_id) GROUP BY 1)",
        recursive=True,
    )
    + f"SELECT stream_id, {r('4 - 2 * ll', 'aic', 3)}, {r('2 * ln(n_events) - 2 * ll', 'bic', 3)} FROM lls",
    digits=3,
)
def _(spark, sf):
    events, streams = fr.user_streams(spark, sf)
    return fi.fit_step(events, streams, power_law(EPS, C), [1]).select("stream_id", "aic", "bic")





def constant_grid(spark, sf):
    """Likelihood over the gate's grid of shapes and n with one constant baseline piece, which SQL can fit."""
    events, streams = fr.user_streams(spark, sf)
    return fi.likelihood_grid(events, streams, k=1, basis="step")


_SHAPES = [(e, c) for e in fi.EPS_GRID for c in fi.C_GRID]

_SHAPE_VALUES = "shapes(kernel_idx, eps, c) AS (VALUES " + ", ".join(f"({i}, {e}::DOUBLE, {c}::DOUBLE)" for i, (e, c) in enumerate(_SHAPES)) + ")"

# peaks of the profile for every cutoff of the shape, from ``ll(stream_id, n, eps, c, ll)``
_GATE_RULES = """
    prof AS (SELECT stream_id, n, max(ll) AS ll, arg_max(eps, ll) AS eps, arg_max(c, ll) AS c FROM ll GROUP BY 1, 2),
    cutoffs(eps_min) AS (VALUES (0.4::DOUBLE), (0.2), (0.1), (0.05), (0.02)),
    traj AS (SELECT stream_id, eps_min, n, max(ll) AS ll FROM ll JOIN cutoffs ON eps >= eps_min GROUP BY 1, 2, 3),
    peaks AS (SELECT stream_id, eps_min, arg_min(n, struct_pack(a := -ll, b := n)) AS n FROM traj GROUP BY 1, 2),
    capped AS (SELECT stream_id, eps_min, arg_min(n, struct_pack(a := -ll, b := n)) AS n FROM traj WHERE n < 1 GROUP BY 1, 2),
    top AS (SELECT stream_id, arg_max(n, ll) AS n, max(ll) AS ll, arg_max(eps, ll) AS eps, arg_max(c, ll) AS c FROM prof GROUP BY 1)"""

# best constant baseline for each fixed n: the derivative in mu falls, 50 halvings find its root
_GRID = with_(
    EV, RANKED, decay_cte([power_law(e, c) for e, c in _SHAPES]),
    _SHAPE_VALUES,
    "ns(n) AS (VALUES " + ", ".join(f"({n}::DOUBLE)" for n in fi.N_GRID) + ")",
    """root AS (SELECT st.stream_id, kernel_idx, n, 0 AS step, 1e-9::DOUBLE AS lo, n_events / horizon AS hi FROM st, shapes, ns
      UNION ALL
      SELECT b.stream_id, b.kernel_idx, b.n, any_value(b.step) + 1,
        CASE WHEN sum(1 / ((b.lo + b.hi) / 2 + b.n * s.s)) > any_value(st.horizon) THEN any_value((b.lo + b.hi) / 2) ELSE any_value(b.lo) END,
        CASE WHEN sum(1 / ((b.lo + b.hi) / 2 + b.n * s.s)) > any_value(st.horizon) THEN any_value(b.hi) ELSE any_value((b.lo + b.hi) / 2) END
      FROM root b JOIN s USING (stream_id, kernel_idx) JOIN st USING (stream_id) WHERE b.step < 50 GROUP BY b.stream_id, b.kernel_idx, b.n),
    ll AS (SELECT b.stream_id, b.n, h.eps, h.c, sum(ln((b.lo + b.hi) / 2 + b.n * s.s)) - any_value((b.lo + b.hi) / 2 * st.horizon) - b.n * any_value(cc.cc) AS ll
      FROM root b JOIN shapes h USING (kernel_idx) JOIN s USING (stream_id, kernel_idx) JOIN st USING (stream_id)
      JOIN cc ON cc.stream_id = b.stream_id AND cc.kernel_idx = b.kernel_idx
      WHERE b.step = 50 GROUP BY b.stream_id, b.n, h.eps, h.c)""",
    _GATE_RULES,
    recursive=True,
)


@query(
    "fit06_fixed_n_baseline",
    _GRID + f"SELECT stream_id, n, eps, c, {r('ll', 'll', 3)} FROM ll WHERE eps = 0.4",
    digits=3,
)
def _(spark, sf):
    events, streams = fr.user_streams(spark, sf)
    grid = fi.likelihood_grid(events, streams, eps=(fi.SHAPE_EPS,), k=1, basis="step")
    return grid.select("stream_id", "n", "eps", "c", "ll")


@query("fit10_likelihood_grid", _GRID + f"SELECT stream_id, n, eps, c, {r('ll', 'll', 3)} FROM ll", digits=3)
def _(spark, sf):
    return constant_grid(spark, sf).select("stream_id", "n", "eps", "c", "ll")


@query(
    "flt06_subcritical_cap",
    _GRID + "SELECT stream_id, n FROM capped WHERE eps_min = 0.05",
)
def _(spark, sf):
    return ga.peak(ga.profile(constant_grid(spark, sf), eps_min=0.05, n_cap=1.0)).select("stream_id", "n")


@query("top03_profile_peak", _GRID + f"SELECT stream_id, n, {r('ll', 'll', 3)} FROM top", digits=3)
def _(spark, sf):
    return ga.peak(ga.profile(constant_grid(spark, sf))).select("stream_id", "n", "ll")


@query("top04_peak_shape", _GRID + "SELECT stream_id, n, eps, c FROM top")
def _(spark, sf):
    return ga.peak(ga.profile(constant_grid(spark, sf))).select("stream_id", "n", "eps", "c")


@query("win13_opening_trajectory", _GRID + "SELECT stream_id, eps_min, n FROM peaks")
def _(spark, sf):
    return ga.trajectory(constant_grid(spark, sf)).select("stream_id", "eps_min", "n")


@query(
    "ver01_gate_verdict",
    _GRID
    + f"""SELECT a.stream_id, a.n AS peak_closed, b.n AS peak, c.n AS peak_capped, {r('b.n - a.n', 'migrated')},
    abs(b.n - a.n) < 0.15 AND b.n < 1 AS identified FROM peaks a JOIN peaks b USING (stream_id) JOIN capped c USING (stream_id)
    WHERE a.eps_min = 0.4 AND b.eps_min = 0.02 AND c.eps_min = 0.02""",
)
def _(spark, sf):
    return ga.gate_verdict(constant_grid(spark, sf))


@query(
    "fit11_profile_shape",
    _GRID
    + f"""SELECT t.stream_id, t.n, t.eps, t.c, {r('max(p.ll) - min(p.ll)', 'span', 3)},
    CASE WHEN max(p.ll) - min(p.ll) < 2 THEN 'shallow' ELSE 'curved' END AS curvature,
    CASE WHEN t.n >= 1.0 OR t.eps <= 0.1 THEN 'boundary' ELSE 'interior' END AS place
    FROM top t JOIN prof p ON p.stream_id = t.stream_id AND p.n BETWEEN 0.30 AND 0.90 GROUP BY 1, 2, 3, 4""",
    digits=3,
)
def _(spark, sf):
    return ga.profile_shape(constant_grid(spark, sf)).drop("ll")


@query(
    "fit14_recovery_shape",
    _GRID.rstrip() + ",\n" + FOREST
    + f""",
    truth AS (SELECT stream_id, avg(CASE WHEN parent_idx IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS n_true FROM forest GROUP BY 1)
    SELECT t.stream_id, t.n, {r('any_value(n_true)', 'n_true', 3)}, {r('max(p.ll) - min(p.ll)', 'span', 3)},
    CASE WHEN max(p.ll) - min(p.ll) < 10 THEN 'flat' WHEN t.n = 1.2 THEN 'boundary' ELSE 'interior' END AS shape,
    max(p.ll) - min(p.ll) >= 10 AND t.n <> 1.2 AND abs(t.n - any_value(n_true)) <= 0.15 AS recovered
    FROM top t JOIN prof p ON p.stream_id = t.stream_id JOIN truth h ON h.stream_id = t.stream_id GROUP BY 1, 2""",
    digits=3,
)
def _(spark, sf):
    truth = reply_share(fr.forest(spark, sf))
    return ga.recovery_shape(constant_grid(spark, sf), truth).drop("ll", "eps", "c")


_VERDICT = f"""SELECT a.stream_id, a.n AS peak_closed, b.n AS peak, c.n AS peak_capped, {r('b.n - a.n', 'migrated')},
    abs(b.n - a.n) < 0.15 AND b.n < 1 AS identified FROM peaks a JOIN peaks b USING (stream_id) JOIN capped c USING (stream_id)
    WHERE a.eps_min = 0.4 AND b.eps_min = 0.02 AND c.eps_min = 0.02"""


def _gate_sql(events: str, decay, ns) -> str:
    """The gate with its linear baseline of ``GATE_K`` pieces: every shape and fixed ``n`` is a problem of its own."""
    return (
        with_(
            events, RANKED, decay([power_law(e, c) for e, c in _SHAPES]), _SHAPE_VALUES, _edges_cte([fi.GATE_K]),
            baseline_fit_cte("linear", [fi.GATE_K], ns),
            "ll AS MATERIALIZED (SELECT stream_id, z AS n, eps, shapes.c, ll FROM best JOIN shapes USING (kernel_idx))", _GATE_RULES, recursive=True,
        )
        + _VERDICT
    )


@query("ver01_near_critical_gate", _gate_sql(EV, decay_cte, fi.N_GRID))
def _(spark, sf):
    """The gate with its full grid and flexible baseline, all users in one job."""
    events, streams = fr.user_streams(spark, sf)
    return ga.certify_near_critical(events, streams)


@query("ver01_extended_gate", _gate_sql(EV_TYPE, stepwise_decay_cte, fi.N_GRID_EXTENDED))
def _(spark, sf):
    events, streams = fr.type_streams(spark, sf)
    return ga.certify_near_critical(events, streams, ns=fi.N_GRID_EXTENDED)


_FINE_SHAPES = [(e, c) for e in fi.EPS_GRID_FINE for c in fi.C_GRID]
_SHARPNESS = with_(
    EV_TYPE, RANKED, stepwise_decay_cte([power_law(e, c) for e, c in _FINE_SHAPES]),
    "fine(kernel_idx, eps) AS (VALUES " + ", ".join(f"({i}, {e}::DOUBLE)" for i, (e, _) in enumerate(_FINE_SHAPES)) + ")",
    _edges_cte([fi.GATE_K]), baseline_fit_cte("linear", [fi.GATE_K], fi.N_GRID_FINE),
    f"""tops AS MATERIALIZED (SELECT stream_id, z AS n, max(ll) AS ll_fine, max(ll) FILTER (eps IN ({", ".join(f"{e}::DOUBLE" for e in fi.EPS_GRID)})) AS ll
      FROM best JOIN fine USING (kernel_idx) GROUP BY 1, 2),
    sharp AS (SELECT stream_id, arg_min(n, struct_pack(a := -ll, b := n)) AS n, arg_min(n, struct_pack(a := -ll_fine, b := n)) AS n_fine,
      max(ll) - max(ll) FILTER (abs(n - 1.05) < 1e-9) AS sharpness FROM tops GROUP BY 1)""",
    recursive=True,
)


@query(
    "fit12_profile_curve",
    _SHARPNESS + f"SELECT stream_id, n, n_fine, {r('sharpness', 'sharpness', 2)}, abs(n - n_fine) < 0.05 AS stable FROM sharp",
    digits=2,
)
def _(spark, sf):
    events, streams = fr.type_streams(spark, sf)
    coarse = fi.likelihood_grid(events, streams, ns=fi.N_GRID_FINE)
    fine = fi.likelihood_grid(events, streams, ns=fi.N_GRID_FINE, eps=fi.EPS_GRID_FINE)
    return ga.profile_sharpness(coarse, fine)


# exact integrated excitation of every shape, by meeting every event with all earlier events of its stream
_EXACT_SHAPES = """
mass AS MATERIALIZED (SELECT i.stream_id, i.event_id, kernel_idx, coalesce(sum(1 - pow(c / (c + i.t - j.t), eps)), 0.0) AS big_g
  FROM rk i CROSS JOIN shapes LEFT JOIN rk j ON i.stream_id = j.stream_id AND j.rn < i.rn GROUP BY 1, 2, 3)"""


def _distance_cte(basis: str) -> str:
    """``dist(pid, ks)``: the KS distance of every problem of ``best`` under its exact compensator."""
    if basis == "linear":
        piece, part = "len * 0.5 * (th[j + 1] + th[j + 2])", "(e.t - edge) * (th[j + 1] + 0.5 * w * (th[j + 2] - th[j + 1]))"
    else:
        piece, part = "len * th[j + 1]", "(e.t - edge) * th[j + 1]"
    return f"""
pre AS MATERIALIZED (SELECT *, coalesce(sum({piece}) OVER (PARTITION BY pid ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before
  FROM (SELECT p.pid, p.stream_id, p.k, p.kernel_idx, l.j, l.edge, l.len, t.th, t.n FROM prob p JOIN lens l ON l.stream_id = p.stream_id AND l.k = p.k JOIN last t ON t.pid = p.pid)),
lamk AS (SELECT p.pid, e.rn, before + {part} + n * m.big_g AS lam FROM pre p JOIN places q ON q.stream_id = p.stream_id AND q.k = p.k AND q.seg = p.j
  JOIN rk e ON e.stream_id = q.stream_id AND e.event_id = q.event_id JOIN mass m ON m.stream_id = q.stream_id AND m.event_id = q.event_id AND m.kernel_idx = p.kernel_idx),
inck AS (SELECT pid, lam - lag(lam) OVER (PARTITION BY pid ORDER BY rn) AS dl FROM lamk),
ordk AS (SELECT pid, 1 - exp(-dl) AS f, row_number() OVER (PARTITION BY pid ORDER BY dl) AS i, count(*) OVER (PARTITION BY pid) AS m FROM inck WHERE dl IS NOT NULL),
dist AS MATERIALIZED (SELECT pid, max(greatest(i / m::DOUBLE - f, f - (i - 1) / m::DOUBLE)) AS ks FROM ordk GROUP BY 1)"""


# the sweep over segment counts: fits, their distances, the criteria's choices and the plateau
_SWEEP = with_(
    EV_TYPE, RANKED, decay_cte([power_law(EPS, C)]), f"shapes(kernel_idx, eps, c) AS (VALUES (0, {EPS}::DOUBLE, {C}::DOUBLE))", _EXACT_SHAPES,
    _edges_cte(fi.K_SWEEP), baseline_fit_cte("step", fi.K_SWEEP), _distance_cte("step"),
    """fits AS MATERIALIZED (SELECT stream_id, k, n, n_events, ks, 2 * (k + 1) - 2 * ll AS aic, (k + 1) * ln(n_events) - 2 * ll AS bic FROM best JOIN dist USING (pid)),
    fl AS (SELECT *, abs(lead(n) OVER (PARTITION BY stream_id ORDER BY k) - n) < 0.03 AS flat FROM fits),
    pk AS (SELECT stream_id, arg_min(k, struct_pack(a := bic, b := k)) AS k_bic, arg_min(k, struct_pack(a := aic, b := k)) AS k_aic,
      min(CASE WHEN flat THEN k END) AS plateau_k FROM fl GROUP BY 1)""",
    recursive=True,
)


def swept(spark, sf, ks):
    events, streams = fr.type_streams(spark, sf)
    fits = fi.fit_step(events, streams, power_law(EPS, C), ks)
    ks_distance = go.ks_of_fits(events, fits, [(EPS, C)], extra=["k"])
    return ga.segment_sweep(fits, ks_distance.select("stream_id", "k", "ks"))


@query(
    "fit07_segment_sweep",
    _SWEEP
    + f"""SELECT stream_id, k, {r('n', 'n', 3)}, {r('ks', 'ks', 3)}, {r('aic', 'aic', 3)}, {r('bic', 'bic', 3)}, k_bic, k_aic, plateau_k,
    coalesce(k_bic >= plateau_k, false) AS in_plateau, ks < 2 / sqrt(n_events) AS fit_ok FROM fits JOIN pk USING (stream_id)""",
    digits=3,
)
def _(spark, sf):
    return swept(spark, sf, fi.K_SWEEP).select(
        "stream_id", "k", "n", "ks", "aic", "bic", "k_bic", "k_aic", "plateau_k", "in_plateau", "fit_ok"
    )


@query("win12_plateau_start", _SWEEP + "SELECT stream_id, plateau_k, coalesce(k_bic >= plateau_k, false) AS in_plateau FROM pk")
def _(spark, sf):
    return swept(spark, sf, fi.K_SWEEP).select("stream_id", "plateau_k", "in_plateau").distinct()


@query("top05_criterion_choice", _SWEEP + "SELECT stream_id, k_bic, k_aic FROM pk")
def _(spark, sf):
    return swept(spark, sf, fi.K_SWEEP).select("stream_id", "k_bic", "k_aic").distinct()


@query(
    "scl10_fit_yardstick",
    _SWEEP + f"SELECT stream_id, k, {r('ks * sqrt(n_events)', 'ks_ratio', 3)}, ks < 2 / sqrt(n_events) AS fit_ok FROM fits",
    digits=3,
)
def _(spark, sf):
    return swept(spark, sf, fi.K_SWEEP).select("stream_id", "k", "ks_ratio", "fit_ok")


_STEP_AND_LINEAR = with_(EV_TYPE, RANKED, decay_cte([power_law(EPS, C)]), _edges_cte(fi.K_SWEEP), recursive=True).rstrip() + ",\n" + ",\n".join(
    f"by_{basis} AS MATERIALIZED ({with_(baseline_fit_cte(basis, fi.K_SWEEP), recursive=True)} SELECT stream_id, k, n, ({p}) * ln(n_events) - 2 * ll AS bic FROM best)"
    for basis, p in (("step", "k + 1"), ("linear", "k + 2"))
)


@query(
    "fit08_step_against_linear",
    _STEP_AND_LINEAR
    + f""" SELECT stream_id, k, {r('a.n', 'n_step', 3)}, {r('a.bic', 'bic_step', 3)}, {r('b.n', 'n_linear', 3)}, {r('b.bic', 'bic_linear', 3)}
    FROM by_step a JOIN by_linear b USING (stream_id, k)""",
    digits=3,
)
def _(spark, sf):
    events, streams = fr.type_streams(spark, sf)
    step = fi.fit_step(events, streams, power_law(EPS, C), fi.K_SWEEP)
    linear = fi.fit_linear(events, streams, power_law(EPS, C), fi.K_SWEEP)
    return step.select("stream_id", "k", F.col("n").alias("n_step"), F.col("bic").alias("bic_step")).join(
        linear.select("stream_id", "k", F.col("n").alias("n_linear"), F.col("bic").alias("bic_linear")), ["stream_id", "k"]
    )


def joint_shapes(spark, sf):
    events, streams = fr.type_streams(spark, sf)
    grid = fi.shape_grid()
    fits = fi.fit_cells(events, streams, [g[2] for g in grid], basis="linear", ks=[fi.GATE_K])
    ks_distance = go.ks_of_fits(events, fits, [(g[0], g[1]) for g in grid], basis="linear")
    idx = F.col("kernel_idx")
    return fits.join(ks_distance.select("stream_id", "kernel_idx", "ks"), ["stream_id", "kernel_idx"]).select(
        "stream_id",
        F.get(F.array(*[F.lit(g[0]) for g in grid]), idx).alias("eps"),
        F.get(F.array(*[F.lit(g[1]) for g in grid]), idx).alias("c"),
        "n", "ll", "ks", "n_events",
    )


# every shape with n free under the gate's baseline, and the distance of each fit
_JOINT = with_(
    EV_TYPE, RANKED, stepwise_decay_cte([power_law(e, c) for e, c in _SHAPES]), _SHAPE_VALUES, _EXACT_SHAPES, _edges_cte([fi.GATE_K]),
    baseline_fit_cte("linear", [fi.GATE_K]), _distance_cte("linear"),
    "joint AS MATERIALIZED (SELECT stream_id, eps, shapes.c, n, ll, ks, n_events FROM best JOIN dist USING (pid) JOIN shapes USING (kernel_idx))",
    recursive=True,
)


@query(
    "fit09_joint_shape_grid",
    _JOINT + f"SELECT stream_id, eps, c, {r('n', 'n', 3)}, {r('ll', 'll', 3)}, {r('ks', 'ks', 3)}, n_events FROM joint",
    digits=3,
)
def _(spark, sf):
    return joint_shapes(spark, sf)


@query(
    "top06_best_shape",
    _JOINT
    + f"""SELECT stream_id, arg_min(eps, struct_pack(a := round(ks, 9), b := eps, d := c)) AS eps_ks, arg_min(c, struct_pack(a := round(ks, 9), b := eps, d := c)) AS c_ks,
    arg_min(eps, struct_pack(a := -round(ll, 6), b := eps, d := c)) AS eps_ll, arg_min(c, struct_pack(a := -round(ll, 6), b := eps, d := c)) AS c_ll,
    {r('min(ks)', 'ks', 3)}, {r('min(n)', 'n_min', 3)}, {r('max(n)', 'n_max', 3)}, min(ks) * sqrt(any_value(n_events)) < 2 AS good_fit FROM joint GROUP BY 1""",
    digits=3,
)
def _(spark, sf):
    return ga.best_shape(joint_shapes(spark, sf)).select(
        "stream_id", "eps_ks", "c_ks", "eps_ll", "c_ll", "ks", "n_min", "n_max", "good_fit"
    )


_SLICED = """
raw AS (SELECT user_id, event_id, (us - min(us) OVER (PARTITION BY user_id)) / 3.6e9 AS t
  FROM (SELECT *, epoch_us(ts) AS us FROM events)),
stepped AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM raw),
base AS MATERIALIZED (SELECT CAST(user_id AS VARCHAR) AS user_id, event_id, t FROM raw
  UNION ALL SELECT user_id || 'c', event_id, round(coalesce(sum(gap) OVER (PARTITION BY user_id
    ORDER BY gap IS NOT NULL, md5('0|' || user_id || '|' || event_id), event_id), 0.0), 6) FROM stepped),
bh AS (SELECT user_id, max(t) AS h FROM base GROUP BY 1),
sl AS (SELECT user_id, j, CASE WHEN j = 0 THEN 0.0 ELSE (j - 1) * h / 3.0::DOUBLE END AS lo,
  CASE WHEN j = 0 THEN h + 1 ELSE j * h / 3.0::DOUBLE END AS hi FROM bh, generate_series(0, 3) g(j)),
ev AS (SELECT b.user_id || '#' || j AS stream_id, event_id, t - min(t) OVER (PARTITION BY b.user_id, j) AS t
  FROM base b JOIN sl ON b.user_id = sl.user_id AND b.t >= lo AND b.t < hi
  QUALIFY count(*) OVER (PARTITION BY b.user_id, j) >= 20),
st AS (SELECT stream_id, max(t) AS horizon, count(*) AS n_events FROM ev GROUP BY 1)"""


def window_inflation(events, min_events=20):
    """``n`` on the whole stream and the mean of its thirds, each slice restarted at its first event."""
    part = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("slice_id")
    h = F.col("horizon")
    slices = stream_spans(events).select("stream_id", h, part).select(
        "stream_id", "slice_id",
        F.when(F.col("slice_id") == 0, 0.0).otherwise((F.col("slice_id") - 1) * h / 3.0).alias("lo"),
        F.when(F.col("slice_id") == 0, h + 1.0).otherwise(F.col("slice_id") * h / 3.0).alias("hi"),
    )
    cut = time_slice(events, slices, min_events).where("t IS NOT NULL")
    cut = checkpointed(cut.select(F.concat_ws("#", "stream_id", "slice_id").alias("stream_id"), "event_id", "t"))
    fits = fi.fit_constant(cut, stream_spans(cut), power_law(EPS, C))
    label = F.split("stream_id", "#")
    parts = fits.select(F.get(label, F.lit(0)).alias("stream_id"), F.get(label, F.lit(1)).alias("j"), "n")
    return parts.groupBy("stream_id").agg(
        F.max(F.when(F.col("j") == "0", F.col("n"))).alias("n_whole"),
        F.avg(F.when(F.col("j") != "0", F.col("n"))).alias("n_thirds"),
    )


@query(
    "fit13_window_inflation",
    with_(
        _SLICED, RANKED, decay_cte([power_law(EPS, C)]), FIT,
        """parts AS (SELECT split_part(stream_id, '#', 1) AS stream_id, split_part(stream_id, '#', 2) AS j, greatest(n, 1e-9) AS n FROM fit),
        res AS (SELECT stream_id, max(CASE WHEN j = '0' THEN n END) AS n_whole, avg(CASE WHEN j <> '0' THEN n END) AS n_thirds FROM parts GROUP BY 1)""",
        recursive=True,
    )
    + f"""SELECT a.stream_id, {r('a.n_whole', 'n_whole', 3)}, {r('a.n_thirds', 'n_thirds', 3)}, {r('a.n_whole - a.n_thirds', 'gap', 3)},
    {r('c.n_whole - c.n_thirds', 'control_gap', 3)}, (a.n_whole - a.n_thirds) - (c.n_whole - c.n_thirds) > 0.08 AS inflated
    FROM res a LEFT JOIN res c ON c.stream_id = a.stream_id || 'c' WHERE a.stream_id NOT LIKE '%c'""",
    digits=3,
)
def _(spark, sf):
    """Every user beside a control: the same gaps in an order drawn by hash, cut and fitted alike."""
    events = checkpointed(fr.user_streams(spark, sf)[0])
    control = shuffled_gaps(events).withColumn("stream_id", F.concat("stream_id", F.lit("c")))
    wide = checkpointed(window_inflation(checkpointed(events.unionByName(control))))
    wide = wide.withColumn("gap", F.col("n_whole") - F.col("n_thirds"))
    is_control = F.col("stream_id").endswith("c")
    beside = wide.where(is_control).select(F.regexp_replace("stream_id", "c$", "").alias("stream_id"), F.col("gap").alias("control_gap"))
    return wide.where(~is_control).join(beside, "stream_id", "left").withColumn("inflated", F.col("gap") - F.col("control_gap") > 0.08)


# ---- goodness of fit ----------------------------------------------------------------------------

_KS = """
inc AS (SELECT *, lam - lag(lam) OVER (PARTITION BY stream_id ORDER BY rn) AS dl FROM lam),
ord AS (SELECT stream_id, 1 - exp(-dl) AS f, row_number() OVER (PARTITION BY stream_id ORDER BY dl) AS i,
  count(*) OVER (PARTITION BY stream_id) AS m FROM inc WHERE dl IS NOT NULL),
ks AS (SELECT stream_id, any_value(m) AS n_increments, max(greatest(i / m::DOUBLE - f, f - (i - 1) / m::DOUBLE)) AS ks FROM ord GROUP BY 1)"""


@query(
    "gof01_ks_distance",
    with_(
        EV, RANKED, decay_cte([power_law(EPS, C)]), FIT, _EXACT,
        "lam AS (SELECT e.stream_id, e.rn, f.mu * e.t + greatest(f.n, 1e-9) * e.big_g AS lam FROM exact e JOIN fit f USING (stream_id))",
        _KS, recursive=True,
    )
    + f"SELECT stream_id, n_increments, {r('ks', 'ks', 3)} FROM ks",
    digits=3,
)
def _(spark, sf):
    events, streams = fr.user_streams(spark, sf)
    fits = fi.fit_cells(events, streams, [power_law(EPS, C)])
    return go.ks_of_fits(events, fits, [(EPS, C)]).select("stream_id", "n_increments", "ks")


_KOLMOGOROV = """CASE WHEN x < 0.2 THEN 1.0 ELSE least(greatest(2 * list_sum([pow(-1, j - 1) * exp(-2.0 * j * j * x * x) for j in range(1, 102)]), 0.0), 1.0) END"""


@query(
    "gof02_exponential_ks",
    with_(
        EV, RANKED, decay_cte([exponential(BETA)]),
        f"lam AS (SELECT stream_id, rn, {MU} * t + {N} * (rn - 1 - s / {BETA}) AS lam FROM s)", _KS,
        "px AS (SELECT *, (sqrt(n_increments) + 0.12 + 0.11 / sqrt(n_increments)) * ks AS x FROM ks)",
    )
    + f"SELECT stream_id, n_increments, {r('ks', 'ks')}, {r(_KOLMOGOROV, 'p_value')} FROM px",
)
def _(spark, sf):
    ks = go.ks_unit_exponential(fixed_exponential(spark, sf), ["stream_id"])
    return ks.withColumn("p_value", go.kolmogorov_p(F.col("ks"), F.col("n_increments")))


def observed_distance(spark, sf):
    """KS distance of every user's constant-baseline fit."""
    events, streams = fr.user_streams(spark, sf)
    fits = fi.fit_cells(events, streams, [power_law(EPS, C)])
    return go.ks_of_fits(events, fits, [(EPS, C)]).select("stream_id", "ks")


# the fit and its KS distance: CTEs that give ``fit`` and ``ks``
FITTED = (decay_cte([power_law(EPS, C)]), FIT)
DISTANCE = (
    _EXACT,
    "lam AS (SELECT e.stream_id, e.rn, f.mu * e.t + greatest(f.n, 1e-9) * e.big_g AS lam FROM exact e JOIN fit f USING (stream_id))",
    _KS,
)


def null_table(spark, sf):
    """Null distances per user from the values of all orders; some are missing."""
    users = fr.table(spark, sf, "events").agg(F.max("user_id") + 1).first()[0]  # one number
    return fr.table(spark, sf, "orders").select(
        (F.col("o_orderkey") % F.lit(users)).cast("string").alias("stream_id"),
        F.col("o_orderkey").alias("replicate"),
        F.when(F.col("o_orderkey") % 7 > 0, (F.col("o_totalprice") % 1000) / 5000.0).alias("d"),
    )


_NULLS = """
obs AS (SELECT stream_id, ks FROM ks),
nulls AS (SELECT CAST(o_orderkey % (SELECT max(user_id) + 1 FROM events) AS VARCHAR) AS stream_id,
  CASE WHEN o_orderkey % 7 > 0 THEN (o_totalprice % 1000) / 5000.0::DOUBLE END AS d FROM orders),
cal AS (SELECT o.stream_id, any_value(o.ks) AS ks, count(d) AS b_eff, count(*) FILTER (WHERE d >= o.ks) AS ge
  FROM obs o LEFT JOIN nulls n USING (stream_id) GROUP BY 1),
gof AS (SELECT stream_id, ks, b_eff, CASE WHEN b_eff >= 10 THEN (1 + ge) / (1 + b_eff)::DOUBLE END AS p_boot FROM cal)"""


@query(
    "gof03_calibrated_p",
    with_(EV, RANKED, *FITTED, *DISTANCE, _NULLS, recursive=True)
    + f"SELECT stream_id, {r('ks', 'ks')}, b_eff, {r('p_boot', 'p_boot')}, coalesce(p_boot >= 0.1, false) AS passed FROM gof",
)
def _(spark, sf):
    return go.calibrated_p(observed_distance(spark, sf), null_table(spark, sf))


@query("joi08_null_lookup", with_(EV, RANKED, *FITTED, *DISTANCE, _NULLS, recursive=True) + "SELECT stream_id, b_eff, ge AS n_at_least FROM cal")
def _(spark, sf):
    rows = observed_distance(spark, sf).join(null_table(spark, sf), "stream_id", "left")
    return rows.groupBy("stream_id").agg(
        F.count("d").alias("b_eff"), F.count_if(F.col("d") >= F.col("ks")).alias("n_at_least")
    )


@query("grn01_granularity_probe", digits=3)
def _(spark, sf):
    events, streams = fr.user_streams(spark, sf)
    return go.granularity_probe(events, streams, 2.0, [0.1, 0.5, 2.0])


@query("grn02_event_units", digits=3)
def _(spark, sf):
    """Fit and fit quality with one event per message and one per (market, ms)."""
    out = None
    msgs = checkpointed(fr.messages(spark, sf))
    for unit in ("fill", "match"):
        rows = ingest.market_times(ingest.to_event_unit(msgs, unit))
        eid = F.col("pos") if unit == "fill" else F.col("ts_ms")
        events = checkpointed(
            rows.select(F.col("asset_id").alias("stream_id"), eid.alias("event_id"), (F.col("t") / 3600.0).alias("t"))
        )
        fits = fi.fit_cells(events, stream_spans(events), [power_law(EPS, C)])
        ks = go.ks_of_fits(events, fits, [(EPS, C)]).select("stream_id", F.col("ks").alias(f"ks_{unit}"))
        part = fits.select("stream_id", F.col("n").alias(f"n_{unit}"), F.col("n_events").alias(f"events_{unit}")).join(ks, "stream_id")
        out = part if out is None else out.join(part, "stream_id")
    return out.withColumn("n_diff", F.col("n_match") - F.col("n_fill"))
