"""Queries over verdicts, control reports and replicate tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplework.functions.columns import wilson_interval, with_binomial_upper
from ripplework.functions.kernels import power_law
from ripplework.operators import fit as fi
from ripplework.operators import gate as ga
from ripplework.operators import goodness as go
from ripplework.operators import replicate as re
from ripplework.operators import scaling as sc
from ripplework.operators import verdict as ve
from ripplework.operators.shape import burstiness, stream_spans
from ripplework.plans import frames as fr
from ripplework.plans.catalog import query
from ripplework.plans.fit_queries import _GRID, _NULLS, DISTANCE, FITTED, C, EPS, constant_grid, null_table, observed_distance
from ripplework.plans.shape_queries import _RATES
from ripplework.plans.sql import EV, MESSAGES, RANKED, r, with_
from ripplework.session import checkpointed

# ---- replicate tables made of line items: discounts as estimates, taxes as half-widths -----------

_FITS = """
fits AS (SELECT l_returnflag || l_linestatus AS cell, l_orderkey AS replicate, 0.05::DOUBLE AS n_true, l_discount AS n_hat,
  l_discount - l_tax AS lo, l_discount + l_tax AS hi, l_discount - 0.03 AS lo2, l_discount + 0.02 AS hi2,
  CAST(l_quantity AS BIGINT) AS n_events FROM lineitem)"""


def replicate_fits(spark, sf):
    d, t = F.col("l_discount"), F.col("l_tax")
    return fr.table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("cell"),
        F.col("l_orderkey").alias("replicate"),
        F.lit(0.05).alias("n_true"),
        d.alias("n_hat"),
        (d - t).alias("lo"), (d + t).alias("hi"), (d - 0.03).alias("lo2"), (d + 0.02).alias("hi2"),
        F.col("l_quantity").cast("bigint").alias("n_events"),
    )


@query(
    "rep01_interval_coverage",
    with_(_FITS)
    + f"""SELECT cell, {r('avg(CASE WHEN lo <= n_true AND n_true <= hi THEN 1.0 ELSE 0.0 END)', 'coverage')}, count(*) AS r,
    {r('median(n_hat)', 'median_n')} FROM fits GROUP BY 1""",
)
def _(spark, sf):
    return re.coverage(replicate_fits(spark, sf))


@query(
    "rep02_interval_agreement",
    with_(_FITS)
    + f"""SELECT cell, {r('avg(abs(lo - lo2))', 'mean_lo_diff')}, {r('avg(abs(hi - hi2))', 'mean_hi_diff')},
    {r('avg(greatest(0.0, least(hi, hi2) - greatest(lo, lo2)))', 'mean_overlap')}, count(*) AS r FROM fits GROUP BY 1""",
)
def _(spark, sf):
    return re.interval_agreement(replicate_fits(spark, sf))


@query(
    "rep03_refit_interval",
    with_(_FITS)
    + f"""SELECT cell, {r('quantile_cont(n_hat, 0.025)', 'lo')}, {r('quantile_cont(n_hat, 0.975)', 'hi')}
    FROM fits WHERE n_events >= 10 GROUP BY 1""",
)
def _(spark, sf):
    return re.refit_interval(replicate_fits(spark, sf))


# ---- gate runs made of orders: price steps as peaks, priority as regime --------------------------

_RUNS = """
runs AS (SELECT o_orderpriority AS regime, CASE WHEN o_orderstatus = 'F' THEN 0.9::DOUBLE ELSE 0.75 END AS plant, o_orderkey AS seed,
  o_custkey % 1000 + 15000 AS n_events, floor(o_totalprice / 50000) * 0.15::DOUBLE + 0.75 AS peak,
  o_totalprice < 100000 AS identified, (1 + o_custkey % 3) * 20000 AS n_target FROM orders),
thin AS (SELECT * FROM runs)"""


def gate_runs(spark, sf):
    return fr.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("regime"),
        F.when(F.col("o_orderstatus") == "F", 0.9).otherwise(0.75).alias("plant"),
        F.col("o_orderkey").alias("seed"),
        (F.col("o_custkey") % 1000 + 15000).alias("n_events"),
        (F.floor(F.col("o_totalprice") / 50000) * 0.15 + 0.75).alias("peak"),
        (F.col("o_totalprice") < 100000).alias("identified"),
        ((1 + F.col("o_custkey") % 3) * 20000).alias("n_target"),
    )


def _wilson(k: str, n: str, sign: str) -> str:
    z = 1.96
    centre = f"({k} / {n}::DOUBLE + {z * z} / (2 * {n}))"
    half = f"{z} * sqrt({k} / {n}::DOUBLE * (1 - {k} / {n}::DOUBLE) / {n} + {z * z} / (4.0 * {n} * {n}))"
    bound = f"({centre} {sign} {half}) / (1 + {z * z} / {n})"
    return f"greatest(0.0, {bound})" if sign == "-" else f"least(1.0, {bound})"


# one-sided bound: halve until the binomial lower tail equals 5%
_UPPER = """
kn AS (SELECT DISTINCT n_migrated AS k, n_runs AS n FROM per),
term AS (SELECT k, n, i, lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) AS lc FROM kn, generate_series(0, (SELECT max(k) FROM kn)) g(i) WHERE i <= k),
cp AS (SELECT k, n, 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM kn
  UNION ALL
  SELECT c.k, c.n, any_value(c.step) + 1,
    CASE WHEN sum(exp(t.lc + t.i * ln((c.lo + c.hi) / 2) + (c.n - t.i) * ln(1 - (c.lo + c.hi) / 2))) > 0.05 THEN any_value((c.lo + c.hi) / 2) ELSE any_value(c.lo) END,
    CASE WHEN sum(exp(t.lc + t.i * ln((c.lo + c.hi) / 2) + (c.n - t.i) * ln(1 - (c.lo + c.hi) / 2))) > 0.05 THEN any_value(c.hi) ELSE any_value((c.lo + c.hi) / 2) END
  FROM cp c JOIN term t USING (k, n) WHERE c.step < 40 GROUP BY c.k, c.n),
ub AS (SELECT k, n, CASE WHEN k = n THEN 1.0 ELSE (lo + hi) / 2 END AS upper95 FROM cp WHERE step = 40)"""

_PER = """
per AS (SELECT regime, plant, count(*) AS n_runs, count(*) FILTER (WHERE NOT identified) AS n_migrated, avg(n_events) AS mean_events FROM runs GROUP BY 1, 2)"""


@query(
    "rep04_false_migration",
    with_(_RUNS, _PER, _UPPER, recursive=True)
    + f"""SELECT regime, plant, n_runs, n_migrated, {r('mean_events', 'mean_events')}, {r('n_migrated / n_runs::DOUBLE', 'rate')},
    {r(_wilson('n_migrated', 'n_runs', '-'), 'wilson_lo')}, {r(_wilson('n_migrated', 'n_runs', '+'), 'wilson_hi')}, {r('upper95', 'upper95')},
    15500 AS target_n, abs(mean_events - 15500) / 15500 < 0.06 AS n_matched
    FROM per JOIN ub ON ub.k = n_migrated AND ub.n = n_runs""",
)
def _(spark, sf):
    runs = gate_runs(spark, sf)
    targets = runs.select("regime").distinct().withColumn("target_n", F.lit(15500).cast("bigint"))
    return re.false_migration(runs, targets)


@query(
    "scl04_wilson_interval",
    with_(_RUNS, _PER)
    + f"SELECT regime, plant, {r(_wilson('n_migrated', 'n_runs', '-'), 'lo')}, {r(_wilson('n_migrated', 'n_runs', '+'), 'hi')} FROM per",
)
def _(spark, sf):
    per = gate_runs(spark, sf).groupBy("regime", "plant").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("identified")).alias("k")
    )
    lo, hi = wilson_interval(F.col("k"), F.col("n"))
    return per.select("regime", "plant", lo.alias("lo"), hi.alias("hi"))


@query(
    "scl05_binomial_upper",
    with_(_RUNS, _PER, _UPPER, recursive=True)
    + f"SELECT regime, plant, {r('upper95', 'upper95')} FROM per JOIN ub ON ub.k = n_migrated AND ub.n = n_runs",
)
def _(spark, sf):
    per = gate_runs(spark, sf).groupBy("regime", "plant").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("identified")).alias("k")
    )
    return with_binomial_upper(per, "k", "n", "upper95").select("regime", "plant", "upper95")


@query(
    "scl06_mid_rank_percentile",
    """WITH v AS (SELECT n_nationkey AS c_nationkey, n_nationkey * 400.0::DOUBLE AS value FROM nation)
    SELECT c_nationkey, value, round(100.0 * (count(*) FILTER (WHERE c_acctbal < value) + 0.5 * count(*) FILTER (WHERE c_acctbal = value)) / count(*), 6) AS percentile
    FROM customer JOIN v USING (c_nationkey) GROUP BY 1, 2""",
)
def _(spark, sf):
    values = fr.table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), (F.col("n_nationkey") * 400.0).alias("value")
    )
    sample = fr.table(spark, sf, "customer").select("c_nationkey", F.col("c_acctbal").alias("x"))
    return re.percentile_ranks(values, sample, ["c_nationkey"])


_MARKETS = ",\n".join([*FITTED, "mk AS (SELECT stream_id, round(greatest(n, 1e-9), 3) AS peak FROM fit)"])


def market_peaks(spark, sf):
    """Branching ratio of every user's constant-baseline fit."""
    events, streams = fr.user_streams(spark, sf)
    fits = fi.fit_constant(events, streams, power_law(EPS, C)).where("n IS NOT NULL")
    return fits.select("stream_id", F.round("n", 3).alias("peak"))


@query(
    "rep05_magnitude_rule",
    with_(
        EV, RANKED, _MARKETS, _RUNS,
        """g AS (SELECT peak AS x FROM runs WHERE NOT identified),
        cuts AS (SELECT median(x) AS median_peak, quantile_cont(x, 0.9) AS cut_peak, avg(CASE WHEN x >= 2.0 THEN 1.0 ELSE 0.0 END) AS ceiling_share FROM g),
        pr AS (SELECT stream_id, peak, 100.0 * (count(*) FILTER (WHERE x < peak) + 0.5 * count(*) FILTER (WHERE x = peak)) / count(*) AS percentile FROM mk, g GROUP BY 1, 2)""",
        recursive=True,
    )
    + f"""SELECT stream_id, {r('peak', 'peak')}, {r('percentile', 'percentile')}, {r('median_peak', 'median_peak')}, {r('cut_peak', 'cut_peak')},
    {r('ceiling_share', 'ceiling_share')},
    CASE WHEN peak > cut_peak THEN 'restored' WHEN peak > median_peak THEN 'graded' ELSE 'absent' END AS label FROM pr, cuts""",
)
def _(spark, sf):
    return re.magnitude_rule(gate_runs(spark, sf), market_peaks(spark, sf))


@query(
    "set02_pooled_peaks",
    with_(_RUNS) + f"SELECT {r('peak', 'peak')}, count(*) AS n FROM runs WHERE NOT identified GROUP BY 1",
)
def _(spark, sf):
    runs = gate_runs(spark, sf).where(~F.col("identified"))
    parts = [runs.where(F.col("plant") == p).select("regime", "peak") for p in (0.75, 0.9)]
    pooled = parts[0].unionByName(parts[1])
    return pooled.withColumn("peak", F.round("peak", 6)).groupBy("peak").agg(F.count(F.lit(1)).alias("n"))


@query(
    "rep06_separation_rule",
    _GRID.rstrip() + ",\n" + _RUNS
    + f""",
    cap AS (SELECT quantile_cont(peak, 0.95) AS genuine_q95 FROM runs WHERE peak > 1.0),
    mk AS (SELECT t.stream_id, t.n, t.ll - p.ll AS sharpness FROM top t JOIN prof p ON p.stream_id = t.stream_id AND abs(p.n - 1.05) < 1e-9),
    ok AS (SELECT bool_and(n <= 1.0 OR (n >= 1.175 AND sharpness >= 10)) AS markets_sharp,
      count(*) FILTER (WHERE NOT (n <= 1.0 OR (n >= 1.175 AND sharpness >= 10))) AS n_failing FROM mk)
    SELECT {r('genuine_q95', 'genuine_q95')}, markets_sharp, n_failing,
    CASE WHEN genuine_q95 <= 1.125 AND markets_sharp THEN 'holds' ELSE 'collapses' END AS verdict FROM ok, cap""",
)
def _(spark, sf):
    return re.separation_rule(gate_runs(spark, sf), ga.peak_sharpness(constant_grid(spark, sf)))


@query(
    "rep07_rate_by_size",
    with_(
        _RUNS,
        """per AS (SELECT n_target, count(*) AS n_runs, count(*) FILTER (WHERE NOT identified) AS n_migrated, avg(n_events) AS mean_events FROM runs GROUP BY 1)""",
    )
    + f"""SELECT n_target, n_runs, n_migrated, {r('mean_events', 'mean_events')}, {r('n_migrated / n_runs::DOUBLE', 'rate')},
    {r(_wilson('n_migrated', 'n_runs', '-'), 'wilson_lo')}, {r(_wilson('n_migrated', 'n_runs', '+'), 'wilson_hi')},
    CASE WHEN (SELECT arg_max(n_migrated / n_runs::DOUBLE, n_target) FROM per) < 0.1 THEN 'size_dependent' ELSE 'intrinsic' END AS verdict FROM per""",
)
def _(spark, sf):
    return re.rate_by_size(gate_runs(spark, sf))


@query(
    "rep09_level_sweep",
    f"""WITH per AS (SELECT o_orderpriority AS level, min(o_totalprice) AS a, max(o_totalprice) AS b, avg(o_totalprice) AS m FROM orders GROUP BY 1)
    SELECT level, {r('a', 'min_value', 3)}, {r('b', 'max_value', 3)}, {r('m', 'mean_value', 3)},
    {r('m / ((sum(m) OVER () - m) / (count(*) OVER () - 1))', 'ratio_to_others', 3)} FROM per""",
    digits=3,
)
def _(spark, sf):
    orders = fr.table(spark, sf, "orders")
    return re.level_sweep(orders.select(F.col("o_orderpriority").alias("level"), F.col("o_totalprice").alias("value")))


@query(
    "top07_smallest_recovered",
    with_(
        _RUNS,
        "per AS (SELECT regime, n_target, count(*) FILTER (WHERE abs(peak - 0.9) <= 0.15) AS rec, count(*) AS seeds FROM runs GROUP BY 1, 2)",
    )
    + "SELECT regime, min(CASE WHEN rec >= seeds // 2 + 1 THEN n_target END) AS floor_n FROM per GROUP BY 1",
)
def _(spark, sf):
    return ga.smallest_recovered(gate_runs(spark, sf).withColumn("n_true", F.lit(0.9)), "regime")


# ---- markets ------------------------------------------------------------------------------------

FLOOR = 70


def overview(spark, sf):
    events, streams = fr.user_streams(spark, sf)
    fits = market_peaks(spark, sf).withColumnRenamed("peak", "n")
    big = streams.where("n_events >= 60").select("stream_id")
    return ve.market_overview(
        streams, fits.join(big, "stream_id", "left_semi"), F.col("horizon"), floor=FLOOR
    ).drop("horizon")


_OVERVIEW = f"""
big AS (SELECT stream_id, peak AS n_hat FROM mk JOIN st USING (stream_id) WHERE n_events >= 60),
ov AS (SELECT stream_id, n_events, n_hat, n_events / horizon AS rate, n_events >= {FLOOR} AS over_floor, coalesce(n_hat > 0.8, false) AS near_critical,
  CASE WHEN n_events >= {FLOOR} THEN 0.0 ELSE ({FLOOR} - n_events) / (n_events / horizon) END AS hrs FROM st LEFT JOIN big USING (stream_id)),
ov2 AS (SELECT *, near_critical AND (over_floor OR hrs < 168) AS on_track FROM ov)"""


@query(
    "agg13_market_overview",
    with_(EV, RANKED, _MARKETS, _OVERVIEW, recursive=True)
    + f"""SELECT stream_id, n_events, {r('n_hat', 'n_hat')}, {r('rate', 'rate_per_hour')}, over_floor, near_critical,
    {r('hrs', 'hours_to_floor')}, on_track FROM ov2""",
)
def _(spark, sf):
    return overview(spark, sf)


@query(
    "agg13_overview_totals",
    with_(EV, RANKED, _MARKETS, _OVERVIEW, recursive=True)
    + """SELECT count(*) AS n_markets, count(*) FILTER (WHERE over_floor) AS n_over, count(*) FILTER (WHERE near_critical) AS n_critical,
    count(*) FILTER (WHERE on_track) AS n_on_track FROM ov2""",
)
def _(spark, sf):
    return ve.overview_totals(overview(spark, sf))


@query(
    "agg13_provisional_fits",
    digits=4,
)
def _(spark, sf):
    events, streams = fr.type_streams(spark, sf)
    return ve.provisional_fits(events, streams).select("stream_id", "n_events", "mu", "n")


@query(
    "top02_largest_markets",
    with_(EV) + "SELECT stream_id, n_events FROM st ORDER BY n_events DESC, stream_id LIMIT 15",
)
def _(spark, sf):
    _, streams = fr.user_streams(spark, sf)
    return ve.top_markets(streams).select("stream_id", "n_events")


_CLEAN = """
cln AS (SELECT asset_id, count(DISTINCT transaction_hash) = count(*) AND count(*) FILTER (WHERE transaction_hash IS NULL) = 0 AS clean
  FROM msg GROUP BY 1)"""

_VERDICT = """
vd AS (SELECT st.stream_id, st.n_events, mk.peak, gof.ks, gof.b_eff, gof.p_boot,
  CASE WHEN st.n_events < 60 OR st.horizon <= 0 THEN 'insufficient_events' WHEN gof.p_boot IS NULL THEN 'inconclusive'
    WHEN gof.p_boot < 0.1 THEN 'flagged_shape_misfit' ELSE 'certified' END AS status
  FROM st LEFT JOIN mk USING (stream_id) LEFT JOIN gof USING (stream_id))"""


def market_verdicts(spark, sf):
    """Verdicts of all users from their fits and KS distances; a fit of 1 stands for the probe."""
    events, streams = fr.user_streams(spark, sf)
    peaks = checkpointed(market_peaks(spark, sf))
    fits = peaks.select("stream_id", F.lit(None).cast("double").alias("mu"), F.col("peak").alias("n"))
    gof = go.calibrated_p(observed_distance(spark, sf), null_table(spark, sf))
    probe = peaks.select("stream_id", (F.col("peak") - 1.0).alias("diff"))
    return ve.market_verdict(streams, fits, gof, probe, min_events=60)


@query(
    "ver02_market_verdict",
    with_(EV, RANKED, _MARKETS, *DISTANCE, _NULLS, _VERDICT, recursive=True)
    + f"""SELECT stream_id, n_events, status, {r("CASE WHEN status <> 'insufficient_events' THEN peak END", 'n')},
    {r("CASE WHEN status <> 'insufficient_events' THEN p_boot END", 'p_boot')}, {r("CASE WHEN status = 'certified' THEN peak - 1.0 END", 'diff')} FROM vd""",
)
def _(spark, sf):
    return market_verdicts(spark, sf).select("stream_id", "n_events", "status", "n", "p_boot", "diff")


@query("ver02_certified_capture", digits=3)
def _(spark, sf):
    """Capture lines to verdicts: parse, drop outages, shape, fit, test and probe every market in both event units."""
    from ripplework.operators import ingest
    from ripplework.plans.ingest_queries import OUTAGE_GAP_S

    lines = checkpointed(fr.messages(spark, sf))  # read for the runs and again for what is kept
    msgs = checkpointed(ingest.outage_filter(lines, OUTAGE_GAP_S))
    nulls = checkpointed(
        null_table(spark, sf).withColumn(
            "stream_id", F.concat(F.lit("m"), (F.col("stream_id").cast("bigint") % 20).cast("string"))
        )
    )
    out = None
    for unit in ("fill", "match"):
        rows = ingest.market_times(ingest.to_event_unit(msgs, unit))
        eid = F.col("pos") if unit == "fill" else F.col("ts_ms")
        events = checkpointed(
            rows.select(F.col("asset_id").alias("stream_id"), eid.alias("event_id"), (F.col("t") / 3600.0).alias("t"))
        )
        streams = checkpointed(stream_spans(events))
        fits = fi.fit_cells(events, streams, [power_law(EPS, C)])
        observed = go.ks_of_fits(events, fits, [(EPS, C)]).select("stream_id", "ks")
        simple = fits.select("stream_id", F.get("theta", F.lit(0)).alias("mu"), "n")
        probe = go.granularity_probe(events, streams, 2.0, [0.1, 0.5, 2.0]).select("stream_id", "diff")
        part = ve.market_verdict(streams, simple, go.calibrated_p(observed, nulls), probe, min_events=100)
        part = part.withColumn("unit", F.lit(unit))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "rep08_pass_rate",
    with_(EV, RANKED, _MARKETS, *DISTANCE, _NULLS, _VERDICT, MESSAGES, _CLEAN, recursive=True)
    + f"""SELECT count(*) AS n_markets, count(*) FILTER (WHERE status = 'certified') AS n_passed,
    count(*) FILTER (WHERE status = 'flagged_shape_misfit') AS n_flagged, count(*) FILTER (WHERE status = 'inconclusive') AS n_inconclusive,
    count(*) FILTER (WHERE clean) AS n_clean, {r("count(*) FILTER (WHERE status = 'certified') / count(*)", 'pass_rate')}
    FROM vd LEFT JOIN cln ON cln.asset_id = 'm' || CAST(CAST(vd.stream_id AS BIGINT) % 20 AS VARCHAR) WHERE status <> 'insufficient_events'""",
)
def _(spark, sf):
    from ripplework.operators import ingest

    _, streams = fr.user_streams(spark, sf)
    market = F.concat(F.lit("m"), (F.col("stream_id").cast("bigint") % 20).cast("string"))
    flags = ingest.clean_stream(fr.messages(spark, sf)).select(F.col("asset_id").alias("market"), "clean")
    clean = streams.select("stream_id", market.alias("market")).join(flags, "market", "left")
    return ve.pass_rate(market_verdicts(spark, sf), clean)


@query(
    "ver07_regime_band",
    with_(EV, RANKED, _MARKETS, recursive=True)
    + """SELECT stream_id, CASE WHEN peak < 0.7 THEN 'subcritical' WHEN peak < 0.9 THEN 'endogenous'
    WHEN peak < 1.0 THEN 'near_critical' ELSE 'supercritical' END AS band FROM mk""",
)
def _(spark, sf):
    return market_peaks(spark, sf).select("stream_id", fi.regime_band(F.col("peak")).alias("band"))


@query(
    "joi07_frozen_baseline",
    with_(EV, RANKED, _MARKETS, recursive=True)
    + f"""SELECT mk.stream_id, {r('peak', 'peak')}, {r('c_acctbal / 10000.0', 'false_rate')} FROM mk
    LEFT JOIN customer ON CAST(c_custkey * 2 AS VARCHAR) = mk.stream_id""",
)
def _(spark, sf):
    baseline = fr.table(spark, sf, "customer").select(
        (F.col("c_custkey") * 2).cast("string").alias("stream_id"), (F.col("c_acctbal") / 10000.0).alias("false_rate")
    )
    return ve.read_against_baseline(market_peaks(spark, sf), baseline)


@query(
    "joi09_side_by_side",
    with_(EV, _RATES)
    + f"""SELECT window_id, {r("any_value(CASE WHEN stream_id = '7' THEN rate END)", 'subject')},
    {r("any_value(CASE WHEN stream_id = '8' THEN rate END)", 'null_arm')} FROM rates GROUP BY 1""",
)
def _(spark, sf):
    from ripplework.operators.shape import window_rates

    events, streams = fr.user_streams(spark, sf)
    rows = window_rates(events, streams)
    wide = rows.groupBy("window_id").pivot("stream_id", ["7", "8"]).agg(F.first("rate"))
    return wide.select("window_id", F.col("7").alias("subject"), F.col("8").alias("null_arm"))


@query(
    "ver04_count_agreement",
    with_(EV)
    + f"""SELECT {r('a', 'mean_a')}, {r('b', 'mean_b')}, {r('se', 'se')}, abs(a - b) <= 3 * se AS agree FROM (
      SELECT avg(n_events) FILTER (WHERE u = 0) AS a, avg(n_events) FILTER (WHERE u = 1) AS b,
      sqrt(var_samp(n_events) FILTER (WHERE u = 0) / count(*) FILTER (WHERE u = 0) + var_samp(n_events) FILTER (WHERE u = 1) / count(*) FILTER (WHERE u = 1)) AS se
      FROM (SELECT *, CAST(stream_id AS BIGINT) % 2 AS u FROM st))""",
)
def _(spark, sf):
    _, streams = fr.user_streams(spark, sf)
    backend = F.concat(F.lit("b"), (F.col("stream_id").cast("bigint") % 2).cast("string"))
    return ve.counts_agree(streams.select(backend.alias("backend"), "n_events"))


def report_cells(spark, sf):
    """Two tail cells and two scaling cells; the last one has its pairing shuffled."""
    rows = sc.uncensored(fr.set_cascades(spark, sf)).drop("censored")
    tails = rows.select(F.concat(F.lit("tail_"), "set_id").alias("cell"), F.lit("tail").alias("role"), "cascade_id", "size", "duration")
    kept = rows.where("set_id = 's0'")
    mixed = sc.shuffle_pairing(kept, ["set_id"], seed=3)
    scaling = [
        d.select(F.lit(name).alias("cell"), F.lit("scaling").alias("role"), "cascade_id", "size", "duration")
        for name, d in (("kept", kept), ("shuffled", mixed))
    ]
    return tails.unionByName(scaling[0]).unionByName(scaling[1])


@query("ver04_instrument_report", digits=3)
def _(spark, sf):
    return ve.instrument_report(checkpointed(report_cells(spark, sf)), replicates=10, min_count=20)


@query("ver04_overall_pass")
def _(spark, sf):
    report = checkpointed(ve.instrument_report(checkpointed(report_cells(spark, sf)), replicates=10, min_count=20))
    _, streams = fr.user_streams(spark, sf)
    backend = F.concat(F.lit("b"), (F.col("stream_id").cast("bigint") % 2).cast("string"))
    agreement = ve.counts_agree(streams.select(backend.alias("backend"), "n_events")).select("agree")
    expected = [
        ("tail_s0", "rejected"), ("tail_s1", "rejected"), ("kept", "not-grossly-violated"), ("shuffled", "grossly-violated"),
    ]
    return ve.report_passes(report, agreement, expected)


def run_inputs(spark, sf):
    """Event types as runs, with successes counted from values and the values as trajectory."""
    labeled = checkpointed(fr.forest(spark, sf, "event_type"))
    counters = labeled.groupBy("stream_id").agg(F.count_if(F.col("value") > 30).alias("successes"))
    return labeled.drop("event_id", "value"), counters, labeled.select("stream_id", "value")


@query("ver06_run_record", digits=3)
def _(spark, sf):
    labeled, counters, trajectory = run_inputs(spark, sf)
    return ve.run_record(labeled, counters, trajectory, n_match=1500, min_count=20)


@query("ver05_control_comparison", digits=3)
def _(spark, sf):
    """Clicks as the subject beside views without any links or successes as the null arm."""
    labeled, counters, trajectory = run_inputs(spark, sf)
    null = F.col("stream_id") == "view"
    arms = labeled.where(F.col("stream_id").isin("click", "view")).withColumns(
        {
            "parent_idx": F.when(~null, F.col("parent_idx")),
            "root_idx": F.when(null, F.col("idx")).otherwise(F.col("root_idx")),
        }
    )
    counters = counters.withColumn("successes", F.when(null, 0).otherwise(F.col("successes")))
    records = ve.run_record(arms, counters, trajectory, n_match=1500, min_count=20)
    kept = records.where(F.col("stream_id").isin("click", "view"))
    return ve.control_comparison(ve.control_columns(arms, checkpointed(kept), (12.0, 144.0)), "click", "view")


