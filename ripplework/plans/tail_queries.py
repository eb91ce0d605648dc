"""Queries over tails and scaling relations of cascades."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplework.operators import scaling as sc
from ripplework.operators import tail as ta
from ripplework.operators.cascades import event_depth, reply_tree_cascades
from ripplework.plans import frames as fr
from ripplework.plans.catalog import query
from ripplework.plans.sql import CASCADES, DEPTH, EV, FOREST, RANKED, r, with_
from ripplework.session import checkpointed

MIN_COUNT = 20
REPLICATES = 20


def zeta_sql(s: str, q: str, x: str, terms: int = 10) -> str:
    """``sum ((q + k) / x)^-s`` by Euler-Maclaurin summation."""
    direct = " + ".join(f"pow(({q} + {k}) / {x}, -({s}))" for k in range(terms))
    m = f"(({q} + {terms}) / {x})"
    return (
        f"({direct} + {x} * pow({m}, 1 - ({s})) / (({s}) - 1) + 0.5 * pow({m}, -({s})) + ({s}) / 12.0 * pow({m}, -({s}) - 1) / {x}"
        f" - ({s}) * (({s}) + 1) * (({s}) + 2) / 720.0 * pow({m}, -({s}) - 3) / pow({x}, 3)"
        f" + ({s}) * (({s}) + 1) * (({s}) + 2) * (({s}) + 3) * (({s}) + 4) / 30240.0 * pow({m}, -({s}) - 5) / pow({x}, 5))"
    )


def scan_cte(hist: str, tag: str = "") -> str:
    """Threshold scan of ``hist(set_id, value, cnt)``: ``scan``, best row per set in ``best``."""
    return f"""
hist{tag} AS ({hist}),
suf{tag} AS (SELECT set_id, value, cnt, sum(cnt) OVER w AS n_ge, sum(cnt * ln(value)) OVER w AS logs,
  sum(cnt) OVER (PARTITION BY set_id) AS n, max(value) OVER (PARTITION BY set_id) AS top
  FROM hist{tag} WINDOW w AS (PARTITION BY set_id ORDER BY value DESC)),
cand{tag} AS (SELECT set_id, value AS xmin, n_ge AS n_tail, n, 1 + n_ge / (logs - n_ge * ln(value - 0.5)) AS alpha
  FROM suf{tag} WHERE value < top),
zed{tag} AS (SELECT *, {zeta_sql('alpha', 'xmin', 'xmin::DOUBLE')} AS z0 FROM cand{tag}),
scan{tag} AS (SELECT c.set_id, c.xmin, any_value(c.alpha) AS alpha, any_value(c.n_tail) AS n_tail, any_value(c.n) AS n,
  max(abs({zeta_sql('c.alpha', 'v.value', 'c.xmin::DOUBLE')} / c.z0 - v.n_ge / c.n_tail::DOUBLE)) AS ks
  FROM zed{tag} c JOIN suf{tag} v ON v.set_id = c.set_id AND v.value >= c.xmin GROUP BY 1, 2),
best{tag} AS (SELECT * FROM scan{tag} QUALIFY row_number() OVER (PARTITION BY set_id ORDER BY ks, xmin) = 1)"""


CHARS = "SELECT lang AS set_id, n_chars AS value, count(*) AS cnt FROM documents GROUP BY 1, 2"
SIZES = "SELECT set_id, size AS value, count(*) AS cnt FROM clean GROUP BY 1, 2"
DURATIONS = "SELECT set_id, duration AS value, count(*) AS cnt FROM clean GROUP BY 1, 2"


def document_lengths(spark, sf):
    docs = fr.table(spark, sf, "documents").select(F.col("lang").alias("set_id"), "n_chars")
    return ta.value_histogram(docs, ["set_id"], "n_chars")


def clean_cells(spark, sf):
    return sc.cascade_cells(fr.set_cascades(spark, sf), ["set_id"])


def tree_cells(spark, sf):
    """Reply-tree cascades of all users, in two sets."""
    trees = reply_tree_cascades(fr.forest(spark, sf))
    rows = trees.select(
        F.concat(F.lit("s"), (F.col("stream_id").cast("bigint") % 2).cast("string")).alias("set_id"), "size", "duration"
    )
    return sc.cascade_cells(rows, ["set_id"])


@query(
    "tail01_exponent_at_threshold",
    with_(scan_cte(CHARS), "pick AS (SELECT set_id, xmin, n_tail, alpha FROM cand WHERE n_tail >= n / 4)")
    + f"""SELECT set_id, xmin, CAST(n_tail AS BIGINT) AS n_tail, {r('alpha', 'alpha')} FROM pick
    QUALIFY row_number() OVER (PARTITION BY set_id ORDER BY xmin DESC) = 1""",
)
def _(spark, sf):
    hist = document_lengths(spark, sf)
    candidates = ta.threshold_candidates(hist, ["set_id"]).where(F.col("alpha").isNotNull())
    upper = candidates.where(F.col("n_ge") >= F.col("n") / 4).groupBy("set_id").agg(F.max("value").alias("xmin"))
    return ta.exponent_at(hist, ["set_id"], upper)


@query(
    "tail02_threshold_scan",
    with_(scan_cte(CHARS))
    + f"""SELECT set_id, xmin, {r('alpha', 'alpha')}, CAST(n_tail AS BIGINT) AS n_tail, CAST(n AS BIGINT) AS n, {r('ks', 'ks')} FROM scan""",
)
def _(spark, sf):
    return ta.threshold_scan(document_lengths(spark, sf), ["set_id"])


@query(
    "tail02_best_threshold",
    with_(scan_cte(CHARS))
    + f"""SELECT set_id, xmin, {r('alpha', 'alpha')}, {r('ks', 'ks')}, CAST(n_tail AS BIGINT) AS n_tail, CAST(n AS BIGINT) AS n FROM best""",
)
def _(spark, sf):
    return ta.fit_tail(document_lengths(spark, sf), ["set_id"])


@query("tail03_alternatives", digits=4)
def _(spark, sf):
    hist = document_lengths(spark, sf)
    return ta.tail_alternatives(hist, ta.fit_tail(hist, ["set_id"]), ["set_id"])


@query("tail04_bootstrap_p")
def _(spark, sf):
    hist = ta.value_histogram(clean_cells(spark, sf), ["set_id"], "size", "cnt")
    return ta.bootstrap_p(hist, ta.fit_tail(hist, ["set_id"]), ["set_id"], REPLICATES)


@query("tail05_tail_verdict", digits=4)
def _(spark, sf):
    hist = ta.value_histogram(clean_cells(spark, sf), ["set_id"], "size", "cnt")
    return ta.tail_verdict(hist, ["set_id"], replicates=REPLICATES)


@query("tail06_guarded_arm", digits=4)
def _(spark, sf):
    # a third set holds single events only and has no tail
    cells = clean_cells(spark, sf).unionByName(
        clean_cells(spark, sf).where("size = 1").withColumn("set_id", F.lit("single"))
    )
    verdict = ta.tail_verdict(ta.value_histogram(cells, ["set_id"], "size", "cnt"), ["set_id"])
    return sc.tail_arm(cells, ["set_id"], verdict, min_count=MIN_COUNT)


def means_cte(source: str = "clean", key: str = "set_id", tag: str = "") -> str:
    return f"""
means{tag} AS (SELECT {key}, duration::DOUBLE AS t, avg(size) AS m FROM {source} GROUP BY 1, 2 HAVING count(*) >= {MIN_COUNT})"""


def slope_cte(z: str, tag: str, means: str = "means", key: str = "set_id") -> str:
    """Coefficients of ``ln m = a + g ln t + b z`` by centred normal equations."""
    return f"""
lx{tag} AS (SELECT {key}, t, ln(m) AS y, ln(t) AS x, {z} AS z FROM {means}),
mm{tag} AS (SELECT {key}, count(*) AS n, avg(x) AS ax, avg(y) AS ay, avg(z) AS az, sum(x*x) - sum(x)*sum(x)/count(*) AS cxx,
  sum(z*z) - sum(z)*sum(z)/count(*) AS czz, sum(x*z) - sum(x)*sum(z)/count(*) AS cxz,
  sum(x*y) - sum(x)*sum(y)/count(*) AS cxy, sum(z*y) - sum(z)*sum(y)/count(*) AS czy FROM lx{tag} GROUP BY 1),
co{tag} AS (SELECT {key}, n, ax, ay, az, (cxy*czz - czy*cxz) / (cxx*czz - cxz*cxz) AS g,
  (cxx*czy - cxz*cxy) / (cxx*czz - cxz*cxz) AS b FROM mm{tag})"""


@query(
    "sca01_curvature_slope",
    "WITH " + CASCADES + "," + means_cte() + "," + slope_cte("1 / t", "c")
    + f" SELECT set_id, {r('CASE WHEN n >= 4 THEN g END', 'inv_snz', 4)} FROM coc",
    digits=4,
)
def _(spark, sf):
    return sc.curvature_slope(clean_cells(spark, sf), ["set_id"], MIN_COUNT)


@query(
    "sca02_binned_slope",
    "WITH " + CASCADES + "," + means_cte()
    + f" SELECT set_id, {r('regr_slope(ln(m), ln(t))', 'binned_slope')} FROM means GROUP BY 1",
)
def _(spark, sf):
    return sc.binned_slope(clean_cells(spark, sf), ["set_id"], MIN_COUNT)


TAIL_SLOPE = """
cut AS (SELECT set_id, quantile_cont(duration, 0.8) AS c FROM clean GROUP BY 1),
tails AS (SELECT set_id, CASE WHEN count(*) >= 50 THEN regr_slope(ln(size), ln(duration)) END AS tail_slope
  FROM clean JOIN cut USING (set_id) WHERE duration >= c GROUP BY 1)"""


@query(
    "sca03_tail_slope",
    "WITH " + CASCADES + "," + TAIL_SLOPE + f" SELECT set_id, {r('tail_slope', 'tail_slope')} FROM tails",
)
def _(spark, sf):
    return sc.tail_slope(clean_cells(spark, sf), ["set_id"])


def _forms_sql() -> str:
    forms = {"1/T": "1 / t", "1/sqrtT": "1 / sqrt(t)", "1/T2": "1 / (t * t)", "logT/T": "ln(t) / t"}
    ctes, parts = [], []
    ctes.append(
        """lxn AS (SELECT set_id, t, ln(m) AS y, ln(t) AS x FROM means),
con AS (SELECT set_id, count(*) AS n, regr_slope(y, x) AS g, regr_intercept(y, x) AS a FROM lxn GROUP BY 1)"""
    )
    parts.append(
        """SELECT set_id, 'naive' AS form, any_value(g) AS slope,
  any_value(n) * ln(sum(pow(y - a - g * x, 2)) / any_value(n)) + 4 AS aic FROM lxn JOIN con USING (set_id) WHERE n >= 4 GROUP BY 1"""
    )
    for i, (form, z) in enumerate(forms.items()):
        ctes.append(slope_cte(z, f"f{i}"))
        parts.append(
            f"""SELECT set_id, '{form}' AS form, any_value(g) AS slope,
  any_value(n) * ln(sum(pow(y - ay - g * (x - ax) - b * (z - az), 2)) / any_value(n)) + 6 AS aic
  FROM lxf{i} JOIN cof{i} USING (set_id) WHERE n >= 4 GROUP BY 1"""
        )
    ctes.append("forms AS (" + " UNION ALL ".join(parts) + ")")
    return ",".join(ctes)


@query(
    "sca06_correction_forms",
    "WITH " + CASCADES + "," + means_cte() + "," + _forms_sql()
    + f""" SELECT set_id, form, {r('slope', 'slope', 3)}, {r('aic', 'aic', 3)},
    row_number() OVER (PARTITION BY set_id ORDER BY aic, form) = 1 AS is_best FROM forms""",
    digits=3,
)
def _(spark, sf):
    return sc.correction_forms(clean_cells(spark, sf), ["set_id"], MIN_COUNT)


_EXPONENTS = (
    "WITH " + CASCADES + "," + scan_cte(SIZES, "s") + "," + scan_cte(DURATIONS, "d") + "," + means_cte() + "," + slope_cte("1 / t", "c")
    + """,
exps AS (SELECT s.set_id, s.alpha AS tau, s.xmin AS xmin_tau, d.alpha AS alpha, d.xmin AS xmin_alpha,
  CASE WHEN c.n >= 4 THEN c.g END AS inv_snz, s.n AS n_cascades
  FROM bests s JOIN bestd d USING (set_id) JOIN coc c USING (set_id))"""
)


@query(
    "sca07_exponent_triple",
    _EXPONENTS
    + f""" SELECT set_id, {r('tau', 'tau', 4)}, xmin_tau, {r('alpha', 'alpha', 4)}, xmin_alpha, {r('inv_snz', 'inv_snz', 4)},
    {r('(alpha - 1) / (tau - 1) - inv_snz', 'delta', 4)} FROM exps""",
    digits=4,
)
def _(spark, sf):
    return sc.exponents(clean_cells(spark, sf), ["set_id"], min_count=MIN_COUNT)


@query(
    "sca08_scaling_residual",
    _EXPONENTS + f" SELECT set_id, {r('(alpha - 1) / (tau - 1) - inv_snz', 'delta', 4)} FROM exps",
    digits=4,
)
def _(spark, sf):
    return sc.exponents(clean_cells(spark, sf), ["set_id"], min_count=MIN_COUNT).select("set_id", "delta")


@query(
    "sca14_estimator_table",
    _EXPONENTS + "," + TAIL_SLOPE
    + f""",
    bins AS (SELECT set_id, regr_slope(ln(m), ln(t)) AS binned_slope FROM means GROUP BY 1)
    SELECT set_id, CAST(n_cascades AS BIGINT) AS n_cascades, {r('(alpha - 1) / (tau - 1)', 'ratio', 4)}, {r('inv_snz', 'inv_snz', 4)},
    {r('tail_slope', 'tail_slope', 4)}, {r('binned_slope', 'binned_slope', 4)},
    {r('(alpha - 1) / (tau - 1) - inv_snz', 'delta', 4)}, {r('(alpha - 1) / (tau - 1) - tail_slope', 'delta_tail', 4)},
    {r('(alpha - 1) / (tau - 1) - binned_slope', 'delta_binned', 4)}
    FROM exps JOIN tails USING (set_id) JOIN bins USING (set_id)""",
    digits=4,
)
def _(spark, sf):
    return sc.estimator_table(clean_cells(spark, sf), ["set_id"], MIN_COUNT).drop("tau", "alpha", "xmin_tau", "xmin_alpha")


def residuals(spark, sf, **options):
    return sc.residual_replicates(clean_cells(spark, sf), ["set_id"], REPLICATES, min_count=MIN_COUNT, **options)


@query("sca09_joint_bootstrap", digits=4)
def _(spark, sf):
    return sc.replicate_interval(residuals(spark, sf), ["set_id"])


@query("sca09_fixed_threshold_bootstrap", digits=4)
def _(spark, sf):
    return sc.replicate_interval(residuals(spark, sf, fixed_threshold=True), ["set_id"], "delta_tail")


# residuals of each set with one of the groups of its users left out
GROUPS = 8


def residual_cte(tag: str = "", source: str = "clean", before: str = "") -> str:
    """``resid(set_id, replicate, delta)`` of ``source(set_id, cascade_id, size, duration)``, set and replicate as one set inside."""
    parts = ",".join(
        [
            f"""grouped AS (SELECT *, CAST(split_part(cascade_id, ':', 1) AS BIGINT) // 2 % {GROUPS} AS own FROM {source}),
            parts AS (SELECT set_id || '#' || x.g AS set_id, size, duration FROM grouped, generate_series(0, {GROUPS - 1}) x(g) WHERE x.g <> own)""",
            scan_cte(SIZES.replace("clean", "parts"), "s"), scan_cte(DURATIONS.replace("clean", "parts"), "d"),
            means_cte("parts"), slope_cte("1 / t", "c"),
        ]
    )
    return f"""
resid{tag} AS MATERIALIZED (WITH {before}{parts}
  SELECT split_part(set_id, '#', 1) AS set_id, CAST(split_part(set_id, '#', 2) AS BIGINT) AS replicate,
    (d.alpha - 1) / (s.alpha - 1) - CASE WHEN c.n >= 4 THEN c.g END AS delta
  FROM (SELECT DISTINCT set_id FROM parts) LEFT JOIN bests s USING (set_id) LEFT JOIN bestd d USING (set_id) LEFT JOIN coc c USING (set_id))"""


def group_residuals(cascades):
    group = F.expr(f"cast(split_part(cascade_id, ':', 1) as bigint) div 2 % {GROUPS}")
    cells = sc.cascade_cells(cascades.withColumn("own", group), ["set_id", "own"])
    return sc.leave_out_residuals(cells, ["set_id"], "own", GROUPS, min_count=MIN_COUNT)


_RESIDUALS = "WITH " + CASCADES + "," + residual_cte()


@query(
    "sca10_corroboration",
    _RESIDUALS
    + f""",
    iv AS (SELECT set_id, avg(delta) AS mean, count(*) FILTER (WHERE delta IS NULL) AS n_undefined, count(*) AS n_replicates,
      quantile_cont(delta, 0.025) AS lo, quantile_cont(delta, 0.975) AS hi FROM resid GROUP BY 1)
    SELECT set_id, {r('mean', 'mean', 4)}, n_undefined, n_replicates, {r('lo', 'lo', 4)}, {r('hi', 'hi', 4)}, {r('(hi - lo) / 2', 'halfwidth', 4)},
    CASE WHEN abs(mean) <= 2.0 * (hi - lo) / 2 THEN 'not-grossly-violated' ELSE 'grossly-violated' END AS label FROM iv""",
    digits=4,
)
def _(spark, sf):
    return sc.corroboration(sc.replicate_interval(group_residuals(fr.set_cascades(spark, sf)), ["set_id"]))


@query(
    "agg11_seed_resolution",
    _RESIDUALS
    + f""" SELECT set_id, {r('avg(delta)', 'mean_delta', 4)}, {r('stddev_samp(delta)', 'sd_seed', 4)},
    {r('2 * sqrt(2.0) * stddev_samp(delta)', 'resolution', 4)} FROM resid GROUP BY 1""",
    digits=4,
)
def _(spark, sf):
    return sc.seed_resolution(group_residuals(fr.set_cascades(spark, sf)), ["set_id"])


@query(
    "agg12_replicate_percentiles",
    _RESIDUALS
    + f""" SELECT set_id, {r('median(delta)', 'p50', 4)}, {r('quantile_cont(delta, 0.025)', 'p025', 4)}, {r('quantile_cont(delta, 0.9)', 'p90', 4)}
    FROM resid GROUP BY 1""",
    digits=4,
)
def _(spark, sf):
    from ripplework.operators.sequence import group_quantiles

    rows = group_residuals(fr.set_cascades(spark, sf))
    return group_quantiles(rows, ["set_id"], "delta", {"p50": 0.5, "p025": 0.025, "p90": 0.9})


def shuffle_cte(fraction: float, seed: int = 0) -> str:
    return f"""
drawn AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY md5('{seed}|' || set_id || '|' || cascade_id), cascade_id) AS rk1,
  count(*) OVER (PARTITION BY set_id) AS n FROM clean),
chosen AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY md5('{seed + 1}|' || set_id || '|' || cascade_id), cascade_id) AS rk2
  FROM drawn WHERE rk1 <= floor({fraction} * n)),
mixed AS (SELECT a.set_id, a.cascade_id, a.size, b.duration FROM chosen a JOIN chosen b ON a.set_id = b.set_id AND a.rk1 = b.rk2
  UNION ALL SELECT set_id, cascade_id, size, duration FROM drawn WHERE rk1 > floor({fraction} * n))"""


@query(
    "sca11_pairing_shuffle",
    "WITH " + CASCADES + "," + shuffle_cte(1.0) + " SELECT set_id, cascade_id, size, duration FROM mixed",
)
def _(spark, sf):
    return sc.shuffle_pairing(fr.set_cascades(spark, sf), ["set_id"])


@query(
    "sca11_partial_shuffle",
    "WITH " + CASCADES + "," + shuffle_cte(0.25, 7) + " SELECT set_id, cascade_id, size, duration FROM mixed",
)
def _(spark, sf):
    return sc.shuffle_pairing(fr.set_cascades(spark, sf), ["set_id"], 0.25, seed=7)


FRACTIONS = (0.25, 1.0)


@query(
    "sca12_resolution_table",
    _RESIDUALS + ","
    + ",".join(residual_cte(f"_{n}", "mixed", shuffle_cte(f, 7).lstrip() + ",") for n, f in enumerate(FRACTIONS))
    + ",\nviol AS ("
    + " UNION ALL ".join(
        f"SELECT set_id, {f}::DOUBLE AS fraction, avg(abs(m.delta - r.delta)) AS v FROM resid r JOIN resid_{n} m USING (set_id, replicate) GROUP BY 1"
        for n, f in enumerate(FRACTIONS)
    )
    + f"""),
    res AS (SELECT set_id, avg(delta) AS mean_delta, stddev_samp(delta) AS sd FROM resid GROUP BY 1)
    SELECT set_id, {r('mean_delta', 'mean_delta', 4)}, {r('sd', 'sd_seed', 4)}, {r('2 * sqrt(2.0) * sd', 'resolution', 4)},
    fraction, {r('v', 'mean_violation', 4)}, v > 2 * sqrt(2.0) * sd AS resolved FROM viol JOIN res USING (set_id)""",
    digits=4,
)
def _(spark, sf):
    rows = checkpointed(fr.set_cascades(spark, sf))
    plain = checkpointed(group_residuals(rows))
    violations = None
    for fraction in FRACTIONS:
        shuffled = group_residuals(sc.shuffle_pairing(rows, ["set_id"], fraction, seed=7))
        part = plain.join(shuffled.withColumnRenamed("delta", "_new"), ["set_id", "replicate"]).select(
            "set_id", F.lit(fraction).alias("fraction"), F.abs(F.col("_new") - F.col("delta")).alias("violation")
        )
        violations = part if violations is None else violations.unionByName(part)
    return sc.violation_table(violations, sc.seed_resolution(plain, ["set_id"]), ["set_id"])


@query(
    "sca13_referenced_interval",
    _RESIDUALS
    + f""",
    d AS (SELECT t.set_id, t.delta - b.delta AS diff FROM resid t JOIN resid b USING (replicate) WHERE t.set_id = 's1' AND b.set_id = 's0')
    SELECT set_id, {r('quantile_cont(diff, 0.025)', 'lo', 4)}, {r('quantile_cont(diff, 0.975)', 'hi', 4)},
    quantile_cont(diff, 0.025) <= 0 AND quantile_cont(diff, 0.975) >= 0 AS contains_zero FROM d GROUP BY 1""",
    digits=4,
)
def _(spark, sf):
    rows = checkpointed(group_residuals(fr.set_cascades(spark, sf)))
    return sc.referenced_interval(rows.where("set_id = 's1'"), rows.where("set_id = 's0'"))


def profile_frame(spark, sf):
    user = F.col("stream_id").cast("bigint")
    labeled = event_depth(fr.forest(spark, sf)).select(
        (user % 2).cast("string").alias("set_id"),
        F.concat_ws(":", "stream_id", F.col("root_idx").cast("string")).alias("root_idx"),
        "depth",
    )
    return sc.cascade_profiles(labeled, ["set_id"])


_PROFILES = """
prof AS (SELECT CAST(CAST(stream_id AS BIGINT) % 2 AS VARCHAR) AS set_id, stream_id, root_idx, depth AS generation, count(*) AS population
  FROM walk GROUP BY 1, 2, 3, 4),
dur AS (SELECT stream_id, root_idx, max(generation) AS duration FROM prof GROUP BY 1, 2),
pm AS (SELECT set_id, duration, generation, avg(population) AS p FROM prof JOIN dur USING (stream_id, root_idx)
  WHERE duration >= 3 GROUP BY 1, 2, 3 HAVING count(*) >= 5),
pts AS (SELECT set_id, duration, j AS point, j * (duration - 1) / 19.0::DOUBLE AS pos
  FROM (SELECT DISTINCT set_id, duration FROM pm), generate_series(0, 19) g(j)),
ht AS (SELECT p.set_id, p.duration, p.point, a.p + (p.pos - floor(p.pos)) * (coalesce(b.p, a.p) - a.p) AS height
  FROM pts p JOIN pm a ON a.set_id = p.set_id AND a.duration = p.duration AND a.generation = CAST(floor(p.pos) AS BIGINT) + 1
  LEFT JOIN pm b ON b.set_id = p.set_id AND b.duration = p.duration AND b.generation = CAST(floor(p.pos) AS BIGINT) + 2)"""


def mean_frame(spark, sf):
    return sc.mean_profiles(profile_frame(spark, sf), ["set_id"], min_t=3, min_members=5)


@query(
    "sca04_mean_profiles",
    with_(EV, RANKED, FOREST, DEPTH, _PROFILES, recursive=True)
    + f"SELECT set_id, duration, point, {r('height', 'height')} FROM ht",
)
def _(spark, sf):
    return mean_frame(spark, sf)


def _collapse_sql(lo: float, step: float, n: int, objective: str) -> str:
    return f"""
gam AS (SELECT {lo}::DOUBLE + i * {step}::DOUBLE AS gamma FROM generate_series(0, {n - 1}) g(i)),
scl AS (SELECT set_id, gamma, point, avg(height / pow(duration, gamma - 1)) AS m, var_pop(height / pow(duration, gamma - 1)) AS v, count(*) AS k
  FROM ht, gam GROUP BY 1, 2, 3),
err AS (SELECT set_id, gamma, {objective} AS e, max(k) AS k FROM scl GROUP BY 1, 2),
col AS (SELECT set_id, CASE WHEN max(k) >= 4 THEN arg_min(gamma, e) END AS gamma FROM err GROUP BY 1)"""


@query(
    "sca04_shape_collapse",
    with_(EV, RANKED, FOREST, DEPTH, _PROFILES, _collapse_sql(1.4, 0.05, 23, "avg(v / (m * m + 1e-12))"), recursive=True)
    + f"SELECT set_id, {r('gamma', 'gamma', 3)} FROM col",
    digits=3,
)
def _(spark, sf):
    return sc.collapse_exponent(mean_frame(spark, sf), ["set_id"])


@query(
    "sca05_profile_exponents",
    with_(
        EV, RANKED, FOREST, DEPTH, _PROFILES,
        _collapse_sql(1.3, 0.025, 53, "avg(v) / (avg(m) * avg(m) + 1e-12)"),
        """shp AS (SELECT set_id, duration, max(height) AS peak, sum(height) AS total FROM ht GROUP BY 1, 2),
        sl AS (SELECT set_id, regr_slope(ln(peak), ln(duration)) + 1 AS peak_exponent,
          regr_slope(ln(total * duration / 19.0::DOUBLE), ln(duration)) AS area_exponent FROM shp GROUP BY 1)""",
        recursive=True,
    )
    + f"""SELECT set_id, {r('peak_exponent', 'peak_exponent')}, {r('area_exponent', 'area_exponent')}, {r('gamma', 'spread_exponent')}
    FROM sl JOIN col USING (set_id)""",
)
def _(spark, sf):
    return sc.profile_exponents(mean_frame(spark, sf), ["set_id"])


