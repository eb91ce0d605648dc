"""Common table expressions shared by the SQL forms of the queries."""

from __future__ import annotations

from ripplework.functions.kernels import Kernel


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"


def r(expr: str, alias: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) AS {alias}"


def events_cte(key: str = "user_id") -> str:
    return f"""
ev AS (SELECT CAST({key} AS VARCHAR) AS stream_id, event_id, user_id, event_type, value,
  (us - min(us) OVER (PARTITION BY {key})) / 3.6e9 AS t
  FROM (SELECT *, epoch_us(ts) AS us FROM events)),
st AS (SELECT stream_id, max(t) AS horizon, count(*) AS n_events FROM ev GROUP BY 1)"""


EV = events_cte()
EV_TYPE = events_cte("event_type")

RANKED = """
rk AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY t, event_id) AS rn,
  t - lag(t) OVER (PARTITION BY stream_id ORDER BY t, event_id) AS gap FROM ev)"""

MESSAGES = """
raw AS (SELECT *, epoch_us(ts) AS us FROM events),
lines AS (SELECT event_id AS pos,
  CASE WHEN event_id % 97 = 0 THEN 'bad' WHEN event_id % 89 = 1 THEN 'bad'
       WHEN event_type = 'signup' THEN 'skipped'
       WHEN event_id % 83 = 2 OR event_id % 79 = 3 THEN 'bad' ELSE 'trade' END AS status,
  'm' || CAST(user_id % 20 AS VARCHAR) AS asset_id,
  (us // 100000000) * 100000 AS ts_ms,
  CAST(CAST(floor(value / 25) AS BIGINT) AS VARCHAR) AS price,
  us / 1e6 + (event_id % 3) * 0.25 AS recv_ts,
  'h' || CAST(CASE WHEN user_id % 5 = 0 THEN event_id // 40 ELSE event_id END AS VARCHAR) AS transaction_hash
  FROM raw),
msg AS (SELECT asset_id, pos, ts_ms, price, recv_ts, transaction_hash FROM lines WHERE status = 'trade')"""

FILLS = """
fills AS (SELECT CAST(l_suppkey AS VARCHAR) AS market, l_orderkey * 10 + l_linenumber AS fill_id,
  CAST(epoch(l_shipdate) AS BIGINT) AS block_time,
  round(l_extendedprice * 1e6) / 1e6 AS usdc, round(l_quantity * 1e6) / 1e6 AS shares
  FROM lineitem)"""

FOREST = """
rooted AS (SELECT *, CASE WHEN event_id % 5 = 0 OR rn = 1 THEN 1 ELSE 0 END AS is_root FROM rk),
trees AS (SELECT *, max(CASE WHEN is_root = 1 THEN rn END)
  OVER (PARTITION BY stream_id ORDER BY rn) AS root_rn FROM rooted),
forest AS (SELECT stream_id, rn - 1 AS idx, t,
  CASE WHEN is_root = 0 THEN greatest(root_rn, rn - 1 - event_id % 3) - 1 END AS parent_idx,
  root_rn - 1 AS root_idx, event_type IN ('click', 'purchase') AS is_update, event_id, value FROM trees)"""

# depth by walking the replies down from the roots
DEPTH = """
walk AS (SELECT stream_id, idx, root_idx, 1 AS depth FROM forest WHERE parent_idx IS NULL
  UNION ALL
  SELECT f.stream_id, f.idx, f.root_idx, w.depth + 1
  FROM walk w JOIN forest f ON f.stream_id = w.stream_id AND f.parent_idx = w.idx)"""

TREES = """
tree_cascades AS (SELECT stream_id, root_idx AS cascade_id, count(*) AS size, max(depth) AS duration
  FROM walk GROUP BY 1, 2)"""


def quiet_cte(k: float = 1.0, source: str = "ev") -> str:
    """Quiet-time cascades of ``source`` with ``dt = k * median gap`` of all events."""
    return f"""
widths AS (SELECT stream_id, count(*) AS n_events, {k} * median(gap) AS dt FROM rk GROUP BY 1),
starts AS (SELECT stream_id, min(t) AS t0 FROM {source} GROUP BY 1),
binned AS (SELECT e.stream_id, CAST(floor((e.t - s.t0) / w.dt) AS BIGINT) AS bin, count(*) AS cnt
  FROM {source} e JOIN widths w USING (stream_id) JOIN starts s USING (stream_id) GROUP BY 1, 2),
flagged AS (SELECT *, CASE WHEN bin - lag(bin) OVER (PARTITION BY stream_id ORDER BY bin) > 1
  THEN 1 ELSE 0 END AS fresh FROM binned),
runs AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY stream_id ORDER BY bin) AS BIGINT) AS run_id FROM flagged),
quiet AS (SELECT stream_id, run_id AS cascade_id, CAST(sum(cnt) AS BIGINT) AS size,
  max(bin) - min(bin) + 1 AS duration FROM runs GROUP BY 1, 2)"""


SETS = """
cas AS (SELECT *, 's' || CAST(CAST(stream_id AS BIGINT) % 2 AS VARCHAR) AS set_id,
  (cascade_id + CAST(stream_id AS BIGINT)) % 9 = 0 AS censored FROM quiet),
clean AS (SELECT set_id, stream_id || ':' || cascade_id AS cascade_id, size, duration
  FROM cas WHERE NOT censored)"""

CASCADES = EV + "," + RANKED + "," + quiet_cte() + "," + SETS


def kernel_values(kernels: list[Kernel]) -> str:
    rows = [
        f"({i}, {j}, {a!r}::DOUBLE, {b!r}::DOUBLE)"
        for i, k in enumerate(kernels)
        for j, (a, b) in enumerate(zip(k.a, k.beta))
    ]
    return "kern(kernel_idx, comp, a, beta) AS (VALUES " + ", ".join(rows) + ")"


# decayed sums by meeting every event with all earlier events of its stream
def decay_cte(kernels: list[Kernel]) -> str:
    """``s(stream_id, event_id, rn, t, kernel_idx, s, q)``: excitation and integrated excitation."""
    return (
        kernel_values(kernels)
        + """,
rates AS (SELECT DISTINCT beta FROM kern),
decayed AS (SELECT i.stream_id, i.event_id, r.beta, sum(exp(-r.beta * (i.t - j.t))) AS big_a
  FROM rk i JOIN rk j ON i.stream_id = j.stream_id AND j.rn < i.rn CROSS JOIN rates r GROUP BY 1, 2, 3),
contracted AS (SELECT stream_id, event_id, kernel_idx, sum(a * big_a) AS s, sum(a / kern.beta * big_a) AS q
  FROM decayed JOIN kern ON kern.beta = decayed.beta GROUP BY 1, 2, 3),
s AS MATERIALIZED (SELECT rk.stream_id, rk.event_id, rk.rn, rk.t, k.kernel_idx,
  coalesce(c.s, 0.0) AS s, coalesce(c.q, 0.0) AS q
  FROM rk CROSS JOIN (SELECT DISTINCT kernel_idx FROM kern) k
  LEFT JOIN contracted c USING (stream_id, event_id, kernel_idx)),
cc AS MATERIALIZED (SELECT rk.stream_id, kern.kernel_idx, sum(a / beta * (1 - exp(-beta * (st.horizon - rk.t)))) AS cc
  FROM rk JOIN st USING (stream_id) CROSS JOIN kern GROUP BY 1, 2)"""
    )


# the same sums for long streams: one event after another, every component decayed by the gap
def stepwise_decay_cte(kernels: list[Kernel]) -> str:
    return (
        kernel_values(kernels)
        + """,
rkm AS MATERIALIZED (SELECT stream_id, event_id, rn, t, gap FROM rk),
kl AS MATERIALIZED (SELECT kernel_idx, list(a ORDER BY comp) AS a, list(beta ORDER BY comp) AS b FROM kern GROUP BY 1),
acc AS (SELECT stream_id, rn, kernel_idx, list_transform(b, lambda x: 0.0::DOUBLE) AS v FROM rkm, kl WHERE rn = 1
  UNION ALL
  SELECT e.stream_id, e.rn, p.kernel_idx, list_transform(list_zip(p.v, kl.b), lambda x: (x[1] + 1) * exp(-x[2] * e.gap))
  FROM acc p JOIN rkm e ON e.stream_id = p.stream_id AND e.rn = p.rn + 1 JOIN kl ON kl.kernel_idx = p.kernel_idx),
s AS MATERIALIZED (SELECT rkm.stream_id, rkm.event_id, rkm.rn, rkm.t, acc.kernel_idx, list_inner_product(acc.v, kl.a) AS s
  FROM acc JOIN rkm USING (stream_id, rn) JOIN kl USING (kernel_idx)),
cc AS MATERIALIZED (SELECT rkm.stream_id, kern.kernel_idx, sum(a / beta * (1 - exp(-beta * (st.horizon - rkm.t)))) AS cc
  FROM rkm JOIN st USING (stream_id) CROSS JOIN kern GROUP BY 1, 2)"""
    )


# constant-baseline fit: mu follows from n because expected and observed counts agree at the optimum,
# and the derivative in n falls, so 60 halvings find its root
FIT = """
head AS MATERIALIZED (SELECT st.stream_id, cc.kernel_idx, st.horizon, st.n_events, cc.cc FROM st JOIN cc USING (stream_id)),
halve AS (SELECT stream_id, kernel_idx, 0 AS step, 0.0::DOUBLE AS lo, n_events / cc AS hi FROM head
  UNION ALL
  SELECT b.stream_id, b.kernel_idx, any_value(b.step) + 1,
    CASE WHEN sum((s.s - h.cc / h.horizon) / ((h.n_events - (b.lo + b.hi) / 2 * h.cc) / h.horizon + (b.lo + b.hi) / 2 * s.s)) > 0
      THEN any_value((b.lo + b.hi) / 2) ELSE any_value(b.lo) END,
    CASE WHEN sum((s.s - h.cc / h.horizon) / ((h.n_events - (b.lo + b.hi) / 2 * h.cc) / h.horizon + (b.lo + b.hi) / 2 * s.s)) > 0
      THEN any_value(b.hi) ELSE any_value((b.lo + b.hi) / 2) END
  FROM halve b JOIN head h USING (stream_id, kernel_idx) JOIN s USING (stream_id, kernel_idx)
  WHERE b.step < 60 GROUP BY b.stream_id, b.kernel_idx),
fit AS (SELECT b.stream_id, b.kernel_idx, (b.lo + b.hi) / 2 AS n, h.horizon, h.n_events, h.cc,
  (h.n_events - (b.lo + b.hi) / 2 * h.cc) / h.horizon AS mu
  FROM halve b JOIN head h USING (stream_id, kernel_idx) WHERE b.step = 60)"""
