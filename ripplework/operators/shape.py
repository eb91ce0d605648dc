"""Event sequences: gaps, bins, count windows, segments, and model-free clustering measures.

Inputs are ``events(stream_id, event_id, t)`` and ``streams(stream_id, horizon)``. Count windows are
never zero-filled to get a mean or a variance: with ``nb`` windows the sums of counts and of squared
counts over the occupied ones are enough.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplework.operators.sequence import arrange, has_hot_group

STREAM = ["stream_id"]
TIME_ORDER = ["t", "event_id"]
SPAN_CHUNK = 10_000


def relative_times(events: DataFrame, micros: str, unit_micros: float = 1e6) -> DataFrame:
    """Time since the stream's first event, in units of ``unit_micros`` microseconds."""
    start = events.groupBy(*STREAM).agg(F.min(micros).alias("_t0"))
    return (
        events.join(start, STREAM)
        .withColumn("t", (F.col(micros) - F.col("_t0")) / F.lit(float(unit_micros)))
        .drop("_t0")
    )


def stream_spans(events: DataFrame) -> DataFrame:
    """``streams(stream_id, horizon, n_events)`` with the last event as the horizon."""
    return events.groupBy(*STREAM).agg(
        F.max("t").alias("horizon"), F.count(F.lit(1)).alias("n_events")
    )


def gaps(events: DataFrame, *, blocked: bool | None = None) -> DataFrame:
    """Events with the time since the event before (NULL on the first) and their rank."""
    seq = arrange(events, STREAM, TIME_ORDER, blocked=blocked).add(rn="rn", lags={"_prev": "t"})
    return seq.rows().withColumn("gap", F.col("t") - F.col("_prev")).drop("_prev")


def first_events(events: DataFrame, n_match: int, *, blocked: bool | None = None) -> DataFrame:
    """The first ``n_match`` events of every stream; the horizon is the last kept time."""
    seq = arrange(events, STREAM, TIME_ORDER, blocked=blocked).add(rn="rn")
    return seq.rows().where(F.col("rn") <= n_match)


def time_slice(events: DataFrame, slices: DataFrame, min_events: int = 50) -> DataFrame:
    """Events of ``[lo, hi)`` slices, restarted at the slice's first event.

    ``slices(stream_id, slice_id, lo, hi)`` holds a handful of rows per stream. Slices with too few
    events keep their count with NULL span.
    """
    cut = events.join(slices, STREAM).where((F.col("t") >= F.col("lo")) & (F.col("t") < F.col("hi")))
    span = cut.groupBy(*STREAM, "slice_id").agg(
        F.min("t").alias("_first"),
        F.max("t").alias("_last"),
        F.count(F.lit(1)).alias("n_events"),
    )
    enough = F.col("n_events") >= min_events
    return (
        cut.join(span, [*STREAM, "slice_id"])
        .withColumns(
            {
                "t": F.when(enough, F.col("t") - F.col("_first")),
                "horizon": F.when(enough, F.col("_last") - F.col("_first")),
            }
        )
        .drop("_first", "_last", "lo", "hi")
    )


def quantize(t: Column, grid: float) -> Column:
    return F.floor(t / F.lit(float(grid))) * F.lit(float(grid))


def bin_counts(events: DataFrame, streams: DataFrame, grid: float) -> DataFrame:
    """Counts per grid bin with empty bins present; the last bin is closed on the right."""
    nb = F.ceil(F.col("horizon") / F.lit(float(grid))).cast("bigint")
    sized = streams.select("stream_id", nb.alias("_nb")).where(F.col("_nb") > 0)
    counts = (
        events.join(sized, STREAM)
        .select(
            "stream_id",
            F.least(F.floor(F.col("t") / F.lit(float(grid))), F.col("_nb") - 1).alias("bin"),
        )
        .groupBy("stream_id", "bin")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    chunk = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_nb") - 1) / F.lit(SPAN_CHUNK)))
    first = F.col("_chunk") * SPAN_CHUNK
    last = F.least(first + SPAN_CHUNK - 1, F.col("_nb") - 1)
    frame = sized.withColumn("_chunk", F.explode(chunk)).select(
        "stream_id", F.explode(F.sequence(first, last)).alias("bin")
    )
    return frame.join(counts, ["stream_id", "bin"], "left").select(
        "stream_id", "bin", F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt")
    )


def tie_fraction(events: DataFrame, *, blocked: bool | None = None) -> DataFrame:
    """Share of neighbours with equal time; streams of fewer than two events give 0."""
    rows = gaps(events, blocked=blocked)
    return rows.groupBy(*STREAM).agg(
        F.coalesce(F.avg((F.col("gap") == 0).cast("double")), F.lit(0.0)).alias("tie_fraction")
    )


def burstiness(events: DataFrame, *, blocked: bool | None = None) -> DataFrame:
    """``(sd - mean) / (sd + mean)`` of the gaps (population SD); NULL below three events."""
    rows = gaps(events, blocked=blocked).groupBy(*STREAM).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.avg("gap").alias("_m"),
        F.stddev_pop("gap").alias("_s"),
    )
    value = F.try_divide(F.col("_s") - F.col("_m"), F.col("_s") + F.col("_m"))
    return rows.select(
        "stream_id", "n_events", F.when(F.col("n_events") >= 3, value).alias("burstiness")
    )


def _count_moments(rows: DataFrame, keys: Sequence[str], windows: str) -> DataFrame:
    """Mean, population and sample variance of counts over ``windows`` windows, empty ones included."""
    per_bin = rows.groupBy(*keys, windows, "_bin").agg(F.count(F.lit(1)).alias("_c"))
    sums = per_bin.groupBy(*keys, windows).agg(
        F.sum("_c").alias("_s1"), F.sum(F.col("_c") * F.col("_c")).alias("_s2")
    )
    nb, s1, s2 = F.col(windows), F.col("_s1"), F.col("_s2")
    spread = nb * s2 - s1 * s1
    return sums.withColumns(
        {
            "mean_count": F.try_divide(s1, nb),
            "var_pop": F.try_divide(spread, nb * nb),
            "var_samp": F.try_divide(spread, nb * (nb - 1)),
        }
    ).drop("_s1", "_s2")


def fano_profile(events: DataFrame, streams: DataFrame, window_sizes: Sequence[float]) -> DataFrame:
    """Variance over mean of counts per window size; NULL below two windows or without events."""
    sizes = F.array(*[F.lit(float(w)) for w in window_sizes])
    frame = streams.select("stream_id", "horizon", F.explode(sizes).alias("window_size")).select(
        "stream_id",
        "window_size",
        F.floor(F.col("horizon") / F.col("window_size")).cast("bigint").alias("n_windows"),
    )
    inside = F.col("t") <= F.col("n_windows") * F.col("window_size")
    rows = (
        events.join(frame, STREAM)
        .where((F.col("n_windows") >= 2) & inside)
        .withColumn(
            "_bin", F.least(F.floor(F.col("t") / F.col("window_size")), F.col("n_windows") - 1)
        )
    )
    moments = _count_moments(rows, ["stream_id", "window_size"], "n_windows")
    fano = F.try_divide("var_pop", F.col("mean_count"))
    return frame.join(
        moments.select("stream_id", "window_size", fano.alias("fano")),
        ["stream_id", "window_size"],
        "left",
    )


# fixed values: fewest windows and fewest events per window for a usable mean-variance estimate
MIN_WINDOWS = 15
MIN_MEAN = 5.0


def _mean_variance_n() -> Column:
    usable = (
        (F.col("n_windows") >= MIN_WINDOWS)
        & (F.col("mean_count") >= MIN_MEAN)
        & (F.col("var_samp") > F.col("mean_count"))
    )
    return F.when(usable, 1.0 - F.sqrt(F.try_divide("mean_count", F.col("var_samp"))))


def mean_variance_n(events: DataFrame, frame: DataFrame) -> DataFrame:
    """``1 - sqrt(mean/var)`` of counts for each row of ``frame(stream_id, window_id, span, width)``.

    ``span`` limits the events used; the number of windows is ``floor(span / width)``.
    """
    sized = frame.withColumn(
        "n_windows", F.floor(F.col("span") / F.col("width") + F.lit(1e-9)).cast("bigint")
    )
    rows = events.join(sized, STREAM).where(
        (F.col("t") <= F.col("n_windows") * F.col("width")) & (F.col("t") <= F.col("span"))
    )
    rows = rows.withColumn(
        "_bin", F.least(F.floor(F.col("t") / F.col("width")), F.col("n_windows") - 1)
    )
    keys = ["stream_id", "window_id"]
    moments = _count_moments(rows, keys, "n_windows").withColumn("n_hat", _mean_variance_n())
    return sized.drop("span").join(
        moments.select(*keys, "mean_count", "n_hat"), keys, "left"
    )


LADDER_STEPS = 10
LADDER_MOST_WINDOWS = 800


def window_ladder(streams: DataFrame) -> DataFrame:
    """Ten log-spaced widths from ``T/800`` to ``T/15`` for every stream."""
    step = F.explode(F.sequence(F.lit(0), F.lit(LADDER_STEPS - 1))).alias("window_id")
    ratio = F.lit(float(LADDER_MOST_WINDOWS)) * F.pow(
        F.lit(MIN_WINDOWS / LADDER_MOST_WINDOWS), F.col("window_id") / F.lit(LADDER_STEPS - 1.0)
    )
    return streams.select("stream_id", "horizon", step).select(
        "stream_id",
        F.col("window_id").cast("bigint").alias("window_id"),
        F.col("horizon").alias("span"),
        (F.col("horizon") / ratio).alias("width"),
    )


def mean_variance_rise(events: DataFrame, streams: DataFrame) -> DataFrame:
    """First and last valid estimate on the ladder, their rise, and first third against the whole."""
    ladder = mean_variance_n(events, window_ladder(streams)).where("n_hat IS NOT NULL")
    ends = ladder.groupBy(*STREAM).agg(
        F.min_by("n_hat", "window_id").alias("n_small_window"),
        F.max_by("n_hat", "window_id").alias("n_large_window"),
    )
    mid = streams.select(
        "stream_id",
        F.explode(
            F.array(
                F.struct(F.lit(0).cast("bigint").alias("window_id"), F.col("horizon").alias("span")),
                F.struct(
                    F.lit(1).cast("bigint").alias("window_id"), (F.col("horizon") / 3.0).alias("span")
                ),
            )
        ).alias("w"),
        (F.col("horizon") / 120.0).alias("width"),
    ).select("stream_id", "w.window_id", "w.span", "width")
    halves = mean_variance_n(events, mid).groupBy(*STREAM).agg(
        F.max(F.when(F.col("window_id") == 0, F.col("n_hat"))).alias("n_whole"),
        F.max(F.when(F.col("window_id") == 1, F.col("n_hat"))).alias("n_first_third"),
    )
    return halves.join(ends, STREAM, "left").withColumn(
        "rise", F.col("n_large_window") - F.col("n_small_window")
    )


def window_rates(events: DataFrame, streams: DataFrame, k: int = 8) -> DataFrame:
    """Event counts over ``k`` equal time windows, empty ones included, with the rate per unit time."""
    b = F.least(F.floor(F.col("t") * F.lit(float(k)) / F.col("horizon")), F.lit(k - 1))
    counts = (
        events.join(streams.select("stream_id", "horizon"), STREAM)
        .where(F.col("horizon") > 0)
        .select("stream_id", b.cast("bigint").alias("window_id"))
        .groupBy("stream_id", "window_id")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    frame = streams.where(F.col("horizon") > 0).select(
        "stream_id",
        "horizon",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint"))).alias("window_id"),
    )
    out = frame.join(counts, ["stream_id", "window_id"], "left").withColumn(
        "cnt", F.coalesce("cnt", F.lit(0)).cast("bigint")
    )
    return out.withColumn("rate", F.col("cnt") * F.lit(float(k)) / F.col("horizon")).drop("horizon")


def rate_swing(events: DataFrame, streams: DataFrame, k: int = 8) -> DataFrame:
    """Largest over smallest rate, once over occupied windows and once with a floor of 1e-9."""
    rates = window_rates(events, streams, k)
    busy = F.when(F.col("cnt") > 0, F.col("rate"))
    return rates.groupBy(*STREAM).agg(
        F.try_divide(F.max(busy), F.min(busy)).alias("swing"),
        (F.max("rate") / F.greatest(F.min("rate"), F.lit(1e-9))).alias("swing_with_empty"),
    )


def quarter_ratio(events: DataFrame, streams: DataFrame) -> DataFrame:
    """Events in the last quarter of time over events in the first (at least one)."""
    rows = events.join(streams.select("stream_id", "horizon"), STREAM)
    q = F.col("horizon") / 4.0
    counts = rows.groupBy(*STREAM).agg(
        F.count_if(F.col("t") < q).alias("_first"),
        F.count_if(F.col("t") >= F.col("horizon") - q).alias("_last"),
    )
    return counts.select(
        "stream_id", (F.col("_last") / F.greatest(F.col("_first"), F.lit(1))).alias("quarter_ratio")
    )


def segment_edges(
    events: DataFrame,
    streams: DataFrame,
    segment_counts: Sequence[int],
    *,
    blocked: bool | None = None,
    ranked: DataFrame | None = None,
) -> DataFrame:
    """Edges of ``K`` segments with equal event counts, for every ``K`` asked for.

    One row per (stream, k) with ``edges``: 0, the midpoints between boundary events, the horizon.
    Boundaries round half to even and are clipped to ``[1, N-1]``. ``ranked`` gives the events with their rank ``rn``, if
    the caller has it.
    """
    if ranked is None:
        ranked = arrange(events, STREAM, TIME_ORDER, blocked=blocked).add(rn="rn").rows()
    ks = F.explode(F.array(*[F.lit(int(k)).cast("bigint") for k in segment_counts]))
    frame = (
        streams.select("stream_id", "horizon", "n_events", ks.alias("k"))
        .withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k"))))
        .withColumn(
            "_i",
            F.greatest(
                F.least(
                    F.bround(F.col("_j") * F.col("n_events") / F.col("k")).cast("bigint"),
                    F.col("n_events") - 1,
                ),
                F.lit(1),
            ),
        )
    )
    inner = (
        frame.where((F.col("_j") > 0) & (F.col("_j") < F.col("k")))
        .withColumn("rn", F.explode(F.array(F.col("_i"), F.col("_i") + 1)))
        .join(ranked.select("stream_id", "rn", "t"), ["stream_id", "rn"])
        .groupBy("stream_id", "k", "_j")
        .agg((F.sum("t") * 0.5).alias("_edge"))
    )
    ends = frame.where((F.col("_j") == 0) | (F.col("_j") == F.col("k"))).select(
        "stream_id", "k", "_j", F.when(F.col("_j") == 0, F.lit(0.0)).otherwise(F.col("horizon")).alias("_edge")
    )
    # at most K + 1 entries per list
    packed = inner.unionByName(ends).groupBy("stream_id", "k").agg(
        F.array_sort(F.collect_list(F.struct("_j", "_edge"))).alias("_e")
    )
    return packed.select("stream_id", "k", F.transform("_e", lambda e: e["_edge"]).alias("edges"))


def _segment_of(t: Column, edges: Column) -> Column:
    """Number of the segment that ``t`` is in, from 0 to the last."""
    below = F.size(F.filter(edges, lambda e: e <= t)) - 1
    return F.greatest(F.least(below, F.size(edges) - 2), F.lit(0))


def with_segment(events: DataFrame, edges: DataFrame) -> DataFrame:
    """Every event with its segment (clipped to ``[0, K-1]``) and its place inside the segment."""
    rows = events.join(edges, STREAM).withColumn("seg", _segment_of(F.col("t"), F.col("edges")).cast("bigint"))
    lo = F.get(F.col("edges"), F.col("seg").cast("int"))
    hi = F.get(F.col("edges"), (F.col("seg") + 1).cast("int"))
    return rows.withColumns(
        {"seg_lo": lo, "seg_hi": hi, "weight": F.try_divide(F.col("t") - lo, hi - lo)}
    )


def with_segments(events: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per event with arrays ``segs`` and ``weights`` over all segment counts, in ascending order of ``k``.

    The same places as ``with_segment`` gives, without a row for every segment count. A segment of no length has weight 0.
    """
    # one entry for each segment count
    packed = edges.groupBy(*STREAM).agg(F.array_sort(F.collect_list(F.struct("k", "edges"))).alias("_all"))
    t = F.col("t")
    rows = events.join(packed, STREAM).withColumn("segs", F.transform("_all", lambda p: _segment_of(t, p["edges"]).cast("int")))

    def place(p: Column, i: Column) -> Column:
        seg = F.get(F.col("segs"), i)
        lo, hi = F.get(p["edges"], seg), F.get(p["edges"], seg + 1)
        return F.coalesce(F.try_divide(t - lo, hi - lo), F.lit(0.0))

    return rows.withColumn("weights", F.transform("_all", place)).drop("_all")


def shuffled_gaps(events: DataFrame, seed: int = 0, digits: int = 6) -> DataFrame:
    """A control for every stream: its own gaps in an order drawn by hash, so trends and clusters are gone.

    The first event stays at 0; as many events and the same span as before. Times are rounded to
    ``digits``, so they do not depend on how running sums are put together. Streams that hold most rows are ordered in blocks.
    """
    steps = arrange(events.select("stream_id", "event_id", "t"), ["stream_id"], ["t", "event_id"]).add(lags={"_before": "t"}).rows()
    steps = steps.select(
        "stream_id", "event_id", F.col("_before").isNotNull().alias("_later"), (F.col("t") - F.col("_before")).alias("_gap"),
        F.md5(F.concat_ws("|", F.lit(str(seed)), "stream_id", F.col("event_id").cast("string"))).alias("_mix"),
    )
    mixed = arrange(steps, ["stream_id"], ["_later", "_mix", "event_id"]).add(sums={"_t": "_gap"}).rows()
    return mixed.select("stream_id", "event_id", F.round(F.coalesce("_t", F.lit(0.0)), digits).alias("t"))
