"""Ordered columns (lag, rank, running sum) that survive one stream holding most rows.

A plain ``Window.partitionBy(stream)`` puts a whole stream in one task. ``arrange`` looks at the
largest stream first: below ``max_rows`` it keeps the plain window, above it rows are laid out by
``repartitionByRange(stream, time, tie)``, which cuts even a single stream into even blocks. The
block number is written down with the rows (checkpoint), windows then run inside one block of one
stream, and a table with one row per (stream, block) carries the last value, the row count and the
sums of the earlier blocks across.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplework.session import checkpointed

MAX_ROWS_KEY = "spark.ripplework.sequence.maxRows"
DEFAULT_MAX_ROWS = 2_000_000
BLOCK = "_block"


def sequence_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(MAX_ROWS_KEY, str(DEFAULT_MAX_ROWS)))


def has_hot_group(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> bool:
    """True when some group of ``keys`` holds more rows than one task should sort."""
    limit = sequence_limit(df) if limit is None else limit
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return not sizes.where(F.col("_rows") > limit).isEmpty()


class Arranged:
    """Rows of each key in a fixed order, plus the means to add ordered columns to them."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], blocked: bool):
        self.df = df
        self.keys = list(keys)
        self.order = list(order)
        self.blocked = blocked

    def _over(self) -> Window:
        parts = self.keys + ([BLOCK] if self.blocked else [])
        return Window.partitionBy(*parts).orderBy(*self.order)

    def transform(self, fn) -> Arranged:
        """Apply a row-wise change that keeps the keys, the order columns and the block."""
        return Arranged(fn(self.df), self.keys, self.order, self.blocked)

    def add(
        self,
        *,
        rn: str | None = None,
        lags: Mapping[str, str] | None = None,
        leads: Mapping[str, str] | None = None,
        sums: Mapping[str, str] | None = None,
    ) -> Arranged:
        """Add row numbers (from 1), previous values, next values and running sums (inclusive)."""
        lags, leads, sums = dict(lags or {}), dict(leads or {}), dict(sums or {})
        w = self._over()
        running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        added: dict[str, Column] = {}
        if rn:
            added[rn] = F.row_number().over(w).cast("bigint")
        for out, src in sums.items():
            added[out] = F.sum(src).over(running)
        if not self.blocked:
            for out, src in lags.items():
                added[out] = F.lag(src).over(w)
            for out, src in leads.items():
                added[out] = F.lead(src).over(w)
            return self.transform(lambda d: d.withColumns(added))

        # the struct tells "no earlier row in this block" from "the earlier value is NULL"
        for out, src in lags.items():
            added[f"_lag_{out}"] = F.lag(F.struct(F.col(src).alias("v"))).over(w)
        for out, src in leads.items():
            added[f"_lead_{out}"] = F.lead(F.struct(F.col(src).alias("v"))).over(w)
        place = F.struct(*self.order)
        ends = [F.count(F.lit(1)).alias("_n")]
        ends += [F.sum(src).alias(f"_sum_{out}") for out, src in sums.items()]
        ends += [
            F.max_by(F.struct(F.col(src).alias("v")), place).alias(f"_end_{out}")
            for out, src in lags.items()
        ]
        ends += [
            F.min_by(F.struct(F.col(src).alias("v")), place).alias(f"_start_{out}")
            for out, src in leads.items()
        ]
        blocks = self.df.groupBy(*self.keys, BLOCK).agg(*ends)
        across = Window.partitionBy(*self.keys).orderBy(BLOCK)
        before = across.rowsBetween(Window.unboundedPreceding, -1)
        carry = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_carry_n")]
        carry += [F.sum(f"_sum_{out}").over(before).alias(f"_carry_{out}") for out in sums]
        carry += [F.lag(f"_end_{out}").over(across).alias(f"_carry_{out}") for out in lags]
        carry += [F.lead(f"_start_{out}").over(across).alias(f"_carry_{out}") for out in leads]
        blocks = blocks.select(*self.keys, BLOCK, *carry)

        joined = self.df.withColumns(added).join(blocks, [*self.keys, BLOCK], "left")
        final: dict[str, Column] = {}
        if rn:
            final[rn] = F.col(rn) + F.col("_carry_n")
        for out in sums:
            local, earlier = F.col(out), F.col(f"_carry_{out}")
            final[out] = F.when(earlier.isNull(), local).otherwise(
                earlier + F.coalesce(local, F.lit(0))
            )
        for out in lags:
            final[out] = F.coalesce(F.col(f"_lag_{out}"), F.col(f"_carry_{out}"))["v"]
        for out in leads:
            final[out] = F.coalesce(F.col(f"_lead_{out}"), F.col(f"_carry_{out}"))["v"]
        drop = ["_carry_n"] + [f"_carry_{o}" for o in (*sums, *lags, *leads)]
        drop += [f"_lag_{o}" for o in lags] + [f"_lead_{o}" for o in leads]
        return self.transform(lambda _: joined.withColumns(final).drop(*drop))

    def rows(self) -> DataFrame:
        return self.df.drop(BLOCK) if self.blocked else self.df


def arrange(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    blocked: bool | None = None,
    block_rows: int | None = None,
) -> Arranged:
    """Order ``df`` inside ``keys``; ``blocked=None`` measures the largest group first.

    ``block_rows`` is for work that holds a block in memory: blocks of about so many rows, however few partitions are set.
    """
    if blocked is None:
        blocked = has_hot_group(df, keys)
    if not blocked:
        return Arranged(df, keys, order, False)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if block_rows is not None:
        parts = max(parts, -(-df.count() // block_rows))
    laid_out = df.repartitionByRange(parts, *keys, *order).withColumn(BLOCK, F.spark_partition_id())
    return Arranged(checkpointed(laid_out), keys, order, True)


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    *,
    cnt: str | None = None,
    blocked: bool | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles per group, one output column per entry of ``probs``.

    ``cnt`` names a column of repetitions. Ordinary groups use the built-in ``percentile``; groups
    too large for one buffer are ranked as a value histogram and cut by running counts.
    """
    rows = df.where(F.col(value).isNotNull())
    if blocked is None:
        blocked = has_hot_group(rows, keys)
    if not blocked:
        times = (F.col(cnt),) if cnt else ()
        aggs = [F.percentile(value, float(p), *times).alias(out) for out, p in probs.items()]
        return rows.groupBy(*keys).agg(*aggs)
    weight = F.sum(cnt) if cnt else F.count(F.lit(1))
    hist = rows.groupBy(*keys, value).agg(weight.alias("_c"))
    ranked = arrange(hist, keys, [value], blocked=True).add(sums={"_cum": "_c"}).rows()
    ranked = ranked.join(hist.groupBy(*keys).agg(F.sum("_c").alias("_total")), list(keys))

    def position(p: float) -> Column:
        return F.lit(float(p)) * (F.col("_total") - 1)

    aggs = [F.first("_total").alias("_total")]
    for out, p in probs.items():
        for end, at in (("_lo_", F.floor(position(p))), ("_hi_", F.ceil(position(p)))):
            aggs.append(F.min(F.when(F.col("_cum") > at, F.col(value))).alias(end + out))
    cut = ranked.groupBy(*keys).agg(*aggs)
    outs = []
    for out, p in probs.items():
        lo, hi = F.col("_lo_" + out), F.col("_hi_" + out)
        inside = position(p) - F.floor(position(p))
        outs.append((lo + (hi - lo) * inside).cast("double").alias(out))
    return cut.select(*keys, *outs)
