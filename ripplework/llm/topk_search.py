"""Exact top-k by inner product: columnar branch and bound.

Vectors become whole numbers and are packed in blocks that store one dimension after another. Candidate
blocks are dealt over lanes, every block of queries is sent to each lane, and they meet in one equi-join. For
each query the scores grow by ``DIM_STEP`` dimensions at a time. What the dimensions still to come can
add is at most the product of the remaining lengths of query and candidate; candidates whose score plus
that mass stays under the k-th best assured score are dropped and the arrays compacted. A block returns
at most ``k`` rows a query, and a ranked window with early limits merges them.

Defined cases: a vector that is null, empty, or holds a null or non-finite component takes no part, nor does
a null id; vectors meet only those of equal length; of several rows with the id of a query the smallest
vector asks, and all are left out of its answers; other repeated rows each count; ties go to the smaller id.
Scores must fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024
CANDIDATE_ROWS = 16_384
QUERY_ROWS = 256
DIM_STEP = 8
_BLOCK = "block long, dim int, ids binary, cells binary"
_ARROW_BLOCK = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("cells", pa.binary())])
_FOUND = "query_id long, vec_id long, score long"
_ARROW_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def whole(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v``: the usable vectors as arrays of long, ``floor(SCALE * x)``."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * F.lit(float(SCALE)))).alias("v"),
        fine.alias("fine"), F.size(x).alias("n"),
    ).filter(F.col("vec_id").isNotNull() & F.coalesce("fine", F.lit(False)) & (F.col("n") > 0)).select("vec_id", "v")


def _pack(rows: int):
    """Rows to blocks of at most ``rows`` vectors, one dimension after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        made = 0
        part = TaskContext.get().partitionId()

        def emit(dim: int, ids: np.ndarray, cells: np.ndarray) -> pa.RecordBatch:
            nonlocal made
            made += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + made]), pa.array([dim], pa.int32()), pa.array([ids.tobytes()]), pa.array([np.ascontiguousarray(cells.T).tobytes()])],
                schema=_ARROW_BLOCK,
            )

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            size = np.asarray(lists.value_lengths())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.r_[0, np.cumsum(size)]
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                cells = flat[starts[at][:, None] + np.arange(dim)]
                had = held.pop(int(dim), [])
                had.append((ids[at], cells))
                ids_all, cells_all = (np.concatenate(x) for x in zip(*had, strict=True))
                full = len(ids_all) // rows * rows
                for i in range(0, full, rows):
                    yield emit(int(dim), ids_all[i : i + rows], cells_all[i : i + rows])
                if full < len(ids_all):
                    held[int(dim)] = [(ids_all[full:], cells_all[full:])]
        for dim, had in held.items():
            yield emit(dim, *(np.concatenate(x) for x in zip(*had, strict=True)))

    return run


def _suffix_lengths(cells: np.ndarray, steps: list[int]) -> np.ndarray:
    """Length of each vector's part from each step on, rounded up."""
    squares = cells.astype(np.float64) ** 2
    tails = [squares[s:].sum(axis=0) for s in steps[1:]]
    return np.sqrt(np.stack([*tails, np.zeros(cells.shape[1])])) * (1 + 1e-9) + 1e-9


def search_block(query_ids, queries, ids, cells, k: int):
    """Best ``k`` of a candidate block for each query of a block; ``queries`` and ``cells`` are dimension x vector."""
    dim = cells.shape[0]
    steps = list(range(0, dim, DIM_STEP))
    top = dim * float(np.abs(queries).max(initial=0)) * float(np.abs(cells).max(initial=0))
    kind = np.float64 if top < 2**52 else np.int64  # doubles hold such sums exactly
    queries, cells = queries.astype(kind), cells.astype(kind)
    query_tail, tail = _suffix_lengths(queries, steps), _suffix_lengths(cells, steps)
    out = []
    for j, query_id in enumerate(query_ids):
        alive = np.flatnonzero(ids != query_id)
        score = np.zeros(len(alive), kind)
        q = queries[:, j]
        for n, s in enumerate(steps):
            score = score + q[s : s + DIM_STEP] @ cells[s : s + DIM_STEP][:, alive]
            if n + 1 < len(steps) and len(alive) > k:
                mass = query_tail[n, j] * tail[n, alive]
                assured = np.partition(score - mass, len(alive) - k)[len(alive) - k]
                keep = score + mass >= assured - 1
                alive, score = alive[keep], score[keep]
        best = np.lexsort((ids[alive], -score))[:k]
        out.append((np.full(len(best), query_id), ids[alive[best]], score[best].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, query_ids = (np.frombuffer(row[c], np.int64) for c in ("ids", "query_ids"))
                cells, queries = (np.frombuffer(row[c], np.int64).reshape(row["dim"], -1) for c in ("cells", "query_cells"))
                found = search_block(query_ids, queries, ids, cells, k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], schema=_ARROW_FOUND)

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of ``candidates(vec_id, v)`` for each of ``queries(vec_id, v)``."""
    spark = candidates.sparkSession
    lanes = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = candidates.mapInArrow(_pack(CANDIDATE_ROWS), _BLOCK).withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes)))
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    asking = asked.mapInArrow(_pack(QUERY_ROWS), _BLOCK).select(
        "dim", F.col("ids").alias("query_ids"), F.col("cells").alias("query_cells"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("lane"),
    )
    # candidate blocks are dealt over lanes, and each query block is sent to every lane once
    met = blocks.repartition(lanes, "dim", "lane").join(asking.repartition(lanes, "dim", "lane"), ["dim", "lane"])
    found = met.select("dim", "query_ids", "query_cells", "ids", "cells").mapInArrow(_search(k), _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
