"""Codes for vectors: one codebook a part, learnt by Lloyd's rounds over cover trees.

Vectors become whole numbers and are cut into ``PARTS`` equal parts. Rows are dealt in blocks of at most ``BLOCK_ROWS``;
for each block and part one cover tree is built and written once: nested centres at halving scales, children within
their parent's scale, siblings further apart than the child's, each node with its radius, the number and the sum
of the vectors below it. A round goes down every tree from its root, a level at a time for all nodes still
open: where the second nearest codebook entry is further than the nearest by more than twice the radius, the
triangle inequality gives the whole subtree to the nearest entry with its sum; otherwise its children open, and
the points of undecided leaves are compared exactly. A task returns sums for each entry, whose number depends on the
codebooks alone, and all arithmetic that decides is done in whole numbers.

Defined cases: a vector that is null, or holds a null or non-finite component, takes no part. The parts are those of the
kept vector with the smallest id whose length ``PARTS`` divides; vectors of other lengths keep a row with null code and error.
The first entries are the smallest ids, null ids last, equal ids by vector; fewer vectors make fewer entries. Repeated
rows count each; ties go to the lower entry. Numbers so large that a squared distance or a sum would not fit a long
raise an error. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplework.session import checkpointed, spread

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
BLOCK_ROWS = 4096
LEAF_POINTS = 12
LABEL_SALTS = 32
_PIECE = "block long, part int, cells binary"
_ARROW_PIECE = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("cells", pa.binary())])
Codebooks = list[np.ndarray]


def whole(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, label, v``: the usable vectors as arrays of long, ``floor(SCALE * x)``."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), x.alias("x"), fine.alias("fine"))
    return rows.filter("fine").select("vec_id", "label", F.transform("x", lambda c: F.floor(c * F.lit(float(SCALE)))).alias("v"))


class CoverTree:
    """A cover tree over the rows of a whole-number matrix, equal rows taken together."""

    def __init__(self, points: np.ndarray):
        self.points, self.row_of, weight = np.unique(points, axis=0, return_inverse=True, return_counts=True)
        self.row_of = self.row_of.reshape(-1).astype(np.int32)
        wide = self.points.astype(np.int64)
        order: list[np.ndarray] = []
        nodes: list[list] = []  # centre, squared radius, first and last place in order, children
        todo = [(np.arange(len(wide)), 0, ((wide - wide[:1]) ** 2).sum(axis=1), -1)] if len(wide) else []
        placed = 0
        while todo:
            members, centre, squares, parent = todo.pop()
            node = len(nodes)
            reach = int(squares.max())
            nodes.append([centre, reach, placed, placed + len(members), []])
            if parent >= 0:
                nodes[parent][4].append(node)
            if len(members) <= LEAF_POINTS or reach == 0:
                order.append(members)
                placed += len(members)
                continue
            # squared scale of the children: the largest power of two that does not reach the farthest point
            child = 4 ** (((reach - 1).bit_length() - 1) // 2) if reach > 1 else 0
            groups = []
            while len(members):
                near = squares <= child
                groups.append((members[near], centre, squares[near], node))
                members = members[~near]
                if len(members):
                    centre = members[0]
                    squares = ((wide[members] - wide[centre]) ** 2).sum(axis=1)
            todo += reversed(groups)
        self.order = np.concatenate(order).astype(np.int32) if order else np.zeros(0, np.int32)
        self.centre = np.array([n[0] for n in nodes], np.int32)
        self.reach = np.array([n[1] for n in nodes], np.int64)
        self.first, self.last = (np.array([n[i] for n in nodes], np.int32) for i in (2, 3))
        self.child_ends = np.cumsum([len(n[4]) for n in nodes]).astype(np.int32)
        self.children = np.array([c for n in nodes for c in n[4]], np.int32)
        # cumulative sums in the order of the leaves: a subtree is one stretch of it
        total = np.cumsum(wide[self.order] * weight[self.order][:, None], axis=0)
        self.sums = np.concatenate([np.zeros((1, wide.shape[1]), np.int64), total])
        self.counts = np.r_[0, np.cumsum(weight[self.order])]

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``first, last, entry``: stretches of ``order`` and the nearest entry of all their points."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        open_ = np.zeros(min(1, len(self.centre)), np.int64)
        while len(open_):
            squares = _squares(self.points[self.centre[open_]], entries)
            best = squares.argmin(axis=1)
            far = np.sqrt(squares.astype(np.float64))
            nearest = far[np.arange(len(open_)), best]
            far[np.arange(len(open_)), best] = np.inf
            second = far.min(axis=1)
            # strictly further for every point below, with room for rounding
            sure = second - nearest > 2 * np.sqrt(self.reach[open_].astype(np.float64)) * (1 + 1e-9) + 1e-9 * (1 + nearest)
            sure |= self.reach[open_] == 0  # one point: its distances are exact
            found.append((self.first[open_[sure]], self.last[open_[sure]], best[sure]))
            rest = open_[~sure]
            child_first = np.where(rest > 0, self.child_ends[rest - 1], 0)
            n_children = self.child_ends[rest] - child_first
            leaves = rest[n_children == 0]
            if len(leaves):
                size = (self.last - self.first)[leaves]
                at = np.repeat(self.first[leaves] - np.cumsum(size) + size, size) + np.arange(size.sum())
                found.append((at, at + 1, _squares(self.points[self.order[at]], entries).argmin(axis=1)))
            inner = np.repeat(child_first - np.cumsum(n_children) + n_children, n_children) + np.arange(n_children.sum())
            open_ = self.children[inner].astype(np.int64)
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none, none)

    def totals(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum and number of the points nearest to each entry."""
        first, last, entry = self.assign(entries)
        sums, counts = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
        np.add.at(sums, entry, self.sums[last] - self.sums[first])
        np.add.at(counts, entry, self.counts[last] - self.counts[first])
        return sums, counts

    def codes(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry and squared distance of every row, in the order of the rows."""
        first, last, entry = self.assign(entries)
        code = np.zeros(len(self.points), np.int64)
        by = np.argsort(first)  # the stretches lie side by side
        code[self.order] = np.repeat(entry[by], (last - first)[by])
        error = ((self.points.astype(np.int64) - entries[code]) ** 2).sum(axis=1)
        return code[self.row_of], error[self.row_of]


def _squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return ((points.astype(np.int64)[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)


def _blocks(rows: DataFrame, dim: int, kind: str) -> DataFrame:
    """``block, part, cells`` of ``rows(vec_id, label, v)``: the cells of each part, and at part -1 the ids and labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, n_held = TaskContext.get().partitionId(), 0, [], 0

        def emit(rows: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal made
            made += 1
            cells = rows.column(2).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(rows), PARTS, -1)
            sink = pa.BufferOutputStream()
            names = rows.select([0, 1])
            with pa.ipc.new_stream(sink, names.schema) as out:
                out.write_batch(names)
            payload = [sink.getvalue().to_pybytes(), *(np.ascontiguousarray(cells[:, p]).tobytes() for p in range(PARTS))]
            block = pa.array([(task << 32) + made] * (PARTS + 1), pa.int64())
            return pa.RecordBatch.from_arrays([block, pa.array(range(-1, PARTS), pa.int32()), pa.array(payload)], schema=_ARROW_PIECE)

        for batch in batches:
            for start in range(0, len(batch), BLOCK_ROWS):
                held.append(batch.slice(start, BLOCK_ROWS))
                n_held += len(held[-1])
                if n_held >= BLOCK_ROWS:
                    merged = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    yield emit(merged.slice(0, BLOCK_ROWS))
                    held = [merged.slice(BLOCK_ROWS)]
                    n_held = len(held[0])
        if n_held:
            yield emit(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return rows.filter(F.size("v") == dim).select("vec_id", "label", "v").mapInArrow(run, _PIECE)


def plant(blocks: DataFrame, width: int, kind: str) -> DataFrame:
    """``block, part, cells`` with a cover tree in ``cells`` in place of the numbers of every part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree = CoverTree(np.frombuffer(row["cells"], kind).reshape(-1, width))
                yield pa.RecordBatch.from_pylist([{**row, "cells": pickle.dumps(tree, 5)}], schema=_ARROW_PIECE)

    return checkpointed(spread(blocks, "block", "part").mapInArrow(run, _PIECE))


def improve(trees: DataFrame, codebooks: Codebooks) -> Codebooks:
    """One round: every entry becomes the floored mean of the parts that are nearest to it; unused ones stay."""
    kind = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros(c.shape, np.int64) for c in codebooks], [np.zeros(len(c), np.int64) for c in codebooks]
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s, n = pickle.loads(cells.as_buffer()).totals(codebooks[part])
                sums[part] += s
                counts[part] += n
        rows = [(p, e, int(counts[p][e]), sums[p][e].tolist()) for p in range(len(sums)) for e in np.flatnonzero(counts[p]).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * 4, kind, strict=True)], schema=kind)

    found = trees.select("part", "cells").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    # entries times components, whatever the number of vectors
    means = found.select("part", "entry", "n", F.posexplode("sums").alias("i", "s")).groupBy("part", "entry", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    better = [c.copy() for c in codebooks]
    for r in means.collect():
        better[r["part"]][r["entry"], r["i"]] = r["s"] // r["n"]
    return better


def encode(blocks: DataFrame, trees: DataFrame, codebooks: Codebooks, label_type: str) -> DataFrame:
    """``vec_id, label, code, error`` of every row of the blocks."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                code, error = pickle.loads(row["cells"]).codes(codebooks[row["part"]])
                cells = code.astype(np.uint8).tobytes() + error.astype("<i8").tobytes()
                yield pa.RecordBatch.from_pylist([{**row, "cells": cells}], schema=_ARROW_PIECE)

    def join(table: pa.Table) -> pa.Table:
        cells = dict(zip(table.column("part").to_pylist(), table.column("cells").to_pylist(), strict=True))
        names = pa.ipc.open_stream(cells.pop(-1)).read_all()
        n = names.num_rows
        code = np.stack([np.frombuffer(cells[p], np.uint8, n) for p in range(PARTS)], axis=1)
        error = sum(np.frombuffer(cells[p], "<i8", n, n) for p in range(PARTS))
        return pa.table([*names.columns, pa.array([c.tobytes().hex() for c in code]), pa.array(error)], ["vec_id", "label", "code", "error"])

    parts = blocks.filter("part = -1").unionAll(trees.mapInArrow(assign, _PIECE))
    return parts.groupBy("block").applyInArrow(join, f"vec_id long, label {label_type}, code string, error long")


def codebooks_digest(codebooks: Codebooks) -> str:
    """Lowercase hex SHA-256 of all components, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for c in codebooks for x in c.reshape(-1).tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """``vec_id, label, code, error, label_error`` of the usable rows of ``vectors(vec_id, embedding, label)``, and the codebooks."""
    rows = whole(vectors)
    label_type = rows.schema["label"].dataType.simpleString()
    fits = (F.size("v") > 0) & (F.size("v") % PARTS == 0)
    # each list is at most ENTRIES vectors
    smallest = rows.filter(fits).orderBy(F.asc_nulls_last("vec_id"), "v").select("v")
    first = smallest.limit(1).collect()
    dim = len(first[0]["v"]) if first else 0
    codebooks: Codebooks = []
    out = None
    if dim:
        known = rows.filter(F.size("v") == dim)
        n, most = known.agg(F.count(F.lit(1)), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))).first()
        if 4 * most**2 * dim >= 2**63 or most * n >= 2**63:
            raise ValueError("components too large for whole-number distances")
        kind = "<i4" if most < 2**31 else "<i8"
        start = np.array([r["v"] for r in smallest.filter(F.size("v") == dim).limit(ENTRIES).collect()], np.int64)
        codebooks = [np.ascontiguousarray(c) for c in np.split(start, PARTS, axis=1)]
        blocks = checkpointed(_blocks(known, dim, kind))
        trees = plant(blocks.filter("part >= 0"), dim // PARTS, kind)
        for _ in range(rounds):
            codebooks = improve(trees, codebooks)
        out = encode(blocks, trees, codebooks, label_type)
    other = rows.filter(F.size("v") != dim).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    out = checkpointed(other if out is None else out.unionByName(other))
    salts = F.explode(F.sequence(F.lit(0), F.lit(LABEL_SALTS - 1)))
    per_label = out.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("l"), "label_error", salts.alias("s"))
    dealt = out.withColumn("salt", F.pmod(F.hash("vec_id", "code"), F.lit(LABEL_SALTS)))
    found = dealt.join(per_label, F.col("label").eqNullSafe(F.col("l")) & (F.col("salt") == F.col("s")), "left")
    return found.select("vec_id", "label", "code", "error", "label_error"), codebooks
