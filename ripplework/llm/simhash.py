"""SimHash near-duplicates: range join over segment popcounts.

A 64-bit fingerprint is embedded as the bit counts of its 32 two-bit segments. The Manhattan distance of
two embeddings never exceeds the Hamming distance of the fingerprints. Two fingerprints within ``radius``
bits are within ``radius // 2`` in the embedding of at least one half, and then share a grid cell that
is within ``radius // 4`` (rounded up) steps of both. Each distinct fingerprint is therefore put into its
own cell and the cells one step away, in both halves; what meets in a cell is verified exactly.

Exact copies and equal fingerprints are collapsed before the join. Within a cell a breadth-first walk
links each fingerprint once, so a cell with many near copies emits one link per member and not one
per pair; links then go through ``components``.

Defined cases: a null text is an empty one; a text without words has fingerprint zero and links like
any other; fewer words than a shingle make one shingle of them all; repeated rows keep a row each; a null
``doc_id`` keeps its row and never names a component unless all its members are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplework.llm.components import components
from ripplework.session import checkpointed

RADIUS = 4
SHINGLE_WORDS = 4
SEED = 42
_CHUNK = 1 << 16
_WALK_FROM = 12
_FIELD_LOW = np.uint64(0x5555555555555555)
_ARROW_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_ARROW_CELL = pa.schema([("cell", pa.int64()), ("fp", pa.int64())])
_ARROW_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends)]
    n = len(words) - shingle_words + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle_words - 1 :], strict=False)), np.uint64, n
    )
    counts = np.zeros(64, np.int64)
    for i in range(0, n, _CHUNK):
        part = hashes[i : i + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, **more: Column) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a long) for every row of ``docs(doc_id, text)``; ``more`` longs follow."""
    schema = pa.schema([*_ARROW_FP, *[(name, pa.int64()) for name in more]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle_words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], schema=schema)

    given = docs.select(F.col("doc_id").cast("long"), "text", *[c.alias(name) for name, c in more.items()])
    return given.mapInArrow(run, ", ".join(f"{name} long" for name in ("doc_id", "fp", *more)))


def cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grid cells of unsigned fingerprints: own and one step away, for either half, with the row of each."""
    embedded = fps - ((fps >> np.uint64(1)) & _FIELD_LOW)  # 32 two-bit fields, each 0, 1 or 2
    found, rows = [], []
    for half in (0, 1):
        key = (embedded >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        tag = np.uint64(half << 32)
        found.append(key | tag)
        rows.append(np.arange(len(fps)))
        for field in range(16):
            step = np.uint64(1 << 2 * field)
            value = (key >> np.uint64(2 * field)) & np.uint64(3)
            up, down = np.flatnonzero(value < 2), np.flatnonzero(value > 0)
            found += [(key[up] + step) | tag, (key[down] - step) | tag]
            rows += [up, down]
    return np.concatenate(found), np.concatenate(rows)


def _cell_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for i in range(0, len(fps), 4096):
            part = fps[i : i + 4096]
            key, row = cells(part)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(part[row].view(np.int64))], schema=_ARROW_CELL)


def _walk(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of each member of one cell to the first member it is joined to inside the cell."""
    roots, members = [], []
    left = fps
    while len(left) > 1:
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= radius
            if near.any():
                hit = left[near]
                left = left[~near]
                queue.extend(hit)
                members.append(hit)
                roots.append(np.full(len(hit), root))
    none = np.zeros(0, np.uint64)
    return (np.concatenate(roots), np.concatenate(members)) if roots else (none, none)


def links_within(cell: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """Links (two columns) among rows sorted by cell, verified by exact Hamming distance."""
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[starts, len(cell)])
    out = []
    large = sizes > _WALK_FROM
    for s, n in zip(starts[large], sizes[large], strict=True):
        out.append(np.stack(_walk(fps[s : s + n], radius), axis=1))
    small = ~large
    for shift in range(1, min(_WALK_FROM, int(sizes[small].max(initial=1)))):
        use = small & (sizes > shift)
        first, count = starts[use], sizes[use] - shift
        at = np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        near = np.bitwise_count(fps[at] ^ fps[at + shift]) <= radius
        out.append(np.stack([fps[at[near]], fps[at[near] + shift]], axis=1))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.uint64)


def _link_rows(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # rows of the last cell, which the next batch may go on with

        def emit(cell: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            pairs = links_within(cell, fps, radius).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=_ARROW_LINK)

        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            fps = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            held.append((cell, fps))
            if cell[0] == cell[-1]:
                continue
            cell, fps = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = np.searchsorted(cell, cell[-1])
            held = [(cell[cut:], fps[cut:])]
            yield emit(cell[:cut], fps[:cut])
        if held:
            yield emit(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: links that join all fingerprints of ``distinct(fp)`` within ``radius`` bits into their components."""
    if not 0 <= radius <= 5:  # one half is then within 2, so both are within one step of a shared cell
        raise ValueError("the grid serves radii up to 5")
    spread = 2 * int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = distinct.select("fp").mapInArrow(_cell_rows, "cell long, fp long")
    laid = keyed.repartition(spread, "cell").sortWithinPartitions("cell", "fp")
    return laid.mapInArrow(_link_rows(radius), "a long, b long").distinct()


def _rooted(marked: DataFrame, radius: int) -> DataFrame:
    """``fp, first_id, root``: the smallest id of each fingerprint of ``marked(doc_id, fp)`` and its component."""
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    joined = components(near_links(first.select("fp"), radius))
    return first.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs(doc_id, text)``."""
    marked = checkpointed(fingerprints(docs, shingle_words))
    rooted = _rooted(marked, radius)
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = rooted.join(named, "root").select("fp", "component_id")
    return marked.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row of ``docs`` for each component: the smallest id, null last, and of rows with one id the smallest hash."""
    key = {"row_a_": F.xxhash64(*docs.columns), "row_b_": F.xxhash64(F.lit(SEED), *docs.columns)}  # 128 bits; equal rows have one key
    marked = checkpointed(fingerprints(docs, shingle_words, **key))
    of_fp = marked.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *key)).alias("first"))
    firsts = _rooted(marked, radius).join(of_fp, "fp").groupBy("root").agg(F.min("first").alias("first"))
    chosen = firsts.select(*[F.col(f"first.{name}").alias(name + "first_") for name in key])
    keyed = docs.select("*", *[c.alias(name) for name, c in key.items()])
    kept = keyed.join(chosen, [keyed[name] == chosen[name + "first_"] for name in key], "left_semi")
    return kept.dropDuplicates(list(key)).select(*docs.columns)
