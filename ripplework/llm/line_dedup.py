"""Line deduplication by edit distance: a segment-partition join.

Two lines are near copies if their edit distance is at most the threshold of the shorter one (``threshold``:
0 below 10 characters, 1 below 20, ``MAX_EDITS`` from there on, whatever the length). A line of length ``l`` is split
into threshold-plus-one even segments; a line within the threshold keeps one of them whole, at a place and length
shift that the threshold bounds. Lines put their segments into an index by (length, segment, content) and probe
it with the few substrings that those bounds allow for each shorter length. Cells with the same lines are one cell.

Lines that meet are verified by a banded bit-parallel edit distance.

Exact copies are one line throughout, known by a 128-bit hash. The index is met by hashes alone, so that
line texts travel only for lines that met another one. Inside a cell a breadth-first walk links each line once,
so a crowd of near copies makes one link per member. Linked lines form a class, and the first line of a class
by document and position stays.

Defined cases: lines without a non-space character are left alone, as is a null text; an empty table gives an
empty result; a row is known by its id and a 128-bit hash of its text, so that repeated rows are the same places, whose
lines stay or go together, while rows with other texts under one id, or under none, are rows of their own;
a null id comes before all others; columns other than id and text pass through ``deduplicated`` unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplework.llm.components import components
from ripplework.session import checkpointed

_LINE = "doc_id long, row binary, line_no int, key binary"
_ARROW_LINE = pa.schema([("doc_id", pa.int64()), ("row", pa.binary()), ("line_no", pa.int32()), ("key", pa.binary())])
_ARROW_CELL = pa.schema([("cell", pa.int64()), ("line", pa.int64())])
_ARROW_TEXT = pa.schema([("line", pa.int64()), ("key", pa.binary()), ("content", pa.string())])
_ARROW_LINK = pa.schema([("a", pa.binary()), ("b", pa.binary())])
_ROW_BATCH = 1 << 18
#: more edits cost the cube of their number in probes; this is the largest that fits the limits in README.md
MAX_EDITS = 2
#: bits of the map of lines that met another one; texts of other lines don't travel
MARK_BITS = 26


def threshold(length: int) -> int:
    """Edits that a line of this many characters may differ by."""
    return 0 if length < 10 else 1 if length < 20 else MAX_EDITS


def segments(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, size) of an even partition, the longer segments last."""
    base, longer = divmod(length, parts)
    out, start = [], 0
    for i in range(parts):
        size = base + (i >= parts - longer)
        out.append((start, size))
        start += size
    return out


def probes(length: int) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment, start, size): where a line of ``length`` may hold a whole segment of a line no longer."""
    out = []
    for shorter in range(length, -1, -1):
        t = threshold(shorter)
        shift = length - shorter
        if shift > threshold(length):
            break
        if not t or shift > t:
            continue
        for i, (start, size) in enumerate(segments(shorter, t + 1)):
            lo = max(start - i, start + shift - (t - i), 0)
            hi = min(start + i, start + shift + (t - i), length - size)
            out += [(shorter, i, at, size) for at in range(lo, hi + 1)]
    return out


class _Probes(dict):
    def __missing__(self, length: int) -> list[tuple[int, int, int, int]]:
        self[length] = found = probes(length)
        return found


def within(a: str, b: str, limit: int) -> bool:
    """Is the edit distance at most ``limit``: one bit per diagonal of the band, one word per number of edits."""
    if abs(len(a) - len(b)) > limit:
        return False
    start, least = 0, min(len(a), len(b))
    if a[:least] == b[:least]:
        return True  # the rest is insertions, as many as the lengths differ
    step = 1 << least.bit_length()
    while step:  # common beginning by halving steps
        if start + step <= least and a[start : start + step] == b[start : start + step]:
            start += step
        step >>= 1
    end, step = 0, 1 << least.bit_length()
    while step:
        if start + end + step <= least and a[len(a) - end - step : len(a) - end] == b[len(b) - end - step : len(b) - end]:
            end += step
        step >>= 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return max(len(a), len(b)) <= limit
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << (i + limit)
    band = (1 << 2 * limit + 1) - 1
    # bit d of level e: with e edits, b[:j] was turned into a[:j + d - limit]
    levels = [band & ((1 << limit + e + 1) - (1 << limit)) for e in range(limit + 1)]
    for j, c in enumerate(b):
        equal = where.get(c, 0) >> j & band
        before, new = 0, 0
        for e in range(limit + 1):
            level = levels[e]
            new = (level & equal | before | before >> 1 | new << 1 if e else level & equal) & band
            levels[e], before = new, level
        if not levels[limit]:
            return False
    return bool(levels[limit] >> (len(a) - len(b) + limit) & 1)


def _lines(text: str | None) -> list[tuple[int, str]]:
    return [(n, line) for n, line in enumerate((text or "").split("\n")) if line and not line.isspace()]


def _key(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def _short(key: bytes) -> int:
    """63 bits of a key, with the lowest bit free."""
    return int.from_bytes(key[:8], "little", signed=True) & ~1


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows, numbers, keys = [], [], [], []
        for doc_id, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            found = _lines(text.as_py())
            ids += [doc_id] * len(found)
            rows += [row] * len(found)
            numbers += [n for n, _ in found]
            keys += [_key(line) for _, line in found]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary()), pa.array(numbers, pa.int32()), pa.array(keys, pa.binary())], schema=_ARROW_LINE)


def _row_key() -> Column:
    """128 bits that tell apart the texts of one id; with the id, the name of a row."""
    return F.unhex(F.md5(F.col("text").cast("binary")))


def line_table(docs: DataFrame) -> DataFrame:
    """``doc_id, row, line_no, key`` of every line of ``docs(doc_id, text)`` that is not blank."""
    return docs.select(F.col("doc_id").cast("long"), _row_key(), "text").mapInArrow(_line_rows, _LINE)


def _cell_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index and probe entries; the lowest bit of a line's number tells whether the entry is indexed."""
    hash_of, known = xxhash.xxh64_intdigest, _Probes()

    def emit(cells: np.ndarray, lines: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cells.view(np.int64)), pa.array(lines)], schema=_ARROW_CELL)

    for batch in batches:
        distinct = {line for text in batch.column(0) for _, line in _lines(text.as_py())}
        cells: list[int] = []
        lines: list[int] = []
        for line in distinct:
            if not threshold(len(line)):
                continue
            name = _short(_key(line))
            own = set(segments(len(line), threshold(len(line)) + 1))
            for length, i, at, size in known[len(line)]:
                cells.append(hash_of(line[at : at + size].encode("utf-8", "surrogatepass"), length * 4 + i))
                lines.append(name | (length == len(line) and (at, size) in own))
            if len(cells) >= _ROW_BATCH:
                yield emit(np.array(cells, np.uint64), np.array(lines, np.int64))
                cells, lines = [], []
        yield emit(np.array(cells, np.uint64), np.array(lines, np.int64))


def _by_cell(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple]:
    """Whole cells of rows sorted by cell, as arrow arrays of many cells at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        cell = batch.column(0)
        if cell[0].as_py() == cell[-1].as_py():
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = int(np.searchsorted(table.column(0).to_numpy(), cell[-1].as_py()))
        held = table.slice(cut).to_batches()
        if cut:
            yield tuple(table.slice(0, cut).column(c) for c in range(columns))
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield tuple(table.column(c) for c in range(columns))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of the cells in which an indexed line meets another line, each line once a cell; equal cells get one name."""
    for cell, line in _by_cell(batches, 2):
        cell, line = cell.to_numpy(), line.to_numpy()
        name, indexed = line & ~np.int64(1), (line & 1).astype(bool)
        fresh = np.r_[True, (cell[1:] != cell[:-1]) | (name[1:] != name[:-1])]  # sorted by cell and line
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        group = np.cumsum(np.r_[True, cell[1:] != cell[:-1]]) - 1
        met = (np.add.reduceat(fresh.astype(np.int64), first) > 1) & np.logical_or.reduceat(indexed, first)
        keep = fresh & met[group]
        mixed = name.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
        members = np.add.reduceat(np.where(fresh, mixed ^ mixed >> np.uint64(29), np.uint64(0)), first)  # the same for the same lines
        yield pa.RecordBatch.from_arrays([pa.array(members[group][keep].view(np.int64)), pa.array(name[keep])], schema=_ARROW_CELL)


def _marks(lines: DataFrame) -> np.ndarray:
    """A bitmap of ``2 ** MARK_BITS`` bits, whatever the corpus, with a bit for each of ``lines(line)``."""
    place = F.shiftright("line", 1).bitwiseAND((1 << MARK_BITS) - 1)
    pages = lines.groupBy(F.shiftright(place, 15).alias("page")).agg(F.bitmap_construct_agg(place.bitwiseAND((1 << 15) - 1)).alias("bits"))
    marks = np.zeros((1 << MARK_BITS - 15, 1 << 12), np.uint8)
    for r in pages.collect():
        marks[r["page"]] = np.frombuffer(r["bits"], np.uint8)
    return marks.ravel()


def _text_rows(batches: Iterator[pa.RecordBatch], marks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Texts of the lines whose bit is marked: those that met another line, and few others."""
    mask = (1 << MARK_BITS) - 1
    for batch in batches:
        found = list({line for text in batch.column(0) for _, line in _lines(text.as_py()) if threshold(len(line))})
        keys = [_key(line) for line in found]
        names = np.fromiter(map(_short, keys), np.int64, len(keys))
        place = names >> 1 & mask
        at = np.flatnonzero(marks[place >> 3] >> (place & 7).astype(np.uint8) & 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[at]), pa.array([keys[i] for i in at], pa.binary()), pa.array([found[i] for i in at], pa.string())], schema=_ARROW_TEXT
        )


def cell_links(keys: list[bytes], lines: list[str]) -> list[tuple[bytes, bytes]]:
    """Links of the distinct lines of one cell, each to the first line it is joined to."""
    out, left = [], list(dict(zip(keys, lines, strict=True)).items())
    while len(left) > 1:
        root, *left = left
        queue = [root[1]]
        while queue and left:
            line = queue.pop()
            rest = []
            for other in left:
                if within(line, other[1], threshold(min(len(line), len(other[1])))):
                    out.append((root[0], other[0]))
                    queue.append(other[1])
                else:
                    rest.append(other)
            left = rest
    return out


def _link_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cell, key, line in _by_cell(batches, 3):
        cell = cell.to_numpy()
        bounds = np.r_[np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]), len(cell)]
        found: set[tuple[bytes, bytes]] = set()
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo > 1:
                found.update(cell_links(key.slice(lo, hi - lo).to_pylist(), line.slice(lo, hi - lo).to_pylist()))
        a, b = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=_ARROW_LINK)


def near_links(docs: DataFrame) -> DataFrame:
    """``a, b``: keys of lines that are linked, joining all near copies among the lines of ``docs(text)``."""
    spread = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("text")
    entries = texts.mapInArrow(_cell_rows, "cell long, line long").repartition(spread, "cell").sortWithinPartitions("cell", "line")
    met = checkpointed(entries.mapInArrow(_met, "cell long, line long").distinct())
    wanted = met.select("line").distinct()
    marks = docs.sparkSession.sparkContext.broadcast(_marks(wanted))  # 2 ** MARK_BITS bits
    sent = texts.mapInArrow(lambda batches: _text_rows(batches, marks.value), "line long, key binary, content string")
    known = sent.join(wanted, "line")
    verified = met.join(known, "line").select("cell", "key", "content")
    laid = verified.repartition(spread, "cell").sortWithinPartitions("cell", "key")
    return laid.mapInArrow(_link_rows, "a binary, b binary").distinct()


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, row, line_no, key, first_doc_id, first_line_no, near, removed`` of every line that is not blank.

    ``first_*`` is the first line of the class and names it; ``near`` tells that the class holds different lines.
    """
    lines = checkpointed(line_table(docs))
    joined = components(near_links(docs)).withColumnRenamed("node", "key")
    place = F.struct("doc_id", "line_no", "row")
    firsts = lines.groupBy("key").agg(F.min(place).alias("first"))
    rooted = firsts.join(joined, "key", "left").withColumn("near", F.col("root").isNotNull())
    rooted = checkpointed(rooted.select("key", "first", "near", F.coalesce("root", "key").alias("root")))
    named = rooted.filter("near").groupBy("root").agg(F.min("first").alias("of_class"))
    of_key = rooted.join(named, "root", "left").select("key", F.coalesce("of_class", "first").alias("first"), "near")
    return lines.join(of_key, "key").select(
        "doc_id", "row", "line_no", "key", F.col("first.doc_id").alias("first_doc_id"), F.col("first.line_no").alias("first_line_no"), "near",
        (~place.eqNullSafe(F.col("first"))).alias("removed"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with the later lines of every class taken out of ``text``; ``n_chars``, if there, follows."""
    gone = classes(docs).filter("removed").groupBy("doc_id", "row").agg(F.collect_set("line_no").alias("gone_lines_"))
    gone = gone.select(F.col("doc_id").alias("gone_doc_"), F.col("row").alias("gone_row_"), "gone_lines_")  # at most the lines of one document
    names = docs.columns
    same_row = F.col("doc_id").cast("long").eqNullSafe(F.col("gone_doc_")) & (_row_key() == F.col("gone_row_"))
    held = docs.join(gone, same_row, "left").select(*names, "gone_lines_")
    at, size_at = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(len(names))]
            texts = columns[at].to_pylist()
            for i, gone_here in enumerate(batch.column(len(names))):
                if gone_here.is_valid:
                    out = set(gone_here.as_py())
                    texts[i] = "\n".join(line for n, line in enumerate(texts[i].split("\n")) if n not in out)
            columns[at] = pa.array(texts, pa.string())
            if size_at >= 0:
                sizes = [old if t is None else len(t) for t, old in zip(texts, columns[size_at].to_pylist(), strict=True)]
                columns[size_at] = pa.array(sizes, columns[size_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return held.mapInArrow(run, docs.schema)
