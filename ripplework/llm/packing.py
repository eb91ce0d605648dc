"""Best-fit packing after Martello-Toth reduction.

Packing needs only how many pieces there are of each length, at most ``capacity`` numbers however large
the corpus. On that histogram small sets that provably dominate every alternative are fixed first: a
full piece alone; two pieces that fill a sequence exactly; the longest piece alone if nothing fits beside
it, or with the longest piece that fits if no more than that one fits, or if no two that fit weigh more.
What is left is packed best fit, longest first, for whole classes of equally filled sequences at once.

The plan says for each length which ranks go to which run of sequences. Its size depends on the capacity
alone (a length touches each class of fill once and splits one), so it is broadcast. Pieces get their rank
inside their length from salted counts, so that a length that holds most pieces is spread over tasks.

Tokens come from whole texts. A text is cut where a space follows a non-space: the pre-tokens of the
vocabulary never cross such a place, so the bytes of each part's ids are kept in a bounded cache.

Defined cases: a null or empty text is a document of the end id alone; a null ``doc_id`` and repeated rows are
packed like other rows; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ripplework.session import checkpointed

CAPACITY = 2048
END_ID = 0
CACHE_PARTS = 300_000
CACHE_CHARS = 48
_SPACES = re.compile(r"\s ")  # a space that does not follow a non-space
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_ARROW_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


class _Known(dict):
    """Bytes of the ids of text parts, made when first asked for."""

    def __init__(self, tokenizer_path: str, ranks_path: str, pattern: str):
        super().__init__()
        ranks = {}
        with open(ranks_path, "rb") as lines:
            for token, rank in map(bytes.split, lines):
                ranks[base64.b64decode(token)] = int(rank)
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, part: str) -> bytes:
        ids = array("I", self.encode(part)).tobytes()
        if len(part) <= CACHE_CHARS:
            self[part] = ids
        return ids


class Encoder:
    """Texts to the little-endian bytes of their ids under a tokenizer file.

    ``ranks_path`` names the same vocabulary as ranks, which encodes single parts faster. Texts for which
    parts might not be independent go through the tokenizer whole.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str, pattern: str):
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = _Known(tokenizer_path, ranks_path, pattern)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if _SPACES.search(text) or any(t in text for t in self.special):
            return self.whole(text)
        head, *rest = text.split(" ")
        parts = [" " + p for p in rest]
        if head:
            parts.insert(0, head)
        out = b"".join(map(self.known.__getitem__, parts))
        if len(self.known) > CACHE_PARTS:
            self.known.clear()
        return out


def cut(n_ids: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than the capacity."""
    if n_ids <= capacity:
        return [(0, n_ids)]
    first = n_ids % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n_ids, capacity))]


def pieces(docs: DataFrame, vocabulary: tuple[str, str, str], capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every row of ``docs(doc_id, text)``, with the checksum of their ids.

    ``vocabulary`` is (tokenizer file, the same as a file of ranks, pattern of pre-tokens).
    """
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*vocabulary)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py() or "") + end
                for n, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc_id, n, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW_PIECE, strict=True)], schema=_ARROW_PIECE)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PIECE)


class _Plan:
    """Counts still to place and the rows of the plan."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.left)
        self.used = dict.fromkeys(self.left, 0)
        self.sequences = 0
        self.rows: list[tuple[int, int, int, int, int, int]] = []

    def place(self, size: int, n: int, first: int, each: int, offset: int) -> None:
        """The next ``n`` pieces of a size, ``each`` to a sequence from ``first`` on."""
        lo = self.used[size]
        self.rows.append((size, lo, lo + n, first, each, offset))
        self.used[size] = lo + n
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def fix(self, n: int, *sizes: int) -> None:
        """``n`` new sequences that each hold just these pieces."""
        offset = 0
        for size in sizes:
            self.place(size, n, self.sequences, 1, offset)
            offset += size
        self.sequences += n

    def pair(self, a: int, b: int) -> None:
        n = self.left[a] // 2 if a == b else min(self.left[a], self.left[b])
        if a == b:
            self.place(a, 2 * n, self.sequences, 2, 0)
            self.sequences += n
        else:
            self.fix(n, a, b)

    def partner(self, size: int, most: int) -> int:
        """The longest piece within ``most`` beside one of ``size``; 0 if none."""
        at = bisect_left(self.sizes, most + 1) - 1
        if at >= 0 and self.sizes[at] == size and self.left[size] < 2:
            at -= 1
        return self.sizes[at] if at >= 0 else 0

    def least(self, without: int, n: int) -> int:
        """Sum of the ``n`` shortest pieces other than one of ``without``; beyond the capacity if there are fewer."""
        total = taken = 0
        for size in self.sizes:
            use = min(self.left[size] - (size == without), n - taken)
            total, taken = total + use * size, taken + use
            if taken == n:
                return total
        return self.capacity + 1

    def best_two(self, without: int, most: int) -> int:
        """Greatest weight of two pieces that fit in ``most`` beside one of ``without``."""
        lo, hi, best = 0, len(self.sizes) - 1, 0
        while lo <= hi:
            a, b = self.sizes[lo], self.sizes[hi]
            need = 1 + (a == b)
            if a + b > most or self.left[b] - (b == without) < need:
                hi -= 1
            else:
                if self.left[a] - (a == without) >= 1:
                    best = max(best, a + b)
                lo += 1
        return best

    def reduce(self) -> None:
        capacity = self.capacity
        if self.left.get(capacity):
            self.fix(self.left[capacity], capacity)
        for size in list(self.sizes):  # exact pairs dominate every other set of either piece
            other = capacity - size
            if size <= other and self.left.get(size, 0) and self.left.get(other, 0) and (size != other or self.left[size] > 1):
                self.pair(size, other)
        while self.sizes:
            longest = self.sizes[-1]
            room = capacity - longest
            second = self.partner(longest, room)
            if not second:
                self.fix(1 if longest * 2 <= capacity else self.left[longest], longest)
            elif self.least(longest, 2) > room or (self.least(longest, 3) > room and self.best_two(longest, room) <= second):
                self.pair(longest, second)
            else:
                break

    def best_fit(self) -> None:
        open_by_room: dict[int, list[tuple[int, int]]] = {}
        rooms: list[int] = []

        def add(room: int, first: int, n: int) -> None:
            if room and n:
                if room not in open_by_room:
                    open_by_room[room] = []
                    insort(rooms, room)
                open_by_room[room].append((first, n))

        while self.sizes:
            size = self.sizes[-1]
            n = self.left[size]
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                first, many = open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room]
                    rooms.pop(at)
            else:
                room = self.capacity
                first, many = self.sequences, -(-n // (room // size))
                self.sequences += many
            each = room // size
            offset = self.capacity - room
            full = min(many, n // each)
            if full:
                self.place(size, full * each, first, each, offset)
                add(room - each * size, first, full)
            rest = n - full * each
            if full < many and rest:  # fewer than one sequence takes
                self.place(size, rest, first + full, rest, offset)
                add(room - rest * size, first + full, 1)
                full += 1
            add(room, first + full, many - full)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, rank from, rank to, first sequence, pieces each, offset) that place every counted piece."""
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    p = _Plan(counts, capacity)
    p.reduce()
    p.best_fit()
    return p.rows


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """Sequences that no packing can do without (the bound by long, middle and short pieces)."""
    best = -(-sum(s * n for s, n in counts.items()) // capacity)
    for least in {0, *(s for s in counts if 2 * s <= capacity)}:
        long = sum(n for s, n in counts.items() if s > capacity - least)
        middle = [(s, n) for s, n in counts.items() if capacity / 2 < s <= capacity - least]
        short = sum(s * n for s, n in counts.items() if least <= s <= capacity / 2)
        n_middle = sum(n for _, n in middle)
        room = capacity * n_middle - sum(s * n for s, n in middle)
        best = max(best, long + n_middle + max(0, -(-(short - room) // capacity)))
    return best


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts(doc_id, piece, length, ...)`` with ``sequence_id`` and ``offset``; ``parts`` must be fixed rows."""
    spark = parts.sparkSession
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = plan(counts, capacity)
    schema = "length long, lo long, hi long, first long, each long, at long"
    places = F.broadcast(spark.createDataFrame(rows, schema))
    salts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
        .select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    )
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("rank", F.row_number().over(inside) - 1).join(starts, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("ahead")).drop("salt", "ahead")
    placed = ranked.join(places, "length").filter((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    ahead = F.col("rank") - F.col("lo")
    return placed.select(
        *parts.columns,
        (F.col("first") + F.floor(ahead / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(ahead, F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: tuple[str, str, str], capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for all documents."""
    return pack(checkpointed(pieces(docs, vocabulary, capacity)), capacity)
