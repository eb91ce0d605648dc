"""Quality rules as a bitmask ledger: measure once, judge as often as wanted.

``ledger`` reads every text once and stores its measurements and one integer whose bit ``b`` says that
rule ``b`` failed. A policy is a named, versioned set of bits, so judging a corpus by another policy,
comparing versions and ablating single rules read the ledger (a few numbers per document), never the
texts. Ablations are one pass of partial aggregates over the bits; what is shuffled is one row per
policy and task.

Defined cases: a null text has no words and no lines, so it fails ``too_short``; a null ``doc_id`` and
repeated rows keep one ledger row each; an empty table gives an empty ledger; columns other than the
id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rule number -> (name, condition over the measurements under which a document fails).
RULES: dict[int, tuple[str, str]] = {
    0: ("too_short", "n_words < 50"),
    1: ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    2: ("symbol_heavy", "10 * n_symbols > 3 * n_words"),
    3: ("short_words", "word_chars < 2 * n_words"),
    4: ("long_words", "word_chars > 15 * n_words"),
    5: ("repeated_lines", "3 * n_dup_lines > 2 * n_lines"),
    6: ("too_long", "n_words > 1000000"),
}
BASE_MASK = 0b0000011

# (policy, version) -> bits that reject. Version 1 has the base rules alone.
POLICIES: dict[tuple[str, int], int] = {
    ("web", 1): 0b0000011,
    ("web", 2): 0b0011111,
    ("web", 3): 0b0111111,
}
PRODUCTION = ("web", 2)

_SYMBOLS = b"#*$%&|<>"
_MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
_ARROW = pa.schema([(part.split()[0], pa.int64()) for part in _MEASURES.split(", ")])
_NOT_SYMBOL = bytes(b for b in range(256) if b not in _SYMBOLS)
_CONTINUATION = bytes(range(0x80, 0xC0))


def repeat_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
    if len(codes) < 2_000_000:  # three ids below 2^21 fit in one integer
        windows = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:
        pairs = np.unique(ids[:-1] * len(codes) + ids[1:], return_inverse=True)[1]
        windows = np.unique(pairs[:-1] * len(codes) + ids[2:], return_inverse=True)[1]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    twice = twice[np.r_[True, twice[1:] != twice[:-1]]]
    at = np.searchsorted(twice, windows)
    hit = twice[np.minimum(at, len(twice) - 1)] == windows
    covered = np.zeros(n, bool)
    covered[:-2] |= hit
    covered[1:-1] |= hit
    covered[2:] |= hit
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # splits at 0x20 and 0x09-0x0D, as the word pattern does
    joined = b"".join(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        len(words),
        len(joined.translate(None, _CONTINUATION)),
        len(raw.translate(None, _NOT_SYMBOL)),
        len(lines),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        rows = [measure(t.as_py()) for t in texts]
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in columns)], schema=_ARROW)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Mapping[int, tuple[str, str]] = RULES) -> DataFrame:
    """One row per document: its id (as ``doc_id``), the measurements and ``failures``."""
    measured = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _measure_batches, _MEASURES
    )
    bits = F.lit(0).cast("long")
    for bit, (_, condition) in rules.items():
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failures", bits)


def judge(book: DataFrame, mask: int, column: str = "kept") -> DataFrame:
    """The verdict of one policy: kept if no bit of ``mask`` is set."""
    return book.withColumn(column, F.col("failures").bitwiseAND(F.lit(mask).cast("long")) == 0)


def ablation(book: DataFrame, policies: Mapping[tuple[str, int], int] = POLICIES, rules: Mapping[int, tuple[str, str]] = RULES) -> DataFrame:
    """Per policy version and rule: documents that fail it, that fail nothing else, and that are kept without it."""
    fails = F.col("failures")
    aggregates = [F.count(F.lit(1)).alias("n_docs")]
    cells = []
    for (policy, version), mask in policies.items():
        active = fails.bitwiseAND(F.lit(mask).cast("long"))
        kept = f"kept_{policy}_{version}"
        aggregates.append(F.count_if(active == 0).alias(kept))
        for bit, (name, _) in rules.items():
            if mask >> bit & 1:
                one = F.lit(1 << bit).cast("long")
                n_fail, n_only = f"f_{policy}_{version}_{bit}", f"o_{policy}_{version}_{bit}"
                aggregates += [
                    F.count_if(active.bitwiseAND(one) != 0).alias(n_fail),
                    F.count_if(active == one).alias(n_only),
                ]
                cells.append(
                    F.struct(
                        F.lit(policy).alias("policy"), F.lit(version).alias("version"), F.lit(name).alias("rule"),
                        F.col(n_fail).alias("n_failed"), F.col(n_only).alias("n_failed_only"),
                        (F.col(kept) + F.col(n_only)).alias("n_kept_without"), F.col(kept).alias("n_kept"),
                        F.col("n_docs").alias("n_docs"),
                    )
                )
    return book.agg(*aggregates).select(F.inline(F.array(*cells)))
