"""Language identification by compression.

A language is known by a zstandard raw-content dictionary: a bounded sample of its labelled texts. A
text belongs to the language whose dictionary makes it smallest. Texts are reduced to lower-case words,
then compressed whole, in pieces of ``PIECE_BYTES`` that each start from the dictionary, so that a long
text is judged by all it holds and not by what its beginning taught the compressor.

The score is the margin ``1 - smallest / second smallest`` scaled by ``FULL_MARGIN`` into 0 to 1;
``identify`` marks predictions below ``min_score`` as rejected. The sample that a dictionary is made of
is bounded by ``sample_docs`` texts of ``SAMPLE_BYTES`` each and ``DICTIONARY_BYTES`` in all, for each
language; which texts it takes depends on a hash of the id alone.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; with equal
sizes the language first in order wins with score 0; with one learned language the score is 1; with
none every row is ``und``; repeated rows are predicted each on its own; columns other than id, text and
language are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_DOCS = 32
SAMPLE_BYTES = 4096
DICTIONARY_BYTES = 32_768
PIECE_BYTES = 4096
LEVEL = 6
FULL_MARGIN = 0.2
MIN_SCORE = 0.05
UNKNOWN = "und"

_NOT_WORD = re.compile(r"[\W\d_]+")
_ARROW = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
_OUT = "doc_id long, lang_pred string, score double, rejected boolean"


def words_only(text: str | None) -> bytes:
    """The words of a text in lower case with single spaces; empty if it has no letter."""
    words = _NOT_WORD.sub(" ", (text or "").lower()).strip()
    return words.encode("utf-8", "ignore") if any(map(str.isalpha, words)) else b""  # signs such as ½ are word characters, not letters


def held_out(doc_id: F.Column) -> F.Column:
    """Rows that nothing may be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """Language -> dictionary content, from the rows of ``docs(doc_id, text, lang)`` that may be learned from.

    What reaches the driver is bounded by languages x ``sample_docs`` x ``SAMPLE_BYTES``.
    """
    rows = docs.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (
        rows.select("doc_id", "lang").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= sample_docs)
    )
    few = F.broadcast(chosen.select("doc_id", "lang", "place"))  # sample_docs rows a language
    texts = rows.join(few, ["doc_id", "lang"]).select(
        "lang", "place", F.substring("text", 1, SAMPLE_BYTES).alias("text")
    )
    found: dict[str, list[tuple[int, str]]] = {}
    for row in texts.collect():
        found.setdefault(row["lang"], []).append((row["place"], row["text"]))
    contents = {}
    for lang, sample in sorted(found.items()):
        content = b" ".join(words_only(t) for _, t in sorted(sample))[:DICTIONARY_BYTES]
        if len(content) >= 8:  # the least that a raw dictionary can hold
            contents[lang] = content
    return contents


class Model:
    """The compressors of one task, one for each language."""

    def __init__(self, contents: dict[str, bytes]):
        self.langs = sorted(contents)
        self.coders = []
        for lang in self.langs:
            content = zstandard.ZstdCompressionDict(contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(dict_data=content, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, words: bytes) -> list[int]:
        pieces = [words[i : i + PIECE_BYTES] for i in range(0, len(words), PIECE_BYTES)]
        return [sum(len(coder.compress(p)) for p in pieces) for coder in self.coders]

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_only(text)
        if not words or not self.langs:
            return UNKNOWN, 0.0
        ranked = sorted(zip(self.sizes(words), self.langs, strict=True))
        if len(ranked) == 1:
            return ranked[0][1], 1.0
        margin = 1 - ranked[0][0] / ranked[1][0]
        return ranked[0][1], min(1.0, margin / FULL_MARGIN)


def identify(docs: DataFrame, contents: dict[str, bytes], min_score: float = MIN_SCORE) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``lang_pred``, ``score`` and ``rejected`` (narrow margin or no words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(contents)
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(1)]
            langs, scores = [x[0] for x in found], [x[1] for x in found]
            rejected = [x == UNKNOWN or s < min_score for x, s in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                schema=_ARROW,
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _OUT)
