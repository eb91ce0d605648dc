"""Byte-pair encoding through a minimal automaton of frequent words, and decoding.

Words (pre-tokens) are counted over all texts. The most frequent ones, ``LEXICON_WORDS`` at most, become a minimal
acyclic automaton over their bytes: equal suffixes share states, and the numbers on a word's path add up to its
place in a table of ids. Automaton, table, merges and token bytes are one file, which Spark copies to every
executor and whose pages the Python workers of a machine share by mapping it. A task looks up the
different words of a block side by side; words that the automaton doesn't know are merged pair by pair, exactly.
The lexicon decides how fast a text is encoded and never what its ids are.

Splitting and merging follow the tokenizer file: strings of added tokens are cut out first, then words by the byte-level
pattern, with letters and numbers as the tokenizer's library knows them (Unicode versions differ). Only the driver reads the file.

Defined cases: a null text is an empty one and has no ids; null and repeated ids of documents stay as they are; an empty
table gives an empty result; texts of any length are encoded whole, in stretches of words.
"""

from __future__ import annotations

import json
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from heapq import heapify, heappop, heappush
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ripplework.session import checkpointed

LEXICON_WORDS = 65_536
LEXICON_BYTES = 64
BLOCK_WORDS = 250_000
BATCH_BYTES = 8_000_000
LONG_TEXT = 1_000_000
COUNTED_WORDS = 250_000
#: classes of counts a factor of two, for choosing the most frequent words without ordering all
COUNT_CLASSES = 16
SHORT_WORD = 48
#: fixed values: the pre-token pattern of byte-level vocabularies
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NO_RANK = 2**31 - 1
_STAND_IN = "\ue000"  # neither letter, number nor space


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be seen, else the next free one from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in seen]
    return [chr(b) if b in seen else chr(256 + hidden.index(b)) for b in range(256)]


def other_letters(tokenizer: Tokenizer) -> list[int]:
    """Code points that ``regex`` has as letters or numbers and the tokenizer's library has not."""
    doubtful = []
    for start in range(0, 0x110000, 0x10000):
        block = "".join(map(chr, range(start, start + 0x10000))) if start else "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
        doubtful += [c for c in regex.findall(r"[\p{L}\p{N}]", block) if unicodedata.category(c)[0] not in "LN"]
    split = tokenizer.pre_tokenizer.pre_tokenize_str
    return [ord(c) for c in doubtful if len(split(f"a{c}a")) > 1 and len(split(f"1{c}1")) > 1]


def _ranges(codes: Sequence[int]) -> list[tuple[int, int]]:
    """Ascending numbers as runs (first, last)."""
    codes = np.asarray(codes)
    cuts = np.flatnonzero(np.diff(codes) != 1) + 1
    return [(int(run[0]), int(run[-1])) for run in np.split(codes, cuts)]


class Merges:
    """A vocabulary's merges: words to ids, exactly."""

    def __init__(self, byte_ids: Sequence[int], pairs: dict[tuple[int, int], tuple[int, int]]):
        self.byte_ids, self.pairs = byte_ids, pairs

    def ids(self, word: bytes) -> list[int]:
        """Merge the pair of the lowest rank, the first of them, until no pair is left."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > SHORT_WORD:
            return self._long(ids)
        pairs = self.pairs
        while len(ids) > 1:
            best, at = None, 0
            for i in range(len(ids) - 1):
                found = pairs.get((ids[i], ids[i + 1]))
                if found is not None and (best is None or found < best):
                    best, at = found, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs and links between neighbours."""
        n, pairs = len(ids), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], i, ids[i], ids[i + 1], found[1]) for i in range(n - 1) if (found := pairs.get((ids[i], ids[i + 1])))]
        heapify(heap)
        while heap:
            _, i, left, right, made = heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of the two was merged meanwhile
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if found := pairs.get((made, ids[after[i]])):
                    heappush(heap, (found[0], i, made, ids[after[i]], found[1]))
            if before[i] >= 0 and (found := pairs.get((ids[before[i]], made))):
                heappush(heap, (found[0], before[i], ids[before[i]], made, found[1]))
        return [x for x in ids if x >= 0]


class Vocabulary:
    """What a byte-level tokenizer file says."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        letters = byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        ids = said["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in said["model"]["merges"]]
        self.byte_ids = [ids[c] for c in letters]
        self.pairs = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.tokens = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = bytes(of_letter[c] for c in token) if all(c in of_letter for c in token) else token.encode()
        self.others = other_letters(Tokenizer.from_file(path))
        self.merges = Merges(self.byte_ids, self.pairs)


def _is_latin(text: str) -> bool:
    """Whether all code points are below 256, where all Unicode versions agree."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Splitter:
    """Whole texts to words; strings of added tokens are words of their own."""

    def __init__(self, special: Sequence[str], others: Sequence[int]):
        self.find = regex.compile(PATTERN)
        self.special = frozenset(special)
        longest = sorted(special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if special else None
        self.other = regex.compile("[" + "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in _ranges(others)) + "]") if others else None

    def _plain(self, text: str) -> list[str] | Iterator[str]:
        if self.other is not None and not _is_latin(text) and self.other.search(text):
            spans = (m.span() for m in self.find.finditer(self.other.sub(_STAND_IN, text)))
            return (text[a:b] for a, b in spans)
        return self.find.findall(text) if len(text) < LONG_TEXT else (m[0] for m in self.find.finditer(text))

    def words(self, text: str) -> list[str] | Iterator[str]:
        """The words of a text; one after another if it is long."""
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        return (w for part in self.cut.split(text) if part for w in ([part] if part in self.special else self._plain(part)))


class _State:
    __slots__ = ("arcs", "final", "n")

    def __init__(self):
        self.arcs: dict[int, _State] = {}
        self.final = False
        self.n = 0


def minimal_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """The smallest acyclic automaton of sorted different ``words``.

    ``arcs`` holds ``state << 8 | byte`` in ascending order, ``to`` where it leads, ``skip`` how many words of the state
    come before those of the arc, and ``final`` whether a word ends in a state. State 0 is the start.
    """
    root, known, path = _State(), {}, []

    def settle(down_to: int) -> None:
        """Replace the states below a depth of the last word by equal ones that are known."""
        while len(path) > down_to:
            parent, byte, state = path.pop()
            state.n = state.final + sum(t.n for t in state.arcs.values())
            key = (state.final, *((b, id(t)) for b, t in state.arcs.items()))
            parent.arcs[byte] = known.setdefault(key, state)

    last = b""
    for word in words:
        same = next((i for i, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
        settle(same)
        state = path[-1][2] if path else root
        for byte in word[same:]:
            path.append((state, byte, child := _State()))
            state.arcs[byte] = child
            state = child
        state.final = True
        last = word
    settle(0)
    numbers, todo, arcs, to, skip, final = {id(root): 0}, [root], [], [], [], []
    for state in todo:  # grows while it is read
        final.append(state.final)
        before = int(state.final)
        for byte, target in sorted(state.arcs.items()):
            if id(target) not in numbers:
                numbers[id(target)] = len(todo)
                todo.append(target)
            arcs.append(numbers[id(state)] << 8 | byte)
            to.append(numbers[id(target)])
            skip.append(before)
            before += target.n
    return {
        "arcs": np.array(arcs, np.int64), "to": np.array(to, np.int32), "skip": np.array(skip, np.int32), "final": np.array(final, np.bool_)
    }


def _ragged(parts: Sequence, kind) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and the elements of all parts one after another."""
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = b"".join(parts) if kind == np.uint8 else [x for p in parts for x in p]
    return offsets, np.frombuffer(flat, np.uint8) if kind == np.uint8 else np.array(flat, kind)


def compile_lexicon(words: Sequence[str], vocabulary: Vocabulary, path: str) -> None:
    """Write the automaton of ``words`` with their ids, and all that encoding and decoding need, to one file."""
    plain = sorted({w.encode() for w in words if w and w not in vocabulary.special})
    image = minimal_automaton(plain)
    image["id_offsets"], image["ids"] = _ragged([vocabulary.merges.ids(w) for w in plain], np.uint32)
    image["token_offsets"], image["token_bytes"] = _ragged(vocabulary.tokens, np.uint8)
    image["byte_ids"] = np.array(vocabulary.byte_ids, np.uint32)
    pairs = np.array(sorted((a << 32 | b, rank, made) for (a, b), (rank, made) in vocabulary.pairs.items()), np.int64).reshape(-1, 3)
    image["pair_keys"], image["pair_ranks"] = np.ascontiguousarray(pairs[:, 0]), pairs[:, 1].astype(np.int32)
    image["made"] = pairs[np.argsort(pairs[:, 1]), 2].astype(np.uint32)  # by rank
    head = {"special": vocabulary.special, "others": vocabulary.others, "longest": max(map(len, plain), default=0), "arrays": {}}
    at = 0
    for name, array in image.items():
        head["arrays"][name] = (array.dtype.str, array.shape, at)
        at += -(-array.nbytes // 64) * 64
    text = json.dumps(head).encode()
    with open(path, "wb") as out:
        out.write(len(text).to_bytes(8, "little") + text)
        start = -(-(8 + len(text)) // 64) * 64
        for name, array in image.items():
            out.seek(start + head["arrays"][name][2])
            out.write(np.ascontiguousarray(array).tobytes())
        out.truncate(start + at)


class Lexicon:
    """A mapped lexicon file."""

    def __init__(self, path: str):
        mapped = np.memmap(path, np.uint8, "r")
        size = int.from_bytes(mapped[:8].tobytes(), "little")
        head = json.loads(mapped[8 : 8 + size].tobytes())
        start = -(-(8 + size) // 64) * 64
        self.arrays = {}
        for name, (kind, shape, at) in head["arrays"].items():
            n = int(np.prod(shape)) * np.dtype(kind).itemsize
            self.arrays[name] = mapped[start + at : start + at + n].view(kind).reshape(shape)
        self.special, self.longest = head["special"], head["longest"]
        self.special_bytes = {s.encode(): i for s, i in self.special.items()}
        self.splitter = Splitter(list(self.special), head["others"])
        self.token_offsets, self.token_bytes = self.arrays["token_offsets"], self.arrays["token_bytes"]
        self._merges: Merges | None = None

    def _one(self, word: bytes) -> list[int]:
        if self._merges is None:
            keys, ranks, made = (self.arrays[x].tolist() for x in ("pair_keys", "pair_ranks", "made"))
            pairs = {(k >> 32, k & 0xFFFFFFFF): (r, made[r]) for k, r in zip(keys, ranks, strict=True)}
            self._merges = Merges(self.arrays["byte_ids"].tolist(), pairs)
        return self._merges.ids(word)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = self.arrays["pair_keys"]
        if not len(keys):
            return np.full(len(left), _NO_RANK)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, self.arrays["pair_ranks"][at], _NO_RANK)

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of words by merges alone: in each step every word merges its pair of the lowest rank, the first of them."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.arrays["byte_ids"][np.frombuffer(b"".join(words), np.uint8)].astype(np.int64)
        word = np.repeat(np.arange(len(words)), size)
        inner = np.r_[word[1:] == word[:-1], [False] * min(1, len(word))]  # a symbol with another one of its word after it
        rank = np.full(len(ids), _NO_RANK)
        pair = np.flatnonzero(inner)
        rank[pair] = self._ranks(ids[pair], ids[pair + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            length = np.diff(np.r_[first, len(ids)])
            least = np.minimum.reduceat(rank, first)
            going = np.repeat(least < _NO_RANK, length)
            if not going.all():
                done.append((word[~going], ids[~going]))
                ids, word, inner, rank, least, length = ids[going], word[going], inner[going], rank[going], least[least < _NO_RANK], length[least < _NO_RANK]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(least, length))
            at = at[np.r_[True, word[at[1:]] != word[at[:-1]]]]
            ids[at] = self.arrays["made"][rank[at]]
            inner[at] = inner[at + 1]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # one symbol goes before each of the later ones
            ids, word, inner, rank = ids[keep], word[keep], inner[keep], rank[keep]
            rank[at] = _NO_RANK
            before = at[at > 0] - 1
            again = np.r_[at, before]
            again = again[inner[again]]
            rank[again] = self._ranks(ids[again], ids[again + 1])
        if not done:
            return np.zeros(len(words) + 1, np.int64), np.zeros(0, np.uint32)
        word, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        by = np.argsort(word, kind="stable")
        return np.r_[0, np.cumsum(np.bincount(word, minlength=len(words)))], ids[by].astype(np.uint32)

    def _unseen(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of words that the automaton doesn't know; few of them are long or added tokens."""
        odd = [n for n, w in enumerate(words) if len(w) > LEXICON_BYTES or w in self.special_bytes]
        if not odd:
            return self.merged(words)
        alone = {n: [self.special_bytes[words[n]]] if words[n] in self.special_bytes else self._one(words[n]) for n in odd}
        offsets, ids = self.merged([b"" if n in alone else w for n, w in enumerate(words)])
        size = np.diff(offsets)
        size[odd] = [len(alone[n]) for n in odd]
        where = np.repeat(np.arange(len(words)), size)
        out = np.zeros(len(where), np.uint32)
        is_odd = np.isin(where, odd)
        out[~is_odd] = ids
        out[is_odd] = [x for n in odd for x in alone[n]]
        return np.r_[0, np.cumsum(size)], out

    def places(self, words: list[bytes]) -> np.ndarray:
        """Each word's place in the table of ids, -1 if it is unknown."""
        arcs, to, skip = self.arrays["arcs"], self.arrays["to"], self.arrays["skip"]
        size = np.fromiter(map(len, words), np.int64, len(words))
        state, place = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        offsets = np.r_[0, np.cumsum(size)[:-1]] if len(words) else size
        flat = np.frombuffer(b"".join(words), np.uint8)
        alive = np.flatnonzero((size > 0) & (size <= self.longest))
        place[(size == 0) | (size > self.longest)] = -1
        at = 0
        while len(alive):
            key = state[alive] << 8 | flat[offsets[alive] + at]
            arc = np.minimum(np.searchsorted(arcs, key), len(arcs) - 1)
            found = arcs[arc] == key
            place[alive[~found]] = -1
            alive, arc = alive[found], arc[found]
            place[alive] += skip[arc]
            state[alive] = to[arc]
            at += 1
            ended = size[alive] == at
            done = alive[ended]
            place[done[~self.arrays["final"][state[done]]]] = -1
            alive = alive[~ended]
        return place

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``ends, ids``: the ids of all words one after another, and where each word's ids end."""
        number = {w: n for n, w in enumerate(dict.fromkeys(words))}
        different, codes = [w.encode() for w in number], np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        place = self.places(different)
        unseen = np.flatnonzero(place < 0)
        own_offsets, own = self._unseen([different[i] for i in unseen.tolist()])
        id_offsets = self.arrays["id_offsets"]
        known = np.where(place < 0, 0, place)
        first = np.where(place < 0, 0, id_offsets[known])
        size = np.where(place < 0, 0, id_offsets[np.minimum(known + 1, len(id_offsets) - 1)] - first)
        first[unseen], size[unseen] = own_offsets[:-1] + len(self.arrays["ids"]), np.diff(own_offsets)
        size = size[codes]
        ends = np.cumsum(size)
        pool = np.concatenate([self.arrays["ids"], own])
        return ends, pool[np.repeat(first[codes] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]

    def encode_texts(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The little-endian ids of every text, in order."""
        held: list[str] = []
        parts: list[tuple[int, bool]] = []  # words of a text in the block, and whether it ends there
        began: list[bytes] = []

        def flush() -> Iterator[bytes]:
            ends, ids = self.encode(held)
            ends = np.r_[0, ends].astype(np.int64)
            raw, word = ids.astype("<u4"), 0
            for n, last in parts:
                began.append(raw[ends[word] : ends[word + n]].tobytes())
                word += n
                if last:
                    yield b"".join(began)
                    began.clear()
            held.clear()
            parts.clear()

        for text in texts:
            words = self.splitter.words(text or "")
            if isinstance(words, list):
                held += words
                parts.append((len(words), True))
                if len(held) >= BLOCK_WORDS:
                    yield from flush()
                continue
            while True:
                size = BLOCK_WORDS - len(held)
                some = list(islice(words, size))
                held += some
                parts.append((len(some), len(some) < size))
                if len(held) >= BLOCK_WORDS:
                    yield from flush()
                if len(some) < size:
                    break
        yield from flush()

    def decode(self, ids: bytes) -> str:
        """The text of little-endian ids; bytes that are no UTF-8 become replacement characters."""
        at = np.frombuffer(ids, "<u4").astype(np.int64)
        first = self.token_offsets[at]
        size = self.token_offsets[at + 1] - first
        ends = np.cumsum(size)
        flat = np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        return self.token_bytes[flat].tobytes().decode("utf-8", "replace")


_OPENED: dict[str, Lexicon] = {}


def _opened(name: str) -> Lexicon:
    """The lexicon file that Spark brought to this machine, mapped once a worker."""
    if name not in _OPENED:
        _OPENED.clear()
        _OPENED[name] = Lexicon(SparkFiles.get(name))
    return _OPENED[name]


def _stretches(values: Iterable) -> Iterator[tuple[int, list]]:
    """Values in lists of about ``BATCH_BYTES``, each with the number of those before it."""
    first, held, size = 0, [], 0
    for value in values:
        held.append(value)
        size += len(value)
        if size >= BATCH_BYTES:
            yield first, held
            first, held, size = first + len(held), [], 0
    yield first, held


def word_counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``word, n`` over all texts of ``docs(text)``."""
    special, others = list(vocabulary.special), vocabulary.others

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, counts = Splitter(special, others), Counter()

        def emit() -> pa.RecordBatch:
            words = [w for w in counts if len(w) <= LEXICON_BYTES]
            made = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[w] for w in words], pa.int64())], ["word", "n"])
            counts.clear()
            return made

        for batch in batches:
            for text in batch.column(0):
                words = splitter.words(text.as_py() or "")
                counts.update(words if isinstance(words, list) else (w for w in words if len(w) <= LEXICON_BYTES))
                if len(counts) > COUNTED_WORDS:
                    yield emit()
        yield emit()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, words: int) -> DataFrame:
    """The words of ``counts(word, n)`` in the highest classes of ``n`` that hold at most ``words`` together."""
    step = F.floor(F.log2("n") * COUNT_CLASSES)
    classes = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()  # 64 * COUNT_CLASSES rows at most
    lowest, total = None, 0
    for row in sorted(classes, key=lambda r: -r["step"]):
        total += row["words"]
        if total > words:
            break
        lowest = row["step"]
    return counts.filter(F.lit(False) if lowest is None else step >= lowest)


def build_lexicon(docs: DataFrame, tokenizer_path: str, words: int = LEXICON_WORDS) -> str:
    """Compile the ``words`` most frequent words of ``docs`` and give every executor the file; its name."""
    spark: SparkSession = docs.sparkSession
    vocabulary = Vocabulary(tokenizer_path)
    counts = checkpointed(word_counts(docs, vocabulary).filter((F.col("n") > 1) & (F.octet_length("word") <= LEXICON_BYTES)))
    frequent = [r["word"] for r in most_frequent(counts, words).select("word").collect()]  # at most ``words`` strings of ``LEXICON_BYTES``
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = Path(tempfile.mkdtemp(prefix="ripplework-lexicon-")) / name
    compile_lexicon(frequent, vocabulary, str(path))
    spark.sparkContext.addFile(str(path))
    return name


def encode(docs: DataFrame, lexicon: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every row of ``docs(doc_id, text)``; ``ids`` are little-endian 32-bit numbers."""
    kind = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _opened(lexicon)
        for batch in batches:
            for first, ids in _stretches(known.encode_texts(x.as_py() for x in batch.column(1))):
                size = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(ids)), size, pa.array(ids, pa.binary())], schema=kind)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, lexicon: str) -> DataFrame:
    """``encoded(doc_id, n_tokens, ids)`` with ``decoded``, the text of its ids."""
    kind = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _opened(lexicon)
        for batch in batches:
            for first, texts in _stretches(known.decode(x.as_py() or b"") for x in batch.column(2)):
                yield pa.RecordBatch.from_arrays([*batch.slice(first, len(texts)).columns, pa.array(texts, pa.string())], schema=kind)

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
