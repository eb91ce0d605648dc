"""Quality classifier by co-training.

Two views of a document are learned apart: what its text says (words, their beginnings, runs of signs,
how much is repeated or in capitals) and what its page metadata says (source, language, length, layout).
Each view is a logistic model over hashed features, scaled by their log-odds. Over several rounds each view
labels the unlabelled documents it is sure of and hands them to the other view as pseudo-labels. Both
are then calibrated on labelled documents kept apart, and a logistic combination of the two calibrated
views scores every document.

Models are fitted on the driver on a bounded sample, ``N_LABELLED`` labelled documents chosen by a hash of the id, and
on the pseudo-labels. Those come from all unlabelled documents, with or without an id: the hashed features of all documents
are written once, every round scores all of them with the weights of both views, sends id and doubt of the sure ones, leaves
out labelled ones by a join on those narrow rows, and the surest ``HANDED_OVER`` of either kind and view (at most
``4 * HANDED_OVER`` documents a round) hand their features to the driver. Documents with equal features
count once. Scoring is a map over the features, or over all documents and whole texts.

Defined cases: a document is bad if any of its label rows has ``quality`` 0 or ``toxic`` 1, and unlabelled if all
are null; null metadata is a value of its own; a null text is empty; without labels of both kinds every
document is accepted with score 0.5; repeated rows are scored each; a null ``doc_id`` is scored, not learned from.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import reduce
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplework.session import checkpointed, scratch_path

N_LABELLED = 4000
DIMENSIONS = 1 << 18
ROUNDS = 4
HANDED_OVER = 150  # of either kind, each round and view
SURE = 0.98
PSEUDO_WEIGHT = 0.5
SEVERAL = (2, 4)
ROUND_STEPS = 100
LAST_STEPS = 400
ACCEPT_FROM = 0.5
_CACHE = 200_000
_TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]+")
_ASCII_TOKEN = re.compile(r"[a-z]+|[\x00-\x08\x0e-\x1b!-/:-@\[-^`{-\x7f]+")  # what _TOKEN finds in lower-case ASCII, in less time
_CAPITAL = re.compile("[A-ZÀ-ÖØ-ÞΑ-ΩА-Я]")
_ASCII_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_SCORES = "doc_id long, score double, text_score double, page_score double, accepted boolean"
_ARROW_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("text_score", pa.float64()), ("page_score", pa.float64()), ("accepted", pa.bool_())])


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "ignore")) % DIMENSIONS


def _level(x: float) -> int:
    return int(math.log2(x + 1) * 2)


_BEGINNINGS = [(n, zlib.crc32(f"^{n}".encode())) for n in (4, 5, 6, 7)]


class _Words(dict):
    """Token -> slots of its features, as the bytes of 32-bit numbers."""

    def __missing__(self, token: str) -> bytes:
        whole = token.encode("utf-8", "ignore")
        found = {zlib.crc32(whole) % DIMENSIONS}
        if len(token) > 4 and token[0].isalpha():
            plain = token.isascii()
            for n, start in _BEGINNINGS:  # the checksum goes on from that of "^n"
                if len(token) <= n:
                    break
                found.add(zlib.crc32(whole[:n] if plain else token[:n].encode("utf-8", "ignore"), start) % DIMENSIONS)
        if len(self) >= _CACHE:
            self.clear()
        self[token] = slots = array("i", found).tobytes()
        return slots


def _first_of_each(rising: np.ndarray) -> np.ndarray:
    """True where a sorted array has a new number."""
    new = np.empty(rising.size, bool)
    new[:1] = True
    np.not_equal(rising[1:], rising[:-1], out=new[1:])
    return new


def text_features(text: str | None, words: _Words) -> np.ndarray:
    """Slots of the text view of one whole text."""
    text = text or ""
    plain = text.isascii()
    tokens = (_ASCII_TOKEN if plain else _TOKEN).findall(text.lower())
    distinct = set(tokens)
    all_slots = np.frombuffer(b"".join(map(words.__getitem__, distinct)), np.int32).copy()
    all_slots.sort()
    first = np.flatnonzero(_first_of_each(all_slots))
    once, count = all_slots[first], np.diff(first, append=all_slots.size)
    # beginnings that several different words have
    often = [once[count >= k].astype(np.int64) * 40503 + k for k in SEVERAL]
    n = max(1, len(tokens))
    if plain:
        raw = text.encode()
        capitals = len(raw) - len(raw.translate(None, _ASCII_CAPITALS))
    else:
        capitals = len(_CAPITAL.findall(text))
    shape = [
        _slot(f"@capitals {int(10 * capitals / max(1, len(text)))}"),
        _slot(f"@distinct {int(8 * len(distinct) / n)} {min(6, _level(n) // 3)}"),
        _slot(f"@again {int(10 * sum(map(eq, tokens, tokens[1:])) / n)}"),
        _slot(f"@signs {int(10 * (n - sum(map(str.isalpha, tokens))) / n)}"),
    ]
    found = (np.concatenate([once, *often, shape]) % DIMENSIONS).astype(np.int32)
    found.sort()
    return found[_first_of_each(found)]


def page_features(text: str | None, lang: str | None, source: str | None) -> np.ndarray:
    """Slots of the metadata view: where the page is from, its language, size and layout."""
    text = text or ""
    lines = text.count("\n") + 1
    slots = {
        _slot(f"source {source}"), _slot(f"lang {lang}"), _slot(f"size {_level(len(text))}"),
        _slot(f"lines {_level(lines)}"), _slot(f"line size {_level(len(text) / lines)}"),
        _slot(f"lang and size {lang} {_level(len(text)) // 2}"),
    }
    return np.fromiter(sorted(slots), np.int32, len(slots))


_FEATURES = "doc_id long, key long, text_slots binary, page_slots binary"
_ARROW_FEATURES = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("text_slots", pa.binary()), ("page_slots", pa.binary())])
_SURE = "list int, doubt double, key long, doc_id long"
_ARROW_SURE = pa.schema([("list", pa.int32()), ("doubt", pa.float64()), ("key", pa.int64()), ("doc_id", pa.int64())])


def _packed(slots: np.ndarray) -> bytes:
    """Rising slots as their steps, which compress well; a step that is too long for 16 bits is cut in several."""
    steps = slots.copy()
    steps[1:] -= slots[:-1]
    steps[:1] += 1
    if steps.max(initial=0) < 0xFFFF:
        return steps.astype(np.uint16).tobytes()
    whole, rest = np.divmod(steps, 0xFFFF)
    out = np.full(len(steps) + int(whole.sum()), 0xFFFF, np.uint16)
    out[np.cumsum(whole + 1) - 1] = rest
    return out.tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    steps = np.frombuffer(packed, np.uint16)
    return (np.cumsum(steps, dtype=np.int64) - 1)[steps != 0xFFFF].astype(np.int32)


def _dots(packed: pa.Array, weights: np.ndarray) -> np.ndarray:
    """The scaled sums of the weights of packed slots, row by row."""
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
    if not len(packed) or offsets[0] == offsets[-1]:
        return np.zeros(len(packed))
    steps = np.frombuffer(packed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint16)
    ends = (offsets - offsets[0]) // 2
    so_far = np.r_[0, np.cumsum(steps, dtype=np.int64)]
    row = np.repeat(np.arange(len(packed)), np.diff(ends))
    slots = so_far[1:] - so_far[ends[:-1]][row] - 1
    whole = steps != 0xFFFF
    total = np.bincount(row[whole], weights[slots[whole]], len(packed))
    return total / np.sqrt(np.maximum(1, np.bincount(row[whole], minlength=len(packed))))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Id, a hash of the slots of both views, and these slots."""
    words = _Words()
    for batch in batches:
        texts, langs, sources = batch.column(1), batch.column(2), batch.column(3)
        of_text = [_packed(text_features(t.as_py(), words)) for t in texts]
        of_page = [_packed(page_features(t.as_py(), x.as_py(), s.as_py())) for t, x, s in zip(texts, langs, sources, strict=True)]
        keys = np.array([xxhash.xxh3_64_intdigest(p + t) for t, p in zip(of_text, of_page, strict=True)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys), pa.array(of_text, pa.binary()), pa.array(of_page, pa.binary())], schema=_ARROW_FEATURES)


def featured(docs: DataFrame) -> DataFrame:
    """``doc_id, key, text_slots, page_slots`` of every row of ``docs(doc_id, text, lang, source)``, written once."""
    found = docs.select(F.col("doc_id").cast("long"), "text", "lang", "source").mapInArrow(_features, _FEATURES)
    path = scratch_path(docs.sparkSession, "features")
    found.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(found.schema).parquet(path)


class Rows:
    """Sparse rows of slots."""

    def __init__(self, rows: list[np.ndarray], whole: list[int] | None = None):
        self.size = np.array([len(r) for r in rows], np.int64)
        self.slots = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), self.size)
        self.whole = self.size if whole is None else np.array(whole, np.int64)  # slots before some were left out
        self.scale = 1 / np.sqrt(np.maximum(1, self.whole))

    def take(self, at: np.ndarray) -> Rows:
        starts = np.r_[0, np.cumsum(self.size)]
        return Rows([self.slots[starts[i] : starts[i + 1]] for i in at], self.whole[at])

    def list(self) -> list[np.ndarray]:
        return np.split(self.slots, np.cumsum(self.size)[:-1]) if len(self.size) else []

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.slots], len(self.size)) * self.scale


def repeated(rows: list[np.ndarray]) -> list[np.ndarray]:
    """``rows`` without the slots that only one of them has; nothing can be learned from those."""
    count = np.zeros(DIMENSIONS, np.int32)
    for r in rows:
        count[r] += 1  # a row has a slot once
    return [r[count[r] > 1] for r in rows]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_view(rows: Rows, y: np.ndarray, weight: np.ndarray, steps: int, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic model over log-odds-scaled features."""
    of = weight[rows.row]
    good = np.bincount(rows.slots, of * (y[rows.row] == 0), DIMENSIONS) + 0.5
    bad = np.bincount(rows.slots, of * (y[rows.row] == 1), DIMENSIONS) + 0.5
    ratio = np.log(bad / (weight[y == 1].sum() + 1)) - np.log(good / (weight[y == 0].sum() + 1))
    share = np.where(y == 1, 0.5 / max(1e-9, weight[y == 1].sum()), 0.5 / max(1e-9, weight[y == 0].sum())) * weight
    v, b = np.zeros(DIMENSIONS), 0.0
    ahead, ahead_b, t = v, b, 1.0
    rate = 4.0 / max(1.0, float((np.bincount(rows.row, (ratio**2)[rows.slots], len(y)) * rows.scale**2).max(initial=1.0)))
    for _ in range(steps):
        error = share * (_sigmoid(rows.dot(ratio * ahead) + ahead_b) - y)
        slope = ratio * np.bincount(rows.slots, (error * rows.scale)[rows.row], DIMENSIONS) + penalty * ahead
        new, new_b = ahead - rate * slope, ahead_b - rate * error.sum()
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + (t - 1) / after * (new - v), new_b + (t - 1) / after * (new_b - b)
        v, b, t = new, new_b, after
    return ratio * v, b


def calibrate(scores: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Intercept and slopes of a logistic fit of ``y`` on the columns of ``scores``, with a weak prior."""
    x = np.column_stack([np.ones(len(y)), scores])
    beta, prior = np.zeros(x.shape[1]), np.r_[0.0, np.full(x.shape[1] - 1, 1e-2)]
    for _ in range(50):
        p = _sigmoid(x @ beta)
        slope = x.T @ (y - p) - prior * beta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(prior + 1e-9)
        step = np.linalg.solve(hessian, slope)
        beta = beta + step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return beta


class _Given:
    """Unlabelled rows that are at hand."""

    def __init__(self, views: list[Rows]):
        self.views, self.left = views, np.arange(len(views[0].size))

    def surest(self, fitted: list) -> list[tuple[list[list[np.ndarray]], np.ndarray]]:
        """By view: the rows that it is sure of, as slots of every view, and their labels. No row is given twice."""
        chosen = []
        for v, (weights, b, line) in enumerate(fitted):
            p = _sigmoid(line[0] + line[1] * (self.views[v].take(self.left).dot(weights) + b))
            order = np.argsort(-p, kind="stable")
            sure_bad = order[p[order] >= SURE][:HANDED_OVER]
            sure_good = order[::-1][p[order[::-1]] <= 1 - SURE][:HANDED_OVER]
            chosen.append((self.left[np.r_[sure_bad, sure_good]], np.r_[np.ones(len(sure_bad)), np.zeros(len(sure_good))]))
        self.left = np.setdiff1d(self.left, np.concatenate([at for at, _ in chosen]))
        return [([view.take(at).list() for view in self.views], y) for at, y in chosen]


class _Table:
    """The unlabelled rows of a table of features: those whose id is not in ``known(doc_id)``."""

    def __init__(self, features: DataFrame, known: DataFrame):
        self.features, self.known, self.used = features, known, np.zeros(0, np.int64)

    def surest(self, fitted: list) -> list[tuple[list[list[np.ndarray]], np.ndarray]]:
        spark = self.features.sparkSession
        shared = spark.sparkContext.broadcast((fitted, self.used))
        sure = self.features.mapInArrow(lambda batches: _sure_rows(batches, *shared.value), _SURE)
        sure = checkpointed(sure.join(self.known, "doc_id", "left_anti"))
        once = sure.groupBy("list", "key").agg(F.min("doubt").alias("doubt"))
        tops = [once.filter(F.col("list") == n).orderBy("doubt", "key").limit(HANDED_OVER) for n in range(2 * len(fitted))]
        chosen = reduce(DataFrame.unionAll, tops).collect()  # at most HANDED_OVER of each list
        keys = F.broadcast(spark.createDataFrame([(k,) for k in {r["key"] for r in chosen}], "key long"))
        rows = self.features.join(keys, "key").select("key", "text_slots", "page_slots").dropDuplicates(["key"]).collect()
        slots = {r["key"]: (_unpacked(r["text_slots"]), _unpacked(r["page_slots"])) for r in rows}
        shared.destroy()
        self.used = np.union1d(self.used, np.array(list(slots), np.int64))
        out = []
        for v in range(len(fitted)):
            mine = sorted((r["list"], r["doubt"], r["key"]) for r in chosen if r["list"] // 2 == v)
            out.append(([[slots[key][view] for *_, key in mine] for view in (0, 1)], np.array([1.0 - n % 2 for n, *_ in mine])))
        return out


def _sure_rows(batches: Iterator[pa.RecordBatch], fitted: list, used: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows that each view is sure of: list 2 v of bad ones, 2 v + 1 of good ones."""
    for batch in batches:
        key = batch.column(1).to_numpy()
        fresh = ~np.isin(key, used)
        for v, (weights, b, line) in enumerate(fitted):
            p = _sigmoid(line[0] + line[1] * (_dots(batch.column(2 + v), weights) + b))
            for n, doubt in ((2 * v, 1 - p), (2 * v + 1, p)):
                at = np.flatnonzero(fresh & (doubt <= 1 - SURE))
                ids = batch.column(0).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n, np.int32)), pa.array(doubt[at]), pa.array(key[at]), ids], schema=_ARROW_SURE)


def co_train(views: list[Rows], bad: np.ndarray, rounds: int = ROUNDS, pool: _Given | _Table | None = None) -> dict | None:
    """Model of two views of the same rows; ``bad`` is 1, 0, or -1 for unlabelled. None without both kinds.

    Pseudo-labels come from ``pool``, or from the unlabelled rows.
    """
    known = np.flatnonzero(bad >= 0)
    apart = known[np.arange(len(known)) % 4 == 3]
    given = known[np.arange(len(known)) % 4 != 3]
    if any(len(set(bad[x].tolist())) < 2 for x in (apart, given)):
        return None
    if pool is None:
        pool = _Given([view.take(np.flatnonzero(bad < 0)) for view in views])
    held_apart = [view.take(apart) for view in views]
    taught = [(view.take(given).list(), bad[given].astype(float), np.ones(len(given))) for view in views]

    def learn(v: int, steps: int = ROUND_STEPS):
        rows, y, weight = taught[v]
        weights, b = fit_view(Rows(repeated(rows), [len(r) for r in rows]), y, weight, steps)
        return weights, b, calibrate(held_apart[v].dot(weights) + b, bad[apart])

    for _ in range(rounds):
        handed = pool.surest([learn(v) for v in range(len(views))])
        for v in range(len(views)):
            rows, y = handed[1 - v]
            had = taught[v]
            taught[v] = ([*had[0], *rows[v]], np.r_[had[1], y], np.r_[had[2], np.full(len(y), PSEUDO_WEIGHT)])
        if not any(len(y) for _, y in handed):
            break
    fitted = [learn(v, LAST_STEPS) for v in range(len(views))]
    logits = [line[0] + line[1] * (held_apart[v].dot(w) + b) for v, (w, b, line) in enumerate(fitted)]
    return {"views": fitted, "mix": calibrate(np.column_stack(logits), bad[apart])}


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, bad`` for the labelled documents."""
    one = labels.filter(F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull()))
    worst = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0))
    one = one.groupBy("doc_id").agg(worst.alias("bad"))
    return docs.select("doc_id").join(one, "doc_id", "left").select("doc_id", F.coalesce("bad", F.lit(-1)).alias("bad"))


def learn(docs: DataFrame, labels: DataFrame, n_labelled: int = N_LABELLED, features: DataFrame | None = None) -> dict | None:
    """The model, from a bounded sample of the labelled and from all unlabelled ``docs(doc_id, text, lang, source)``.

    ``labels`` has ``doc_id, quality, toxic``; rows that share a labelled id give one row to the sample. ``features`` may
    hold ``featured(docs)`` if it is there already.
    """
    spark = docs.sparkSession
    features = featured(docs) if features is None else features
    marked = checkpointed(labelled(features.filter(F.col("doc_id").isNotNull()), labels).distinct().filter("bad >= 0"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_labelled).collect()
    if not chosen:
        return None
    sample = F.broadcast(spark.createDataFrame(chosen, "doc_id long, bad int"))  # at most n_labelled rows
    one = F.min(F.struct("key", "text_slots", "page_slots"))
    rows = features.join(sample, "doc_id").groupBy("doc_id", "bad").agg(one.alias("one")).select("bad", "one.*").collect()
    rows.sort(key=lambda r: (r["key"], r["bad"]))  # whatever the partitions
    bad = np.array([r["bad"] for r in rows], np.int32)
    views = [Rows([_unpacked(r[f"{name}_slots"]) for r in rows]) for name in ("text", "page")]
    del rows
    return co_train(views, bad, pool=_Table(features, marked.select("doc_id")))


class _Scorer:
    """The model inside a task; made from the broadcast weights, which are DIMENSIONS numbers a view whatever the corpus."""

    def __init__(self, shared):
        self.model = shared.value
        self.words = _Words()

    def good(self, texts: pa.Array, langs: pa.Array, sources: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Chances of being good: combined, and by view."""
        n = len(texts)
        if self.model is None:
            return np.full(n, 0.5), np.full((n, 2), 0.5)
        logits = np.zeros((n, 2))
        for i, (text, lang, source) in enumerate(zip(texts, langs, sources, strict=True)):
            whole = text.as_py()
            of_views = text_features(whole, self.words), page_features(whole, lang.as_py(), source.as_py())
            for v, slots in enumerate(of_views):
                weights, b, line = self.model["views"][v]
                logits[i, v] = line[0] + line[1] * (float(weights[slots].sum()) / math.sqrt(max(1, len(slots))) + b)
        mix = self.model["mix"]
        return 1 - _sigmoid(mix[0] + logits @ mix[1:]), 1 - _sigmoid(logits)


def _share(docs: DataFrame, model: dict | None):
    if model is not None:
        model = model | {"views": [(w.astype(np.float32), b, line) for w, b, line in model["views"]]}
    return docs.sparkSession.sparkContext.broadcast(model)


def score(docs: DataFrame, model: dict | None, accept_from: float = ACCEPT_FROM) -> DataFrame:
    """``doc_id, score, text_score, page_score, accepted``; scores are chances of being good."""
    shared = _share(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared)
        for batch in batches:
            good, views = scorer.good(*(batch.column(c) for c in (1, 2, 3)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (good, views[:, 0], views[:, 1], good >= accept_from))], schema=_ARROW_SCORES)

    return docs.select(F.col("doc_id").cast("long"), "text", "lang", "source").mapInArrow(run, _SCORES)


def score_features(features: DataFrame, model: dict | None, accept_from: float = ACCEPT_FROM) -> DataFrame:
    """The same as ``score`` from the rows of ``featured``, without reading a text."""
    shared = _share(features, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            n = len(batch)
            good, views = np.full(n, 0.5), np.full((n, 2), 0.5)
            if model is not None:
                fitted = enumerate(model["views"])
                logits = np.stack([line[0] + line[1] * (_dots(batch.column(2 + v), w) + b) for v, (w, b, line) in fitted], axis=1)
                good, views = 1 - _sigmoid(model["mix"][0] + logits @ model["mix"][1:]), 1 - _sigmoid(logits)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (good, views[:, 0], views[:, 1], good >= accept_from))], schema=_ARROW_SCORES)

    return features.select("doc_id", "key", "text_slots", "page_slots").mapInArrow(run, _SCORES)


def accepted(docs: DataFrame, model: dict | None, accept_from: float = ACCEPT_FROM) -> DataFrame:
    """The rows of ``docs`` that the model accepts, with all their columns."""
    shared = _share(docs, model)
    at = [docs.columns.index(c) for c in ("text", "lang", "source")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared)
        for batch in batches:
            good, _ = scorer.good(*(batch.column(c) for c in at))
            yield batch.filter(pa.array(good >= accept_from))

    return docs.mapInArrow(run, docs.schema)
