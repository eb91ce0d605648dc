"""Packing, mixing, the classifier, the pipeline and the SQL of the queries."""

import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from compare import TABLES, rows_of
from ripplework import llm
from ripplework.llm import classifier as cl
from ripplework.llm import mixing as mx
from ripplework.llm import packing as pk
from ripplework.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="needs the given tables")


@needs_tables
@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = rows_of(llm.QUERIES[name](spark, SF).toPandas())
    want = rows_of(con.execute(llm.SQL[name]).df())
    assert got[0] == want[0] and [list(map(str, r)) for r in got[1]] == [list(map(str, r)) for r in want[1]]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_tokenizer(tokenizer, corpus):
    rng = random.Random(1)
    parts = ["a", "b", "Th", " ", "  ", " \n", "\n", "\t", "é", "'s", "'ll", "12", "!", "…", "\xa0", "　", "<|endoftext|>", "x", "ß ", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + [r[1] or "" for r in corpus]
    encoder = pk.Encoder(*vocabulary())
    for text in texts:
        assert encoder.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def check_packing(rows, capacity):
    at = defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in at.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at)


def test_pieces_and_sequences(spark, docs, corpus, no_docs, tokenizer):
    rows = pk.pack_documents(docs, vocabulary(), 256).collect()
    n = check_packing(rows, 256)
    counts = Counter(r["length"] for r in rows)
    assert n <= pk.lower_bound(counts, 256) + 1
    want = Counter()
    for doc_id, text, *_ in corpus:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 256 or 256, len(ids) + 1, 256)] if len(ids) > 256 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert pk.pack_documents(no_docs, vocabulary()).count() == 0


def best_by_search(lengths, capacity):
    """Fewest sequences, by trying everything."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i] and rooms[k] not in rooms[:k]:
                place(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best


def sequences(rows):
    used = defaultdict(list)
    for size, lo, hi, first, each, offset in rows:
        for k in range(lo, hi):
            used[first + (k - lo) // each].append((offset + (k - lo) % each * size, size))
    for pieces in used.values():
        end = 0
        for offset, size in sorted(pieces):
            assert offset == end
            end += size
    return used


def test_plan_places_all_and_comes_near_the_best():
    rng = random.Random(2)
    lost = 0
    for _ in range(250):
        capacity = rng.choice([10, 17, 30])
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(0, 9))), reverse=True)
        used = sequences(pk.plan(Counter(lengths), capacity))
        assert Counter(s for v in used.values() for _, s in v) == Counter(lengths)
        assert all(sum(s for _, s in v) <= capacity for v in used.values())
        best = best_by_search(lengths, capacity)
        assert pk.lower_bound(Counter(lengths), capacity) <= best <= len(used)
        lost += len(used) - best
    assert lost <= 3


def test_reduction_never_costs_a_sequence():
    rng = random.Random(6)
    for _ in range(250):
        capacity = rng.choice([12, 20])
        lengths = sorted((rng.randint(2, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        p = pk._Plan(Counter(lengths), capacity)
        p.reduce()
        left = sorted(Counter(p.left).elements(), reverse=True)
        assert p.sequences + best_by_search(left, capacity) == best_by_search(lengths, capacity)


def test_lengths_beyond_the_capacity_are_refused():
    with pytest.raises(ValueError):
        pk.plan({11: 1}, 10)


def test_raking_meets_the_targets(spark):
    rng = random.Random(3)
    cells = spark.createDataFrame(
        [(s, x, t, float(rng.randint(1, 1000))) for s in "abcd" for x in ("en", "fr") for t in "pqr"] + [("e", "en", "p", 0.0)],
        "source string, lang string, topic string, tokens double",
    )
    shares = {"source": {"a": 1.0, "b": 2.0, "c": 3.0, "d": 2.0, "unseen": 9.0}, "lang": {"en": 3.0, "fr": 1.0}, "topic": {"p": 1.0, "q": 1.0, "r": 1.0}}
    targets = {k: spark.createDataFrame(list(v.items()), "value string, share double") for k, v in shares.items()}
    keep = 0.02  # so little that every cell has enough
    raked = mx.rake(cells, targets, 30, keep)
    total = keep * cells.agg(F.sum("tokens")).first()[0]
    for name, wanted in shares.items():
        got = {r[name]: r["w"] for r in raked.groupBy(name).agg(F.sum("weight").alias("w")).collect()}
        whole = sum(v for k, v in wanted.items() if k != "unseen")
        for value, share in wanted.items():
            if value != "unseen":
                assert got[value] == pytest.approx(total * share / whole, rel=1e-6)
    p = {(r["source"], r["lang"], r["topic"]): r["probability"] for r in mx.probabilities(raked, keep=keep).collect()}
    assert all(0 <= x <= 1 for x in p.values()) and p["e", "en", "p"] == keep
    dropped = targets | {"lang": spark.createDataFrame([("en", 1.0)], "value string, share double")}
    assert {r["weight"] for r in mx.rake(cells, dropped, 2).filter("lang = 'fr'").collect()} == {0.0}


def test_raking_gives_no_cell_more_than_it_has(spark):
    rng = random.Random(9)
    cells = spark.createDataFrame(
        [(s, x, t, float(rng.choice([5, 50, 500]))) for s in "abcd" for x in ("en", "fr") for t in "pqr"], "source string, lang string, topic string, tokens double"
    )
    targets = {k: mx.tempered(cells, k, 0.5) for k in mx.DIMENSIONS}
    raked = mx.rake(cells, targets, 40, 0.7)
    rows = raked.collect()
    assert all(r["weight"] <= r["tokens"] for r in rows)
    assert sum(r["weight"] for r in rows) == pytest.approx(0.7 * sum(r["tokens"] for r in rows), rel=0.05)


def test_mix_of_odd_rows(docs, corpus, no_docs):
    rows = mx.described(docs)
    found = mx.sample(rows, mx.plan_mix(rows)).collect()
    assert len(found) == len(corpus)
    assert Counter(r["doc_id"] for r in found if r["sampled"]) == Counter(r["doc_id"] for r in mx.mixed(docs).collect())
    assert mx.mixed(docs).columns == docs.columns
    assert mx.mixed(no_docs).count() == 0
    plan = mx.sample(rows, mx.plan_mix(rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_rows_without_an_id_are_drawn_one_by_one(spark):
    words = "concat_ws(' ', transform(sequence(1, 20), i -> concat('w', id * i)))"
    docs = spark.range(2000).selectExpr(
        "if(id % 2 = 0, null, id) as doc_id", f"{words} as text", "'en' as lang", "'s' as source", "'clash' as text_md5"
    )
    kept = mx.mixed(docs).collect()
    none = sum(r["doc_id"] is None for r in kept)
    assert 540 < none < 660 and 540 < len(kept) - none < 660
    twice = docs.filter("doc_id is null").limit(300)
    copies = Counter(r["text"] for r in mx.mixed(twice.unionAll(twice)).collect())
    assert set(copies.values()) == {2} and 140 < len(copies) < 220


def test_expected_tokens_follow_the_tempered_shares(spark):
    rows = spark.range(4000).selectExpr(
        "id as doc_id", "if(id % 10 < 6, 'big', concat('s', id % 10)) as source", "if(id % 7 < 4, 'en', 'fr') as lang", "'prose' as topic", "id % 50 as tokens"
    )
    found = mx.sample(rows, mx.plan_mix(rows))
    full, drawn = ({r["source"]: r["n"] for r in found.groupBy("source").agg(F.sum(c).alias("n")).collect()} for c in ("tokens", F.expr("tokens * probability")))
    raised = {k: v ** mx.TEMPERATURES["source"] for k, v in full.items()}
    for k in full:
        assert drawn[k] / sum(drawn.values()) == pytest.approx(raised[k] / sum(raised.values()), rel=1e-4)
    n = found.filter("sampled").count()
    assert n == pytest.approx(found.agg(F.sum("probability")).first()[0], rel=0.1)


@needs_tables
def test_classifier_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    if not Path(folder).exists():
        pytest.skip("needs the given tables")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    learned = labels.filter(F.xxhash64("doc_id") % 5 != 0)
    scored = cl.score(docs, cl.learn(docs, learned)).join(labels.filter(F.xxhash64("doc_id") % 5 == 0), "doc_id").collect()
    clean = [r["accepted"] for r in scored if r["quality"] == 1 and r["toxic"] == 0]
    junk = [r["accepted"] for r in scored if r["quality"] == 0]
    toxic = [r["accepted"] for r in scored if r["toxic"] == 1]
    assert sum(clean) / len(clean) > 0.99 and sum(junk) / len(junk) < 0.15 and sum(toxic) / len(toxic) < 0.1


def test_views_teach_each_other():
    """A view that labels little learns from the sure labels of the other."""
    rng = np.random.default_rng(4)
    n = 1200
    truth = rng.integers(0, 2, n)
    text = [np.unique(np.r_[rng.integers(0, 400, 12), 1000 + y]).astype(np.int32) for y in truth]
    page = [np.unique(np.r_[rng.integers(2000, 2020, 2), 3000 + (y if rng.random() < 0.95 else 1 - y) * 40 + rng.integers(0, 40)]).astype(np.int32) for y in truth]
    bad = np.where(np.arange(n) < 160, truth, -1)
    model = cl.co_train([cl.Rows(text), cl.Rows(page)], bad)
    alone = cl.co_train([cl.Rows(text), cl.Rows(page)], bad, rounds=0)

    def right(m, v):
        weights, b, line = m["views"][v]
        s = line[0] + line[1] * (cl.Rows([text, page][v]).dot(weights) + b)
        return ((s > 0) == truth)[160:].mean()

    assert right(model, 1) > right(alone, 1) and right(model, 0) > 0.95


def test_slots_survive_packing():
    for slots in ([], [0], [5, 6, 70_000, 262_143], [65_534, 65_535, 131_070], [0, 65_535, 131_071, 196_606], list(range(0, 262_144, 997))):
        assert cl._unpacked(cl._packed(np.array(slots, np.int32))).tolist() == slots


def test_every_unlabelled_document_may_be_handed_over(spark):
    """A rare kind of bad page, beyond any small pool, is the surest one and is found by its page."""
    rng = random.Random(5)
    rows = [(i, f"text {rng.random()} {rng.random()}", "en", "bad" if i % 2 else "good") for i in range(400)]
    rows += [(i, f"common {rng.random()} words {i}", "en", "unseen") for i in range(1000, 6000)]
    rows += [(i, f"rareword {word}", "en", "bad") for i, word in enumerate(["once", "twice", "thrice"], 7000)]
    rows += [(None, "rareword without an id", "en", "bad")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    table = cl._Table(cl.featured(docs), docs.filter("doc_id < 1000").select("doc_id"))
    weights = [np.zeros(cl.DIMENSIONS), np.zeros(cl.DIMENSIONS)]
    weights[1][cl._slot("source bad")] = 100.0
    fitted = [(w, 0.0, np.array([0.0, 1.0])) for w in weights]
    handed = table.surest(fitted)
    assert [len(y) for _, y in handed] == [0, 4] and handed[1][1].tolist() == [1.0] * 4
    assert all(cl._slot("rareword") in slots for slots in handed[1][0][0])
    assert [len(y) for _, y in table.surest(fitted)] == [0, 0]


def test_classifier_of_odd_rows(docs, corpus, labels, no_docs):
    for model in (cl.learn(docs, labels), cl.learn(docs, labels.filter("quality = 1 and toxic = 0")), cl.learn(no_docs, labels), cl.learn(docs, labels.limit(0))):
        rows = cl.score(docs, model).collect()
        assert len(rows) == len(corpus) and all(0 <= r["score"] <= 1 for r in rows)
        kept = cl.accepted(docs, model)
        assert kept.columns == docs.columns
        assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in rows if r["accepted"])
        again = cl.score_features(cl.featured(docs), model).collect()
        key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["score"])
        for a, b in zip(sorted(rows, key=key), sorted(again, key=key)):
            assert a["doc_id"] == b["doc_id"] and abs(a["score"] - b["score"]) < 1e-4 and abs(a["text_score"] - b["text_score"]) < 1e-4
    assert cl.learn(docs, labels.limit(0)) is None
    assert cl.score(no_docs, None).count() == 0
    marked = {r["doc_id"]: r["bad"] for r in cl.labelled(docs, labels).collect() if r["doc_id"] is not None}
    assert marked[12] == 1 and marked[3003] == -1


def test_scores_equal_a_plain_loop(docs, corpus, labels):
    model = cl.learn(docs, labels)
    words, plain = cl._Words(), Counter()
    for doc_id, text, lang, source, _ in corpus:
        logits = []
        for (weights, b, line), slots in zip(model["views"], (cl.text_features(text, words).tolist(), cl.page_features(text, lang, source).tolist())):
            logits.append(line[0] + line[1] * (sum(weights[i] for i in slots) / max(1, len(slots)) ** 0.5 + b))
        score = 1 - 1 / (1 + np.exp(-(model["mix"][0] + model["mix"][1] * logits[0] + model["mix"][2] * logits[1])))
        plain[doc_id, round(float(score), 3)] += 1
    got = Counter((r["doc_id"], round(r["score"], 3)) for r in cl.score_features(cl.featured(docs), model).collect())
    off = sum((got - plain).values())
    assert off <= 2  # a score on the edge of a rounding step


def test_pipeline_stages_on_odd_rows(spark, docs, labels, no_docs, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for start in (docs, no_docs):
        held = start
        for n, (_, stage) in enumerate(cp.STAGES):
            out = stage(spark, held, str(tmp_path))
            path = str(tmp_path / f"stage{n}-{start is docs}")
            out.write.parquet(path)
            out = spark.read.schema(out.schema).parquet(path)
            if n < len(cp.STAGES) - 1:
                assert out.columns == docs.columns
                assert {r[0] for r in out.select("doc_id").collect()} <= {r[0] for r in held.select("doc_id").collect()}
            held = out
        check_packing(held.collect(), pk.CAPACITY)


@needs_tables
def test_pipeline_runs_its_stages(spark):
    packed = cp.run(spark, SF).collect()
    assert packed and check_packing(packed, pk.CAPACITY) <= pk.lower_bound(Counter(r["length"] for r in packed)) + 1
