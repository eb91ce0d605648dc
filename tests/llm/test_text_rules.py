"""Rule ledger, language identification and license scan."""

import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplework.llm import language_id as li
from ripplework.llm import license_scan as ls
from ripplework.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize(
    "text", [None, "", " \n ", "a", "a b c", "a b c a b c", "x x x x x", "é ü # | <\n\né ü # | <\n", "a b\x0bc\x0cd \x1c e", "ab " * 1000, "a a a b a a a"]
)
def test_measures_equal_the_count_by_hand(text):
    assert qr.measure(text) == by_hand(text)


def test_ledger_on_odd_rows(docs, corpus):
    got = sorted(map(tuple, qr.ledger(docs).drop("failures").collect()), key=repr)
    assert got == sorted([(r[0], *by_hand(r[1])) for r in corpus], key=repr)


def test_policies_and_ablation_follow_the_bits(docs):
    book = qr.ledger(docs)
    rows = book.collect()
    for r in qr.ablation(book).collect():
        mask = qr.POLICIES[r["policy"], r["version"]]
        bit = next(b for b, (name, _) in qr.RULES.items() if name == r["rule"])
        assert r["n_docs"] == len(rows)
        assert r["n_failed"] == sum(x["failures"] & mask >> bit << bit & 1 << bit > 0 for x in rows)
        assert r["n_kept"] == sum(x["failures"] & mask == 0 for x in rows)
        assert r["n_kept_without"] == sum(x["failures"] & mask & ~(1 << bit) == 0 for x in rows)


def test_ledger_of_no_rows(no_docs):
    assert qr.ledger(no_docs).count() == 0
    assert {r["n_kept"] for r in qr.ablation(qr.ledger(no_docs)).collect()} == {0}


def test_language_of_odd_rows(docs, corpus):
    contents = li.learn(docs)
    assert set(contents) == {"de", "en", "fr"}
    got = li.identify(docs, contents).collect()
    assert len(got) == len(corpus)
    found = {r["doc_id"]: r for r in got}
    for doc_id in (3000, 3001, 3002, 3006):
        assert (found[doc_id]["lang_pred"], found[doc_id]["score"], found[doc_id]["rejected"]) == ("und", 0.0, True)
    assert all(0 <= r["score"] <= 1 for r in got)
    right = [found[r[0]]["lang_pred"] == r[2] for r in corpus if r[0] is not None and r[0] < 2500 and r[1]]
    assert sum(right) / len(right) > 0.97


def test_language_without_anything_learned(docs, no_docs):
    assert li.learn(no_docs) == {}
    assert {r["lang_pred"] for r in li.identify(docs, {}).collect()} == {"und"}
    assert li.identify(no_docs, {"en": b"some content"}).count() == 0
    one = li.identify(docs, {"en": b"some content"}).filter("doc_id = 10").first()
    assert (one["lang_pred"], one["score"]) == ("en", 1.0)


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the given tables")
def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = li.identify(docs, li.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter(li.held_out(F.col("doc_id"))).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) / len(found) > 0.97


def plain_scan(text, index, known):
    """Every template aligned at every place, without fingerprints."""
    words = ls.codes(text or "", known)
    out = set()
    for name, template in zip(index.names, index.words):
        band = max(2, len(template) // 5)
        best = max((ls.align(template, words, s, band)[0] for s in range(-len(template), len(words) + 1)), default=0)
        if best >= ls.MIN_COVERAGE * len(template):
            out.add((name, best))
    return out


def test_scan_finds_what_alignment_everywhere_finds():
    index, known = ls.Index(ls.TEMPLATES), ls._Codes()
    mit = ls.TEMPLATES["ISC"]
    texts = [
        None, "", "no license here at all, just words", "Text. Released under the MIT  license. More.",
        "x " * 50 + mit.replace("software", "program"), mit.replace("and/or", "or else") + " tail", mit[: len(mit) // 2],
        "This work is LICENSED under the gnu general public license version 3", "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.",
        "permission permission to use copy", ls.TEMPLATES["Apache-2.0"],
    ]
    for text in texts:
        got = ls.scan(text, index, known)
        assert {(n, m) for n, m, *_ in got} == plain_scan(text, index, known), text
    assert len(ls.scan(texts[8], index, known)) == 2
    name, n, size, start, end = ls.scan(texts[3], index, known)[0]
    assert texts[3][start:end] == "Released under the MIT  license"


def test_scan_loses_no_copy_with_few_edits():
    """Edits spread evenly or at random, as many as the coverage allows: every copy is reported."""
    index, known = ls.Index(ls.TEMPLATES), ls._Codes()
    assert [r[:2] for r in ls.scan("Released under an MIT License", index, known)] == [("MIT (statement)", 4)]
    assert [r[:2] for r in ls.scan("under the MIT License", index, known)] == [("MIT (statement)", 4)]
    rng = random.Random(3)
    for name, template in ls.TEMPLATES.items():
        words = re.findall(r"\w+", template)
        n, most = len(words), ls.edits(len(words), ls.MIN_COVERAGE)
        evenly = [range(most and n // most - 1, n, n // most)[:most]] if most else [()]
        for places in evenly + [sorted(rng.sample(range(n), most)) for _ in range(12)]:
            copy = list(words)
            for k, p in enumerate(places):
                copy[p] = rng.choice([f"zz{k}", "", f"zz{k} {copy[p]}"])  # replaced, left out, one put in
            text = " ".join(["before", "that", *filter(None, copy), "comes", "after"])
            got = [r for r in ls.scan(text, index, known) if r[0] == name]
            assert got and got[0][1] >= n - most, (name, text)


def test_scan_takes_other_coverages():
    half = ls.Index({"n": " ".join(f"w{i}" for i in range(40))}, 0.6)
    text = " ".join(f"w{i}" if i % 5 not in (1, 3) else f"x{i}" for i in range(40))
    assert [r[1] for r in ls.scan(text, half, ls._Codes())] == [24]
    assert ls.scan(text, ls.Index({"n": " ".join(f"w{i}" for i in range(40))}, 0.8), ls._Codes()) == []
    assert [r[1] for r in ls.scan("a one b", ls.Index({"o": "One", "none": ""}), ls._Codes())] == [1]


def test_scan_of_odd_rows(spark, docs, no_docs):
    assert ls.scan_documents(docs).count() == 0
    assert ls.scan_documents(no_docs).count() == 0
    row = spark.createDataFrame([(None, "İ Released under the MIT License."), (1, None)], "doc_id long, text string")
    assert [tuple(r)[:2] for r in ls.scan_documents(row).collect()] == [(None, "MIT (statement)")]


def test_word_characters_that_are_no_letters_are_no_words():
    assert [li.words_only(t) for t in ("²", "① ½", "12 ½!", "½ a")][:3] == [b"", b"", b""] and li.words_only("½ a") != b""


def test_features_of_words_are_those_of_their_slots(monkeypatch):
    """Checksums of beginnings go on from a fixed start, and plain text takes a plainer pattern: the slots stay the same."""
    from ripplework.llm import classifier as cl

    def plainly(text):
        tokens = cl._TOKEN.findall(text.lower())
        slots = []
        for t in set(tokens):
            slots += {slot(t), *(slot(f"^{n}{t[:n]}") for n in (4, 5, 6, 7) if len(t) > n and t[0].isalpha())}
        return {s for s in slots} | {(s * 40503 + k) % cl.DIMENSIONS for k in cl.SEVERAL for s in set(slots) if slots.count(s) >= k}

    slot, called = cl._slot, []
    monkeypatch.setattr(cl, "_slot", lambda feature: called.append(feature) or slot(feature))
    odd = ["", "A_b-c!? 12 snake_case Words wordings wordy word WORDS", "".join(map(chr, range(128))) * 2, "Größe größer Größenwahn İstanbul naïveté \ud800x", "日本語の文章 ...... ######"]
    for text in odd:
        called.clear()
        got = cl.text_features(text, cl._Words())
        assert len(called) == 4  # none for a word
        assert set(got.tolist()) == plainly(text) | {slot(x) for x in called}
        assert (np.diff(got) > 0).all() and (cl._unpacked(cl._packed(got)) == got).all()
    for slots in ([0], [0, 1, 0xFFFE], [0xFFFE], [0xFFFF, 3 * 0xFFFF, cl.DIMENSIONS - 1]):
        assert cl._unpacked(cl._packed(np.array(slots, np.int32))).tolist() == slots
