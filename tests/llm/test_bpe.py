"""Encoding through the lexicon against the tokenizer's library."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ripplework import llm
from ripplework.llm import lexicon_bpe as lb

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return lb.Vocabulary(PATH)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def lexicon_of(words, vocabulary, folder):
    path = folder / "lexicon.bin"
    lb.compile_lexicon(words, vocabulary, str(path))
    return lb.Lexicon(str(path))


def odd_texts(vocabulary):
    rng = random.Random(3)
    parts = [
        "a", "b", "Th", "the", " the", " ", "  ", " \n", "\n", "\t", "é", "'s", "'ll", "12", "!", "…", "\xa0", "　", "<|endoftext|>", "<|endof", "x", "ß ",
        "\x00", "日本", "🙂", "é", "‍", "Ünï", *map(chr, vocabulary.others[:5]), *map(chr, vocabulary.others[-5:]),
    ]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 16))) for _ in range(1500)]
    return texts + [" " * 999, "ab" * 3000, "\n" * 500 + "x", "é" * 700, "".join(rng.choice("abcde ") for _ in range(20_000)), "z" * 5000 + "<|endoftext|>" * 3]


def test_words_of_every_code_point(vocabulary, tokenizer):
    splitter, split = lb.Splitter(list(vocabulary.special), vocabulary.others), tokenizer.pre_tokenizer.pre_tokenize_str
    codes = [*range(0xD800), *range(0xE000, 0x110000)]
    for i in range(0, len(codes), 256):
        text = "".join(f"a{c}b {c}1{c}!{c}\n" for c in map(chr, codes[i : i + 256]))
        assert list(splitter.words(text)) == [text[a:b] for _, (a, b) in split(text)]


def test_automaton_is_minimal_and_numbers_its_words():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 7))).encode() for _ in range(90)})
    image = lb.minimal_automaton(words)
    after = {}
    for arc, to, skip in zip(image["arcs"].tolist(), image["to"].tolist(), image["skip"].tolist()):
        after.setdefault(arc >> 8, {})[arc & 255] = (to, skip)

    def accepted(state):
        own = {b""} if image["final"][state] else set()
        return frozenset(own | {bytes([b]) + w for b, (to, _) in after.get(state, {}).items() for w in accepted(to)})

    languages = [accepted(s) for s in range(len(image["final"]))]
    assert languages[0] == frozenset(words) and len(set(languages)) == len(languages)
    for place, word in enumerate(words):
        state = total = 0
        for byte in word:
            state, skip = after[state][byte]
            total += skip
        assert image["final"][state] and total == place


@pytest.mark.parametrize("n_words", [0, 40, 4000])
def test_ids_and_texts_equal_the_library(vocabulary, tokenizer, tmp_path, monkeypatch, n_words):
    texts = odd_texts(vocabulary)
    counts = Counter(w for t in texts for w in lb.Splitter(list(vocabulary.special), vocabulary.others).words(t))
    lexicon = lexicon_of([w for w, _ in counts.most_common(n_words)], vocabulary, tmp_path)
    monkeypatch.setattr(lb, "BLOCK_WORDS", 1000)  # texts that go over several blocks
    monkeypatch.setattr(lb, "LONG_TEXT", 5000)
    got = list(lexicon.encode_texts([*texts, None]))
    assert got[-1] == b"" and len(got) == len(texts) + 1
    for text, ids in zip(texts, got):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text[:80]
        assert lexicon.decode(ids) == tokenizer.decode(want, skip_special_tokens=False) == text


def test_decoding_of_broken_ids(vocabulary, tokenizer, tmp_path):
    lexicon, rng = lexicon_of(["a"], vocabulary, tmp_path), random.Random(5)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(50_257), rng.choice(vocabulary.byte_ids)]) for _ in range(rng.randint(0, 12))]
        assert lexicon.decode(np.array(ids, "<u4").tobytes()) == tokenizer.decode(ids, skip_special_tokens=False)


def test_merges_one_by_one_with_a_heap_and_side_by_side(vocabulary, monkeypatch, tmp_path):
    rng = random.Random(9)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 40))).encode() for _ in range(500)]
    short = [vocabulary.merges.ids(w) for w in words]
    offsets, ids = lexicon_of([], vocabulary, tmp_path).merged([*words, b"", b"x"])
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [*short, [], vocabulary.merges.ids(b"x")]
    monkeypatch.setattr(lb, "SHORT_WORD", 0)
    assert [vocabulary.merges.ids(w) for w in words] == short


def digests(tokenizer, doc_id, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    back = tokenizer.decode(ids, skip_special_tokens=False)
    return doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_documents_in_spark(spark, docs, corpus, no_docs, tokenizer, vocabulary, monkeypatch):
    assert {r["word"]: r["n"] for r in lb.word_counts(docs, vocabulary).collect()}["word"] == 1
    counts = spark.createDataFrame([("a", 90), ("b", 90), ("c", 50), ("d", 3)], "word string, n long")
    assert [sorted(r["word"] for r in lb.most_frequent(counts, n).collect()) for n in (0, 1, 2, 3, 9)] == [[], [], ["a", "b"], ["a", "b", "c"], ["a", "b", "c", "d"]]
    monkeypatch.setattr(lb, "BATCH_BYTES", 9000)
    name = lb.build_lexicon(docs, PATH, 300)
    rows = lb.decode(lb.encode(docs, name), name).collect()
    got = Counter((r["doc_id"], r["n_tokens"], hashlib.sha256(r["ids"]).hexdigest(), hashlib.sha256(r["decoded"].encode()).hexdigest()) for r in rows)
    assert got == Counter(digests(tokenizer, r[0], r[1]) for r in corpus)
    name = lb.build_lexicon(no_docs, PATH)
    assert lb.decode(lb.encode(no_docs, name), name).count() == 0
    assert lb.encode(docs, name).count() == len(corpus)  # an empty lexicon


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the given tables")
def test_query_equals_the_library(spark, tokenizer):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = Counter(tuple(r) for r in llm.QUERIES["op13_bpe_codec"](spark, SF).collect())
    assert got == Counter(digests(tokenizer, *r) for r in rows)
