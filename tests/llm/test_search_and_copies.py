"""Top-k search, SimHash, line and substring deduplication against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
import xxhash

from ripplework.llm import components as co
from ripplework.llm import line_dedup as ld
from ripplework.llm import rindex as ri
from ripplework.llm import simhash as sh
from ripplework.llm import suffix_dedup as sd
from ripplework.llm import topk_search as ts


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("k", [1, 3, 10])
def test_top_k_equals_all_scores(spark, k):
    rng = random.Random(k)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(rng.choice([5, 19]))], "x") for i in range(150)]
    rows += [(200, None, "x"), (201, [], "x"), (202, [1.0, None, 0.0, 0.0, 0.0], "x"), (203, [math.nan] * 5, "x"), (204, [math.inf] * 5, "x"), (None, [1.0] * 5, "x")]
    rows += [rows[7], rows[7], (151, rows[7][1], "y"), (300, [0.0] * 5, "x"), (400, [1e6] * 19, "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(4)
    whole = ts.whole(df)
    got = {tuple(r) for r in ts.top_k(whole, whole.filter("vec_id % 100 = 0"), k).collect()}
    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q, v in {(i, tuple(v)) for i, v in fine if i % 100 == 0}:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q and len(w) == len(v))[:k]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)}
    assert got == want


def test_top_k_of_no_rows(spark):
    none = ts.whole(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert ts.top_k(none, none, 3).count() == 0


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w.decode() for w in low.encode().split()]
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components_equal_brute_force(docs, corpus, no_docs):
    got = sorted(map(tuple, sh.near_duplicates(docs).collect()), key=repr)
    fps = [plain_fingerprint(r[1]) for r in corpus]
    pairs = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    of = roots(len(fps), pairs)
    least = {}
    for row, root in zip(corpus, of):
        if row[0] is not None:
            least[root] = min(row[0], least.get(root, row[0]))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    assert got == sorted([(r[0], f, least.get(c)) for r, f, c in zip(corpus, signed, of)], key=repr)
    assert sh.near_duplicates(no_docs).count() == 0


def test_grid_loses_no_pair(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(150)] + [0, (1 << 64) - 1]
    fps = list(dict.fromkeys([*base, *(f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))) for f in base for _ in range(6))]))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = sh.near_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    at = {f: i for i, f in enumerate(signed)}
    want = roots(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    assert roots(len(fps), [(at[a], at[b]) for a, b in links]) == want


def test_crowded_cell_makes_one_link_a_member():
    rng = np.random.default_rng(1)
    fps = np.unique(np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 12, (400, 2)).astype(np.uint64), axis=1))
    pairs = sh.links_within(np.zeros(len(fps), np.int64), np.sort(fps), 4)
    assert len(pairs) == len(fps) - 1


def test_components_of_chains_and_hubs(spark, docs):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(300, 300), (None, 5), (7, None)]
    pairs += [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    got = dict(map(tuple, co.components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    clean = [(a, b) for a, b in pairs if a is not None and b is not None and a != b]
    want = roots(301, clean)
    assert got == {n: want[n] for n in {x for p in clean for x in p}}
    assert co.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_row_stays_of_each_group(docs, corpus):
    kept = sh.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and sorted(ids, key=repr) == sorted({r["component_id"] for r in sh.near_duplicates(docs).collect()}, key=repr)


def test_one_row_stays_of_each_group_whatever_its_ids(spark):
    """Different texts under one id, or under none, are different groups, and repeated rows are one."""
    rng = random.Random(11)
    texts = [" ".join(rng.choice([f"w{n}{k}" for k in range(90)]) for _ in range(60)) for n in range(7)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (4, texts[2]), (4, texts[3]), (9, texts[3]), (None, texts[4]), (3, texts[4]), (6, texts[5]), (6, texts[5]), (8, None), (None, None)]
    kept = [tuple(r) for r in sh.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept, key=repr) == sorted([(None, texts[0]), (None, texts[1]), (4, texts[2]), (4, texts[3]), (3, texts[4]), (6, texts[5]), (8, None)], key=repr)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, letters, most):
    out = list(text)
    for _ in range(rng.randint(0, most)):
        i, kind = rng.randint(0, len(out)), rng.random()
        if kind < 0.4:
            out.insert(i, rng.choice(letters))
        elif out and kind < 0.7:
            out.pop(min(i, len(out) - 1))
        elif out:
            out[min(i, len(out) - 1)] = rng.choice(letters)
    return "".join(out)


def test_banded_distance_and_segments():
    rng = random.Random(0)
    for _ in range(4000):
        letters = rng.choice(["ab", "abcdefgh", "aé😀"])
        a = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        b = edited(rng, a, letters, 4)
        d = distance(a, b)
        assert [ld.within(a, b, n) for n in range(4)] == [d <= n for n in range(4)], (a, b)
        a, b = sorted((a, b), key=len)
        t = ld.threshold(len(a))
        if t and 0 < d <= t:
            own = {(len(a), i, a[s : s + n]) for i, (s, n) in enumerate(ld.segments(len(a), t + 1))}
            assert own & {(n, i, b[s : s + z]) for n, i, s, z in ld.probes(len(b))}, (a, b)


def line_rows(corpus):
    return [(r[0], n, line) for r in corpus for n, line in enumerate((r[1] or "").split("\n")) if line and not line.isspace()]


def test_line_classes_equal_brute_force(spark, no_docs):
    rng = random.Random(4)
    pool = ["".join(rng.choice("abcde ") for _ in range(rng.randint(3, 45))) for _ in range(40)]
    corpus = [(i, "\n".join(edited(rng, rng.choice(pool), "abcde", 2) for _ in range(rng.randint(0, 7))), "en", "s", 0) for i in range(60)]
    corpus += [(None, pool[0], None, None, None), (70, None, None, None, None), (71, "", "", "", 0), (5, corpus[5][1], "en", "s", 0)]
    df = spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {(r["doc_id"], r["line_no"]): r for r in ld.classes(df).collect()}
    rows = line_rows(corpus)
    assert ld.classes(df).count() == len(rows)
    lines = list(dict.fromkeys(x[2] for x in rows))
    near = [(a, b) for a in range(len(lines)) for b in range(a) if distance(lines[a], lines[b]) <= ld.threshold(min(len(lines[a]), len(lines[b])))]
    of = dict(zip(lines, roots(len(lines), near)))
    key = lambda p: (p[0] is not None, p[0] or 0, p[1])
    first = {}
    for doc_id, n, line in rows:
        c = of[line]
        first[c] = min(first.get(c, (doc_id, n)), (doc_id, n), key=key)
    for doc_id, n, line in rows:
        r = got[doc_id, n]
        assert (r["first_doc_id"], r["first_line_no"]) == first[of[line]]
        assert r["removed"] == ((doc_id, n) != first[of[line]])
    cleaned = {r["doc_id"]: r["text"] for r in ld.deduplicated(df).collect() if r["doc_id"] != 5}
    for doc_id, text, *_ in corpus:
        if doc_id != 5:
            kept = None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if (doc_id, n) not in got or not got[doc_id, n]["removed"])
            assert cleaned[doc_id] == kept
    assert ld.classes(no_docs).count() == 0 and ld.deduplicated(no_docs).count() == 0


def test_lines_of_odd_rows(docs, corpus):
    assert ld.classes(docs).count() == len(line_rows(corpus))
    cleaned = ld.deduplicated(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == len(corpus)
    assert all(r["n_chars"] == len(r["text"]) for r in cleaned.collect() if r["text"] is not None)


def long_lines(rng, n):
    """Long lines over few syllables, and edits of them around the threshold."""
    syllables = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 4))) + rng.choice(["", " "]) for _ in range(40)]
    out = []
    for _ in range(n):
        line = "".join(rng.choice(syllables) for _ in range(rng.choice([15, 20, 21, 40, 90])))
        out += [line, *(edited(rng, line, "abcd 😀", ld.threshold(len(line)) * 2) for _ in range(3))]
    return list(dict.fromkeys(out))


def test_long_lines_within_the_threshold_meet():
    rng = random.Random(8)
    met = 0
    for _ in range(120):
        lines = sorted(long_lines(rng, 1), key=len)
        for j, b in enumerate(lines):
            for a in lines[:j]:
                d, t = distance(a, b), ld.threshold(len(a))
                assert ld.within(a, b, t) == (d <= t) and ld.within(a, b, 9) == (d <= 9), (a, b)
                if d <= t:
                    met += 1
                    own = {(len(a), i, a[s : s + n]) for i, (s, n) in enumerate(ld.segments(len(a), t + 1))}
                    assert own & {(n, i, b[s : s + z]) for n, i, s, z in ld.probes(len(b))}
    assert met > 50


def test_classes_of_long_lines_equal_brute_force(spark):
    rng = random.Random(9)
    lines = long_lines(rng, 25)
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "doc_id long, text string").repartition(3)
    near = [(a, b) for a in range(len(lines)) for b in range(a) if abs(len(lines[a]) - len(lines[b])) <= 40 and distance(lines[a], lines[b]) <= ld.threshold(min(len(lines[a]), len(lines[b])))]
    want = roots(len(lines), near)
    assert len(near) > 20
    assert {r["doc_id"]: r["first_doc_id"] for r in ld.classes(df).collect()} == dict(enumerate(want))


def test_lines_of_rows_with_one_id_or_none(spark):
    """A repeat in one row takes nothing from another row of the same id, nor from other rows without one."""
    seen = "a line that the first document has too"
    uniques = ["first\nno other row has a line like it", "quite another text begins here\nsecond and last"]
    rows = [(None, seen + "\n" + seen), *[(None, u) for u in uniques], (5, "\n".join([uniques[0].split("\n")[0]] * 2)), (5, uniques[1].upper())]
    kept = sorted(r["text"] for r in ld.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == sorted([seen, *uniques, "", uniques[1].upper()])


def test_matching_statistics_equal_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        letters = rng.choice([b"ab", b"abc", b"\x00\xff", b"a"])
        texts = [bytes(rng.choice(letters) for _ in range(rng.randint(0, rng.choice([3, 20, 100])))) for _ in range(rng.randint(0, 12))]
        depth = rng.choice([1, 3, 7, 8, 14, 20, 50])
        index = ri.RunLengthIndex(texts, depth)
        patterns = [bytes(rng.choice(letters + b"z" * (rng.random() < 0.1)) for _ in range(rng.randint(0, 30))) for _ in range(6)] + texts[:3]
        length, row, start = index.matching_statistics(patterns)
        values = np.array([rng.randint(0, 99) for _ in texts], np.int64)
        least = index.least_of_class(values)
        for j, p in enumerate(patterns):
            for i in range(len(p)):
                best = 0
                while best < len(p) - i and any(p[i : i + best + 1] in t for t in texts):
                    best += 1
                assert length[start[j] + i] == best
                if best >= depth:
                    assert least[index.class_of[row[start[j] + i]]] == min(v for v, t in zip(values, texts) if p[i : i + depth] in t)


def test_rows_of_an_index_find_their_run_by_one_look_up():
    """A match moves to another row at every letter, and must not walk or search for the run that holds it."""
    rng = np.random.default_rng(14)
    texts = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in rng.integers(1, 90, 60)]
    index = ri.RunLengthIndex([*texts, texts[0], b""], 8)
    assert (index.run_of == np.searchsorted(index.run_start, np.arange(index.n), "right") - 1).all()
    patterns = [t[3:] + b"z" + t[:9] for t in texts]
    length, _, starts = index.matching_statistics(patterns)
    for k, p in enumerate(patterns):
        for i in range(len(p)):
            assert length[starts[k] + i] == max(n for n in range(len(p) - i + 1) if any(p[i : i + n] in t for t in texts))


def test_patterns_start_from_their_last_word(monkeypatch):
    """Of patterns that the texts hold hardly a letter is compared: the turns of their first letters are left out."""
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"abcdefgh") for _ in range(rng.randint(50, 84))) for _ in range(400)]
    index = ri.RunLengthIndex(texts, 50)
    compared, plain = [], ri.RunLengthIndex.common
    monkeypatch.setattr(ri.RunLengthIndex, "common", lambda self, a, b, most: compared.append(len(a)) or plain(self, a, b, most))
    length, _, start = index.matching_statistics(texts)
    assert (length == np.concatenate([np.arange(len(t), 0, -1) for t in texts])).all()
    assert sum(compared) < len(texts)


def plain_removal(corpus):
    first = {}
    for doc_id, text, *_ in corpus:
        body = (text or "").encode()
        if doc_id is not None:
            for p in range(len(body) - 49):
                g = body[p : p + 50]
                first[g] = min(doc_id, first.get(g, doc_id))
    out = []
    for doc_id, text, *_ in corpus:
        body = (text or "").encode()
        gone = bytearray(len(body))
        if doc_id is not None:
            for p in range(len(body) - 49):
                if first[body[p : p + 50]] < doc_id:
                    gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(body, gone) if not g)
        spans = sum(g and not before for g, before in zip(gone, b"\0" + bytes(gone)))
        out.append((doc_id, len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [(sd.BLOCK_BYTES, sd.INDEX_BYTES), (3000, 500)])
def test_removed_spans_equal_brute_force(docs, corpus, no_docs, sizes):
    got = sd.removed_spans(docs, *sizes)
    rows = got.collect()
    assert sorted([tuple(r)[:5] for r in rows], key=repr) == plain_removal(corpus)
    assert all(sum(e - s for s, e in zip(r["starts"], r["ends"])) == r["n_removed"] for r in rows)
    assert sd.removed_spans(no_docs).count() == 0


def test_removed_spans_of_periodic_texts(spark):
    rows = [(3, "a" * 49), (2, "a" * 120), (1, "ab" * 100), (5, "ba" * 40 + "c" + "a" * 60), (4, "a" * 120), (6, "xyz" * 30), (7, "yzx" * 30), (0, "")]
    got = sd.removed_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted([tuple(r)[:5] for r in got.collect()], key=repr) == plain_removal(rows)
