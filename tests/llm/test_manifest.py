"""The Merkle manifest against a plain tree."""

import hashlib
import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from ripplework.llm import merkle as mk


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes):
    """Top of a tree and each leaf's siblings (left, right), level by level."""
    ways, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for leaf, i in enumerate(at):
            run = i - i % 8
            ways[leaf].append(("".join(level[run:i]), "".join(level[i + 1 : run + 8])))
        at = [i // 8 for i in at]
        level = [h(*level[i : i + 8]) for i in range(0, len(level), 8)]
    return level[0], ways


def plain_manifest(rows, hit):
    def leaf(row, text):
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)])

    groups = {}
    for row in rows:
        low = None if row[1] is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[1])
        own = leaf(row, row[1])
        groups.setdefault(row[2], []).append((row[0], own, leaf(row, low) if hit(row[0]) else own))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    climbed = {g: climb([x[1] for x in groups[g]]) for g in order}
    root, tops = climb([climbed[g][0] for g in order])
    out = []
    for g, top in zip(order, tops):
        for place, ((doc_id, own, used), way) in enumerate(zip(groups[g], climbed[g][1])):
            fold = used
            for left, right in way + top:
                fold = h(left, fold, right)
            proof = h(*[left + right for left, right in way + top])
            out.append((doc_id, g, place, own, climbed[g][0], root, proof, fold, fold == root))
    return out


def hit(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0


def spark_hit():
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 0


def test_manifest_equals_a_plain_tree(spark, docs, corpus):
    got = [tuple(r) for r in mk.manifest(docs, spark_hit()).collect()]
    assert Counter(got) == Counter(plain_manifest(corpus, hit))
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_repeated_missing_and_far_ids(spark):
    rng = random.Random(2)
    ids = [None] * 90 + [7] * 80 + [-(2**63), 2**63 - 1, -1, 0, 63, 64] + [rng.randrange(-(2**62), 2**62) for _ in range(60)] + [2**40 + i for i in range(150)]
    rows = [(i, rng.choice(["A", "b", "Ç"]), "x", None, 1) for i in ids for _ in range(rng.choice([1, 1, 2]))]
    rows += [(5, None, None, None, None), (6, "One", "single", "s", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    got = [tuple(r) for r in mk.manifest(df, spark_hit()).collect()]
    assert Counter(got) == Counter(plain_manifest(rows, hit))


def test_one_row_and_no_rows(spark, no_docs):
    assert mk.manifest(no_docs, spark_hit()).count() == 0
    one = spark.createDataFrame([(1, "a", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    [row] = mk.manifest(one).collect()
    assert row["leaf"] == row["root"] == row["folded_root"] and row["verified"] and row["proof_sha256"] == h("")
