"""Small tables with everything that real ones hold now and then."""

import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = [
    "cell", "fp", "block", "salt", "rank", "length", "n", "root", "node", "key", "line_no", "shard", "load", "score", "bad",
    "first", "weight", "tokens", "topic", "probability", "piece", "start", "place", "component_id", "line", "shared", "value", "sampled",
]


def passage(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def small_corpus(seed=7, n=60):
    """Rows (doc_id, text, lang, source, n_chars): prose, copies, near copies, shared passages, odd ones."""
    rng = random.Random(seed)
    vocabulary = {
        lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(400)]
        for lang, letters in (("en", "abcdefgh"), ("fr", "éèàilmnop"), ("de", "öäüqrstuvw"))
    }
    shared = passage(rng, vocabulary["en"], 60)
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "fr", "de"])
        lines = [passage(rng, vocabulary[lang], rng.randint(4, 30)).capitalize() + "." for _ in range(rng.randint(1, 8))]
        if i % 7 == 3:
            lines.insert(1, shared)
        rows.append([i + 10, "\n".join(lines), lang, f"s{i % 4}"])
    for i in range(0, n, 5):  # exact and near copies
        text = rows[i][1]
        rows.append([1000 + i, text, rows[i][2], "s0"])
        at = rng.randrange(len(text))
        rows.append([2000 + i, text[:at] + "x" + text[at + 1 :], rows[i][2], "s0"])
    rows += [
        [3000, None, "en", "s1"], [3001, "", None, None], [3002, " \n\t\n ", "de", "s1"], [3003, "word", "en", None],
        [3004, passage(rng, vocabulary["en"], 30_000), "en", "s0"], [3005, "a" * 5000, None, "s2"], [3005, "a" * 5000, None, "s2"],
        [None, rows[2][1], "en", "s0"], [None, None, None, None], [3006, "12 34 !!", "fr", "s2"], [3007, "ab\x00cd " * 20, "en", "s1"],
        [-5, rows[4][1], "fr", "s3"], [3008, rows[4][1] + "\n" + rows[6][1], "fr", "s3"],
    ]
    return [tuple([*r, None if r[1] is None else len(r[1])]) for r in rows]


@pytest.fixture(scope="session")
def corpus():
    return small_corpus()


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus over several partitions, with extra columns named like those that operators use inside."""
    df = spark.createDataFrame(corpus, SCHEMA).repartition(5, F.hash("text"))
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHING]).cache()


@pytest.fixture(scope="session")
def no_docs(spark, docs):
    return spark.createDataFrame([], docs.schema)


@pytest.fixture(scope="session")
def labels(spark, corpus):
    rows = [(r[0], None if r[0] % 9 == 0 else int(r[0] % 3 > 0), 0) for r in corpus if r[0] is not None and r[0] % 2 == 0]
    return spark.createDataFrame([*rows, (None, 0, 1), (10, None, None), (12, 1, 1)], "doc_id long, quality int, toxic int")
