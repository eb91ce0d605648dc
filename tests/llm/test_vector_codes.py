"""Cover trees and vector codes against plain assignment."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from ripplework.llm import cover_codes as cc


def plain_squares(points, entries):
    return ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)


@pytest.mark.parametrize("n, width, spread", [(1, 3, 10), (2, 1, 1), (40, 1, 50), (500, 2, 30), (900, 8, 3000), (300, 4, 2)])
def test_tree_covers_and_assigns_like_a_plain_scan(n, width, spread):
    rng = np.random.default_rng(n)
    points = np.concatenate([rng.integers(-spread, spread + 1, (n, width)), np.full((n // 3, width), spread)])
    tree = cc.CoverTree(points)
    assert sorted(tree.order.tolist()) == list(range(len(tree.points)))
    for node in range(len(tree.centre)):
        below = tree.points[tree.order[tree.first[node] : tree.last[node]]]
        assert ((below - tree.points[tree.centre[node]]) ** 2).sum(axis=1).max() == tree.reach[node]
        kids = tree.children[tree.child_ends[node - 1] if node else 0 : tree.child_ends[node]]
        if len(kids):
            assert tree.centre[node] in tree.centre[kids]
            assert [tree.first[node], *tree.last[kids]] == [*tree.first[kids], tree.last[node]]
            apart = plain_squares(tree.points[tree.centre[kids]], tree.points[tree.centre[kids]])
            assert (apart[~np.eye(len(kids), dtype=bool)] > tree.reach[kids].max()).all()
    for k in (1, 2, 16):
        entries = points[rng.integers(0, len(points), k)] + rng.integers(-2, 3, (k, width))
        squares = plain_squares(points, entries)
        code, error = tree.codes(entries)
        assert (code == squares.argmin(axis=1)).all() and (error == squares.min(axis=1)).all()
        sums, counts = tree.totals(entries)
        for e in range(k):
            assert counts[e] == (code == e).sum() and (sums[e] == points[code == e].sum(axis=0)).all()


def test_far_subtrees_are_given_whole():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(0, 50, (2000, 4)), rng.integers(10_000, 10_050, (2000, 4))])
    tree = cc.CoverTree(points)
    first, last, _ = tree.assign(np.array([[25] * 4, [10_025] * 4]))
    assert len(first) <= 4 and (last - first).sum() == len(tree.points)


def plain_codes(rows, rounds=cc.ROUNDS):
    fine = [
        (i, [math.floor(cc.SCALE * float(np.float32(x))) for x in v], label)
        for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    fine.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = next((len(v) for _, v, _ in fine if v and len(v) % cc.PARTS == 0), 0)
    known = [r for r in fine if dim and len(r[1]) == dim]
    out = [(i, label, None, None) for i, v, label in fine if not dim or len(v) != dim]
    books = []
    if known:
        parts = np.split(np.array([v for _, v, _ in known], np.int64), cc.PARTS, axis=1)
        codes, errors = [], []
        for part in parts:
            book = part[: cc.ENTRIES].copy()
            for _ in range(rounds):
                code = plain_squares(part, book).argmin(axis=1)
                book = np.array([part[code == e].sum(axis=0) // (code == e).sum() if (code == e).any() else b for e, b in enumerate(book)])
            books.append(book)
            squares = plain_squares(part, book)
            codes.append(squares.argmin(axis=1))
            errors.append(squares.min(axis=1))
        for n, (i, _, label) in enumerate(known):
            out.append((i, label, "".join(f"{c[n]:02x}" for c in codes), int(sum(e[n] for e in errors))))
    sums = defaultdict(lambda: None)
    for _, label, _, error in out:
        if error is not None:
            sums[label] = (sums[label] or 0) + error
    return sorted(((*r, sums[r[1]]) for r in out), key=repr), books


def check(spark, rows, monkeypatch):
    monkeypatch.setattr(cc, "BLOCK_ROWS", 64)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, block int, part string").repartition(3)
    found, books = cc.compress(df)
    got = sorted((tuple(r) for r in found.select("vec_id", "label", "code", "error", "label_error").collect()), key=repr)
    want, plain_books = plain_codes(rows)
    assert got == want
    assert [b.tolist() for b in books] == [b.tolist() for b in plain_books]


def test_codes_equal_plain_rounds(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(i % 5, 0.4) for _ in range(16)], rng.choice([0, 1, None])) for i in range(400)]
    same = [0.5] * 16
    rows += [(None, same, 1), (None, [0.25] * 16, None), (3, same, 2), (3, same, 2), *[(500 + i, same, 3) for i in range(150)]]
    rows += [(600, None, 1), (601, [], 1), (602, [1.0, None] * 8, 1), (603, [math.nan] * 16, 1), (604, [math.inf] * 16, 1), (605, [1.0] * 15, 1), (-9, [1.0] * 24, None), (-10, [2.0] * 3, 1)]
    rows = [r for r in rows if r[0] != -9]
    check(spark, rows, monkeypatch)


@pytest.mark.parametrize("rows", [[], [(1, [1.0] * 7, 0)], [(1, [1.0] * 8, None)], [(i, [float(i // 2)] * 8, i) for i in range(9)]])
def test_codes_of_few_rows(spark, monkeypatch, rows):
    check(spark, rows, monkeypatch)


def test_numbers_beyond_a_long_are_refused(spark):
    df = spark.createDataFrame([(1, [1e7] * 8, 0), (2, [-1e7] * 8, 0)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError):
        cc.compress(df)
