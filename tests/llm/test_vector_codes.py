"""Product codes against k-means without any pruning."""

import math
import random

import numpy as np
import pytest

from folioscan.llm import vector_codes as vc

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, parts=vc.PARTS, entries=vc.ENTRIES, rounds=vc.ROUNDS):
    """(vec_id, code, error, label) per row and all codebooks, by comparing all entries."""
    kept = []
    for i, vector, label in rows:
        if vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((i, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], []
    width = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    cut = [(i * width // parts, (i + 1) * width // parts) for i in range(parts)]
    books = [[v[a:b] for _, v, _ in kept[:entries]] for a, b in cut]

    def assign():
        for i, v, label in kept:
            found = []
            for (a, b), book in zip(cut, books):
                found.append(min((sum((x - y) ** 2 for x, y in zip(v[a:b], e)), n)
                                 for n, e in enumerate(book)))
            yield i, v, label, found

    for _ in range(rounds):
        members = {}
        for _, v, _, found in assign():
            for p, ((a, b), (_, n)) in enumerate(zip(cut, found)):
                members.setdefault((p, n), []).append(v[a:b])
        for (p, n), held in members.items():
            books[p][n] = [sum(c) // len(held) for c in zip(*held)]
    return [(i, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found), label)
            for i, _, label, found in assign()], books


def check(spark, rows, schema=SCHEMA):
    frame = spark.createDataFrame(rows, schema)
    answers = vc.report(frame).collect()
    expected, books = plain([r[:3] for r in rows])
    totals = {}
    for _, _, error, label in expected:
        totals[label] = totals.get(label, 0) + error
    key = str
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in answers), key=key) == sorted(
        ((i, code, error, totals[label]) for i, code, error, label in expected), key=key)
    digest = vc.Codebooks(np.zeros((1, 0), np.int64))
    digest.entries = [np.array(b) for b in books]
    assert {r.codebooks_sha256 for r in answers} == ({digest.digest()} if expected else set())


def vectors(n, width, seed, spread=1.0):
    rng = random.Random(seed)
    return [(i * 3 % n, [rng.gauss(0, spread) for _ in range(width)],
             rng.choice([None, 1, 2])) for i in range(n)]


def test_equals_plain_rounds(llm):
    check(llm, vectors(300, 32, 1))


def test_ties_copies_and_negative_means(llm):
    rows = [(i, [-(i % 5) / 256.0 - 0.001 * (i % 2)] * 16, i % 3) for i in range(200)]
    check(llm, rows + rows[:50])


def test_odd_rows(llm):
    rows = vectors(90, 20, 2) + [
        (500, None, 1), (501, [], 1), (502, [float("nan")] * 20, 1), (503, [1.0] * 19, None),
        (504, [None] * 20, 2), (505, [float("inf")] * 20, 2), (None, [0.5] * 20, None),
        (7, [0.25] * 20, None), (7, [0.25] * 20, None)]
    check(llm, rows)


def test_extra_columns_may_clash(llm):
    rows = [(*r, "x", "y", 1, "z") for r in vectors(40, 16, 3)]
    check(llm, rows, SCHEMA + ", id string, vector string, code int, kept string")


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, [0.5] * 16, None)]])
def test_few_rows(llm, rows):
    check(llm, rows)


def test_values_beyond_the_range_are_held(llm):
    rows = [(i, [1e30 * (-1) ** i] * 16, None) for i in range(3)]
    answers = vc.report(llm.createDataFrame(rows, SCHEMA)).collect()
    assert {r.error for r in answers} == {0}


def test_bounds_prune_and_lose_nothing():
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (64, 4))
    rows = centres[rng.integers(0, 64, 5000)] + rng.integers(-60, 60, (5000, 4))
    pivots = vc.choose_pivots(centres)
    near = vc.distances(rows, pivots).astype(np.float32)
    index, best, evaluated = vc.nearest(rows, near, centres, pivots)
    all_pairs = np.stack([vc.squared(rows, c) for c in centres], axis=1)
    assert (index == all_pairs.argmin(axis=1)).all() and (best == all_pairs.min(axis=1)).all()
    assert evaluated < rows.shape[0] * 64 / 5
