"""Near duplicates, repeated bytes and exact search against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.llm import census, components, jaccard, repeats, topk
from folioscan.llm.common import words


def _rows(df):
    return [r.asDict() for r in df.collect()]


def _near_copies(rnd, count, size=60):
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rnd.choices(vocabulary, k=size) for _ in range(4)]
    texts = []
    for i in range(count):
        text = list(base[i % 4])
        for _ in range(rnd.choice((0, 0, 1, 1, 2, 4))):
            text[rnd.randrange(size)] = rnd.choice(vocabulary)
        texts.append(" ".join(text))
    return texts + [" ".join(rnd.choices(vocabulary, k=size)) for _ in range(10)]


def _expected(rows):
    sets = []
    for _, text in rows:
        w = words(text or "")
        sets.append({tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    ids = collections.defaultdict(list)
    for (doc_id, _), r in zip(rows, root, strict=True):
        if doc_id is not None:
            ids[r].append(doc_id)
    return sorted((str(d), len(s), str(min(ids[r], default=None)))
                  for (d, _), s, r in zip(rows, sets, root, strict=True))


@pytest.mark.parametrize("shard_rows", [1000, 7])
def test_components(llm, monkeypatch, shard_rows):
    monkeypatch.setattr(jaccard, "SHARD_ROWS", shard_rows)
    rows = list(enumerate(_near_copies(random.Random(5), 60)))
    found = jaccard.components(llm.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]))
                  for r in _rows(found)) == _expected(rows)


def test_components_of_odd_rows(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found = _rows(jaccard.components(odd))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]))
                  for r in found) == _expected(rows)
    assert jaccard.components(nothing).count() == 0


def test_representatives(odd, nothing):
    kept = jaccard.representatives(odd)
    assert kept.columns == odd.columns
    # 5 copies 4, 7 (twice) and 8 are near copies of 6.
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        map(str, [1, 2, 3, 4, 6, 9, 10, 11, 12, None]))
    assert jaccard.representatives(nothing).count() == 0


def test_representatives_of_rows_that_a_shuffle_deals(llm):
    texts = [f"w{i // 3} a b c d e f {i // 3}" for i in range(60)]
    rows = llm.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = jaccard.representatives(rows.repartition(7))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 60, 3))


def test_connected(llm):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (200, 100), (7, 7)]
    found = components.connected(llm.createDataFrame(edges, "a bigint, b bigint"))
    roots = {r.node: r.root for r in found.collect()}
    assert roots == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 100}
    empty = llm.createDataFrame([], "a bigint, b bigint")
    assert components.connected(empty).count() == 0


def test_census_counts_and_first_blocks():
    low = np.array([5, 5, 7, 1 << 40], np.uint64)
    parts, which, count, begins = census._distinct(low, None, 3)
    assert count[which].tolist() == [2, 2, 1, 1] and begins[-1] == 3
    high = np.array([1, 2, 1, 1], np.uint64)
    _, which, count, _ = census._distinct(low, high, 3)
    assert count[which].tolist() == [1, 1, 1, 1]


def test_longest_previous_factors():
    rnd = random.Random(2)
    for _ in range(200):
        text = "".join(rnd.choices("ab", k=rnd.randint(1, 30)))
        order = sorted(range(len(text)), key=lambda i: text[i:])

        def common(a, b, text=text):
            n = 0
            while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            return n

        shared = [0] + [common(order[i - 1], order[i]) for i in range(1, len(order))]
        found = repeats.longest_previous_factors(order, shared)
        assert found == [max((common(p, q) for q in range(p)), default=0) for p in order]


def _repeated(texts, length, keep_first):
    seen = collections.defaultdict(list)
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            seen[t[p:p + length]].append((i, p))
    cover = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places[1 if keep_first else 0:]:
                cover[i][p:p + length] = True
    return [bytes(np.frombuffer(t, np.uint8)[~c]) if t else b""
            for t, c in zip(texts, cover, strict=True)]


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("length", [200, 40])
def test_find_repeats(llm, monkeypatch, keep_first, length):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 6000)
    monkeypatch.setattr(repeats, "PIECE_BYTES", 1500)
    rnd = random.Random(8)
    parts = ["".join(rnd.choices("abcdé ", k=rnd.choice((30, 150, 199, 200, 260, 700))))
             for _ in range(12)]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 5))) + str(i) for i in range(60)]
    texts += ["ab" * 400, "z" * 199, "z" * 150]
    rows = list(enumerate(texts))
    docs = llm.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    found = {r["doc_id"]: r for r in _rows(
        repeats.find_repeats(docs, length, keep_first))}
    want = _repeated([t.encode() for t in texts], length, keep_first)
    assert [bytes(found[i]["kept"]) for i in range(len(texts))] == want
    for i, text in enumerate(texts):
        gone = sum(s["end"] - s["start"] for s in found[i]["spans"])
        assert gone == len(text.encode()) - len(want[i])


def test_repeats_with_fewer_buckets_than_blocks(odd, monkeypatch):
    before = sorted(map(str, _rows(repeats.digests(repeats.find_repeats(odd)))))
    monkeypatch.setattr(repeats, "MOST_BUCKETS", 1)
    assert sorted(map(str, _rows(repeats.digests(repeats.find_repeats(odd))))) == before


def test_repeats_of_odd_rows(odd, nothing):
    rows = odd.select("doc_id", "text").collect()
    want = _repeated([(r.text or "").encode() for r in rows], 200, False)
    found = _rows(repeats.digests(repeats.find_repeats(odd)))
    assert sorted(r["kept_sha256"] for r in found) == sorted(
        hashlib.sha256(w).hexdigest() for w in want)
    assert repeats.find_repeats(nothing).count() == 0


def _top(rows, k):
    good = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows
            if i is not None and v is not None
            and all(x is not None and np.isfinite(x) for x in v)]
    found = []
    for n, (q, a) in enumerate(good):
        if q % 5 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i)
                            for m, (i, b) in enumerate(good) if m != n)
            found += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(found)


def test_search(llm, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_CELLS", 200)
    monkeypatch.setattr(topk, "CHECK_EVERY", 5)
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.normal(0, 0.3, 8).tolist()) for i in range(150)]
    rows += [(150, rows[5][1]), (151, rows[5][1]), (10, rows[5][1])]  # ties and a repeated id
    rows += [(152, None), (155, [None] * 8), (160, [float("nan")] * 8), (None, rows[0][1]),
             (165, [float("inf")] + [0.0] * 7)]
    vectors = llm.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn(
        "score", F.lit("clash"))
    found = topk.search(vectors, F.col("vec_id") % 5 == 0)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect()) == _top(rows, 5)


def test_search_small(llm):
    schema = "vec_id bigint, embedding array<float>"
    two = llm.createDataFrame([(0, [1.0]), (1, [2.0])], schema)
    assert [tuple(r) for r in topk.search(two, F.col("vec_id") == 0).collect()] == [
        (0, 1, 1, 256 * 512)]
    assert topk.search(two.limit(0), F.col("vec_id") == 0).count() == 0
    one = llm.createDataFrame([(0, [1.0])], schema)
    assert topk.search(one, F.col("vec_id") == 0).count() == 0


def test_search_stops_on_proof(monkeypatch):
    monkeypatch.setattr(topk, "RESCORED", 4)
    monkeypatch.setattr(topk, "CHECK_EVERY", 8)
    rnd = np.random.default_rng(1)
    vectors = np.zeros((4000, 16), np.int64)
    vectors[:, 0] = np.arange(4000)
    vectors[:, 1:] = rnd.integers(0, 2, (4000, 15))
    query = np.array([1000] + [1] * 15)
    found, done = topk.ImpactIndex(np.arange(4000), vectors).search(
        query[None], 5, np.array([-1]))
    want = sorted(zip((-(vectors @ query)).tolist(), range(4000), strict=True))[:5]
    assert found == [[(-s, i) for s, i in want]]
    assert done < 16 * topk.SEGMENTS
