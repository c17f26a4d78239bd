"""SimHash near-duplicates against a comparison of all pairs."""

import os
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from folioscan.llm import golay

SF_DIR = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        words = words.replace(space, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """(id, fingerprint, least id reachable) of (id, text) by comparing all pairs."""
    prints = [plain_fingerprint(text) for _, text in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return sorted(((i, f"{p:016x}", least.get(g)) for (i, _), p, g in zip(rows, prints, group)),
                  key=str)


def ours(found):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in found.collect()), key=str)


def test_words_one_error_apart_share_a_key():
    sets = [set(row[row >= 0].tolist()) for row in golay.fuzzy_keys()]
    assert all(sets[w] & sets[w ^ 1 << b] for w in range(1 << 16) for b in range(16))
    assert {len(s) for s in sets} == {1, 6}


def test_every_link_shares_a_key():
    rng = random.Random(3)
    for errors in range(4):
        for _ in range(400):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), errors):
                b ^= 1 << bit
            made = [set(golay.keys(np.array([x], np.uint64))[0].tolist()) for x in (a, b)]
            assert made[0] & made[1]


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = " ".join(random.Random(1).choices(["One", "two", "drei\t", "四", "x" * 90], k=4000))
    whole = golay.fingerprint(text)
    monkeypatch.setattr(golay, "PIECE_BYTES", 7)
    assert golay.fingerprint(text) == whole == plain_fingerprint(text)


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert ours(golay.components(odd)) == plain_components(rows)


def test_nothing(nothing):
    assert golay.components(nothing).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")
def test_table_equals_all_pairs(llm):
    docs = llm.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert ours(golay.components(docs)) == plain_components(rows)


def _connected_as(prints, edges):
    group = {p: p for p in prints}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in edges:
        assert (a ^ b).bit_count() <= 3
        group[find(a)] = find(b)
    return {frozenset(p for p in prints if find(p) == r) for r in map(find, prints)}


@pytest.mark.parametrize("shard", [3, 50, 4096])
def test_hot_keys_in_shards(llm, monkeypatch, shard):
    monkeypatch.setattr(golay, "SHARD_ROWS", shard)
    rng = random.Random(shard)
    base = rng.getrandbits(64)
    prints = {base}
    for _ in range(25):  # chains of few errors, and strangers under the same keys
        far = base ^ rng.getrandbits(16) << 48
        for _ in range(4):
            prints.add(far)
            for bit in rng.sample(range(32, 64), 2):
                far ^= 1 << bit
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = golay.links(llm.createDataFrame(signed, "print bigint")).collect()
    edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in found]
    pairs = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3]
    assert _connected_as(prints, edges) == _connected_as(prints, pairs)


def test_frequent_fingerprints(llm, monkeypatch):
    monkeypatch.setattr(golay, "HOT_ROWS", 5)
    monkeypatch.setattr(golay, "HOT_KEYS", 1 << 40)
    docs = llm.range(40).select(F.col("id").alias("doc_id"), F.when(
        F.col("id") % 3 == 0, F.lit("the same text again and again")).otherwise(
        F.concat(F.lit("text "), F.sha2(F.col("id").cast("string"), 256))).alias("text"))
    assert ours(golay.components(docs)) == plain_components([tuple(r) for r in docs.collect()])
