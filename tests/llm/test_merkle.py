"""The hash tree against one built in plain Python."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from folioscan.llm import merkle
from folioscan.llm.common import ascii_lower


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    fields = [row.doc_id, row.source, row.lang, row.n_chars, row.text]
    return digest(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [digest(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
        levels.append(nodes)
    return levels


def siblings(levels, place):
    found = []
    for level in levels[:-1]:
        run = place // 8 * 8
        found.append(("".join(level[run:place]), "".join(level[place + 1:run + 8])))
        place //= 8
    return found


def plain(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row.lang, []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]])
    top = tree([trees[g][-1][0] for g in order])
    found = []
    for at, g in enumerate(order):
        for place, row in enumerate(groups[g]):
            found.append((row.doc_id, leaf(row), trees[g][-1][0], top[-1][0],
                          tuple(siblings(trees[g], place) + siblings(top, at))))
    return sorted(found, key=str)


def ours(found):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, tuple((s.before, s.after)
                    for s in r.proof)) for r in found), key=str)


def table(llm, n, langs):
    i = F.col("id")
    return llm.range(n).select(
        i.alias("doc_id"), F.concat(F.lit("Text "), i.cast("string")).alias("text"),
        F.when(i % langs > 0, (i % langs).cast("string")).alias("lang"),
        F.lit("src").alias("source"), (i * 7).alias("n_chars"))


@pytest.mark.parametrize(("n", "langs", "levels"), [
    (1, 1, 4), (9, 2, 1), (140, 2, 1), (200, 90, 2), (200, 1, 4)])
def test_equals_plain_tree(llm, n, langs, levels):
    docs = table(llm, n, langs)
    hit = F.col("doc_id") % 4 == 0
    changed = F.when(hit, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    found = merkle.manifest(docs, changes={"text": changed}, levels=levels).collect()
    assert ours(found) == plain(docs.collect())
    rows = {r.doc_id: r for r in docs.collect()}
    for r in found:
        proof = [(s.before, s.after) for s in r.proof]
        assert merkle.fold(r.leaf, proof) == r.root
        row = rows[r.doc_id]
        other = leaf(type(row)(**row.asDict() | {"text": row.text.lower()}))
        assert r.folded_root == (merkle.fold(other, proof) if r.doc_id % 4 == 0 else r.root)
        assert r.verified == (r.doc_id % 4 != 0)


def test_odd_rows(odd):
    found = merkle.manifest(odd).collect()
    assert ours(found) == plain(odd.select("doc_id", "text", "lang", "source", "n_chars").collect())
    assert all(r.verified for r in found)
    answers = merkle.digests(merkle.manifest(odd)).collect()
    expected = {r.leaf: digest(*(s.before + s.after for s in r.proof)) for r in found}
    assert len(answers) == len(found)
    # Copies of a row differ in their places.
    assert sum(r.proof_sha256 == expected[r.leaf] for r in answers) >= len(found) - 2


def test_nothing(nothing):
    assert merkle.manifest(nothing).count() == 0


def test_retained_states_resume_at_their_slot():
    parent = merkle.Parent(["a", "b", "c"])
    assert parent.digest == digest("abc") and parent.fold(1, "x") == digest("axc")
    assert [merkle.height(n) for n in (0, 1, 2, 8, 9, 64, 65)] == [0, 0, 1, 1, 2, 2, 3]
