"""Models, decontamination, secrets and archives."""

import base64
import hashlib
import io
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.llm import decontaminate, hmm, secrets, toxicity, warc
from folioscan.llm.common import words


@pytest.mark.parametrize("stretch,held", [(512, 1 << 20), (1, 4), (2, 3), (3, 100)])
def test_forward_equals_sum_over_paths(monkeypatch, stretch, held):
    monkeypatch.setattr(hmm, "STRETCH", stretch)
    monkeypatch.setattr(hmm, "STEP_TOKENS", held)
    rnd = np.random.default_rng(0)
    states, vocabulary = 3, 5
    chain = hmm.Chain(rnd.dirichlet([1] * states), rnd.dirichlet([1] * states, states))
    emit = rnd.random((vocabulary, states))
    lengths = np.array([4, 1, 5, 2])
    ids = rnd.integers(0, vocabulary, lengths.sum()).astype(np.int32)
    sequences = hmm._Sequences(ids, lengths)
    score = sequences.log10_likelihood(chain, emit)
    counts, moves, begins = sequences.expect(chain, emit.astype(np.float32))
    ends = np.cumsum(lengths)
    want_counts, want_moves = np.zeros((vocabulary, states)), np.zeros((states, states))
    for k, part in enumerate(np.split(ids, ends[:-1])):
        total = 0.0
        paths = []
        for path in itertools.product(range(states), repeat=len(part)):
            p = chain.first[path[0]] * emit[part[0], path[0]]
            for t in range(1, len(part)):
                p *= chain.move[path[t - 1], path[t]] * emit[part[t], path[t]]
            total += p
            paths.append((p, path))
        assert math.isclose(score[k], math.log10(total), rel_tol=1e-9)
        for p, path in paths:
            for t, state in enumerate(path):
                want_counts[part[t], state] += p / total
                if t:
                    want_moves[path[t - 1], state] += p / total
    assert np.allclose(counts, want_counts, atol=1e-4)
    assert np.allclose(moves, want_moves, atol=1e-4)
    assert math.isclose(begins.sum(), len(lengths), rel_tol=1e-5)


@pytest.mark.parametrize("rounds", [1, 2])
def test_hmm_scores(odd, nothing, monkeypatch, rounds):
    monkeypatch.setattr(hmm, "BLOCK_BYTES", 20_000)
    rows = hmm.score(odd, rounds=rounds).collect()
    docs = odd.collect()
    counts: dict[bytes, int] = {}
    for d in docs:
        if zlib.crc32(str("" if d.doc_id is None else d.doc_id).encode()) % 7 != 2:
            for w in [*words(d.text or ""), b""]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (len(t), sum(w in counts for w in t),
         round(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in t), 6))
        for t in ([*words(d.text or ""), b""] for d in docs))
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows) == want
    assert {r.train_tokens for r in rows} == {n}
    assert all(r.score < 0 for r in rows)
    assert hmm.score(nothing).count() == 0


def _plain_pass(text, first, move, emit):
    """Likelihood, and expected states, moves and first states of one text; no scaling."""
    seen = [emit[w] for w in text]
    ahead, back = [first * seen[0]], [np.ones(len(first))]
    for e in seen[1:]:
        ahead.append(ahead[-1] @ move * e)
    for e in seen[:0:-1]:
        back.insert(0, move @ (e * back[0]))
    total = ahead[-1].sum()
    held = [a * b / total for a, b in zip(ahead, back)]
    moves = sum((np.outer(ahead[t - 1], seen[t] * back[t]) * move / total
                 for t in range(1, len(text))), np.zeros_like(move))
    return total, held, moves


@pytest.mark.parametrize("rounds", [1, 3])
def test_hmm_scores_are_those_of_plain_baum_welch(llm, monkeypatch, rounds):
    monkeypatch.setattr(hmm, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(hmm, "STRETCH", 5)
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choices("abcdefgh", k=rnd.randint(0, 30)))) for i in range(60)]
    texts = {i: [*words(t), b""] for i, t in rows}
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    states = hmm.STATES
    vocabulary = sorted({w for t in train for w in t})
    n, v = sum(map(len, train)), len(vocabulary)
    share = {w: (sum(t.count(w) for t in train) + 1) / (n + v + 1)
             for t in texts.values() for w in t}
    start = hmm.start_ratio(hmm._hashes(vocabulary), states)
    emit = dict(zip(vocabulary, start))
    first = np.full(states, 1 / states)
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    for _ in range(rounds):
        expected = {w: np.zeros(states) for w in share}
        begun, moved = np.ones(states), np.ones((states, states))
        for text in train:
            _, held, moves = _plain_pass(text, first, move, emit)
            begun, moved = begun + held[0], moved + moves
            for w, h in zip(text, held):
                expected[w] += h
        first, move = begun / begun.sum(), moved / moved.sum(axis=1, keepdims=True)
        occupied = sum(expected.values())
        model = {w: (expected[w] + (v + 1) * share[w]) / (occupied + v + 1) for w in share}
        emit = {w: model[w] / share[w] for w in share}
    docs = llm.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    found = {r.doc_id: r.score for r in hmm.score(docs, rounds=rounds).collect()}
    for i, text in texts.items():
        want = math.log10(_plain_pass(text, first, move, model)[0])
        assert math.isclose(found[i], want, rel_tol=1e-5), (i, found[i], want)


def test_hmm_long_texts_run_in_stretches():
    """A text of a million words beside short ones: as a plain recursion scores it."""
    rnd = np.random.default_rng(5)
    lengths = np.array([3, 1_000_000, 1, 700])
    ids = rnd.integers(0, 50, lengths.sum()).astype(np.int32)
    chain = hmm.Chain(rnd.dirichlet([1] * 4), rnd.dirichlet([1] * 4, 4))
    emit = rnd.random((50, 4))
    sequences = hmm._Sequences(ids, lengths)
    score = sequences.log10_likelihood(chain, emit)
    state, want = chain.first, 0.0
    for t, w in enumerate(ids[3:1_000_003].tolist()):
        state = (state @ chain.move if t else state) * emit[w]
        scale = state.sum()
        want += math.log10(scale)
        state = state / scale
    assert math.isclose(score[1], want, rel_tol=1e-9)
    counts, moves, begins = sequences.expect(chain, emit.astype(np.float32))
    assert np.allclose(counts.sum(axis=1), np.bincount(ids, minlength=50), rtol=1e-4)
    assert math.isclose(moves.sum(), lengths.sum() - len(lengths), rel_tol=1e-4)
    assert math.isclose(begins.sum(), len(lengths), rel_tol=1e-5)
    assert math.isclose(sequences.likelihood, score.sum(), rel_tol=1e-5)
    assert hmm._Sequences(ids[:0], lengths[:0]).log10_likelihood(chain, emit).tolist() == []


def test_hmm_is_a_distribution():
    """Over all words and one place for unknown ones, every state's emissions sum to one."""
    totals = hmm.Totals(100, 3, None, np.array([60.0, 40.0]))
    seen, expected = np.array([50, 30, 20]), np.array([[30.0, 20], [20, 10], [10, 10]])
    known = totals.emit(seen, expected).sum(axis=0)
    unknown = totals.emit(np.array([0]), np.zeros((1, 2)))[0]
    assert np.allclose(known + unknown, 1)


def test_hmm_learns_states():
    rnd = random.Random(1)
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    texts = [" ".join(rnd.choices(a if i % 2 else b, k=40)) for i in range(100)]
    start = hmm.start_model(texts, 2)
    of = {w: start.ratio[n] for w, n in start.numbers.items()}
    side = {w: int(np.argmax(r)) for w, r in of.items() if w}
    assert len({side[w.encode()] for w in a}) == len({side[w.encode()] for w in b}) == 1


def test_hmm_trains_on_the_corpus(llm, monkeypatch):
    """The jobs reach the model that whole-corpus rounds in memory reach, in blocks of any size."""
    monkeypatch.setattr(hmm, "BLOCK_BYTES", 4000)
    rnd = random.Random(4)
    sides = [[f"{c}{i}" for i in range(25)] for c in "abcd"]
    rows = [(i, " ".join(w for _ in range(rnd.randint(1, 6))
                         for w in rnd.choices(rnd.choice(sides), k=12))) for i in range(120)]
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    want = hmm.start_model(train, hmm.STATES)
    numbers = hmm._Numbers()
    ids, lengths = hmm._encode(train, numbers)
    share = (np.bincount(ids) + 1) / (len(ids) + len(numbers) + 1)
    likely = hmm._Sequences(ids, lengths).log10_likelihood(
        want.chain, want.ratio * share[:, None])
    docs = llm.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = {r.doc_id: r for r in hmm.score(docs).collect()}
    assert [r.held_out for _, r in sorted(found.items())] == [
        zlib.crc32(str(i).encode()) % 7 == 2 for i in range(120)]
    got = [found[i].score for i, _ in rows if not found[i].held_out]
    assert np.allclose(got, likely, rtol=1e-3)
    # Settled: two more rounds add little to what the corpus has gained over one round.
    few = {r.doc_id: r.score for r in hmm.score(docs, rounds=1).collect()}
    assert sum(got) > sum(few[i] for i, r in found.items() if not r.held_out) + 0.1 * len(ids)


ITEMS = [" ".join(f"Item{i}word{j}," for j in range(20 + i)) for i in range(12)]


def test_leaks(llm, odd, nothing):
    rnd = random.Random(3)
    other = [f"other{i}" for i in range(500)]

    def wrap(text):
        return " ".join(rnd.choices(other, k=30)) + " " + text + " " + " ".join(
            rnd.choices(other, k=30))

    def edited(text, edits):
        w = text.split()
        for at in rnd.sample(range(len(w)), edits):
            w[at] = rnd.choice(other)
        return " ".join(w)

    rows, want = [], set()
    for i, item in enumerate(ITEMS):
        limit = decontaminate.allowed(20 + i)
        for edits in (0, 1, limit, limit + 3):
            doc = len(rows)
            rows.append((doc, wrap(edited(item.lower() if edits else item, edits))))
            if edits <= limit:
                want.add((doc, i, edits))
    rows += [(1000, None), (1001, ""), (1002, wrap(""))]
    items = [*enumerate(ITEMS), (50, None), (51, "too short"), (0, ITEMS[0])]
    benchmark = llm.createDataFrame(items, "item_id bigint, text string")
    docs = llm.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert found == want
    kept = {r.doc_id for r in decontaminate.clean(docs, benchmark).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _, _ in want}
    assert decontaminate.leaks(nothing, benchmark).count() == 0
    assert decontaminate.leaks(odd, benchmark.limit(0)).count() == 0
    assert decontaminate.clean(odd, benchmark).columns == odd.columns


def test_recall_at_the_allowed_distance():
    rnd = random.Random(9)
    index = decontaminate.Index([(i, " ".join(f"x{rnd.randrange(900)}" for _ in range(30)))
                                 for i in range(60)])
    hit = 0
    for item in range(60):
        names = {n: w for w, n in index.vocabulary.items()}
        w = [names[int(n)].decode() for n in index.items[item]]
        for at in rnd.sample(range(30), decontaminate.allowed(30)):
            w[at] = "changed"
        hit += any(m[1] == item for m in index.matches(["before it " + " ".join(w) + " after"]))
    assert hit >= 0.95 * 60


@pytest.mark.parametrize("kind", ["change", "insert", "delete"])
def test_recall_of_any_length(kind):
    rnd = random.Random(12)
    for n, trials in ((15, 20), (32, 20), (50, 20), (100, 5), (250, 5), (500, 5), (700, 5), (1000, 4)):
        index = decontaminate.Index([(0, " ".join(f"x{rnd.randrange(900)}" for _ in range(n)))])
        names = {n: w.decode() for w, n in index.vocabulary.items()}
        hit = 0
        for _ in range(trials):
            w = [names[int(x)] for x in index.items[0]]
            for _ in range(decontaminate.allowed(n)):
                at = rnd.randrange(len(w))
                w[at:at + (kind != "insert")] = [] if kind == "delete" else ["other"]
            hit += bool(index.matches(["", "before it " + " ".join(w) + " after"]))
        assert hit == trials if n > 32 else hit >= 0.95 * trials, n


def test_long_items_are_found_by_the_keys_of_their_pieces():
    text = " ".join(f"x{i}" for i in range(200))
    index = decontaminate.Index([(7, text)])
    assert [end - begin for begin, end in decontaminate.pieces(200)] == [28, 29, 28, 29, 28, 29, 29]
    assert decontaminate.pieces(32) == [(0, 32)]
    assert index.matches([text, "a " + text]) == [(0, 7, 0, 0, 200), (1, 7, 0, 1, 201)]
    index.by_key.clear()
    assert index.matches([text]) == []


def test_leaks_against_a_search_of_all_places():
    rnd = random.Random(21)
    sizes = [1, 3, 4, 5, 9, 15, 24, 32, 33, 40, 64, 65, 90, 150]
    items = [[f"x{rnd.randrange(60)}" for _ in range(n)] for n in sizes]
    texts = []
    for item in items:
        for share in (0, 0.5, 1, 1.4):
            w = list(item)
            for _ in range(round(share * decontaminate.allowed(len(w)))):
                at = rnd.randrange(len(w) + 1)
                w[at:at + rnd.randrange(2)] = rnd.choice([[], ["other"], [f"x{rnd.randrange(60)}"]])
            around = [f"x{rnd.randrange(60)}" for _ in range(rnd.randrange(40))]
            texts.append(around + w + around[::-1] + rnd.choice([[], w]))
    texts += [[], ["x1"], [f"x{rnd.randrange(60)}" for _ in range(3000)]]
    index = decontaminate.Index([(i, " ".join(w)) for i, w in enumerate(items)])
    want = set()
    for row, words in enumerate(texts):
        numbers = np.array([index.vocabulary.get(w.encode(), 0) for w in words], np.int64)
        for i, item in enumerate(index.items):
            edits = decontaminate.edit_match(item, numbers)[0]
            if edits <= decontaminate.allowed(len(item)):
                want.add((row, i, edits))
    found = {m[:3] for m in index.matches([" ".join(w) for w in texts])}
    assert len(want) > 60
    assert {f[:2] for f in found} <= {w[:2] for w in want}
    assert len({f[:2] for f in found}) >= 0.98 * len(want)
    assert len(found & want) >= 0.98 * len(want)


def test_leaks_of_small_batches():
    """Fewer word places in a batch than in a segment; items of 9 and 19 words have four."""
    for n in (9, 19):
        index = decontaminate.Index([(0, " ".join(f"x{i}" for i in range(n)))])
        for texts in ([""], ["", ""], [" .,"], ["x1"], ["x1", ""], ["x1 x2"]):
            assert index.matches(texts) == []


def test_leaks_of_short_items_and_scripts_without_spaces():
    items = [(0, "What now?"), (1, "yes"), (2, "水の沸点は何度ですか答えてください"), (3, " ?"),
             (4, "น้ำเดือดที่กี่องศา")]
    index = decontaminate.Index(items)
    assert [m[:3] for m in index.matches(["he said: what NOW then", "what is now", "", "Yes"])] == [
        (0, 0, 0), (3, 1, 0)]
    altered = items[2][1].replace("沸", "氷").replace("何", "幾")
    found = index.matches(["前文 " + altered + " yes yes", items[4][1], "水の沸点 別の文です"])
    assert [m[:3] for m in found] == [(0, 1, 0), (0, 2, 2), (1, 4, 0)]


def test_edit_match_is_exact():
    rnd = np.random.default_rng(5)
    for _ in range(200):
        item, text = rnd.integers(1, 4, rnd.integers(1, 7)), rnd.integers(1, 4, rnd.integers(0, 9))

        def distance(a, b):
            row = list(range(len(b) + 1))
            for i, x in enumerate(a, 1):
                row, last = [i], row
                for j, y in enumerate(b, 1):
                    row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
            return row[-1]

        spans = [(i, j) for i in range(len(text) + 1) for j in range(i, len(text) + 1)]
        best = min(distance(item, text[i:j]) for i, j in spans)
        edits, start, end = decontaminate.edit_match(item, text)
        assert edits == best == distance(item, text[start:end])


def test_scan_of_odd_rows(odd, nothing):
    rows = secrets.scan(odd).collect()
    patterns = [(k.name, re.compile(k.pattern, re.A), k) for k in secrets.KINDS if k.base]
    want = []
    for d in odd.collect():
        spans = []
        for order, (name, pattern, kind) in enumerate(patterns):
            spans += [(m.start(), order, f"{name}:{m.start()}:{m.end()}")
                      for m in pattern.finditer(d.text or "") if len(m[kind.group]) >= kind.least]
        joined = ",".join(s[2] for s in sorted(spans))
        want.append((len(spans), hashlib.sha256(joined.encode()).hexdigest()))
    assert sorted((r.n_assign + r.n_access + r.n_hex, r.base_sha256) for r in rows) == sorted(want)
    assert secrets.scan(nothing).count() == 0


def test_ownership(llm):
    example = "AbcDefGhi0123456789example"
    rows = [(i, f"copied {example} everywhere", f"org{i}/repo") for i in range(5)]
    rows += [(9, "mine LiveKey98765ZYXwvu43210gh here", "me/one"),
             (10, "mine LiveKey98765ZYXwvu43210gh here", "me/two"),
             (11, "token: secretvalue123 token=ab secret: token: abcdefghijkl", None)]
    docs = llm.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert all(found[i].spans == "" for i in range(5))
    assert found[9].spans == found[10].spans == "opaque:5:30"
    assert found[11].spans == "assign:0:21" and found[11].n_live == 1
    masked = {r.doc_id: r.text for r in secrets.mask(docs).collect()}
    assert masked[0] == rows[0][1] and masked[9] == "mine [secret] here"
    assert masked[11] == "[secret] token=ab secret: token: abcdefghijkl"


def test_mask_keeps_columns(odd):
    masked = secrets.mask(odd)
    assert masked.columns == odd.columns and masked.count() == odd.count()
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert texts[1] is None and texts[12] == "[secret] and [secret] [secret]"


def _labelled(llm, count=400):
    rnd = random.Random(6)
    plain, bad = [f"plain{i}" for i in range(200)], ["vile", "awful", "nasty"]
    docs, labels = [], []
    for i in range(count):
        text = rnd.choices(plain, k=rnd.randint(5, 300))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rnd.randint(1, 3)):
                text.insert(rnd.randrange(len(text)), rnd.choice(bad) + rnd.choice(("", "!", "ly")))
        docs.append((i, " ".join(text)))
        if i < count // 2:
            labels.append((i, int(i % 3 > 0), int(toxic)))
    return (llm.createDataFrame(docs, "doc_id bigint, text string"), llm.createDataFrame(
        [*labels, (None, 1, 1), (7, None, None), (99999, 1, 1)],
        "doc_id bigint, quality int, toxic int"))


def test_toxicity(llm, odd, nothing):
    docs, labels = _labelled(llm)
    flagged = {r.doc_id for r in toxicity.rejected(docs, labels).collect()}
    toxic = set(range(0, 400, 5))
    held = set(range(200, 400))
    assert len(flagged & toxic & held) >= 0.95 * len(toxic & held)
    assert not (flagged - toxic) & held
    kept = {r.doc_id for r in toxicity.accepted(docs, labels).collect()}
    assert kept == set(range(400)) - flagged
    assert toxicity.accepted(odd, labels).columns == odd.columns
    assert toxicity.accepted(odd, labels).count() == odd.count()
    assert toxicity.accepted(odd, labels.limit(0)).count() == odd.count()
    for name in ("p_toxic", "P_toxic", "P_Quality", "c0"):
        clash = odd.withColumn(name, F.lit("mine"))
        answered = toxicity.accepted(clash, labels)
        assert answered.columns == clash.columns and answered.schema[name].dataType == T.StringType()
        assert {r[name] for r in answered.collect()} == {"mine"}
    assert toxicity.rejected(nothing, labels).count() == 0


def test_labels_without_use_take_no_place(llm):
    docs, labels = _labelled(llm)
    want = toxicity.fit(docs, labels, toxicity.CHAIN, max_rows=200)
    assert len(want[1].buckets)
    useless = llm.createDataFrame([(i, 1, 0) for i in range(1000, 6000)], labels.schema).unionByName(
        llm.createDataFrame([(i, None, None) for i in range(200, 400)], labels.schema))
    found = toxicity.fit(docs, labels.unionByName(useless), toxicity.CHAIN, max_rows=200)
    for a, b in zip(want, found, strict=True):
        assert a.buckets.tolist() == b.buckets.tolist() and np.allclose(a.weights, b.weights)
    half = llm.createDataFrame([(i, 1, None) for i in range(200, 400)], labels.schema)
    found = toxicity.fit(docs, labels.unionByName(half), toxicity.CHAIN, max_rows=200)
    assert want[1].buckets.tolist() == found[1].buckets.tolist()


def test_chain_uses_out_of_fold_predictions():
    rnd = np.random.default_rng(2)
    rows = [np.unique(rnd.integers(0, 500, 30)) for _ in range(300)]
    first = np.array([int(5 in r or 6 in r) for r in rows])
    labels = np.column_stack([first, first])
    models = toxicity.fit_rows(rows, labels, np.arange(300) % 5, ["a", "b"])
    assert len(models[0].earlier) == 0 and len(models[1].earlier) == 1
    assert models[1].earlier[0] > 0


def test_archive_round_trip(llm, nothing):
    html = ["<p>one</p>", None, "", "<p>one</p>", "naïve 中", "x" * 300_000, "<p>one</p>"]
    rows = [(10 - i, f"http://a/{i} b", h) for i, h in enumerate(html)] + [(None, None, "lonely")]
    rows += [(20, "u", "twice"), (20, "u", "twice")]
    pages = llm.createDataFrame(rows, "page_id bigint, url string, html string")
    found = warc.round_trip(pages).collect()
    first: dict[str, int] = {}
    for i, _, h in sorted((r for r in rows if r[0] is not None)):
        first.setdefault(h or "", i)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
           for r in found if r.page_id not in (None, 20)]
    want = []
    for i, _, h in rows:
        if i not in (None, 20):
            data = (h or "").encode()
            again = first[h or ""] != i
            want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                         "revisit" if again else "response", first[h or ""] if again else None))
    assert sorted(got) == sorted(want)
    assert sorted((r.record_type, r.refers_to) for r in found if r.page_id == 20) == [
        ("response", None), ("revisit", 20)]
    assert [r.record_type for r in found if r.page_id is None] == ["response"]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_reader_finds_damage():
    good = warc.record("response", "urn:page:1:0", "http://a", "d", b"payload" * 50_000)
    more = warc.record("response", "urn:page:2:0", None, "d", b"")
    read = list(warc.read_records(io.BytesIO(good + more), keep_payload=True))
    assert [r.problem for r in read] == [None, None] and read[0].payload == b"payload" * 50_000
    whole = zlib.decompress(good, 31)

    def packed(data):
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        return packer.compress(data) + packer.flush()

    for broken in (packed(whole.replace(b"payload", b"paYload", 1)), good[:-20],
                   packed(whole[:-3]), packed(whole + b"x" * 9), packed(b"no version\r\n\r\n"),
                   packed(whole.replace(b"Content-Length: 35", b"Content-Length: 34", 1))):
        assert list(warc.read_records(io.BytesIO(broken)))[-1].problem
