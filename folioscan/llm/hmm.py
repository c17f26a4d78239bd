"""A hidden Markov language model trained and applied by Spark jobs.

Texts are encoded once into blocks: documents as numbers of the block's own vocabulary. A
Baum-Welch round runs forward and backward inside each block and yields expected counts of
(state, word) for its vocabulary, which are summed over blocks by word; the sums return to
the blocks that hold the word. So no task and no driver ever holds the whole vocabulary.

Words are dealt by hash over shares. A share numbers its words once; after that a block and a
share exchange arrays of counts in the order of the block's words, a row per block and share,
never words again and never a row per token.

The scaled forward recursion then gives the exact likelihood of every sequence: the sum over
all state paths. Words have, in each state, the expected counts smoothed by the unigram
distribution with one further place for every word not seen in training.

Expectation needs a start that tells the states apart: a hash of each word gives its weight in
each state. No sample takes part; rounds over all training documents go on until the
likelihood of the training corpus has settled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.common import blocks, bucketed, discard, mixed, release, text_of, words
from folioscan.sources.shared import new_folder

STATES = 4
BLOCK_BYTES = 16 << 20
STRETCH = 512  # tokens that follow one another in a task; longer texts are cut and composed
STEP_TOKENS = 1 << 20  # of stretches whose forward states are held at once
SETTLED = 1e-3  # gain of a round in log10 likelihood per training token that ends training
SEED = 7
END = b""  # the token that ends every text; words are never empty


@dataclass
class Chain:
    """Start and transition probabilities of the states."""

    first: np.ndarray
    move: np.ndarray


class _Steps:
    """Stretches run side by side, longest first, so that step t concerns a leading part."""

    def __init__(self, begin: np.ndarray, size: np.ndarray):
        steps = int(size[0])
        alive = np.searchsorted(-size, -np.arange(1, steps + 1), "right").tolist()
        ends = np.cumsum(alive).tolist()
        # Of each step: its first and last place among the tokens in order of the steps.
        self.parts = [(e - n, e) for n, e in zip(alive, ends, strict=True)]
        self.places = np.concatenate([begin[:n] + t for t, n in enumerate(alive)])


class _Sequences:
    """Sequences of one block, cut into stretches that run side by side.

    Moves and emissions of a stretch are a K x K product. Products of all stretches of longer
    sequences are made at once and composed along each sequence; that gives the exact forward
    vector on entry and backward vector on exit of every stretch, which then runs alone. So
    no text takes more steps than a stretch has tokens, and states of few tokens are held.
    """

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, chosen: np.ndarray | None = None):
        self.ids, self.count = ids, len(lengths)
        lengths = np.asarray(lengths, np.int64)
        begins = np.cumsum(lengths) - lengths
        which = np.arange(len(lengths)) if chosen is None else chosen
        pieces = -(-lengths[which] // STRETCH)
        number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(STRETCH, np.repeat(lengths[which], pieces) - number * STRETCH)
        order = np.argsort(-size, kind="stable")
        # All that follows is in this order, longest stretch first.
        self.owner = np.repeat(which, pieces)[order]
        self.begin = np.repeat(begins[which], pieces)[order] + number[order] * STRETCH
        self.size = size[order]
        self.number = number[order]
        spot = np.empty(len(order), np.int64)
        spot[order] = np.arange(len(order))
        more = number + 1 < np.repeat(pieces, pieces)
        self.next = np.where(more, np.append(spot[1:], -1)[:len(spot)], -1)[order]

    def _groups(self, some: np.ndarray) -> Iterator[np.ndarray]:
        """The stretches `some`, in runs of about STEP_TOKENS tokens."""
        group = (np.cumsum(self.size[some]) - 1) // STEP_TOKENS
        yield from np.split(some, np.flatnonzero(np.diff(group)) + 1) if len(some) else ()

    def _products(self, some: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
        """Of each stretch, what every state before its first token makes of those after its
        last one, [to, from, stretch], up to a factor of the stretch.

        Rows of a product differ at most by the ratio of moves, so one scale serves them all.
        """
        states = len(move)
        made = np.zeros((states, states, len(some)), emit.dtype)
        done = 0
        for group in self._groups(some):
            steps = _Steps(self.begin[group], self.size[group])
            product = np.zeros((states, states, len(group)), emit.dtype)
            for t, (a, b) in enumerate(steps.parts):
                seen = np.take(emit, self.ids[steps.places[a:b]], axis=1)
                if t:
                    ahead = move.T @ product[:, :, :b - a].reshape(states, -1)
                    now = ahead.reshape(states, states, -1) * seen[:, None]
                else:
                    now = np.eye(states, dtype=emit.dtype)[:, :, None] * seen[:, None]
                product[:, :, :b - a] = now / now.sum(axis=(0, 1))
            made[:, :, done:done + len(group)] = product
            done += len(group)
        return made

    def _borders(self, first: np.ndarray, move: np.ndarray, emit: np.ndarray):
        """Of each stretch: states before it (of a first one: none), states expected at its
        first token, and the backward vector after its last one, up to a factor.
        """
        entry = np.zeros((len(first), len(self.size)), emit.dtype)
        ahead = np.repeat(first[:, None].astype(emit.dtype), len(self.size), axis=1)
        back = np.ones_like(ahead)
        cut = np.flatnonzero((self.number > 0) | (self.next >= 0))
        if not len(cut):
            return entry, ahead, back
        products = self._products(cut, move, emit)
        order = np.argsort(self.number[cut], kind="stable")
        ranks = np.split(order, np.cumsum(np.bincount(self.number[cut]))[:-1])
        for rank in ranks:
            rank = rank[self.next[cut[rank]] >= 0]
            if len(rank):
                here, there = cut[rank], self.next[cut[rank]]
                state = np.einsum("kin,in->kn", products[:, :, rank], ahead[:, here])
                entry[:, there] = state / state.sum(axis=0)
                ahead[:, there] = move.T @ entry[:, there]
        for rank in ranks[::-1]:
            rank = rank[self.next[cut[rank]] >= 0]
            if len(rank):
                here, there = cut[rank], self.next[cut[rank]]
                column = np.searchsorted(cut, there)
                state = move @ np.einsum(
                    "kin,kn->in", products[:, :, column], back[:, there])
                back[:, here] = state / state.sum(axis=0)
        return entry, ahead, back

    def log10_likelihood(self, chain: Chain, emit: np.ndarray) -> np.ndarray:
        """By the scaled forward recursion; in the order the sequences were given."""
        emit = np.ascontiguousarray(emit.T)
        _, ahead, _ = self._borders(chain.first, chain.move, emit)
        found = np.zeros(len(self.size))
        for group in self._groups(np.arange(len(self.size))):
            steps = _Steps(self.begin[group], self.size[group])
            state = None
            for a, b in steps.parts:
                begin = ahead[:, group] if state is None else chain.move.T @ state[:, :b - a]
                state = begin * np.take(emit, self.ids[steps.places[a:b]], axis=1)
                scale = state.sum(axis=0)
                state /= scale
                found[group[:b - a]] += np.log10(scale)
        return np.bincount(self.owner, found, minlength=self.count)

    def expect(self, chain: Chain, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of (word, state), of moves and of first states.

        The log10 likelihood under `emit` is left in `likelihood`.
        """
        states = len(chain.first)
        first, move = chain.first.astype(np.float32), chain.move.astype(np.float32)
        emit = np.ascontiguousarray(emit.T)
        entry, ahead, back = self._borders(first, move, emit)
        counts = np.zeros((emit.shape[1], states))
        moves, begins, self.likelihood = np.zeros((states, states)), np.zeros(states), 0.0
        for group in self._groups(np.arange(len(self.size))):
            steps = _Steps(self.begin[group], self.size[group])
            word = self.ids[steps.places]
            seen = np.take(emit, word, axis=1)
            forward, scale = np.empty_like(seen), np.empty(len(word), seen.dtype)
            state = None
            for a, b in steps.parts:
                begin = ahead[:, group] if state is None else move.T @ state[:, :b - a]
                state = forward[:, a:b]
                np.multiply(begin, seen[:, a:b], out=state)
                scale[a:b] = state.sum(axis=0)
                state /= scale[a:b]
            self.likelihood += float(np.log10(scale.astype(np.float64)).sum())
            behind = back[:, group]
            alive = 0
            for t in range(len(steps.parts) - 1, -1, -1):
                a, b = steps.parts[t]
                state, after, now = forward[:, a:b], behind[:, :b - a], seen[:, a:b]
                # Stretches that end here: forward times backward is a distribution.
                after[:, alive:] /= (state[:, alive:] * after[:, alive:]).sum(axis=0)
                alive = b - a
                state *= after  # what the step before needs of `forward` is its own part
                now *= after
                now /= scale[a:b]
                if t:
                    c = steps.parts[t - 1][0]
                    moves += forward[:, c:c + alive] @ now.T
                    after[:] = move @ now
            a, b = steps.parts[0]
            moves += entry[:, group] @ seen[:, a:b].T
            begins += forward[:, a:b][:, self.number[group] == 0].sum(axis=1, dtype=np.float64)
            for k in range(states):
                counts[:, k] += np.bincount(word, forward[k], minlength=len(counts))
        return counts, moves * chain.move, begins


class _Numbers(dict):
    """Words of a block, numbered as they come; the end is number 0."""

    def __init__(self):
        super().__init__({END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _encode(texts: list[str], numbers: _Numbers) -> tuple[np.ndarray, np.ndarray]:
    flat: list[np.ndarray] = []
    for text in texts:
        found = [*map(numbers.__getitem__, words(text)), 0]
        flat.append(np.array(found, np.int32))
    lengths = np.array([len(f) for f in flat], np.int64)
    return (np.concatenate(flat) if flat else np.zeros(0, np.int32)), lengths


@dataclass
class Start:
    """A model of texts in memory: how likely each word is in each state, against all states."""

    chain: Chain
    numbers: dict[bytes, int]
    ratio: np.ndarray


def _hashes(vocabulary: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, vocabulary), np.uint32)


def start_ratio(hashes: np.ndarray, states: int, seed: int = SEED) -> np.ndarray:
    """A weight of every word in every state, from its hash alone: Gamma(2), mean 1."""
    draw = np.arange(2 * states, dtype=np.int64) + np.int64(seed * 1_000)
    bits = mixed(mixed(hashes)[:, None] ^ mixed(draw)[None, :])
    uniform = ((bits >> np.uint64(11)).astype(np.float64) + 1) / 2.0 ** 53
    return -0.5 * np.log(uniform).reshape(len(hashes), states, 2).sum(axis=2)


def _start_chain(states: int) -> Chain:
    return Chain(np.full(states, 1 / states),
                 np.full((states, states), 0.1 / states) + 0.9 * np.eye(states))


def start_model(texts: list[str], states: int, seed: int = SEED) -> Start:
    """The training of `score` over texts in memory, which tests hold against the jobs."""
    numbers = _Numbers()
    ids, lengths = _encode(texts, numbers)
    sequences = _Sequences(ids, lengths)
    seen = np.bincount(ids, minlength=len(numbers))
    share = (seen + 1) / (len(ids) + len(numbers) + 1)
    ratio, chain = start_ratio(_hashes(numbers), states, seed), _start_chain(states)
    found: list[float] = []
    while len(ids) and not _settled(found, len(ids)):
        counts, moves, begins = sequences.expect(chain, ratio.astype(np.float32))
        totals = Totals(len(ids), len(numbers), _chain(moves, begins), counts.sum(axis=0))
        ratio, chain = totals.emit(seen, counts) / share[:, None], totals.chain
        found.append(sequences.likelihood)
    return Start(chain, dict(numbers), ratio.astype(np.float32))


def _settled(found: list[float], tokens: int) -> bool:
    """Whether training ends, from the likelihoods of the rounds so far.

    The first one is that of the start, which is no distribution. Likelihoods are bounded and
    each further round must gain, so training ends without a limit on the rounds.
    """
    return not tokens or (len(found) > 2 and found[-1] - found[-2] < SETTLED * tokens)


def _chain(moves: np.ndarray, begins: np.ndarray) -> Chain:
    first, move = begins + 1.0, moves + 1.0
    return Chain(first / first.sum(), move / move.sum(axis=1, keepdims=True))


def is_held_out(id_col: Column) -> Column:
    """Whether a document is kept from training; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(7)) == 2


def _expected(
    ids: np.ndarray, lengths: np.ndarray, held: np.ndarray, chain: Chain, emit: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """Expected counts of a block's training documents, and its figures for `Totals`."""
    sequences = _Sequences(ids, lengths, np.flatnonzero(~held))
    counts, moves, begins = sequences.expect(chain, emit)
    return counts, np.concatenate(
        [moves.ravel(), begins, counts.sum(axis=0), [sequences.likelihood]])


def _encoded(rows: DataFrame) -> DataFrame:
    """Blocks of encoded documents with the words' counts in training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in enumerate(blocks(batches, "body", BLOCK_BYTES)):
            numbers = _Numbers()
            ids, lengths = _encode(block.column("body").to_pylist(), numbers)
            held = np.array(block.column("held").to_pylist(), bool)
            train = np.repeat(~held, lengths)
            seen = np.bincount(ids[train], minlength=len(numbers)).astype(np.int32)
            name = TaskContext.get().partitionId() << 32 | number
            fields = {
                "block": pa.array([name], pa.int64()),
                "doc_ids": _one(block.column("id")),
                "held": pa.array([held], pa.list_(pa.bool_())),
                "lengths": pa.array([lengths.astype(np.int32)], pa.list_(pa.int32())),
                "ids": pa.array([ids.tobytes()], pa.binary()),
                "vocabulary": pa.array([b" ".join(numbers).decode()]),
                "counts": pa.array([seen.tobytes()], pa.binary()),
                "hashes": pa.array([_hashes(numbers).tobytes()], pa.binary()),
            }
            yield pa.RecordBatch.from_arrays(list(fields.values()), names=list(fields))

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"block bigint, doc_ids array<{kind}>, held array<boolean>, lengths array<int>, "
             "ids binary, vocabulary string, counts binary, hashes binary")


def _one(column: pa.ChunkedArray) -> pa.ListArray:
    values = column.combine_chunks()
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


@dataclass
class Totals:
    """Figures of the whole training corpus."""

    tokens: int
    vocabulary: int
    chain: Chain
    occupied: np.ndarray

    def emit(self, seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        """Probability of words in each state, from their counts over the corpus."""
        smooth = self.vocabulary + 1
        return (expected + smooth * self.share(seen)[:, None]) / (self.occupied + smooth)

    def share(self, seen: np.ndarray) -> np.ndarray:
        """Probability of words in the corpus, whatever the state."""
        return (seen + 1) / (self.tokens + self.vocabulary + 1)


def _buckets(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _dealt(hashes: np.ndarray, shares: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """A block's words in the order of their shares, and each share's part of that order."""
    share = (mixed(hashes) % np.uint64(shares)).astype(np.int64)
    order = np.argsort(share, kind="stable")
    names, begins = np.unique(share[order], return_index=True)
    ends = [*begins[1:].tolist(), len(order)]
    return order, [(n, slice(b, e)) for n, b, e in zip(
        names.tolist(), begins.tolist(), ends, strict=True)]


def _array(value: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.concatenate([_array(v, kind) for v in column])


def _cut(values: np.ndarray, sizes: list[int]) -> pa.Array:
    """An array as the bytes of its parts."""
    ends = np.cumsum(sizes).tolist()
    return pa.array([values[e - n:e].tobytes() for e, n in zip(ends, sizes, strict=True)],
                    pa.binary())


def _numbered(encoded: DataFrame, shares: int) -> DataFrame:
    """The words of every block and share as numbers of the share, with corpus counts.

    `tokens` and `words` are figures of the share, in one of its rows.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, vocabulary, counts, hashes in zip(*batch.columns, strict=True):
                found = vocabulary.as_py().encode().split(b" ")
                seen = _array(counts, np.int32)
                order, parts = _dealt(_array(hashes, np.uint32), shares)
                at = order.tolist()
                yield pa.RecordBatch.from_arrays([
                    pa.array([n for n, _ in parts], pa.int64()),
                    pa.array([block.as_py()] * len(parts), pa.int64()),
                    pa.array([b" ".join([found[i] for i in at[p]]) for _, p in parts],
                             pa.binary()),
                    pa.array([seen[order[p]].tobytes() for _, p in parts], pa.binary()),
                ], names=["share", "block", "words", "counts"])

    def number(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        lists = [w.as_py().split(b" ") for w in table.column("words")]
        sizes = [len(x) for x in lists]
        slots = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode()
        slots = slots.indices.to_numpy()
        seen = np.bincount(
            slots, weights=_joined(table.column("counts"), np.int32)).astype(np.int64)
        others = [0] * (len(sizes) - 1)
        return pa.table([
            table.column("share"), table.column("block"), _cut(slots.astype(np.int32), sizes),
            _cut(seen[slots], sizes), pa.array([int(seen.sum()), *others], pa.int64()),
            pa.array([int((seen > 0).sum()), *others], pa.int64()),
        ], names=["share", "block", "slots", "seen", "tokens", "words"])

    dealt = encoded.select("block", "vocabulary", "counts", "hashes").mapInArrow(
        deal, "share bigint, block bigint, words binary, counts binary")
    return dealt.groupBy("share").applyInArrow(
        number, "share bigint, block bigint, slots binary, seen binary, tokens bigint, "
                "words bigint")


_SENT = "share bigint, block bigint, expected binary, figures array<double>"
_MODEL = "block bigint, share bigint, seen binary, expected binary, figures array<double>"


def _sent(
    block: int, order: np.ndarray, parts: list[tuple[int, slice]], counts: np.ndarray,
    figures: np.ndarray,
) -> pa.Table:
    """A block's expected counts for each share; the last state is what remains of a count."""
    counts = np.ascontiguousarray(counts[order, :-1], np.float32)
    return pa.table([
        pa.array([n for n, _ in parts], pa.int64()),
        pa.array([block] * len(parts), pa.int64()),
        pa.array([counts[p].tobytes() for _, p in parts], pa.binary()),
        pa.array([figures, *[None] * (len(parts) - 1)], pa.list_(pa.float64())),
    ], names=["share", "block", "expected", "figures"])


def _summed(numbered: DataFrame, sent: DataFrame, states: int) -> DataFrame:
    """Counts summed by word over all blocks, as they return to the blocks."""

    def run(slots: pa.Table, sent: pa.Table) -> pa.Table:
        slots, sent = slots.sort_by("block"), sent.sort_by("block")
        at = _joined(slots.column("slots"), np.int32)
        expected = _joined(sent.column("expected"), np.float32).reshape(len(at), states - 1)
        total = np.stack([np.bincount(at, expected[:, k]) for k in range(states - 1)], 1)
        sizes = [len(_array(s, np.int32)) for s in slots.column("slots")]
        return pa.table([
            slots.column("block"), slots.column("share"), slots.column("seen"),
            _cut(total.astype(np.float32)[at], sizes), sent.column("figures"),
        ], names=["block", "share", "seen", "expected", "figures"])

    return numbered.select("share", "block", "slots", "seen").groupBy("share").cogroup(
        sent.groupBy("share")).applyInArrow(run, _MODEL)


def _unpacked(block: pa.Table, model: pa.Table, shares: int, states: int):
    """Ids, lengths, held flags, word counts and expected counts of one block, and its deal."""
    model = model.sort_by("share")
    order, parts = _dealt(_array(block["hashes"][0], np.uint32), shares)
    seen = np.zeros(len(order), np.int64)
    seen[order] = _joined(model.column("seen"), np.int64)
    expected = np.zeros((len(order), states))
    expected[order, :-1] = _joined(model.column("expected"), np.float32).reshape(
        len(order), states - 1)
    expected[:, -1] = np.maximum(0, seen - expected.sum(axis=1))
    return *_documents(block), seen, expected, order, parts


def _documents(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = _array(block["ids"][0], np.int32)
    lengths = block["lengths"][0].values.to_numpy().astype(np.int64)
    return ids, lengths, block["held"][0].values.to_numpy(zero_copy_only=False)


_KEPT = ["block", "held", "lengths", "ids", "hashes"]


def _first_round(encoded: DataFrame, states: int, shares: int) -> DataFrame:
    """What every block sends under the hashed start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                block = pa.Table.from_batches([batch.slice(at, 1)])
                ids, lengths, held = _documents(block)
                hashes = _array(block["hashes"][0], np.uint32)
                counts, figures = _expected(
                    ids, lengths, held, _start_chain(states),
                    start_ratio(hashes, states).astype(np.float32))
                yield from _sent(block["block"][0].as_py(), *_dealt(hashes, shares), counts,
                                 figures).to_batches()

    return encoded.select(*_KEPT).mapInArrow(run, _SENT)


def _next_round(
    encoded: DataFrame, model: DataFrame, totals: Totals, states: int, shares: int
) -> DataFrame:
    """What every block sends under the corpus model of the round before."""

    def run(block: pa.Table, model: pa.Table) -> pa.Table:
        ids, lengths, held, seen, expected, order, parts = _unpacked(
            block, model, shares, states)
        # Against the share of the word: only ratios between states matter for the counts,
        # and the likelihoods of all rounds lack the same factor.
        emit = totals.emit(seen, expected) / totals.share(seen)[:, None]
        counts, figures = _expected(ids, lengths, held, totals.chain, emit.astype(np.float32))
        return _sent(block["block"][0].as_py(), order, parts, counts, figures)

    return encoded.select(*_KEPT).groupBy("block").cogroup(
        model.drop("figures").groupBy("block")).applyInArrow(run, _SENT)


def _totals(model: DataFrame, tokens: int, vocabulary: int, states: int) -> tuple[Totals, float]:
    """Figures of the corpus after a round, and its likelihood under the model before."""
    size = states * states + 2 * states + 1
    row = model.agg(*(F.sum(F.col("figures")[i]).alias(f"f{i}") for i in range(size))).first()
    figures = np.array([x or 0.0 for x in row])
    moves, begins, occupied, likelihood = np.split(
        figures, np.cumsum([states * states, states, states]))
    return Totals(tokens, vocabulary, _chain(moves.reshape(states, states), begins),
                  occupied), float(likelihood[0])


def _written(spark: SparkSession, df: DataFrame) -> tuple[DataFrame, str]:
    path = new_folder(spark, "hmm-model")
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path), path


def score(
    docs: DataFrame, states: int = STATES, rounds: int | None = None, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Train on the documents that are not held out and score every whole text.

    `rounds` over the training corpus, by default until its likelihood has settled.

    Returns id, held_out, n_tokens, n_known, train_tokens, base_score (unigram, add one) and
    score: log10 of the text's probability under the model, its end included. A row per row
    of `docs`; repeated rows stay, a null or empty text is the end alone, a null id trains.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("id"), text_of(text_col).alias("body")
    ).withColumn("held", is_held_out(F.col("id")))
    kind = rows.schema["id"].dataType.simpleString()
    shares = _buckets(rows)
    encoded = bucketed(_encoded(rows), "block", shares, "hmm-blocks")
    numbered = bucketed(_numbered(encoded, shares), "share", shares, "hmm-words")
    row = numbered.agg(F.sum("tokens"), F.sum("words")).first()
    tokens, vocabulary = row[0] or 0, row[1] or 0
    model, path = _written(
        spark, _summed(numbered, _first_round(encoded, states, shares), states))
    totals, likelihood = _totals(model, tokens, vocabulary, states)
    found = [likelihood]
    while len(found) < rounds if rounds is not None else not _settled(found, tokens):
        last = path
        sent = _next_round(encoded, model, totals, states, shares)
        model, path = _written(spark, _summed(numbered, sent, states))
        discard(spark, last)
        totals, likelihood = _totals(model, tokens, vocabulary, states)
        found.append(likelihood)

    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(block: pa.Table, model: pa.Table) -> pa.Table:
        ids, lengths, held, seen, expected, *_ = _unpacked(block, model, shares, states)
        begins = np.cumsum(lengths) - lengths  # every document has its end
        base = np.log10(totals.share(seen))
        likely = _Sequences(ids, lengths).log10_likelihood(
            totals.chain, totals.emit(seen, expected))
        return pa.table([
            block["doc_ids"][0].values, pa.array(held), pa.array(lengths),
            pa.array(np.add.reduceat((seen > 0)[ids].astype(np.int64), begins)),
            pa.array(np.full(len(lengths), totals.tokens)),
            pa.array(np.add.reduceat(base[ids], begins)), pa.array(likely),
        ], names=names)

    return encoded.select("doc_ids", *_KEPT).groupBy("block").cogroup(
        model.drop("figures").groupBy("block")).applyInArrow(
        run, f"`{id_col}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, "
             "train_tokens bigint, base_score double, score double")
