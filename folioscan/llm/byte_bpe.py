"""Byte-level byte-pair encoding by replaying the merges over a block of the corpus.

The distinct words of a block of documents, in runs of bounded length, lie in an array of
byte tokens. An inverted index leads from each pair of neighbouring tokens to the positions
where it stands, and a queue yields the pairs present in rank order. Applying a merge touches
only its positions and their neighbours, which may enter new pairs of higher or lower rank
into the index. Every merge of a word therefore happens in the order a word-by-word encoder
would choose.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import blocks, text_of

KEPT_WORDS = 500_000
KEPT_LENGTH = 32  # code points of the longest words kept from block to block
BLOCK_BYTES = 8 << 20
REPLAY_LENGTH = 1 << 19  # code points of the words that one replay merges together


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank in every line."""
    with open(path, "rb") as file:
        lines = (line.split() for line in file)
        return {base64.b64decode(token): int(rank) for token, rank in lines}


class Merges:
    """The rank of every pair of tokens that joins into a token, by the pair's ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        single = [bytes([b]) for b in range(256)]
        self.single = np.array([ranks[b] for b in single], np.int64)
        self.initial = np.array([[ranks.get(a + b, -1) for b in single] for a in single])
        self.rank = {
            ranks[token[:cut]] << 32 | ranks[token[cut:]]: rank
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        }

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """The token ids of each word, from one replay of the merges over all words.

        A word that is a token itself becomes that token, as the rank-file library does.
        """
        rank_of = self.rank.get
        whole = [self.ranks.get(w, -1) if w else -2 for w in words]
        parts = [w for w, known in zip(words, whole, strict=True) if known == -1]
        if not parts:
            return [[known] if known >= 0 else [] for known in whole]
        joined = np.frombuffer(b"".join(parts), np.uint8)
        ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
        last = np.zeros(len(joined), bool)
        last[ends - 1] = True
        first = np.roll(last, 1)
        place = np.arange(len(joined))
        tokens = self.single[joined].tolist()
        after = np.where(last, -1, place + 1).tolist()  # next live position, -1 at a word's end
        before = np.where(first, -1, place - 1).tolist()

        # The index: rank of the pair that starts at a position, and positions by rank. A
        # rank names the joined token; different splits of it merge at the same turn.
        ranks = self.initial[joined, np.roll(joined, -1)]
        ranks[last] = -1
        turn = ranks.tolist()
        order = np.argsort(ranks, kind="stable")
        present, begins = np.unique(ranks[order], return_index=True)
        where: dict[int, list[int]] = {
            int(rank): spots.tolist()
            for rank, spots in zip(present, np.split(order, begins[1:]), strict=True)
            if rank >= 0
        }
        queue = list(where)
        heapify(queue)
        while queue:
            rank = heappop(queue)
            spots = where.pop(rank)
            spots.sort()
            for at in spots:
                if turn[at] != rank:
                    continue  # an earlier merge has taken one of the two
                taken = after[at]
                following = after[taken]
                tokens[at] = rank
                turn[taken] = turn[at] = -1
                after[at] = following
                if following >= 0:
                    before[following] = at
                    new = rank_of(rank << 32 | tokens[following])
                    if new is not None:
                        turn[at] = new
                        if new in where:
                            where[new].append(at)
                        else:
                            where[new] = [at]
                            heappush(queue, new)
                ahead = before[at]
                if ahead >= 0:
                    new = rank_of(tokens[ahead] << 32 | rank)
                    if new is None:
                        turn[ahead] = -1
                    else:
                        turn[ahead] = new
                        if new in where:
                            where[new].append(ahead)
                        else:
                            where[new] = [ahead]
                            heappush(queue, new)

        encoded, starts = [], iter([0, *ends.tolist()])
        for known in whole:
            if known != -1:
                encoded.append([known] if known >= 0 else [])
                continue
            ids, at = [], next(starts)
            while at >= 0:
                ids.append(tokens[at])
                at = after[at]
            encoded.append(ids)
        return encoded


def _parts(words: list[str]) -> Iterator[list[str]]:
    """Runs of words of bounded length together, so that a replay's index has a bounded size."""
    begin = held = 0
    for end, word in enumerate(words):
        held += len(word)
        if held > REPLAY_LENGTH:
            yield words[begin:end + 1]
            begin, held = end + 1, 0
    yield words[begin:]


class Codec:
    """Encodes blocks of texts and decodes ids; keeps what it has met, up to a bound.

    A text is cut before each single space that follows a non-space character: the pattern
    always starts a word there and looks no further back. What lies between repeats a lot.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.merges = Merges(ranks)
        self.token_of = {rank: token for token, rank in ranks.items()}
        self._find = regex.compile(pattern).findall
        self._cut = re.compile(r"(?<=\S)(?= )").split
        self._spaced = re.compile(r"\s ").search
        self._words: dict[str, str] = {}  # ids, written in decimal
        self._chunks: dict[str, str] = {}
        # Decoded bytes of the chunks whose ids do not decode to the chunk itself.
        self._changed: dict[str, bytes] = {}
        self._long: list[tuple[dict, str]] = []  # entries that only the present block needs

    def chunks(self, text: str) -> list[str]:
        if self._spaced(text):
            return self._cut(text)
        first, *rest = text.split(" ")
        return [first, *map(" ".__add__, rest)] if text else []

    def learn(self, texts: list[str]) -> Iterator[list[str]]:
        """The chunks of each text; replays the merges over words not met before.

        Only the distinct chunks of a block are held; each text is cut again as it is read.
        """
        for kept, key in self._long:
            kept.pop(key, None)
        self._long = []
        present: set[str] = set()
        for text in texts:
            present.update(self.chunks(text))
        if len(self._chunks) > KEPT_WORDS:  # what this block needs is what blocks often need
            self._chunks = {c: self._chunks[c] for c in present if c in self._chunks}
            self._changed = {c: self._changed[c] for c in present if c in self._changed}
        words = {c: self._find(c) for c in present.difference(self._chunks)}
        needed = set(chain.from_iterable(words.values()))
        if len(self._words) > KEPT_WORDS:
            self._words = {w: self._words[w] for w in needed if w in self._words}
        fresh = sorted(needed.difference(self._words))
        for part in _parts(fresh):
            encoded = self.merges.replay([w.encode() for w in part])
            self._words.update(zip(part, (" ".join(map(str, e)) for e in encoded), strict=True))
        written = self._words.__getitem__
        for chunk, these in words.items():
            self._chunks[chunk] = ids = " ".join(map(written, these))
            decoded = self.decode(map(int, ids.split()))
            if decoded != chunk.encode():
                self._changed[chunk] = decoded
        self._long = [(self._words, w) for w in fresh if len(w) > KEPT_LENGTH]
        for chunk in words:
            if len(chunk) > KEPT_LENGTH:
                self._long += [(self._chunks, chunk), (self._changed, chunk)]
        return map(self.chunks, texts)

    def ids(self, chunks: list[str]) -> list[int]:
        return self.id_array(chunks).tolist()

    def id_array(self, chunks: list[str]) -> np.ndarray:
        written = " ".join(filter(None, map(self._chunks.__getitem__, chunks)))
        return np.fromstring(written, np.int32, sep=" ") if written else np.zeros(0, np.int32)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token_of.__getitem__, ids))

    def digests(self, chunks: list[str]) -> tuple[int, str, str]:
        """Number of ids, digest of the ids in decimal, digest of their decoded bytes."""
        chunks = [c for c in chunks if c]
        written = " ".join(map(self._chunks.__getitem__, chunks))
        if self._changed:
            decoded = b"".join(
                self._changed[c] if c in self._changed else c.encode() for c in chunks)
        else:
            decoded = "".join(chunks).encode()
        count = written.count(" ") + 1 if written else 0
        return (count, hashlib.sha256(written.encode()).hexdigest(),
                hashlib.sha256(decoded).hexdigest())


_codecs: dict[tuple[str, int], Codec] = {}


def _codec(key: tuple[str, int], ranks: dict[bytes, int]) -> Codec:
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks, key[0])
    return _codecs[key]


def id_lists(codec: Codec, found: Iterable[list[str]]) -> pa.Array:
    """The ids of the given texts as a column, without a Python object for each."""
    made = [codec.id_array(chunks) for chunks in found]
    ends = np.cumsum([0, *map(len, made)], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([*made, np.zeros(0, np.int32)]))


def _encoded(docs: DataFrame, ranks_path: str, pattern: str, text_col: str, made: str, rows):
    """`docs` with the fields `made`, a block of texts at a time; no shuffle."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))  # fixed size
    names = docs.columns
    key = (pattern, hash(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, ranks.value)
        for block in blocks(batches, text_col, BLOCK_BYTES):
            texts = [t or "" for t in block.column(text_col).to_pylist()]
            found = codec.learn(texts)
            columns = [block.column(n) for n in names] + rows(codec, found)
            full = pa.table(columns, names=[*names, *(m.split()[0] for m in made.split(", "))])
            yield from full.to_batches(max_chunksize=4096)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return docs.mapInArrow(run, ", ".join([*fields, made]))


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id and token_ids of every text; a null or empty text has no tokens.

    A row per row of `docs`, repeated rows and ids included; the result depends on the text
    alone, so there are no ties. Columns other than the two named are not read.
    """

    def rows(codec: Codec, found: Iterable[list[str]]) -> list[pa.Array]:
        return [id_lists(codec, found)]

    kept = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body"))
    made = _encoded(kept, ranks_path, pattern, "body", "token_ids array<int>", rows)
    return made.select(F.col("id").alias(id_col), "token_ids")


def decode(
    encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "token_ids"
) -> DataFrame:
    """id and the bytes that the ids stand for; null ids give empty bytes.

    An id outside the vocabulary is an error.
    """
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_of = {rank: token for token, rank in ranks.value.items()}
        for batch in batches:
            rows = batch.column(1).to_pylist()
            out = [b"".join(map(token_of.__getitem__, ids or ())) for ids in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.binary())], names=["id", "decoded"]
            )

    kept = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)


def encode_digests(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: the encoding and its decoding, as digests.

    A row per row of `docs`; repeated rows and ids stay, a null text counts as empty.
    """

    def rows(codec: Codec, found: Iterable[list[str]]) -> list[pa.Array]:
        counts, ids, decoded = zip(*map(codec.digests, found), strict=True)
        return [pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)]

    kept = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body"))
    made = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _encoded(kept, ranks_path, pattern, "body", made, rows).select(
        F.col("id").alias(id_col), "n_tokens", "ids_sha256", "decoded_sha256"
    )
