"""Benchmark decontamination by edit distance: CGK embedding, bit-sampling LSH, verification.

Texts are sequences of words. A CGK walk reads a sequence with a pointer that, at every step,
outputs the word it points at and moves on or stays as a random bit for (step, word) says.
Two sequences of small edit distance walk alike, so their outputs differ in few places:
edit distance becomes Hamming distance. Sampling a few output places gives a key that close
sequences share with good chance; several walks and samples bring recall to a target. Keys of
the items are kept in a table, keys of item-sized windows of documents are looked up in it,
and an exact word edit distance decides about every match.

The drift of a walk grows faster than the edits, so long items are embedded in pieces. If a
passage is within a fifth of an item's words in edits, then some piece is within a fifth of its
own words; each piece that is found names a place of the whole item, places that overlap are
chained, and the whole item is verified there.

Embedding every window of every document would be wasteful. If a piece is within `d` edits
of a passage, one of its `d + 1` segments stands there unchanged; only windows around such
a segment are embedded. That condition loses nothing.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import blocks, mixed, text_of

EDITS = 0.2  # of an item's words
ITEM_BYTES = 8 << 20  # of benchmark text indexed at once
TARGET_RECALL = 0.98
SAMPLED = 6  # output places in a key
STRETCH = 4.0  # places of the output that one edit changes, as a planning figure
PIECE_WORDS = 32  # at most, of the pieces that items are embedded in; tests measure recall
WALKS = 8
BATCH_BYTES = 8 << 20  # of text looked up at once
MAX_CELLS = 1 << 19

# Words are letters, digits and all non-ASCII bytes; A-Z are lower-cased.
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)
# Thai, Lao, Tibetan, Burmese, Khmer, kana and Han letters: no spaces part their words.
_UNSPACED = re.compile(
    "[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf"
    "\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def word_list(text: str) -> list[bytes]:
    """The words of a text; each letter of a script without spaces is one."""
    if not text.isascii():
        text = _UNSPACED.sub(r" \g<0> ", text)
    return text.encode().translate(_WORD_BYTES).split()


def allowed(n_words: int) -> int:
    """The edits within which a passage counts as a copy of an item of so many words."""
    return int(EDITS * n_words)


def pieces(n_words: int) -> list[tuple[int, int]]:
    """First and end word of the pieces of an item: of even lengths, as few as the bound allows."""
    count = -(-n_words // PIECE_WORDS)
    cuts = [n_words * k // count for k in range(count + 1)]
    return list(zip(cuts, cuts[1:]))


def embed(rows: np.ndarray, walk: int) -> np.ndarray:
    """The CGK walk over each row of word numbers: three outputs per word, 0 past the end."""
    n, width = rows.shape
    padded = np.zeros((n, width + 1), np.int64)
    padded[:, :width] = rows
    at, line = np.zeros(n, np.int64), np.arange(n)
    out = np.zeros((n, 3 * width), np.int64)
    for step in range(3 * width):
        word = padded[line, at]
        out[:, step] = word
        bit = mixed(word * np.int64(1_000_003) + np.int64(step * 64 + walk)) & np.uint64(1)
        at = np.minimum(at + bit.astype(np.int64), width)
    return out


def bands(n_words: int) -> int:
    """How many samples bring recall at the allowed distance to the target."""
    differ = min(0.9, STRETCH * max(1, allowed(n_words)) / (3 * n_words) * 1.5)
    hit = (1 - differ) ** SAMPLED
    return max(WALKS, math.ceil(math.log(1 - TARGET_RECALL) / math.log(1 - hit)))


def keys(rows: np.ndarray, widths: np.ndarray) -> list[np.ndarray]:
    """The LSH keys of windows: rows of word numbers, 0 beyond each window's width.

    Windows of all widths walk together; where to sample depends on the width.
    """
    made: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(rows)
    groups = [(int(w), np.flatnonzero(widths == w)) for w in np.unique(widths)]
    found = {w: np.zeros((len(lines), bands(w)), np.uint64) for w, lines in groups}
    for walk in range(min(WALKS, max(map(bands, found), default=0))):
        out = embed(rows, walk)
        for width, lines in groups:
            for band in range(walk, bands(width), WALKS):
                places = np.random.default_rng((width, band)).integers(0, 3 * width, SAMPLED)
                key = np.full(len(lines), width * 4096 + band, np.uint64)
                for place in places:
                    key = mixed(key ^ out[lines, place].astype(np.uint64))
                found[width][:, band] = key
    for width, lines in groups:
        for line, row in zip(lines.tolist(), found[width], strict=True):
            made[line] = row
    return made


def _chunks(widths: np.ndarray) -> Iterator[slice]:
    """Runs of windows of rising width whose embeddings take bounded memory."""
    begin = 0
    for end in range(1, len(widths) + 1):
        if end == len(widths) or (end + 1 - begin) * int(widths[end]) > MAX_CELLS:
            yield slice(begin, end)
            begin = end


def edit_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least word edits between the item and any part of the text, with that part's place.

    Returns edits, first and end word of the part; of equal ones the one that ends first.
    """
    m = len(text)
    cost, start = np.zeros(m + 1, np.int64), np.arange(m + 1)
    place = np.arange(m + 1)
    for i, word in enumerate(item, 1):
        step = np.empty(m + 1, np.int64)
        origin = np.empty(m + 1, np.int64)
        step[0], origin[0] = i, 0
        across = cost[:-1] + (text != word)
        down = cost[1:] + 1
        better = across <= down
        step[1:] = np.where(better, across, down)
        origin[1:] = np.where(better, start[:-1], start[1:])
        # Insertions run along the row: the least of (value - place) so far, plus place.
        least = np.minimum.accumulate(step - place)
        fresh = np.where(step - place == least, place, 0)
        cost, start = least + place, origin[np.maximum.accumulate(fresh)]
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), end


class Index:
    """Items of a benchmark: the segments of their pieces, and the keys of the embeddings."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids: list[int] = []
        self.items: list[np.ndarray] = []
        self.vocabulary: dict[bytes, int] = {}
        for item_id, text in items:
            words = word_list(text)
            if words:
                self.ids.append(item_id)
                number = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
                self.items.append(np.array(number, np.int64))
        # Item, first word in it, and length of every piece.
        self.pieces = [(k, begin, end - begin) for k, item in enumerate(self.items)
                       for begin, end in pieces(len(item))]
        segments: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        by_key: dict[int, list[int]] = defaultdict(list)
        for number, (k, begin, length) in enumerate(self.pieces):
            parts = allowed(length) + 1
            size = length // parts
            for offset in range(0, parts * size, size):
                place = begin + offset
                gram = self._grams(self.items[k][place:place + size], size)[0]
                segments[size].append((int(gram), number, offset))
        keyed = [number for number, piece in enumerate(self.pieces) if allowed(piece[2])]
        order = sorted(keyed, key=lambda number: self.pieces[number][2])
        widths = np.array([self.pieces[number][2] for number in order], np.int64)
        for part in _chunks(widths):
            rows = np.zeros((part.stop - part.start, int(widths[part.stop - 1])), np.int64)
            for line, number in enumerate(order[part]):
                k, begin, length = self.pieces[number]
                rows[line, :length] = self.items[k][begin:begin + length]
            for number, found in zip(order[part], keys(rows, widths[part]), strict=True):
                for key in found.tolist():
                    by_key[key].append(number)
        self.by_key = dict(by_key)
        self.segments = {
            size: (np.array([s[0] for s in found], np.uint64)[order := np.argsort(
                np.array([s[0] for s in found], np.uint64), kind="stable")],
                np.array([s[1:] for s in found], np.int64)[order])
            for size, found in segments.items()
        }

    @staticmethod
    def _grams(words: np.ndarray, size: int) -> np.ndarray:
        count = len(words) - size + 1
        gram = np.zeros(max(count, 0), np.uint64)
        for j in range(size):
            gram = mixed(gram ^ words[j:j + count].astype(np.uint64))
        return gram

    def windows(self, words: np.ndarray, ends: np.ndarray) -> set[tuple[int, int, int]]:
        """Places (piece, row, first word) that an unchanged segment points at.

        `words` holds the texts of a batch one after the other with a 0 after each, `ends`
        where the next one begins. The row is that of the segment.
        """
        found: set[tuple[int, int, int]] = set()
        known = words > 0
        for size, (grams, targets) in self.segments.items():
            if len(words) < size:
                continue
            whole = known[:len(words) - size + 1].copy()
            for j in range(1, size):
                whole &= known[j:len(words) - size + 1 + j]
            spots = np.flatnonzero(whole)
            # Hash only the places where all words of a segment belong to the vocabulary.
            gram = np.zeros(len(spots), np.uint64)
            for j in range(size):
                gram = mixed(gram ^ words[spots + j].astype(np.uint64))
            left = np.searchsorted(grams, gram, "left")
            count = np.searchsorted(grams, gram, "right") - left
            hit = count > 0
            spots, left, count = spots[hit], left[hit], count[hit]
            if len(spots):
                which = np.repeat(left, count) + (
                    np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
                piece, offset = targets[which, 0], targets[which, 1]
                spots = np.repeat(spots, count)
                row = np.searchsorted(ends, spots, "right")
                found.update(zip(piece.tolist(), row.tolist(), (spots - offset).tolist(),
                                 strict=True))
        return found

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(row, item id, edits, first word, end word) of every leak, best place per item."""
        lists = [word_list(t) for t in texts]
        sizes = np.array([len(x) for x in lists], np.int64)
        ends = np.cumsum(sizes + 1)
        get = self.vocabulary.get
        flat: list[int] = []
        for found in lists:
            flat.extend(map(get, found, repeat(0)))
            flat.append(0)
        words = np.array(flat, np.int64)
        if not self.items or not len(words):
            return []
        by_width: dict[int, set[int]] = defaultdict(set)
        pairs: dict[tuple[int, int], list[int]] = defaultdict(list)
        for number, row, first in self.windows(words, ends):
            item, begin, n = self.pieces[number]
            slack = allowed(n)
            if slack:
                by_width[n].update(range(first - slack, first + slack + 1))
            else:  # no edit is allowed: the segment is the whole item
                pairs[row, item].append(first - begin)
        # Look the windows' keys up; a match names a piece, and so about where its item stands.
        wanted = sorted((n, first) for n, firsts in by_width.items() for first in firsts)
        widths = np.array([n for n, _ in wanted], np.int64)
        firsts = np.array([first for _, first in wanted], np.int64)
        for part in _chunks(widths):
            first, width = firsts[part], widths[part]
            step = np.arange(int(width[-1]))
            place = first[:, None] + step
            inside = (step < width[:, None]) & (place >= 0) & (place < len(words))
            rows = np.where(inside, words[np.clip(place, 0, len(words) - 1)], 0)
            middle = np.clip(first + width // 2, 0, len(words) - 1)
            text = np.searchsorted(ends, middle, "right").tolist()
            for at, row, found in zip(first.tolist(), text, keys(rows, width), strict=True):
                for number in {k for key in found.tolist() for k in self.by_key.get(key, ())}:
                    item, begin, _ = self.pieces[number]
                    pairs[row, item].append(at - begin)
        leaks = []
        for (row, item), firsts in sorted(pairs.items()):
            n, end = len(self.items[item]), int(ends[row]) - 1
            begin, slack = end - int(sizes[row]), allowed(n)
            best = None
            low = high = None
            for first in [*sorted(set(firsts)), None]:  # windows that overlap are read once
                if best is not None and not best[0]:
                    break
                if first is not None and high is not None and first - slack <= high:
                    high = max(high, first + n + slack)
                    continue
                if high is not None:
                    region = words[max(low, begin):min(high, end)]
                    edits, start, stop = edit_match(self.items[item], region)
                    if edits <= slack and (best is None or edits < best[0]):
                        shift = max(low, begin) - begin
                        best = (edits, start + shift, stop + shift)
                if first is not None:
                    low, high = first - slack, first + n + slack
            if best is not None:
                leaks.append((row, self.ids[item], *best))
        return leaks


def _indexes(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Index]:
    """Indexes over the items, a block of bounded size at a time."""
    kept = benchmark.select(
        F.col(item_col).cast("bigint").alias("item"), text_of(text_col).alias("body"))
    size = kept.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    count = max(1, math.ceil(size / ITEM_BYTES))
    block = F.pmod(F.xxhash64("item", "body"), F.lit(count))
    for number in range(count):
        found = kept.filter(block == number).distinct().collect()
        yield Index(sorted(((r.item, r.body) for r in found), key=lambda r: (r[0] or 0, r[1])))


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Documents that hold a passage within a fifth of an item's words in edits.

    Returns id, item_id, edits, first_word, end_word: a row per document row and item, at
    the place of fewest edits (words counted from 0, end exclusive). Every item and every
    whole text takes part; null texts have no words. Items of fewer than five words allow no
    edit, so only a copy counts; items without words match nothing. Repeated document rows give
    repeated rows; equal items count once. No documents or no items: no rows.
    """
    kept = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body"))
    kind = kept.schema["id"].dataType.simpleString()
    names = [id_col, "item_id", "edits", "first_word", "end_word"]
    made = None
    for index in _indexes(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(index)  # of at most ITEM_BYTES of text

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches, "body", BATCH_BYTES):
                found = shared.value.matches(block.column("body").to_pylist())
                rows = pa.array([f[0] for f in found], pa.int64())
                yield from pa.table(
                    [block.column("id").take(rows), *(
                        pa.array([f[k] for f in found], pa.int64()) for k in range(1, 5))],
                    names=names).to_batches()

        part = kept.mapInArrow(run, f"`{id_col}` {kind}, item_id bigint, edits bigint, "
                                    "first_word bigint, end_word bigint")
        made = part if made is None else made.unionByName(part)
    return made


def clean(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """`docs` without the rows that `leaks` reports; same columns, no shuffle.

    Null, empty and wordless texts stay, repeated rows stay or go together, whatever their
    ids; without items all rows stay, and other columns may have any names.
    """
    name = docs.columns[[c.lower() for c in docs.columns].index(text_col.lower())]
    for index in _indexes(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches, name, BATCH_BYTES):
                texts = [t or "" for t in block.column(name).to_pylist()]
                keep = np.ones(block.num_rows, bool)
                keep[[f[0] for f in shared.value.matches(texts)]] = False
                yield from block.filter(pa.array(keep)).to_batches()

        docs = docs.mapInArrow(run, docs.schema)
    return docs
