"""Exact sub-word token counts of every prefix of a text, by dynamic programming.

For a byte-pair vocabulary whose merges follow piece scores, a sequence of pieces is the
encoding of its text exactly if each piece encodes to itself and each neighbouring pair
encodes to that pair. So the encoding of a prefix is the encoding of a shorter prefix plus
one last piece, and there is one such piece: the table `last piece, count` of every prefix
is filled from left to right, and answers counts, cuts and budgets without encoding again.

Text is first cut where no piece of the vocabulary can reach across; those units repeat a
lot, so each worker keeps the tables' last entries of the units it has seen.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import text_of

SPACE = "▁"  # stands for a space inside pieces
KEPT_UNITS = 500_000
BATCH_ROWS = 2048


class PrefixCounts:
    """Token counts of prefixes under a score-ordered byte-pair model with byte fallback."""

    def __init__(self, model: bytes):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        special = (library.is_unknown, library.is_control, library.is_unused, library.is_byte)
        ids = range(library.vocab_size())
        self._score = {
            library.id_to_piece(i): library.get_score(i)
            for i in ids if not any(kind(i) for kind in special)
        }
        order = sorted(set(self._score.values()), reverse=True)
        at = {score: rank for rank, score in enumerate(order)}
        self._rank = {p: at[score] for p, score in self._score.items()}  # ties share a rank
        self._parts: dict[str, tuple[str, str]] = {}
        # A piece that its own merges never reach is never part of an encoding.
        for piece in sorted((p for p in self._score if len(p) > 1), key=len):
            parts = self._merged(piece)
            if len(parts) == 2:
                self._parts[piece] = (parts[0], parts[1])
        self._longest = max(map(len, self._parts), default=1)
        # Letters and other characters need no common unit unless a piece mixes them.
        odd = "".join(sorted({
            c for p in self._parts for c in p
            if re.match(r"[^\W\d_]", c) and not c.isalpha()
        }))
        letter, other = rf"[^\W\d_{odd}]", rf"(?:[^\w{SPACE}]|[\d_{odd}])"
        mixed = re.compile(f"{letter}{other}|{other}{letter}")
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self._parts):
            self._units = re.compile(r".+", re.S)
        elif any(mixed.search(p) for p in self._parts):
            self._units = re.compile(rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
        else:
            self._units = re.compile(rf"{SPACE}*(?:{letter}+|{other}+)|{SPACE}+")
        self._pairs: dict[tuple[str, str], bool] = {}
        self._totals: dict[str, int] = {}  # by unit
        self._chunks: dict[str, int] = {}  # by what stands between spaces

    def _merged(self, text: str) -> list[str]:
        """The last two parts that merges leave of a piece: best score first, ties left."""
        parts = list(text)
        while len(parts) > 2:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self._rank.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _follows(self, left: str, right: str) -> bool:
        """Whether the two pieces stay apart when their common text is encoded.

        Undoes the later of the two pieces' last merges, again and again: the parts that
        then touch must not have been mergeable at an earlier turn than the undone merge.
        """
        known = self._pairs.get((left, right))
        if known is not None:
            return known
        a, b, turn, known = left, right, float("inf"), True
        while known:
            joint = self._rank.get(a + b)
            if joint is not None and joint < turn:
                known = False
                break
            made_a = self._rank[a] if a in self._parts else -1
            made_b = self._rank[b] if b in self._parts else -1
            if made_a < 0 and made_b < 0:
                break
            if made_a > made_b:
                turn, a = made_a, self._parts[a][1]
            else:  # at equal rank the place further left merges first
                turn, b = made_b + 1, self._parts[b][0]
        if len(self._pairs) < 4 * KEPT_UNITS:
            self._pairs[left, right] = known
        return known

    def _extend(self, text: str, counts: list[int], last: list[str]) -> None:
        """Fill the two tables, which already hold some prefixes, for the rest of `text`."""
        parts, longest, pairs = self._parts, self._longest, self._pairs
        for end in range(len(counts), len(text) + 1):
            for start in range(end - longest if end > longest else 0, end):
                piece = text[start:end]
                if piece in parts:
                    price = 1
                elif start == end - 1:
                    price = 1 if piece in self._score else len(piece.encode())
                else:
                    continue
                if not start or pairs.get((last[start], piece)) or (
                    (last[start], piece) not in pairs and self._follows(last[start], piece)
                ):
                    counts.append(counts[start] + price)
                    last.append(piece)
                    break

    def unit(self, text: str) -> list[int]:
        """Token counts of all prefixes of one unit, the empty one included."""
        counts, last = [0], [""]
        self._extend(text, counts, last)
        return counts

    def _learn(self, units: set[str]) -> None:
        """Totals of units not met before; sorted, so that common prefixes share entries."""
        counts, last, previous = [0], [""], ""
        for unit in sorted(units.difference(self._totals)):
            common = min(len(unit), len(previous))
            while common and not unit.startswith(previous[:common]):
                common -= 1
            del counts[common + 1:], last[common + 1:]
            self._extend(unit, counts, last)
            self._totals[unit] = counts[-1]
            previous = unit

    def _normal(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def _split(self, text: str) -> list[str]:
        """The normal form of a text, cut before the space marks that follow another character.

        Nothing joins across those cuts; the mark itself is left out where it stands alone.
        """
        if not text:
            return []
        chunks = text.replace(SPACE, " ").split(" ")
        if "" not in chunks:
            return chunks
        merged, marks = [], ""
        for chunk in chunks[:-1]:
            if chunk:
                merged.append(marks + chunk)
                marks = ""
            else:
                marks += SPACE
        return [*merged, marks + chunks[-1]]

    def counts(self, texts: list[str]) -> list[int]:
        """The token count of each text: the sum of the last entries of its units' tables."""
        found = [self._split(t) for t in texts]
        present = set().union(*found)
        if len(self._chunks) > KEPT_UNITS:  # what this batch needs is what batches often need
            self._chunks = {c: self._chunks[c] for c in present if c in self._chunks}
        new = present.difference(self._chunks)
        units = {c: self._units.findall(SPACE + c) or [SPACE] for c in new}
        if len(self._totals) > KEPT_UNITS:
            needed = set().union(*units.values())
            self._totals = {u: self._totals[u] for u in needed if u in self._totals}
        self._learn(set().union(*units.values()))
        total = self._totals.__getitem__
        self._chunks.update((c, sum(map(total, u))) for c, u in units.items())
        chunk = self._chunks.__getitem__
        return [sum(map(chunk, these)) for these in found]

    def prefixes(self, text: str) -> list[int]:
        """Token counts of the prefixes of 0, 1, 2, ... code points."""
        counts, before = [], 0
        for unit in self._units.findall(self._normal(text)):
            table = self.unit(unit)
            counts.extend(before + c for c in table[1:])
            before += table[-1]
        # The leading space mark belongs to every prefix but the empty one.
        return [0, *counts[1:]]


_loaded: dict[bytes, PrefixCounts] = {}


def loaded(model: bytes) -> PrefixCounts:
    """The tables of a model, built once per worker."""
    if model not in _loaded:
        _loaded.clear()
        _loaded[model] = PrefixCounts(model)
    return _loaded[model]


def _mapped(
    docs: DataFrame, text_col: str, result: str, kind: pa.DataType,
    compute: Callable[[PrefixCounts, list[str]], list], model_path: str,
) -> DataFrame:
    """`docs` with one more column that `compute` makes of the text; no shuffle."""
    with open(model_path, "rb") as file:
        model = file.read()  # a vocabulary of fixed size, shipped with the function
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = loaded(model)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                rows = batch.slice(start, BATCH_ROWS)
                made = compute(counts, [t or "" for t in rows.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(made, kind)], names=[*rows.schema.names, result]
                )

    types = {pa.int64(): "bigint", pa.string(): "string", pa.list_(pa.int32()): "array<int>"}
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return docs.mapInArrow(run, ", ".join([*fields, f"`{result}` {types[kind]}"]))


def count_tokens(
    docs: DataFrame, model_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Bytes and tokens of every text, and whether the tokens exceed `limit`.

    Returns id, n_bytes, n_tokens, over_limit, a row per row of `docs`; repeated rows and
    ids stay, a null id stays null, a null text counts as empty (no tokens). Other columns
    are not read. Token counts equal the library's without begin, end or special tokens.
    """
    kept = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body"))
    counted = _mapped(
        kept.withColumn("n_bytes", F.octet_length("body").cast("bigint")),
        "body", "n_tokens", pa.int64(), PrefixCounts.counts, model_path,
    )
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )


def prefix_counts(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id and prefix_tokens: entry i is the exact token count of the first i code points.

    An empty or null text has the one entry 0.
    """
    kept = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body"))

    def tables(counts: PrefixCounts, texts: list[str]) -> list[list[int]]:
        return [counts.prefixes(t) for t in texts]

    made = _mapped(kept, "body", "prefix_tokens", pa.list_(pa.int32()), tables, model_path)
    return made.select(F.col("id").alias(id_col), "prefix_tokens")


def fit_budget(
    docs: DataFrame, model_path: str, budget: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id and the longest prefix of the text that encodes to at most `budget` tokens."""

    def cut(counts: PrefixCounts, texts: list[str]) -> list[str]:
        # A longer prefix may have fewer tokens, so all entries are looked at.
        return [
            t[:max(i for i, n in enumerate(counts.prefixes(t)) if n <= budget)] for t in texts
        ]

    kept = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body"))
    made = _mapped(kept, "body", "kept", pa.string(), cut, model_path)
    return made.select(F.col("id").alias(id_col), F.col("kept").alias(text_col))
