"""Deterministic ranks and top-k."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan import settings


def stable_score(score: Column) -> Column:
    """A score that does not depend on the order its parts were added in."""
    return F.round(score, settings.SCORE_DIGITS)


def top_k(scores: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """The `k` best rows per query, with a 0-based `rank`; ties go to chunk_id.

    The rank filter is pushed below the shuffle, so a task sends at most `k` rows
    per query.
    """
    order = W.partitionBy(by).orderBy(F.desc("score"), "chunk_id")
    return (
        scores.withColumn("_row", F.row_number().over(order))
        .filter(F.col("_row") <= k)
        .withColumn("rank", F.col("_row") - 1)
        .drop("_row")
    )


def first_k(scores: DataFrame, k: int) -> DataFrame:
    """The `k` best rows of a single query."""
    return scores.orderBy(F.desc("score"), "chunk_id").limit(k)


class BestOfBlocks:
    """The k best entries so far of each of `n` queries, from blocks of scores.

    `rows` are the numbers of the queries; `settle` comes before reading them.
    """

    def __init__(self, n: int, k: int):
        self.k, self.waiting, self._late = k, 0, []
        self.least = np.full(n, -np.inf)
        self.rows, self.scores = np.zeros(0, np.int64), np.zeros(0)
        self.ids = self.docs = np.zeros(0, object)

    def add(self, found: np.ndarray, ids: np.ndarray, docs: np.ndarray, first: int = 0) -> None:
        """Scores of queries from number `first`, -inf for none, for entries in order of ids."""
        # Scores are equal once rounded, so those just below count too.
        slack = 2 * 10.0 ** -settings.SCORE_DIGITS
        least = self.least[first:first + len(found)]
        wanted = found >= (least - slack)[:, None]
        if found.shape[1] > self.k and np.count_nonzero(wanted) > len(found):
            at = found.shape[1] - self.k
            kth = np.partition(found, at, axis=1)[:, at]
            wanted &= found >= (kth - slack)[:, None]
        row, column = np.nonzero(wanted & (found > -np.inf))
        if not len(row):
            return
        scores = np.round(found[row, column], settings.SCORE_DIGITS)
        kept = _leaders(row, scores, column, self.k)
        self._late.append((row[kept] + first, scores[kept], ids[column[kept]], docs[column[kept]]))
        self.waiting += len(kept)
        if self.waiting > max(len(self.rows), len(self.least)):
            self.settle()

    def settle(self) -> None:
        """Cut what has come in to the best."""
        late = [(self.rows, self.scores, self.ids, self.docs), *self._late]
        rows, scores, ids, docs = (np.concatenate(x) for x in zip(*late, strict=True))
        kept = _leaders(rows, scores, in_order(ids), self.k)
        self.rows, self.scores, self.ids, self.docs = (x[kept] for x in (rows, scores, ids, docs))
        self._late, self.waiting = [], 0
        lowest = np.full(len(self.least), np.inf)
        np.minimum.at(lowest, self.rows, self.scores)
        full = np.bincount(self.rows, minlength=len(lowest)) >= self.k
        self.least[full] = lowest[full]


def _leaders(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best entries of every row number, ties by id, in that order."""
    order = np.lexsort((ids, -scores, rows))
    ordered = rows[order]
    begins = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(order) else order
    place = np.arange(len(order)) - np.repeat(begins, np.diff(np.r_[begins, len(order)]))
    return order[place < k]


def in_order(ids: np.ndarray) -> np.ndarray:
    """Numbers in the order of the ids; null comes first."""
    plain = np.array(["" if i is None else i for i in ids], object)
    return np.unique(plain, return_inverse=True)[1] if len(plain) else np.zeros(0, np.int64)
