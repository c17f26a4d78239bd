"""Toxicity by a classifier chain of linear models over hashed words.

Categories are predicted one after the other; the model of a later category also sees the
probabilities of the earlier ones. In training those are out-of-fold predictions, made by
models that have not seen the row, so a later model meets them as they will be in use.

The chain is fitted on a bounded sample of labelled rows (`max_rows`); prediction is a map
over all documents with weights of fixed size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import text_of, words

BUCKETS = 1 << 20
FOLDS = 5
PREFIXES = (4, 5, 6)
EVIDENCE = 5.5  # standard errors
KEPT_WORDS = 500_000
BATCH_ROWS = 2048


@dataclass(frozen=True)
class Model:
    """A linear model: weights of some hashed words, of earlier categories, and a bias."""

    category: str
    buckets: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float


def buckets(word: bytes) -> list[int]:
    """The hashed word, without the punctuation around it, and its hashed beginnings.

    Beginnings of a few bytes let a model know inflected words it has not seen.
    """
    core = word.strip(b".,;:!?\"'()[]{}<>*_-")
    starts = [core[:n] + b"*" for n in PREFIXES if len(core) >= n]
    return [zlib.crc32(part) % BUCKETS for part in (core, *starts)]


def features_of(text: str) -> np.ndarray:
    """The distinct hashed features of a text."""
    return np.unique(np.array([b for w in set(words(text)) for b in buckets(w)], np.int64))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class _Rows:
    """A sparse 0/1 matrix: the distinct hashed words of each row."""

    def __init__(self, rows: list[np.ndarray]):
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.words = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(rows)), self.sizes)

    def counts(self, chosen: np.ndarray) -> np.ndarray:
        return np.bincount(self.words[chosen[self.row]], minlength=BUCKETS)

    def dense(self, buckets: np.ndarray) -> np.ndarray:
        place = np.full(BUCKETS, -1)
        place[buckets] = np.arange(len(buckets))
        found = place[self.words]
        made = np.zeros((len(self.sizes), len(buckets)), np.float32)
        made[self.row[found >= 0], found[found >= 0]] = 1
        return made


def _fit_one(
    category: str, rows: _Rows, earlier: np.ndarray, y: np.ndarray, use: np.ndarray,
    features: int, penalty: float = 1e-5, steps: int = 800,
) -> Model:
    """Class-balanced logistic regression on the words that tell the classes apart best."""
    positive, negative = use & (y == 1), use & (y == 0)
    n1, n0 = positive.sum(), negative.sum()
    if not n1 or not n0:  # one class only: nothing to tell apart
        none = np.zeros(0, np.int64)
        bias = 0.0 if not (n1 or n0) else (8.0 if n1 else -8.0)
        return Model(category, none, none.astype(float), np.zeros(earlier.shape[1]), bias)
    a, b = rows.counts(positive) / n1, rows.counts(negative) / n0
    both = (a * n1 + b * n0) / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        strength = np.abs(a - b) / np.sqrt(both * (1 - both) * (1 / n1 + 1 / n0))
    # Rare words differ by chance, and there are many of them: ask for clear evidence.
    seen = np.flatnonzero(strength >= EVIDENCE)
    chosen = np.sort(seen[np.argsort(-strength[seen], kind="stable")[:features]])

    x = np.hstack([rows.dense(chosen)[use], earlier[use].astype(np.float32)])
    target = y[use].astype(np.float32)
    share = np.where(target == 1, 0.5 / n1, 0.5 / n0).astype(np.float32)
    w, bias = np.zeros(x.shape[1], np.float32), 0.0
    # Accelerated descent; the step follows from the largest curvature the loss can have.
    probe = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        probe = x.T @ (share * (x @ probe))
        top = float(np.linalg.norm(probe)) or 1.0
        probe /= top
    rate = 1 / (0.25 * (top + 1) + penalty)
    ahead, ahead_bias = w, bias
    for step in range(steps):
        error = share * (_sigmoid(x @ ahead + ahead_bias) - target)
        new = ahead - rate * (x.T @ error + penalty * ahead)
        new_bias = ahead_bias - rate * float(error.sum())
        pull = step / (step + 3)
        ahead, ahead_bias = new + pull * (new - w), new_bias + pull * (new_bias - bias)
        w, bias = new, new_bias
    cut = len(chosen)
    return Model(category, chosen, w[:cut].astype(float), w[cut:].astype(float), float(bias))


def _apply(model: Model, rows: _Rows, earlier: np.ndarray) -> np.ndarray:
    weight = np.zeros(BUCKETS)
    weight[model.buckets] = model.weights
    z = np.bincount(rows.row, weights=weight[rows.words], minlength=len(rows.sizes))
    return _sigmoid(z + earlier @ model.earlier + model.bias)


def fit_rows(
    features: list[np.ndarray], labels: np.ndarray, folds: np.ndarray, categories: list[str],
    kept_words: int = 512,
) -> list[Model]:
    """The chain's models; `labels` has a column per category with -1 where unknown."""
    rows, models = _Rows(features), []
    earlier = np.zeros((len(features), 0))
    for k, category in enumerate(categories):
        y = labels[:, k]
        known = y >= 0
        out = np.zeros(len(y))
        for fold in range(FOLDS):
            held = folds == fold
            if held.any() and k + 1 < len(categories):
                part = _fit_one(category, rows, earlier, y, known & ~held, kept_words)
                out[held] = _apply(part, rows, earlier)[held]
        models.append(_fit_one(category, rows, earlier, y, known, kept_words))
        earlier = np.column_stack([earlier, out])
    return models


def fit(
    docs: DataFrame, labels: DataFrame, categories: list[str], max_rows: int = 8_000,
    id_col: str = "doc_id", text_col: str = "text",
) -> list[Model]:
    """Fit the chain on at most `max_rows` documents of distinct texts for every category.

    The sample is, of each category, the rows of `docs` with a known label and the smallest
    hash of the id, so it does not depend on the layout of the tables. Labels that are null
    or for unknown documents neither count nor take a place; with no labels at all every
    probability is one half, which rejects nothing.
    """
    names = [f"label_{k}" for k in range(len(categories))]
    known = (
        labels.select(F.col(id_col).alias("id"), *(
            F.coalesce(F.col(c).cast("int"), F.lit(-1)).alias(n)
            for c, n in zip(categories, names, strict=True)))
        .filter(F.col("id").isNotNull()).groupBy("id").agg(*(F.max(n).alias(n) for n in names))
        .join(docs.select(F.col(id_col).alias("id")), "id", "left_semi"))
    sample = reduce(DataFrame.unionByName, (
        known.filter(F.col(n) >= 0).orderBy(F.xxhash64("id"), "id").limit(max_rows)
        for n in names)).distinct()  # bounded, so it may be broadcast
    joined = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body")).join(
        F.broadcast(sample), "id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies, *rest = batch.columns
            found = [features_of(t).tobytes() for t in bodies.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(found, pa.binary()), *rest], names=["id", "buckets", *names])

    kind = sample.schema["id"].dataType.simpleString()
    columns = ", ".join(f"{n} int" for n in names)
    # Copies of one text in the sample would weigh as many; the rows are max_rows a category at most.
    taken = joined.mapInArrow(extract, f"id {kind}, buckets binary, {columns}").groupBy(
        "buckets").agg(F.min("id").alias("id"), *(F.max(n).alias(n) for n in names))

    def train(_, table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        features = [np.frombuffer(b, np.int64) for b in table.column("buckets").to_pylist()]
        marks = np.column_stack([table.column(n).to_numpy() for n in names])
        folds = np.array([zlib.crc32(str(i).encode()) % FOLDS
                          for i in table.column("id").to_pylist()])
        models = fit_rows(features, marks, folds, categories)
        return pa.table({
            "category": [m.category for m in models],
            "buckets": pa.array([m.buckets for m in models], pa.list_(pa.int64())),
            "weights": pa.array([m.weights for m in models], pa.list_(pa.float64())),
            "earlier": pa.array([m.earlier for m in models], pa.list_(pa.float64())),
            "bias": [m.bias for m in models],
        })

    fitted = taken.groupBy(F.lit(0).alias("all")).applyInArrow(
        lambda key, table: train(key, table),
        "category string, buckets array<bigint>, weights array<double>, "
        "earlier array<double>, bias double",
    ).collect()  # a few models of fixed size
    made = {r.category: Model(
        r.category, np.array(r.buckets, np.int64), np.array(r.weights), np.array(r.earlier),
        r.bias) for r in fitted}
    none = np.zeros(0)
    return [
        made.get(c) or Model(c, none.astype(np.int64), none, np.zeros(k), 0.0)
        for k, c in enumerate(categories)
    ]


class _Scorer:
    """Applies a chain to texts; keeps the weights of words it has met, up to a bound."""

    def __init__(self, models: list[Model]):
        self._models = models
        self._at: dict[bytes, tuple[int, ...]] = {}
        places = np.unique(np.concatenate([m.buckets for m in models]))
        self._place = {int(b): i for i, b in enumerate(places)}
        self._weights = np.zeros((len(models), len(places)))
        for k, m in enumerate(models):
            self._weights[k, np.searchsorted(places, m.buckets)] = m.weights

    def __call__(self, text: str) -> list[float]:
        at, place = self._at, self._place
        if len(at) > KEPT_WORDS:
            at.clear()
        distinct = set(words(text))
        for word in distinct.difference(at):
            at[word] = tuple(place[b] for b in buckets(word) if b in place)
        known = list(set(chain.from_iterable(map(at.__getitem__, distinct))))
        sums = self._weights[:, known].sum(axis=1) if known else np.zeros(len(self._models))
        made: list[float] = []
        for k, m in enumerate(self._models):
            z = sums[k] + m.bias + float(np.dot(m.earlier, made))
            made.append(float(_sigmoid(np.array(z))))
        return made


def predict(
    docs: DataFrame, models: list[Model], text_col: str = "text"
) -> DataFrame:
    """`docs` with a p_<category> column per category of the chain; no shuffle.

    Every row stays. A null or empty text has no words, so only the biases speak. A column
    of `docs` with the name of a new one is replaced.
    """
    names = [f"p_{m.category}" for m in models]
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in names))
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _Scorer(models)
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(start, BATCH_ROWS)
                made = np.array([score(t or "") for t in batch.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *(pa.array(made[:, k]) for k in range(len(names)))],
                    names=[*batch.schema.names, *names])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema]
    return kept.mapInArrow(run, ", ".join([*fields, *(f"`{n}` double" for n in names)]))


CHAIN = ["quality", "toxic"]
THRESHOLD = 0.5


def rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the chain finds toxic: doc_id, p_quality, p_toxic.

    A row per row found: repeated rows come back as often, a null id stays null. Null and
    empty texts are judged by the biases alone.
    """
    models = fit(docs, labels, CHAIN)
    return predict(docs.select("doc_id", "text"), models).filter(
        F.col("p_toxic") > THRESHOLD).drop("text")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the rows that the chain finds toxic, with the same columns.

    Null and empty texts are judged by the biases alone; repeated rows share a verdict and
    all stay or go. Other columns can bear any name and hold nulls; they come back as
    they were. No rows give no rows.
    """
    models = fit(docs, labels, CHAIN)
    # Under plain names nothing clashes with the columns of the chain.
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    judged = predict(plain, models, f"c{docs.columns.index('text')}")
    return judged.filter(F.col("p_toxic") <= THRESHOLD).select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
