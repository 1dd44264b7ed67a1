"""Toxicity by a classifier chain over hashed words.

Categories are label columns that the caller names, and are predicted one after
another. The model of each is linear in the words of a text (and their first
letters, which catches inflected forms) and in the probabilities that the earlier
models of the chain gave. Those are learnt from predictions out of fold: in
training, a row's earlier probabilities come from models that did not see the
row, as they do when new texts are scored.

The chain is fitted on a bounded sample of labelled rows in numpy. Which features
enough texts of the sample have is counted on Spark, and the driver gets those and
their numbers only. Scoring runs over all documents in one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.linear import bounded_sample, descend, sigmoid
from tarn.llm.rolling import Words, mix, slices
from tarn.llm.shared import saved

# Labelled rows that the chain is fitted on at most.
SAMPLE_ROWS = 12_000
FOLDS = 3
# Features that a model keeps at most, those that tell the category most surely.
FEATURES = 3_000
# Texts of the sample that must have a feature for it to be looked at.
SEEN_IN = 3
# Features that a task holds before it passes on how often it saw each.
HELD_FEATURES = 1_000_000
# Texts of the sample whose features are worked on at once.
BLOCK_TEXTS = 500
PREFIX_BYTES = 6
THRESHOLD = 0.5

# Letters: ASCII ones and all bytes of longer characters.
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every feature of the texts."""
    words = Words(data, offsets, IS_LETTER[data])
    whole, start = words.hashes(data, fold=True), mix(words.hashes(data, fold=True, most=PREFIX_BYTES), 9)
    rows = words.rows()
    return np.concatenate((rows, rows)), np.concatenate((whole, start))


def extract(batches):
    """For the labelled sample: the distinct features of each text."""
    for batch in batches:
        features = []
        for first, last, data, offsets in slices(batch.column("text")):
            rows, hashes = word_features(data, offsets)
            order = np.argsort(rows, kind="stable")
            bounds = np.searchsorted(rows[order], np.arange(last - first + 1))
            features.extend(np.unique(hashes[order[a:b]]).tobytes() for a, b in zip(bounds, bounds[1:], strict=False))
        columns = [batch.column("doc_id"), batch.column("marks"), pa.array(features, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "marks", "features"])


@dataclass
class Model:
    """Weights of feature hashes (sorted), of earlier probabilities, and a constant."""

    hashes: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    constant: float

    def log_odds(self, n: int, rows: np.ndarray, hashes: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes
            pairs = np.unique(rows[hit].astype(np.int64) * len(self.hashes) + at[hit])
            score = np.bincount(pairs // len(self.hashes), self.weights[pairs % len(self.hashes)], minlength=n)
        else:
            score = np.zeros(n)
        return score + earlier @ self.earlier + self.constant


def feature_counts(batches):
    """How many texts of the task have each feature."""

    def flush(held):
        features, times = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(features.view(np.int64)), pa.array(times)], names=["feature", "times"])

    held, size = [], 0
    for batch in batches:
        for features in batch.column("features").to_pylist():
            held.append(np.frombuffer(features, np.uint64))
            size += len(held[-1])
            if size >= HELD_FEATURES:
                yield flush(held)
                held, size = [], 0
    if size:
        yield flush(held)


def common_features(known: DataFrame) -> np.ndarray:
    """The features that at least ``SEEN_IN`` texts have, sorted."""
    counts = known.select("features").mapInArrow(feature_counts, "feature long, times long")
    counts = counts.groupBy("feature").agg(F.sum("times").alias("times")).filter(F.col("times") >= SEEN_IN)
    return np.sort(counts.select("feature").toArrow().column("feature").to_numpy().view(np.uint64))


def number_features(vocabulary):
    """Texts with the places of their features in the vocabulary, without the others."""

    def run(batches):
        features = vocabulary.value
        for batch in batches:
            numbers = []
            for own in batch.column("features").to_pylist():
                own = np.frombuffer(own, np.uint64)
                at = np.searchsorted(features, own)
                numbers.append(at[np.append(features, np.uint64(0))[at] == own].astype(np.int32).tobytes())
            columns = [batch.column("doc_id"), batch.column("marks"), pa.array(numbers, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "marks", "numbers"])

    return run


class Texts:
    """The feature numbers of the sampled texts, one text after the other."""

    def __init__(self, vocabulary: np.ndarray, numbers: list[bytes]):
        self.vocabulary = vocabulary
        self.ends = np.concatenate(([0], np.cumsum([len(n) // 4 for n in numbers]))).astype(np.int64)
        self.columns = np.frombuffer(b"".join(numbers), np.int32)

    def __len__(self) -> int:
        return len(self.ends) - 1

    def blocks(self):
        """Text and feature number of every pair, some texts at a time."""
        for first in range(0, len(self), BLOCK_TEXTS):
            bounds = self.ends[first : first + BLOCK_TEXTS + 1]
            row = np.repeat(np.arange(first, first + len(bounds) - 1), np.diff(bounds))
            yield row, self.columns[bounds[0] : bounds[-1]]

    def log_odds(self, model: Model, earlier: np.ndarray) -> np.ndarray:
        weights = np.zeros(len(self.vocabulary))
        weights[np.searchsorted(self.vocabulary, model.hashes)] = model.weights
        score = np.zeros(len(self))
        for row, column in self.blocks():
            score += np.bincount(row, weights[column], minlength=len(self))
        return score + earlier @ model.earlier + model.constant


def fit(texts: Texts, earlier: np.ndarray, label: np.ndarray, use: np.ndarray) -> Model:
    """A logistic model from the texts of ``use``, on the surest features."""
    size = len(texts.vocabulary)
    total, positive = np.zeros(size, np.int64), np.zeros(size)
    for row, column in texts.blocks():
        known = use[row]
        row, column = row[known], column[known]
        total += np.bincount(column, minlength=size)
        positive += np.bincount(column, label[row], minlength=size)
    n, n_pos = use.sum(), label[use].sum()
    p, q = (positive + 0.5) / (n_pos + 1), (total - positive + 0.5) / (n - n_pos + 1)
    sure = np.abs(np.log(p / q)) / np.sqrt(1 / (positive + 0.5) + 1 / (total - positive + 0.5))
    sure[total < SEEN_IN] = 0
    chosen = np.sort(np.argsort(-sure, kind="stable")[:FEATURES])
    chosen = chosen[sure[chosen] > 1]
    number = np.full(size, -1, np.int32)
    number[chosen] = np.arange(len(chosen))
    order = np.flatnonzero(use)
    place = np.zeros(len(use), np.int32)
    place[order] = np.arange(len(order))
    pairs = []
    for row, column in texts.blocks():
        column = number[column]
        wanted = use[row] & (column >= 0)
        pairs.append((place[row[wanted]], column[wanted]))
    row, column = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (place[:0], number[:0])
    y, extra, k = label[order], earlier[order], len(chosen)

    def gradient(w):
        score = np.bincount(row, w[:k][column], minlength=len(y)) + extra @ w[k:-1] + w[-1]
        error = (sigmoid(score) - y) / len(y)
        slope = np.concatenate((np.bincount(column, error[row], minlength=k), extra.T @ error, [error.sum()]))
        slope[:-1] += 1e-4 * w[:-1]
        return slope

    w = descend(gradient, np.zeros(k + extra.shape[1] + 1), 150, 0.1)
    return Model(texts.vocabulary[chosen], w[:k], w[k:-1], float(w[-1]))


def fit_chain(texts: Texts, labels: np.ndarray) -> list[Model]:
    """One model for each column of ``labels``, fed the earlier ones' probabilities out of fold.

    A model learns from the rows that have its label; others are NaN.
    """
    n = len(texts)
    fold = mix(np.arange(n, dtype=np.uint64), 17) % np.uint64(FOLDS)
    earlier = np.zeros((n, 0))
    chain = []
    for label in labels.T:
        known = ~np.isnan(label)
        label = np.where(known, label, 0)
        chain.append(fit(texts, earlier, label, known))
        out_of_fold = texts.log_odds(chain[-1], earlier)
        for k in range(FOLDS):
            held = fold == k
            if held.any() and (known & ~held).any():
                out_of_fold[held] = texts.log_odds(fit(texts, earlier, label, known & ~held), earlier)[held]
        earlier = np.column_stack((earlier, sigmoid(out_of_fold)))
    return chain


def score_with(chain, categories: tuple[str, ...], threshold: float):
    def run(batches):
        models = chain.value
        for batch in batches:
            found = [np.zeros((0, len(models)))]
            for first, last, data, offsets in slices(batch.column("text")):
                rows, hashes = word_features(data, offsets)
                earlier = np.zeros((last - first, 0))
                for model in models:
                    odds = model.log_odds(last - first, rows, hashes, earlier)
                    earlier = np.column_stack((earlier, sigmoid(odds)))
                found.append(earlier)
            scores = np.concatenate(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, scores.T.copy()), pa.array(scores[:, -1] >= threshold)],
                names=["doc_id", *(f"p_{c}" for c in categories), "toxic"],
            )

    return run


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = SAMPLE_ROWS,
    threshold: float = THRESHOLD,
    categories: tuple[str, ...] = ("toxic",),
) -> DataFrame:
    """Probability of each category and the verdict for every document.

    ``docs`` has ``doc_id`` and ``text``, ``labels`` has ``doc_id`` and a column
    (0 or 1) for each of ``categories``, in the order of the chain; other columns
    are ignored. Gives ``doc_id``, ``p_`` and its name for each category, and
    ``toxic`` (the last probability is at least ``threshold``), one row for each
    input row. The chain learns from at most ``sample_rows`` labelled documents
    and keeps ``FEATURES`` words and word beginnings for each category. A label
    may be null, and its row is then learnt from for the other categories only;
    rows without any label or without a document are left out. Of several labels
    for a document the highest counts, and of several documents that share a
    labelled id one is learnt from; all are scored. A null or empty text gets the
    models' constants, and texts may be of any length. Without any label all
    probabilities are one half, and no document is toxic. Empty ``docs`` give an
    empty result.
    """
    spark = docs.sparkSession
    marks = [F.max(F.col(c).cast("double")).alias(c) for c in categories]
    labelled = labels.filter(F.col("doc_id").isNotNull() & F.coalesce(*categories).isNotNull()).groupBy("doc_id").agg(*marks)
    labelled = labelled.select("doc_id", F.array(*categories).alias("marks"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Bounded by sample_rows, so that it can be broadcast.
    sample = F.broadcast(bounded_sample(labelled, sample_rows))
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = texts.join(sample, "doc_id").groupBy("doc_id", "marks").agg(F.max_by("text", F.xxhash64("text")).alias("text"))
    known = saved(known.mapInArrow(extract, f"doc_id {kind}, marks array<double>, features binary"), "features")
    vocabulary = common_features(known)
    numbered = number_features(spark.sparkContext.broadcast(vocabulary))
    table = known.mapInArrow(numbered, f"doc_id {kind}, marks array<double>, numbers binary").toArrow()
    table = table.sort_by([("doc_id", "ascending")])
    found = [[np.nan if mark is None else mark for mark in row] for row in table.column("marks").to_pylist()]
    found = np.array(found, float).reshape(-1, len(categories))
    chain = fit_chain(Texts(vocabulary, table.column("numbers").to_pylist()), found)
    if np.isnan(found[:, -1]).all():
        threshold = 2.0
    columns = ", ".join(f"p_{c} double" for c in categories)
    score = score_with(spark.sparkContext.broadcast(chain), tuple(categories), threshold)
    return texts.mapInArrow(score, f"doc_id {kind}, {columns}, toxic boolean")
