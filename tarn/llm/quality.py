"""Text quality from positive and unlabelled examples.

Only trusted good texts are labelled; web text is an unknown mixture. The risk of
a classifier on good and bad texts is written through the two samples at hand:
the class prior times the loss on the positives, plus the loss of unlabelled
texts as bad less what the positives among them add to it. That difference
estimates the risk on bad texts, which cannot be negative; where a model drives
it below zero it is overfitting, and the step goes the other way (the
non-negative estimator). The prior is estimated from the same two samples: the
largest share of positives that is consistent with how often each sample reaches
high scores, on a part that the scores were not fitted on.

The model is additive over measures of a text's form, each cut into bins. Only
the labelled positives are a bounded sample: each step of the fit adds up the
slopes of all unlabelled documents on Spark, and where bins are cut and how many
documents reach high scores is counted over all of them too. Measures are taken
once and written; steps read the places of bins, two bytes for each measure.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.linear import bounded_sample, descend, sigmoid
from tarn.llm.rolling import IS_SPACE, Words, slices
from tarn.llm.shared import saved

# Labelled positives that the model is fitted on at most.
SAMPLE_ROWS = 12_000
# Steps of the fit that estimates the prior, and of the one after it that goes on from there.
FIRST_STEPS, STEPS, RATE = 20, 40, 0.3
# Slopes are added as integers with so many fraction bits: no order of addition changes a weight.
SLOPE_BITS = 24
# Bins are finer at the ends, where texts of unusual form are.
QUANTILES = (0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.86, 0.9, 0.92, 0.94, 0.96, 0.98, 0.99)
THRESHOLD = 0.7
# Counts of a measure's values: 1,024 for each power of two from the least one told from 0.
LEAST, POWERS, FRACTION_BITS = 2.0**-14, 24, 10
CODES = POWERS << FRACTION_BITS
# Tables of counts that the driver adds up.
SLOTS = 16
MEASURES = (
    "log_words",
    "mean_word_bytes",
    "upper_share",
    "digit_share",
    "symbol_share",
    "stop_share",
    "wide_share",
    "symbol_words",
    "symbol_ends",
    "bare_symbols",
    "upper_words",
    "repeated_neighbours",
    "distinct_words",
    "lines_per_word",
)


def _mask(*codes) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[list(codes)] = True
    return mask


IS_UPPER, IS_DIGIT = _mask(*range(65, 91)), _mask(*range(48, 58))
IS_STOP = _mask(*b".,;:'?-\"()")
IS_SYMBOL = _mask(*(c for c in range(33, 127) if not chr(c).isalnum())) & ~IS_STOP
IS_WIDE = _mask(*range(128, 256))
IS_ALNUM = _mask(*(c for c in range(256) if c >= 128 or chr(c).isalnum()))


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``MEASURES`` for each text."""
    n = len(offsets) - 1
    words = Words(data, offsets)
    rows = words.rows()
    n_words = np.maximum(np.diff(words.first), 1)
    n_bytes = np.maximum(np.diff(offsets), 1)

    def per_byte(mask):
        seen = np.concatenate(([0], np.cumsum(mask[data])))
        return seen[offsets[1:]] - seen[offsets[:-1]]

    def per_word(flags):
        return np.bincount(rows, flags, minlength=n) / n_words

    def within(mask):
        seen = np.concatenate(([0], np.cumsum(mask[data])))
        return seen[words.ends] - seen[words.starts]

    hashes = words.hashes(data, fold=True)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    order = np.lexsort((hashes, rows))
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    distinct = np.bincount(rows[order], new, minlength=n) / n_words
    symbols, alnum = within(IS_SYMBOL), within(IS_ALNUM)
    ends = IS_SYMBOL[data[words.ends - 1]] if len(rows) else np.zeros(0, bool)
    lengths = words.ends - words.starts
    visible = np.maximum(n_bytes - per_byte(IS_SPACE), 1)
    return np.column_stack(
        (
            np.log1p(np.diff(words.first)),
            np.bincount(rows, lengths, minlength=n) / n_words,
            per_byte(IS_UPPER) / visible,
            per_byte(IS_DIGIT) / visible,
            per_byte(IS_SYMBOL) / visible,
            per_byte(IS_STOP) / visible,
            per_byte(IS_WIDE) / visible,
            per_word(symbols > 0),
            per_word(ends & (alnum > 0)),
            per_word(alnum == 0),
            per_word((within(IS_UPPER) == lengths) & (lengths > 1)),
            per_word(same),
            distinct,
            per_byte(_mask(10)) / n_words,
        )
    )


def extract(batches):
    for batch in batches:
        found = [measures(data, offsets) for _, _, data, offsets in slices(batch.column("text"))]
        values = np.concatenate(found) if found else np.zeros((0, len(MEASURES)))
        columns = [batch.column("doc_id"), *map(pa.array, values.T)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *MEASURES])


def values_of(table) -> np.ndarray:
    return np.column_stack([table.column(m).to_numpy() for m in MEASURES])


def counts_over(measured: DataFrame, places, size: int) -> np.ndarray:
    """How often ``places``, given the values of some rows, names each of ``size`` places.

    A task sends one table of what it counted; equal slots are added on Spark.
    """

    def packed(slot, counts):
        at = np.flatnonzero(counts)
        return [slot], [at.astype(np.int32).tobytes()], [counts[at].tobytes()]

    def count(batches):
        counts = np.zeros(size, np.int64)
        for batch in batches:
            counts += np.bincount(places(values_of(batch)).ravel(), minlength=size)
        yield pa.RecordBatch.from_arrays([*map(pa.array, packed(TaskContext.get().partitionId() % SLOTS, counts))], names=["slot", "at", "n"])

    def total(table):
        counts = np.zeros(size, np.int64)
        for at, n in zip(table.column("at").to_pylist(), table.column("n").to_pylist(), strict=True):
            counts[np.frombuffer(at, np.int32)] += np.frombuffer(n, np.int64)
        return counts

    def add(table):
        return pa.table(dict(zip(("slot", "at", "n"), packed(table.column("slot")[0].as_py(), total(table)), strict=True)))

    schema = "slot long, at binary, n binary"
    return total(measured.select(*MEASURES).mapInArrow(count, schema).groupBy("slot").applyInArrow(add, schema).toArrow())


def code_places(values: np.ndarray) -> np.ndarray:
    """The place of each value's code among those of all measures."""
    shift = 52 - FRACTION_BITS
    bits = np.ascontiguousarray(values, np.float64).view(np.int64) >> shift
    codes = np.clip(bits - (np.float64(LEAST).view(np.int64) >> shift), 0, CODES - 1)
    return codes + np.arange(values.shape[1]) * CODES


def quantile_edges(measured: DataFrame) -> list[np.ndarray]:
    """The quantiles of each measure over all rows, to a tenth of a percent of the value."""
    shift = 52 - FRACTION_BITS
    counts = counts_over(measured, code_places, len(MEASURES) * CODES).reshape(len(MEASURES), CODES)
    edges = []
    for own in np.cumsum(counts, axis=1):
        code = np.searchsorted(own, np.multiply(QUANTILES, own[-1])) if own[-1] else np.zeros(0, np.int64)
        # The largest value of the code: bins hold whole codes.
        above = (code + 1 + (np.float64(LEAST).view(np.int64) >> shift)) << shift
        edges.append(np.unique((above - 1).view(np.float64)))
    return edges


@dataclass
class Additive:
    """A weight for each bin of each measure; bins between quantiles of all texts."""

    edges: list[np.ndarray]
    weights: np.ndarray

    @classmethod
    def over(cls, edges: list[np.ndarray]) -> Additive:
        return cls(edges, np.zeros(sum(len(e) + 1 for e in edges) + 1))

    def indicators(self, values: np.ndarray) -> np.ndarray:
        """The place of each value's bin among all weights."""
        base, places = 0, []
        for edges, column in zip(self.edges, values.T, strict=True):
            places.append(base + np.searchsorted(edges, column, side="left"))
            base += len(edges) + 1
        return np.column_stack(places)

    def log_odds(self, values: np.ndarray) -> np.ndarray:
        return self.weights[self.indicators(values)].sum(axis=1) + self.weights[-1]


def spread(places: np.ndarray, slope: np.ndarray, size: int) -> np.ndarray:
    """The sum of the rows' slopes at each weight, the last of which all rows have."""
    each = np.bincount(places.ravel(), np.repeat(slope, places.shape[1]), minlength=size)
    each[-1] = slope.sum()
    return each


def place_blocks(rows: DataFrame, model: Additive) -> DataFrame:
    """The places of the bins of all ``rows`` (measures and half), many rows packed into one."""

    def pack(batches):
        for batch in batches:
            places, half = model.indicators(values_of(batch)), batch.column("half").to_numpy(zero_copy_only=False)
            packed = [places[half == side].astype(np.uint16).tobytes() for side in (False, True)]
            yield pa.RecordBatch.from_arrays([pa.array([False, True]), pa.array(packed, pa.binary())], names=["half", "places"])

    return rows.select("half", *MEASURES).mapInArrow(pack, "half boolean, places binary")


def mean_slopes(blocks: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """Means over all documents of ``blocks``: of the score's slope at each weight, and of the score."""
    size = len(weights)

    def add(batches):
        sums = np.zeros(size + 2, np.int64)
        for batch in batches:
            for packed in batch.column("places"):
                places = np.frombuffer(packed.as_buffer(), np.uint16).reshape(-1, len(MEASURES))
                score = sigmoid(weights[places].sum(axis=1) + weights[-1])
                slope, whole = (np.rint(x * 2.0**SLOPE_BITS) for x in (score * (1 - score), score))
                sums[:size] += spread(places, slope, size).astype(np.int64)
                sums[size:] += int(whole.sum()), len(places)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 2, dtype=np.int32)), pa.array(sums)], names=["place", "total"])

    of_tasks = blocks.select("places").mapInArrow(add, "place int, total long")
    table = of_tasks.groupBy("place").agg(F.sum("total").alias("total")).toArrow()
    sums = np.zeros(size + 2)
    sums[table.column("place").to_numpy()] = table.column("total").to_numpy()
    means = sums[:-1] / 2.0**SLOPE_BITS / max(sums[-1], 1)
    return means[:-1], means[-1]


def fit(model: Additive, positive: np.ndarray, unlabelled: DataFrame, prior: float, steps: int) -> Additive:
    """The non-negative estimator of the risk, with sigmoid loss, from the weights of ``model`` on.

    ``unlabelled`` are blocks of places. The loss is bounded: under an unbounded
    one the surest positives would weigh so much that a small error of the prior
    hides all bad texts.
    """
    p = model.indicators(positive)

    def gradient(w):
        as_p = sigmoid(w[p].sum(axis=1) + w[-1])
        slope_u, as_u = mean_slopes(unlabelled, w)
        good = -prior * spread(p, as_p * (1 - as_p), len(w)) / len(p)
        bad = slope_u + good
        slope = good + bad if as_u >= prior * as_p.mean() else -bad
        return slope + 1e-4 * np.append(w[:-1], 0)

    return Additive(model.edges, descend(gradient, model.weights, steps, RATE))


def estimate_prior(model: Additive, positive: np.ndarray, unlabelled: DataFrame) -> float:
    """The share of positives among the unlabelled, all of which are counted.

    ``model`` tells the two apart and was fitted on other rows. The share of
    unlabelled scores above a cut is at least the prior times that of positives,
    so every cut bounds the prior from above; the least bound counts.
    """
    high = np.sort(model.log_odds(positive))
    # Cuts that leave most positives above them: elsewhere chance rules the ratio.
    cuts = np.quantile(high, np.linspace(0, 0.5, 100))
    reach_p = 1 - np.searchsorted(high, cuts) / len(high)
    passed = counts_over(unlabelled, lambda values: np.searchsorted(cuts, model.log_odds(values), side="right"), len(cuts) + 1)
    reach_u = np.cumsum(passed[::-1])[::-1][1:] / max(passed.sum(), 1)
    return float(np.clip((reach_u / reach_p).min(), 1 / (passed.sum() + 1), 1))


def score_with(model, threshold: float):
    def run(batches):
        for batch in batches:
            score = sigmoid(model.value.log_odds(values_of(batch)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    return run


def is_held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """How likely each document is of good quality.

    ``docs`` has ``doc_id`` and ``text``, ``labels`` has ``doc_id`` and
    ``quality``; other columns are ignored. Trusted positives are documents with
    ``quality`` 1, at most ``sample_rows`` of them; unlabelled ones are all
    documents. None of those held out is learnt from. Of positives that share an id
    one is learnt from; repeated rows are scored each, and count as unlabelled each.
    Texts may be of any length. Gives ``doc_id``, ``held_out``,
    ``score`` (0 to 1) and ``predicted`` (1 if the score is at least
    ``threshold``), one row for each input row. A null text is empty, and an
    empty text is scored by its measures like any other. Rows without id are
    scored and never learnt from. Without positives every score is one half. Empty
    ``docs`` give an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    learnt = ~is_held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ", ".join(f"{m} double" for m in MEASURES)
    measured = saved(texts.mapInArrow(extract, f"doc_id {kind}, {columns}"), "measures")
    # The prior is estimated with halves.
    every = measured.filter(learnt).withColumn("half", F.xxhash64("doc_id", F.lit(7)) % 2 == 0)
    positives = labels.filter(learnt & (F.col("quality") == 1)).select("doc_id").distinct()
    positives = F.broadcast(bounded_sample(positives, sample_rows))
    # Of rows that share an id one is learnt from, so that the driver gets no more.
    table = every.join(positives, "doc_id").groupBy("doc_id", "half").agg(F.max(F.struct(*MEASURES)).alias("values"))
    table = table.select("half", "values.*").toArrow()
    table = table.sort_by([(c, "ascending") for c in table.column_names])
    values, half = values_of(table), table.column("half").to_numpy()
    model = Additive.over(quantile_edges(every))
    if half.any() and not half.all():
        # Read by each step and small; a lost part is made again from the measures.
        blocks = place_blocks(every, model).persist()
        model = fit(model, values[half], blocks.filter("half"), 0.5, FIRST_STEPS)
        prior = estimate_prior(model, values[~half], every.filter("not half"))
        model = fit(model, values, blocks, prior, STEPS)
        blocks.unpersist()
    scored = measured.mapInArrow(
        score_with(spark.sparkContext.broadcast(model), threshold), f"doc_id {kind}, score double, predicted int"
    )
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
