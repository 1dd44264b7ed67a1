"""The best documents for each query: an impact index searched by pair-bound MaxScore.

1. Documents are cut into blocks; a block's row holds the postings of the terms
   that queries have. From them come document frequencies and term weights.
2. Of each query, terms of neighbouring weight make pairs. The index keeps for
   every block each term's greatest impact and, for each pair whose lists
   intersect in the block, the greatest sum of both impacts in one document.
3. A task walks its blocks with the best scores found so far. What a block can
   reach for a query is the sum over its pairs of the joint maximum, or of the
   greater single one where no document has both terms, which is less than the
   sum of the terms' own maxima. Only blocks that reach the query's threshold
   are scored.

Queries are taken in parts of at most ``PART_TERMS`` terms, which bounds what is
broadcast; a part reads the documents once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.rolling import FOLDED, Words, slices
from tarn.llm.shared import saved

TOP = 50
# Terms of the queries taken at once, counted for each query.
PART_TERMS = 1_000_000
# Text bytes and documents of a block.
BLOCK_BYTES = 1 << 17
BLOCK_DOCS = 256
# Pairs whose joint maxima are worked out at once.
PAIRS_AT_ONCE = 1 << 14
# Terms whose counts travel in one row.
SLICE_TERMS = 4096
# Groups in which the best of a query are picked before the last pick.
PICK_GROUPS = 32

# Bytes of terms: ASCII letters and digits, and all of longer characters.
IS_TERM = np.zeros(256, bool)
IS_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, pa.Array]:
    """Where the terms lie, and they themselves with A-Z as a-z."""
    inside = IS_TERM[data]
    words = Words(data, offsets, inside)
    ends = np.concatenate(([0], np.cumsum(words.ends - words.starts))).astype(np.int64)
    buffers = [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(FOLDED[data[inside]].tobytes())]
    return words, pa.Array.from_buffers(pa.large_binary(), len(words.starts), buffers)


# Queries --------------------------------------------------------------------


def query_terms(batches):
    for batch in batches:
        for first, last, data, offsets in slices(batch.column("text")):
            words, terms = terms_of(data, offsets)
            ids = batch.column("item_id").take(pa.array(first + words.rows()))
            yield pa.RecordBatch.from_arrays([ids, terms.cast(pa.binary())], names=["item_id", "term"])


class Queries:
    """Queries by number, with the terms of each; terms are numbered in byte order."""

    def __init__(self, rows: pa.Table):
        terms = rows.column("term").combine_chunks().cast(pa.large_binary())
        self.vocabulary = pc.unique(terms).take(pc.array_sort_indices(pc.unique(terms)))
        ids = rows.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
        self.ids = ids.dictionary
        order = np.lexsort((pc.index_in(terms, self.vocabulary).to_numpy(), ids.indices.to_numpy()))
        self.terms = pc.index_in(terms, self.vocabulary).to_numpy()[order].astype(np.int64)
        query = ids.indices.to_numpy()[order]
        self.bounds = np.searchsorted(query, np.arange(len(self.ids) + 1))

    def of(self, query: int) -> np.ndarray:
        return self.terms[self.bounds[query] : self.bounds[query + 1]]


# Index ----------------------------------------------------------------------

BLOCKS = "doc_ids array<long>, n_docs long, n_terms long, lengths binary, terms binary, docs binary, times binary"


def make_blocks(vocabulary):
    """Postings of each block in order of term and document, and all documents' lengths."""

    def run(batches):
        known = vocabulary.value
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK_DOCS):
                part = batch.slice(begin, BLOCK_DOCS)
                for first, last, data, offsets in slices(part.column("text"), BLOCK_BYTES):
                    words, terms = terms_of(data, offsets)
                    lengths = np.diff(words.first).astype(np.int64)
                    number = pc.fill_null(pc.index_in(terms, known), -1).to_numpy()
                    hit = number >= 0
                    n = last - first
                    keys, times = np.unique(number[hit].astype(np.int64) * n + words.rows()[hit], return_counts=True)
                    ids = part.column("doc_id").slice(first, n)
                    arrays = (lengths, (keys // n).astype(np.int32), (keys % n).astype(np.int32), times.astype(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids),
                            pa.array([int((lengths > 0).sum())], pa.int64()),
                            pa.array([int(lengths.sum())], pa.int64()),
                            *(pa.array([a.tobytes()], pa.binary()) for a in arrays),
                        ],
                        names=["doc_ids", "n_docs", "n_terms", "lengths", "terms", "docs", "times"],
                    )

    return run


def sliced(total: np.ndarray) -> pa.RecordBatch:
    """The counts in rows of ``SLICE_TERMS``, those that have any."""
    table = np.concatenate((total, np.zeros(-len(total) % SLICE_TERMS, np.int64))).reshape(-1, SLICE_TERMS)
    used = np.flatnonzero(table.any(axis=1))
    counts = pa.array([table[i].tobytes() for i in used], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), counts], names=["slice", "counts"])


def add_up(batches, size: int) -> np.ndarray:
    total = np.zeros(size + -size % SLICE_TERMS, np.int64)
    for batch in batches:
        for number, counts in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            total[number * SLICE_TERMS : (number + 1) * SLICE_TERMS] += np.frombuffer(counts, np.int64)
    return total[:size]


def document_frequencies(blocks: DataFrame, size: int) -> np.ndarray:
    """How many documents have each term; tasks send slices of their counts."""

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for terms in batch.column("terms").to_pylist():
                total += np.bincount(np.frombuffer(terms, np.int32), minlength=size)
        yield sliced(total)

    kind = "slice long, counts binary"
    parts = blocks.select("terms").mapInArrow(count, kind).repartition("slice")
    return add_up(parts.mapInArrow(lambda batches: [sliced(add_up(batches, size))], kind).toArrow().to_batches(), size)


class Weights:
    """Of all terms their weights, and of each query the pairs and what is left single.

    ``pairs`` are two term numbers each; ``parts`` the numbers of pairs, and of
    single terms as ``len(pairs)`` and more, one query after the other.
    """

    def __init__(self, queries: Queries, seen: np.ndarray, n_docs: int, n_terms: int):
        self.queries, self.n_docs, self.n_terms = queries, n_docs, n_terms
        self.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in seen.tolist()], np.int64)
        numbers: dict[tuple[int, int], int] = {}
        parts = []
        for query in range(len(queries.ids)):
            terms = queries.of(query)
            # Rare terms together: few documents have both.
            terms = terms[np.lexsort((terms, -self.weights[terms]))].tolist()
            pairs = [tuple(sorted(terms[i : i + 2])) for i in range(0, len(terms) - 1, 2)]
            single = terms[len(terms) - len(terms) % 2 :]
            parts.append(([numbers.setdefault(pair, len(numbers)) for pair in pairs], single))
        self.pairs = np.array(list(numbers), np.int64).reshape(-1, 2)
        flat = [np.array(pairs + [len(numbers) + t for t in single], np.int64) for pairs, single in parts]
        self.bounds = np.concatenate(([0], np.cumsum([len(f) for f in flat]))).astype(np.int64)
        self.parts = np.concatenate(flat) if flat else np.zeros(0, np.int64)

    def impacts(self, terms: np.ndarray, docs: np.ndarray, times: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        scale = 100 - 50 + 50 * lengths * self.n_docs // max(self.n_terms, 1)
        return self.weights[terms] * (1_000_000_000 * times // (1000 * times + 20 * scale[docs]))


def dense(rows: np.ndarray, docs: np.ndarray, impacts: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    table = np.zeros(shape, np.int64)
    table[rows, docs] = impacts
    return table


INDEX = "doc_ids array<long>, terms binary, maxima binary, pairs binary, joint binary, rows binary, docs binary, impacts binary"


def add_bounds(weights):
    """Blocks with impacts, each term's maximum and the joint maxima of pairs that meet."""

    def run(batches):
        known = weights.value
        for batch in batches:
            for row in batch.to_pylist():
                lengths, times = (np.frombuffer(row[c], np.int64) for c in ("lengths", "times"))
                terms, docs = (np.frombuffer(row[c], np.int32) for c in ("terms", "docs"))
                impacts = known.impacts(terms, docs, times, lengths)
                present, at = np.unique(terms, return_inverse=True)
                table = dense(at, docs, impacts, (len(present), len(lengths)))
                place = np.full(len(known.weights), -1)
                place[present] = np.arange(len(present))
                both = place[known.pairs]
                candidates = np.flatnonzero((both >= 0).all(axis=1))
                joint = [np.zeros(0, np.int64)]
                for k in range(0, len(candidates), PAIRS_AT_ONCE):
                    one, two = (table[both[candidates[k : k + PAIRS_AT_ONCE], side]] for side in (0, 1))
                    joint.append(np.where((one > 0) & (two > 0), one + two, 0).max(axis=1, initial=0))
                joint = np.concatenate(joint)
                meet = joint > 0
                maxima = table.max(axis=1, initial=0)
                arrays = (present, maxima, candidates[meet].astype(np.int64), joint[meet], at.astype(np.int32), docs, impacts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["doc_ids"]], pa.list_(pa.int64())), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)],
                    names=["doc_ids", "terms", "maxima", "pairs", "joint", "rows", "docs", "impacts"],
                )

    return run


# Search ---------------------------------------------------------------------


def reach(known: Weights, terms, maxima, pairs, joint) -> np.ndarray:
    """An upper bound of the scores in a block, for every query."""
    single = np.zeros(len(known.weights), np.int64)
    single[terms] = maxima
    bound = single[known.pairs].max(axis=1, initial=0)
    bound[pairs] = np.maximum(bound[pairs], joint)
    sums = np.concatenate(([0], np.cumsum(np.concatenate((bound, single))[known.parts])))
    return sums[known.bounds[1:]] - sums[known.bounds[:-1]]


def best_of(scores: np.ndarray, ids: np.ndarray, nameless: np.ndarray, top: int) -> np.ndarray:
    return np.lexsort((ids, nameless, -scores))[:top]


def search(weights, top: int):
    """The task's best documents of each query: item_id, doc_id, score."""

    def run(batches):
        known = weights.value
        n = len(known.queries.ids)
        threshold = np.ones(n, np.int64)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in range(n)]
        for batch in batches:
            for row in batch.to_pylist():
                terms, at, docs = (np.frombuffer(row[c], np.int32) for c in ("terms", "rows", "docs"))
                maxima, pairs, joint, impacts = (np.frombuffer(row[c], np.int64) for c in ("maxima", "pairs", "joint", "impacts"))
                queries = np.flatnonzero(reach(known, terms, maxima, pairs, joint) >= threshold)
                if not len(queries):
                    continue
                own_nameless = np.array([i is None for i in row["doc_ids"]], bool)
                own_ids = np.array([i or 0 for i in row["doc_ids"]], np.int64)
                # One row of zeros more, for terms that the block has not.
                table = dense(at, docs, impacts, (len(terms) + 1, len(own_ids)))
                place = np.full(len(known.weights), len(terms))
                place[terms] = np.arange(len(terms))
                for query in queries.tolist():
                    found = table[place[known.queries.of(query)]].sum(axis=0)
                    hit = np.flatnonzero(found >= threshold[query])
                    if len(hit):
                        scores, ids, nameless = (
                            np.concatenate(x) for x in zip(best[query], (found[hit], own_ids[hit], own_nameless[hit]), strict=True)
                        )
                        order = best_of(scores, ids, nameless, top)
                        best[query] = scores[order], ids[order], nameless[order]
                        if len(order) == top:
                            threshold[query] = scores[order[-1]]
        counts = [len(scores) for scores, _, _ in best]
        if sum(counts):
            scores, ids, nameless = (np.concatenate(x) for x in zip(*best, strict=True))
            items = known.queries.ids.take(pa.array(np.repeat(np.arange(n), counts)))
            yield pa.RecordBatch.from_arrays(
                [items, pa.array(ids, mask=nameless), pa.array(scores)], names=["item_id", "doc_id", "score"]
            )

    return run


def picked(found: DataFrame, top: int) -> DataFrame:
    """The best of each query: first within groups of its rows, then of these."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    group = F.pmod(F.xxhash64("doc_id"), F.lit(PICK_GROUPS))
    within = Window.partitionBy("item_id", group).orderBy(*order)
    few = found.withColumn("place", F.row_number().over(within)).filter(F.col("place") <= top).drop("place")
    ranks = few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return ranks.filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def ranked_documents(docs: DataFrame, queries: DataFrame, top: int = TOP, part_terms: int = PART_TERMS) -> DataFrame:
    """The ``top`` documents of each query by score.

    ``docs`` has ``doc_id`` and ``text``, ``queries`` has ``item_id`` and ``text``;
    other columns are ignored. Terms are runs of ASCII letters, digits and all
    other characters beyond ASCII, A-Z as a-z. A document scores the impacts of
    the query's terms, once each, as the contract of op 11 states them; all is
    64-bit integer but the logarithm in a term's weight. Gives ``item_id``,
    ``rank`` (from 1), ``doc_id`` and ``score``, of documents that score above 0;
    equal scores by id, rows without id last. A null or empty text has no terms
    and counts for nothing. Rows of ``docs`` that share an id or text are
    documents of their own. Rows of ``queries`` that share an id, also the null
    one, are one query with the terms of all. Long texts are blocks by
    themselves. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = queries.select(F.col("item_id").cast("long").alias("item_id"), "text")
    asked = saved(asked.mapInArrow(query_terms, "item_id long, term binary").distinct(), "queries")
    parts = max(1, -(-asked.count() // part_terms))
    result = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for part in range(parts):
        own = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).toArrow()
        if not own.num_rows:
            continue
        own = Queries(own)
        vocabulary = spark.sparkContext.broadcast(own.vocabulary)
        blocks = saved(texts.mapInArrow(make_blocks(vocabulary), BLOCKS), "blocks")
        n_docs, n_terms = (x or 0 for x in blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first())
        known = Weights(own, document_frequencies(blocks, len(own.vocabulary)), n_docs, n_terms)
        weights = spark.sparkContext.broadcast(known)
        index = saved(blocks.mapInArrow(add_bounds(weights), INDEX), "index")
        result = result.union(index.mapInArrow(search(weights, top), "item_id long, doc_id long, score long"))
    return picked(result, top)
