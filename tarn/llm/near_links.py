"""What similarity joins over word shingles share: exact overlaps and crowded documents.

A *crowded* document is one whose index keys are so common that its partners
cannot be read off the short lists. Such documents meet in the lists of their
rarest shingles, in one order for all sets. Members outside a list's largest
component are first compared with hubs of it. Then outsiders probe the lists for
all others, and only at a shingle that may be the first one that a link shares:
those of both sizes bound how far down the order it can lie.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.rolling import FOLDED, Words, mix, run_fingerprints, slices
from tarn.llm.shared import connected_components, hint_small, saved

# Entries of the table of shingle frequencies: 8 MB as a broadcast.
FREQUENCY_BUCKETS = 1 << 20
# Entries of it in one row, where tables of tasks are added up.
SLICE_BUCKETS = 1 << 10

_SIGN = np.uint64(1 << 63)
_FOLD = FOLDED.tobytes()


# Sets -----------------------------------------------------------------------


def shingle_sets(texts: pa.Array, words: int, lane: int = 0):
    """The sorted distinct shingle hashes of each text; A-Z count as a-z.

    A text with fewer words than a shingle has one shingle of all its words, a
    text without words none.
    """
    for first, last, data, offsets in slices(texts):
        found = Words(data, offsets)
        single = found.fingerprints(data, fold=True, lane=lane)
        runs = run_fingerprints(single, words, lane)
        for i in range(last - first):
            a, b = found.first[i], found.first[i + 1]
            whole = run_fingerprints(single[a:b], b - a, lane) if a < b < a + words else runs[a : max(a, b - words + 1)]
            yield np.unique(mix(whole))


def as_longs(arrays: list[np.ndarray]) -> pa.Array:
    """Unsigned hashes as arrays of longs, in the same order."""
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array((flat ^ _SIGN).view(np.int64)))


def set_digests(sets: list[np.ndarray], others: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """Two 63-bit sums over the hashes of both lanes: equal for equal sets."""
    one, two = (pa.array([int(mix(s, k).sum() >> np.uint64(1)) for s in kind], pa.int64()) for k, kind in ((1, sets), (2, others)))
    return one, two


def one_row_each(signed: DataFrame, *extra: str) -> DataFrame:
    """Of rows that share an id the one with the largest set."""
    best = F.max(F.struct("n", "set_1", "set_2", "mark", *extra)).alias("best")
    return signed.groupBy("doc_id").agg(best, F.max("n_bytes").alias("n_bytes")).select("doc_id", "best.*", "n_bytes")


def whole_sets(words: int):
    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column("text"), words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), as_longs(sets)], names=["doc_id", "shingles"])

    return run


def texts_of(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of ``texts`` (doc_id, mark, text) that ``ids`` (doc_id, mark) names."""
    return texts.join(hint_small(ids.select("doc_id", "mark")), ["doc_id", "mark"], "left_semi")


def sets_of(ids: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The full sets of the documents in ``ids``, their texts picked in the scan."""
    return texts_of(ids, texts).select("doc_id", "text").mapInArrow(whole_sets(words), "doc_id long, shingles array<long>")


@lru_cache(maxsize=8)
def shingles_of(text: bytes, words: int) -> frozenset:
    found = text.translate(_FOLD).split()  # of bytes: at ASCII white space
    runs = zip(*(found[k:] for k in range(words)), strict=False) if len(found) >= words else [tuple(found)] if found else []
    return frozenset(runs)


def count_overlaps(words: int):
    def run(batches):
        for batch in batches:
            one, two = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("text_a", "text_b"))
            both = [len(shingles_of(x, words) & shingles_of(y, words)) for x, y in zip(one, two, strict=True)]
            columns = [batch.column(c) for c in ("a", "b", "n_a", "n_b")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(both, pa.int64())], names=["a", "b", "n_a", "n_b", "both"])

    return run


def overlaps(pairs: DataFrame, sized: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """``pairs`` (a, b) with the sizes of both sets and of what they share.

    Counted on the words themselves. ``sized`` has doc_id, n and mark, ``texts``
    doc_id, mark and text.
    """
    pairs = saved(pairs.select("a", "b"), "pairs")
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    ids = saved(sized.select("doc_id", "n", "mark").join(ids, "doc_id"), "ids")
    # Rows that repeat id and text are one.
    found = texts_of(ids, texts).join(ids, ["doc_id", "mark"]).dropDuplicates(["doc_id"])
    found = saved(found.select("doc_id", "n", "text"), "texts")
    left, right = (
        found.select(F.col("doc_id").alias(s), F.col("n").alias(f"n_{s}"), F.col("text").alias(f"text_{s}")) for s in ("a", "b")
    )
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "text_a", "text_b")
    return saved(both.mapInArrow(count_overlaps(words), "a long, b long, n_a long, n_b long, both long"), "overlaps")


def is_link(percent: int) -> Column:
    return F.col("both") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("both")) * percent


def close_sizes(n: Column, m: Column, percent: float) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def in_components(entries: DataFrame, reached: DataFrame) -> DataFrame:
    """``entries`` with ``component``: an id without links is its own."""
    joined = entries.join(reached.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return joined.withColumn("component", F.coalesce("component", "doc_id"))


def open_lists(listed: DataFrame, reached: DataFrame) -> DataFrame:
    """Lists (value, doc_id) whose members are in several components, with these."""
    entries = in_components(listed, reached)
    mixed = entries.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    lists = saved(mixed.filter("low < high").select("value"), "lists")
    return saved(entries.join(lists, "value", "left_semi"), "open")


def merged(reached: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links (a, b)."""
    labels = reached.select(F.col("id").alias("a"), F.col("component").alias("b"))
    return connected_components(labels.union(links.select("a", "b")))


# Rarest shingles ------------------------------------------------------------


def bucket_of(values: np.ndarray) -> np.ndarray:
    return (values.view(np.uint64) % np.uint64(FREQUENCY_BUCKETS)).astype(np.int64)


def as_slices(total: np.ndarray) -> pa.RecordBatch:
    """The table in rows of ``SLICE_BUCKETS`` counts, those that have any."""
    table = total.reshape(-1, SLICE_BUCKETS)
    used = np.flatnonzero(table.any(axis=1))
    ends = pa.array((np.arange(len(used) + 1) * SLICE_BUCKETS).astype(np.int32))
    counts = pa.ListArray.from_arrays(ends, pa.array(table[used].ravel()))
    return pa.RecordBatch.from_arrays([pa.array(used), counts], names=["slice", "counts"])


def sum_of_slices(batches) -> np.ndarray:
    total = np.zeros(FREQUENCY_BUCKETS, np.int64)
    for batch in batches:
        counts = batch.column("counts").flatten().to_numpy().reshape(-1, SLICE_BUCKETS)
        np.add.at(total.reshape(-1, SLICE_BUCKETS), batch.column("slice").to_numpy(), counts)
    return total


def count_buckets(batches):
    """How many shingles fall into each bucket."""
    total = np.zeros(FREQUENCY_BUCKETS, np.int64)
    for batch in batches:
        values = batch.column("shingles").flatten().to_numpy()
        total += np.bincount(bucket_of(values), minlength=FREQUENCY_BUCKETS)
    yield as_slices(total)


def add_slices(batches):
    yield as_slices(sum_of_slices(batches))


def bucket_counts(sets: DataFrame) -> np.ndarray:
    """Shingles of all ``sets`` in each bucket; its size is fixed.

    Tasks send slices of their tables, which others add up as they arrive.
    """
    kind = "slice long, counts array<long>"
    parts = sets.select("shingles").mapInArrow(count_buckets, kind)
    return sum_of_slices(parts.repartition("slice").mapInArrow(add_slices, kind).toArrow().to_batches())


def pick_rarest(counts, percent: int):
    def run(batches):
        frequency = counts.value
        for batch in batches:
            first, sizes = [], []
            for shingles in batch.column("shingles"):
                values = shingles.values.to_numpy()
                order = np.lexsort((values, frequency[bucket_of(values)]))
                # One more than a link may lack.
                most = len(values) - -(-len(values) * percent // 100) + 1
                first.append(values[order[:most]])
                sizes.append(len(values))
            lengths = [len(f) for f in first]
            values = np.concatenate(first) if first else np.zeros(0, np.int64)
            ids = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(first)), lengths)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(values),
                    ids,
                    pa.array(np.repeat(sizes, lengths).astype(np.int64)),
                    pa.array(np.concatenate([np.arange(n) for n in lengths]) if lengths else np.zeros(0, np.int64), pa.int32()),
                ],
                names=["value", "doc_id", "n", "place"],
            )

    return run


def rarest_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """Lists of at least two over the rarest shingles: of each set one more than a link may lack.

    Two linked sets share one of their first shingles in any order that is the
    same for all sets. Here it is that of a frequency table of fixed size, so
    that each task finds them by itself and only they leave it.
    """
    counts = sets.sparkSession.sparkContext.broadcast(bucket_counts(sets).astype(np.int64))
    rare = saved(sets.mapInArrow(pick_rarest(counts, percent), "value long, doc_id long, n long, place int"), "rarest")
    lists = rare.groupBy("value").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("value")
    return saved(rare.join(saved(lists, "lists"), "value", "left_semi"), "rare")


# Crowded documents ----------------------------------------------------------


def first_meetings(open_: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that may be links, by the first shingle that both have.

    ``open_``: value, doc_id, n, place, component. A link of sizes n and m shares
    ``need`` shingles. The first shared one, at some place of each order, is
    followed by all the others, so at most ``n - need`` stand before it.
    """
    one, two = (
        open_.select("value", *(F.col(c).alias(f"{short}{s}") for c, short in (("doc_id", ""), ("component", "c_"), ("n", "n_"), ("place", "p_"))))
        for s in ("a", "b")
    )
    need = F.ceil((F.col("n_a") + F.col("n_b")) * percent / (100 + percent))
    met = one.join(two, "value").filter(
        (F.col("a") < F.col("b"))
        & (F.col("c_a") != F.col("c_b"))
        & (F.col("p_a") <= F.col("n_a") - need)
        & (F.col("p_b") <= F.col("n_b") - need)
        & close_sizes(F.col("n_a"), F.col("n_b"), percent)
    )
    return saved(met.select("a", "b").distinct(), "met")


def hub_pairs(open_: DataFrame, stars: DataFrame) -> DataFrame:
    """Members outside the largest component of each list, with its hub of most links so far.

    They only spare work: what they don't link is compared all the same.
    """
    by_component = open_.groupBy("value", "component").agg(F.count(F.lit(1)).alias("members"))
    main = by_component.groupBy("value").agg(F.max_by("component", F.struct("members", "component")).alias("main"))
    placed = open_.join(saved(main, "main"), "value")
    degree = stars.groupBy(F.col("a").alias("doc_id")).agg(F.count(F.lit(1)).alias("degree"))
    inside = placed.filter("component = main").join(saved(degree, "degree"), "doc_id", "left")
    most = F.max_by("doc_id", F.struct(F.coalesce("degree", F.lit(0)), -F.col("doc_id")))
    hubs = saved(inside.groupBy("value").agg(most.alias("a")), "hubs")
    return placed.filter("component != main").join(hubs, "value").select("a", F.col("doc_id").alias("b")).distinct()


def crowded_links(
    crowded: DataFrame,
    sized: DataFrame,
    texts: DataFrame,
    stars: DataFrame,
    reached: DataFrame,
    likely: Callable[[DataFrame], DataFrame],
    words: int,
    percent: int,
) -> DataFrame:
    """Components once all links between crowded documents are known.

    ``crowded``: doc_id, mark; ``stars``: links of hubs (a) so far; ``reached``: the
    components so far; ``likely`` leaves of pairs those that may be links. Only
    documents of different components are compared.
    """
    sets = saved(sets_of(crowded, texts, words), "sets")
    rare = rarest_shingles(sets, percent)
    links = overlaps(likely(hub_pairs(open_lists(rare, reached), stars)), sized, texts, words).filter(is_link(percent))
    reached = merged(reached, links)
    met = likely(first_meetings(open_lists(rare, reached), percent))
    return merged(reached, overlaps(met, sized, texts, words).filter(is_link(percent)))
