"""Documents of equal keys, whatever makes the keys: one shuffle of packed hashes.

Every document sends its keys to buckets by value. A bucket gives back, of keys
that several documents have, the pairs of each with the smallest id of its list
(*stars*), the members of lists of up to ``LONG``, and for each document how many
of its keys are more common. A task settles the keys that over ``LONG`` of its
own documents have, so that a key that a third of all documents have is a few
rows for each task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.near_links import shingle_sets
from tarn.llm.rolling import mix
from tarn.llm.shared import saved, shuffle_partitions

# Documents of a key up to which all of them are listed.
LONG = 64
# Hubs that a document is compared with before all others.
HUBS = 2
# Keys that a task holds before it passes them on, and text bytes for each bucket.
HELD_KEYS = 1_000_000
BUCKET_BYTES = 1 << 22

LOW = np.uint64(0xFFFFFFFF)
THIRTY_TWO = np.uint64(32)

# What a packed row holds: keys with their documents, pairs with a hub, common keys of documents.
KEYS, STARS, COMMON = range(3)
PACKED = "bucket int, kind int, x binary, y binary, slots binary, times binary"
FOUND = "kind int, a long, b long, times long"


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal neighbours, and their lengths."""
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(keys)))


def stars_of(docs: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of the first document of each run with its others, and how many runs have them."""
    pairs = np.column_stack((np.repeat(docs[starts], lengths), docs))
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0, return_counts=True)


def common_keys(docs: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many common keys each document has in each of its two bands."""
    pairs, times = np.unique(np.column_stack((docs, slots.astype(np.int64))), axis=0, return_counts=True)
    return pairs, times


def pack_keys(words: int, keys_of: Callable, buckets: int):
    """Keys as one row for each bucket; those of over ``LONG`` documents of the task are settled."""

    def flush(held) -> Iterator[pa.RecordBatch]:
        keys, docs, slots = (np.concatenate([h[i] for h in held]) for i in range(3))
        codes = ((keys >> THIRTY_TWO) % np.uint64(buckets) << THIRTY_TWO) | (keys & LOW)
        order = np.lexsort((docs, codes))
        codes, docs, slots = codes[order], docs[order], slots[order]
        starts, lengths = runs(codes)
        often = lengths > LONG
        sent = ~np.repeat(often, lengths)
        sent[starts[often]] = True
        times = np.ones(len(codes), np.int64)
        times[starts[often]] = lengths[often]
        yield from rows(KEYS, (codes[sent] >> THIRTY_TWO).astype(np.int32), (codes[sent] & LOW).astype(np.uint32), docs[sent], slots[sent], times[sent].astype(np.uint32))
        settled = np.repeat(often, lengths)
        if settled.any():
            own, own_lengths = runs(codes[settled])
            pairs, times = stars_of(docs[settled], own, own_lengths)
            yield from rows(STARS, spread(pairs[:, 1]), pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.uint8), times.astype(np.uint32))
            # The document that goes on is counted where it arrives.
            others = settled & ~sent
            pairs, times = common_keys(docs[others], slots[others])
            yield from rows(COMMON, spread(pairs[:, 0]), pairs[:, 0], pairs[:, 0], pairs[:, 1].astype(np.uint8), times.astype(np.uint32))

    def spread(docs: np.ndarray) -> np.ndarray:
        return (mix(docs.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)

    def rows(kind, bucket, *columns):
        order = np.argsort(bucket, kind="stable")
        starts, lengths = runs(bucket[order])
        parts = [order[a : a + n] for a, n in zip(starts, lengths, strict=True)]
        packed = [pa.array([c[p].tobytes() for p in parts], pa.binary()) for c in columns]
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[order][starts], pa.int32()), pa.array([kind] * len(parts), pa.int32()), *packed],
            names=["bucket", "kind", "x", "y", "slots", "times"],
        )

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for doc, hashes in zip(ids, shingle_sets(batch.column("text"), words), strict=True):
                keys, slots, bad = keys_of(hashes)
                held.append((keys, np.full(len(keys), doc, np.int64), slots))
                size += len(keys)
                lacking = [(slot, n) for slot, n in enumerate(bad) if n]
                if lacking:
                    held_bad.append((doc, lacking))
            if size >= HELD_KEYS or len(held_bad) >= HELD_KEYS:
                yield from flush(held)
                yield from lacking_rows()
                held, size = [], 0
        if held:
            yield from flush(held)
            yield from lacking_rows()

    held_bad: list[tuple[int, list[tuple[int, int]]]] = []

    def lacking_rows():
        flat = np.array([(doc, slot, n) for doc, bad in held_bad for slot, n in bad], np.int64).reshape(-1, 3)
        held_bad.clear()
        if len(flat):
            yield from rows(COMMON, spread(flat[:, 0]), flat[:, 0], flat[:, 0], flat[:, 1].astype(np.uint8), flat[:, 2].astype(np.uint32))

    return run


def match_keys(table: pa.Table) -> pa.Table:
    """Of one bucket: pairs with hubs, the members of short lists, bad segments of documents."""
    kinds = table.column("kind").to_numpy()
    bucket = np.int64(table.column("bucket")[0].as_py()) << np.int64(32)
    columns = {n: table.column(n).to_pylist() for n in ("x", "y", "slots", "times")}

    def joined(kind: int, name: str, of_type):
        return np.frombuffer(b"".join(columns[name][i] for i in np.flatnonzero(kinds == kind)), of_type)

    codes, docs = joined(KEYS, "x", np.uint32), joined(KEYS, "y", np.int64)
    slots, times = joined(KEYS, "slots", np.uint8), joined(KEYS, "times", np.uint32).astype(np.int64)
    order = np.lexsort((docs, codes))
    codes, docs, slots, times = codes[order], docs[order], slots[order], times[order]
    starts, lengths = runs(codes)
    total = np.add.reduceat(times, starts) if len(starts) else times
    several = np.repeat(total > 1, lengths)
    common = np.repeat(total > LONG, lengths)
    own, own_lengths = runs(codes[several])
    stars, n_stars = stars_of(docs[several], own, own_lengths)
    stars = np.concatenate((np.column_stack((joined(STARS, "x", np.int64), joined(STARS, "y", np.int64))), stars))
    n_stars = np.concatenate((joined(STARS, "times", np.uint32).astype(np.int64), n_stars))
    listed = several & ~common
    pairs, n_common = common_keys(docs[common], slots[common])
    bad = np.concatenate((np.column_stack((joined(COMMON, "x", np.int64), joined(COMMON, "slots", np.uint8).astype(np.int64))), pairs))
    n_bad = np.concatenate((joined(COMMON, "times", np.uint32).astype(np.int64), n_common))
    kind = np.repeat(np.array([STARS, KEYS, COMMON], np.int32), [len(stars), int(listed.sum()), len(bad)])
    return pa.table(
        {
            "kind": kind,
            "a": np.concatenate((stars[:, 0], bucket | codes[listed].astype(np.int64), bad[:, 0])),
            "b": np.concatenate((stars[:, 1], docs[listed], bad[:, 1])),
            "times": np.concatenate((n_stars, slots[listed].astype(np.int64), n_bad)),
        }
    )


def lists_of_keys(texts: DataFrame, words: int, keys_of: Callable, n_bytes: int) -> DataFrame:
    """Stars, members of short lists and counts of common keys, as rows of ``FOUND``.

    ``texts`` (doc_id, text) has ``n_bytes`` of text. ``keys_of`` takes the sorted
    shingle hashes of a set and gives its keys, a small number (*slot*) for each
    and, slot by slot, how many keys count as common from the start. ``a`` and
    ``b`` are: of ``STARS`` hub and member with the number of shared keys, of
    ``KEYS`` key and member with the slot, of ``COMMON`` document and slot with a
    count.
    """
    buckets = max(shuffle_partitions(texts.sparkSession), n_bytes // BUCKET_BYTES)
    packed = texts.mapInArrow(pack_keys(words, keys_of, buckets), PACKED)
    return saved(packed.groupBy("bucket").applyInArrow(match_keys, FOUND), "found")


def best_hubs(stars: DataFrame) -> DataFrame:
    """Of the hubs (a) of each member (b) the ``HUBS`` that share most keys with it.

    What they don't link is compared all the same, in the short lists or as crowded.
    """
    pairs = stars.groupBy("a", "b").agg(F.sum("times").alias("times"))
    best = Window.partitionBy("b").orderBy(F.desc("times"), "a")
    return saved(pairs.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= HUBS).select("a", "b"), "stars")
