"""Repeated stretches across all documents: the plan of op 8 and op 9.

A *unit* is a word or a byte, a *window* a fixed number of units. Which windows
also occur earlier is found in four steps; texts are shuffled once, to meet
what is known about them, and what else is shuffled are packed hashes.

1. Copies. Of documents with equal units the smallest id goes on. The others
   are known to be repeats as a whole, so that no group of copies, however
   large, reaches the later steps.
2. Anchors. A window that repeats contains an anchor that repeats (what an
   anchor is, the operator says). Anchor hashes go to buckets by value; a bucket
   tells each document which of its anchors others have too.
3. Segments. Windows holding a shared anchor, and only they, go to buckets by
   the least hash inside them, which equal windows have in common. Neighbours
   with the same least hash travel together as one segment. The windows of each
   least hash are counted first: one that more than ``HOT_WINDOWS`` have, and
   more than a part of what a bucket gets anyway, such as a string shorter than a
   window that many documents share, is cut into pieces
   by other anchors (for op 9 longer ones, with several windows to a piece, as
   single windows overlap). Of hot pieces the windows go to buckets by their own
   hash, so that only equal ones meet. Equal segments meet before they are cut.
4. A bucket compares the windows themselves and names the stretches to remove.
   Buckets take turns, so that what is shuffled at once is no more than the text.
   The stretches are written, and the tables of segments removed.

To its bucket a task sends what it has as one row of packed arrays: by itself a
segment would take more bytes for its row than for its units.

In steps 2 and 3 each task first settles among its own rows what repeats there:
a passage that a third of all documents hold leaves a task once, not once for
each document, and what is settled goes past the buckets. The number of buckets
follows the size of the input, so that a bucket stays about the same size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.rolling import mix, slices
from tarn.llm.shared import (
    brief_shuffles,
    earliest_of_copies,
    hint_small,
    remove_tables,
    saved,
    shuffle_partitions,
    text_or_empty,
)

# Anchors or segment bytes that a task holds before it passes them on.
HELD_ANCHORS = 1_000_000
HELD_BYTES = 1 << 24
# Bytes of text for each bucket.
BUCKET_BYTES = 1 << 22
# Windows with one least hash that travel to one bucket; or this part of the windows
# of a mean bucket (one in so many), if that is more. With a fixed number alone ever more least hashes
# would be hot in larger tables, though the buckets are no larger.
HOT_WINDOWS = 4096
HOT_PART = 128
# Windows of a segment that are split at once.
PIECE_WINDOWS = 1 << 16
# Bytes of segments that are shuffled at once; those of the texts if they are more.
TURN_BYTES = 1 << 28
# Bytes of the values in a batch: their places are 32-bit numbers.
BATCH_BYTES = 1 << 28

LOW = np.uint64(0xFFFFFFFF)
THIRTY_TWO = np.uint64(32)


def code_of(values: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket number in the upper half, 32 further bits of the hash in the lower."""
    return ((values >> THIRTY_TWO) % np.uint64(buckets) << THIRTY_TWO) | (values & LOW)


def groups_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal neighbours, and the run number of each row."""
    new = np.ones(len(keys), bool)
    differ = keys[1:] != keys[:-1]
    new[1:] = differ if differ.ndim == 1 else differ.any(axis=1)
    return np.flatnonzero(new), np.cumsum(new) - 1


def flagged(rows: np.ndarray, codes: np.ndarray, known_rows: np.ndarray, known: np.ndarray):
    """Whether each (row, code) is among the known ones (64-bit hashes of both)."""
    both = lambda r, c: mix(c ^ mix(r.astype(np.uint64), 5))
    return np.isin(both(rows, codes), both(known_rows, known))


def segments_of(at: np.ndarray, rows: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows at ``at`` cut into runs with one text and one least hash.

    Gives the places in ``at`` where a run begins, and the windows of each run.
    """
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]]) | (rows[at[1:]] != rows[at[:-1]])
    begin = np.flatnonzero(new)
    return begin, np.diff(np.append(begin, len(at)))


def binary_array(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Stretches of bytes that follow one another in ``values``, one each value."""
    bounds = np.append(begins, ends[-1:] if len(ends) else 0).astype(np.int64)
    buffers = [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())]
    return pa.Array.from_buffers(pa.large_binary(), len(begins), buffers)


def bounds_of(units: pa.Array) -> np.ndarray:
    """Where the values of a large binary array begin and end in its buffer."""
    return np.frombuffer(units.buffers()[1], np.int64)[units.offset : units.offset + len(units) + 1]


def expand(segments: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every window of the segments: segment number and place in it."""
    n = windows[segments]
    return np.repeat(segments, n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


# Step 2 ---------------------------------------------------------------------

ANCHORS = "bucket int, settled boolean, codes binary, docs binary, indexed binary"


def pack_anchors(shape, buckets: int):
    """Tasks' anchors as one row for each bucket.

    Anchors that several documents of the task hold are settled: each of those
    documents is told, and the bucket gets the anchor once, as document -1.
    """

    def flush(held) -> Iterator[pa.RecordBatch]:
        codes, docs, indexed = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(codes, kind="stable")
        starts, group = groups_of(codes[order])
        several = np.zeros(len(codes), bool)
        several[order] = (np.diff(np.append(starts, len(codes))) > 1)[group]
        any_indexed = np.zeros(len(codes), bool)
        any_indexed[order] = np.logical_or.reduceat(indexed[order], starts)[group]
        first = np.zeros(len(codes), bool)
        first[order[starts]] = True
        sent = ~several | first
        bucket = (codes >> THIRTY_TWO).astype(np.int32)
        yield from rows(bucket[sent], codes[sent], np.where(several, -1, docs)[sent], any_indexed[sent], False)
        if several.any():
            # Told already: they only pass through, spread by document.
            spread = (mix(docs[several].astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            yield from rows(spread, codes[several], docs[several], indexed[several], True)

    def rows(bucket, codes, docs, indexed, settled):
        kept = (lambda c: c.tobytes()) if settled else (lambda c: (c & LOW).astype(np.uint32).tobytes())
        order = np.argsort(bucket, kind="stable")
        starts, _ = groups_of(bucket[order])
        ends = np.append(starts[1:], len(codes))
        parts = [order[a:b] for a, b in zip(starts, ends, strict=True)]
        yield pa.RecordBatch.from_pydict(
            {
                "bucket": pa.array(bucket[order][starts], pa.int32()),
                "settled": pa.array([settled] * len(parts), pa.bool_()),
                "codes": pa.array([kept(codes[p]) for p in parts], pa.binary()),
                "docs": pa.array([docs[p].astype(np.int64).tobytes() for p in parts], pa.binary()),
                "indexed": pa.array([np.packbits(indexed[p]).tobytes() for p in parts], pa.binary()),
            }
        )

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for first, last, data, offsets in slices(batch.column("text")):
                row, values, indexed = shape.anchors(data, offsets)
                held.append((code_of(values, buckets), ids[first:last][row], indexed))
                size += len(row)
                if size >= HELD_ANCHORS:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return run


def match_anchors(table: pa.Table) -> pa.Table:
    """Of one bucket: (doc_id, code) of each anchor that occurs again and is indexed."""
    docs, codes, indexed, told, told_codes = [], [], [], [], []
    bucket = np.uint64(table.column("bucket")[0].as_py()) << THIRTY_TWO
    for settled, c, d, i in zip(
        *(table.column(n).to_pylist() for n in ("settled", "codes", "docs", "indexed")), strict=True
    ):
        d = np.frombuffer(d, np.int64)
        if settled:
            told.append(d)
            told_codes.append(np.frombuffer(c, np.uint64))
        else:
            docs.append(d)
            codes.append(np.frombuffer(c, np.uint32))
            indexed.append(np.unpackbits(np.frombuffer(i, np.uint8), count=len(d)).astype(bool))
    if docs:
        docs, codes, indexed = map(np.concatenate, (docs, codes, indexed))
        order = np.argsort(codes, kind="stable")
        docs, codes, indexed = docs[order], codes[order], indexed[order]
        starts, group = groups_of(codes)
        times = np.add.reduceat(np.where(docs < 0, 2, 1), starts)
        shared = (times > 1) & np.logical_or.reduceat(indexed, starts)
        chosen = shared[group] & (docs >= 0)
        told.append(docs[chosen])
        told_codes.append(bucket | codes[chosen].astype(np.uint64))
    told, told_codes = np.concatenate(told), np.concatenate(told_codes)
    return pa.table({"doc_id": pa.array(told, pa.int64()), "code": pa.array(told_codes.view(np.int64))})


# Steps 3 and 4 --------------------------------------------------------------

SEGMENTS = "bucket int, settled boolean, least long, doc_id long, start int, windows int, units binary"
STRETCHES = "doc_id long, start int, end int"


def segment_batches(bucket, settled: bool, least, docs, starts, windows, units: pa.Array | None) -> Iterator[pa.RecordBatch]:
    """Rows of segments, of a bounded number of bytes each batch."""
    sizes = np.zeros(len(docs), np.int64) if units is None else np.diff(bounds_of(units))
    n, first = len(docs), 0
    ends = np.cumsum(sizes)
    while first < n:
        before = ends[first - 1] if first else 0
        last = min(n, max(first + 1, int(np.searchsorted(ends, before + BATCH_BYTES, side="right"))))
        at = slice(first, last)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(bucket[at].astype(np.int32)),
                pa.array(np.full(last - first, settled)),
                pa.array(least[at].view(np.int64)),
                pa.array(docs[at]),
                pa.array(starts[at].astype(np.int32)),
                pa.array(windows[at].astype(np.int32)),
                units[first:last].cast(pa.binary()) if units is not None else pa.nulls(len(docs[at]), pa.binary()),
            ],
            names=["bucket", "settled", "least", "doc_id", "start", "windows", "units"],
        )
        first = last


def settle(shape, least, docs, starts, windows, units: pa.Array, bucket) -> Iterator[pa.RecordBatch]:
    """Of equal segments the earliest is sent on; the stretches of the others are settled.

    ``bucket`` gives the buckets of the segments at some places.
    """
    key = units.dictionary_encode().indices.to_numpy()
    order = np.lexsort((starts, docs, key))
    first, group = groups_of(key[order])
    repeat = np.zeros(len(key), bool)
    if shape.same_document:
        repeat[order] = True
        repeat[order[first]] = False
    else:
        repeat[order] = docs[order] > docs[order][first][group]
    sent, gone = np.flatnonzero(~repeat), np.flatnonzero(repeat)
    yield from segment_batches(bucket(sent), False, least[sent], docs[sent], starts[sent], windows[sent], units.take(pa.array(sent)))
    if len(gone):
        doc, begin, end = joined(docs[gone], starts[gone], starts[gone] + windows[gone] + shape.width - 1)
        zero = np.zeros(len(doc), np.uint64)
        yield from segment_batches(zero, True, zero, doc, begin, end - begin - shape.width + 1, None)


def pack_segments(shape, anchor_buckets: int, buckets: int):
    """Segments of windows that hold a shared anchor, with what compares them."""

    def flush(held) -> Iterator[pa.RecordBatch]:
        least, docs, starts, windows = (np.concatenate([h[i] for h in held]) for i in range(4))
        units = pa.concat_arrays([h[4] for h in held])
        yield from settle(shape, least, docs, starts, windows, units, lambda at: least[at] % np.uint64(buckets))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            known = batch.column("codes")
            lengths = np.diff(known.offsets.to_numpy())
            known_rows = np.repeat(np.arange(len(ids)), lengths)
            known = known.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            for first, last, data, offsets in slices(batch.column("text")):
                a, b = np.searchsorted(known_rows, (first, last))
                found = shape.segments(
                    data, offsets, lambda r, v, a=a, b=b, f=first: flagged(r, code_of(v, anchor_buckets), known_rows[a:b] - f, known[a:b])
                )
                row, least, starts, windows, units = found
                if len(row):
                    held.append((least, ids[first:last][row], starts, windows, units))
                    size += units.nbytes + 40 * len(row)
                if size >= HELD_BYTES:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return run


def split_windows(shape, buckets: int, cut: int):
    """Segments cut into pieces, each in a bucket by its own hash."""

    def flush(held) -> Iterator[pa.RecordBatch]:
        docs, starts, windows = (np.array([h[i] for h in held], np.int64) for i in (1, 2, 3))
        units = pa.array([h[4] for h in held], pa.large_binary())
        segment, at, n, pieces, hashes = shape.pieces(units, windows, cut)
        yield from settle(shape, hashes, docs[segment], starts[segment] + at, n, pieces, lambda chosen: hashes[chosen] % np.uint64(buckets))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("least", "doc_id", "start", "windows")]
            for least, doc, start, windows, units in zip(*columns, batch.column("units").to_pylist(), strict=True):
                for first in range(0, windows, PIECE_WINDOWS):
                    n = min(PIECE_WINDOWS, windows - first)
                    held.append((least, doc, start + first, n, shape.cut(units, first, n)))
                    size += n * shape.window_bytes
                    if size >= HELD_BYTES:
                        yield from flush(held)
                        held, size = [], 0
        if held:
            yield from flush(held)

    return run


def routed(
    segments: DataFrame, shape, buckets: int, hot_windows: int = HOT_WINDOWS, paths: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Segments to compare in their buckets, and settled ones; hot least hashes are split.

    ``paths`` gets the paths of the tables that both read.
    """
    paths = [] if paths is None else paths
    left = saved(segments, "segments", paths)
    windows = left.filter("not settled").agg(F.sum("windows")).first()[0] or 0
    hot_windows = max(hot_windows, windows // (HOT_PART * buckets))
    cold, settled = [], [left.filter("settled")]
    for cut in shape.cuts:
        open_ = left.filter("not settled")
        hot = open_.groupBy("least").agg(F.sum("windows").alias("n")).filter(F.col("n") > hot_windows).select("least")
        hot = hint_small(saved(hot, "hot", paths))
        if hot.isEmpty():
            cold.append(open_)
            break
        cold.append(open_.join(hot, "least", "left_anti").select(*left.columns))
        split = open_.join(hot, "least", "left_semi").select(*left.columns)
        # Equal segments of all tasks side by side, so that they are settled; a partition of many is divided.
        split = split.hint("rebalance", F.col("units")).sortWithinPartitions("units")
        left = saved(split.mapInArrow(split_windows(shape, buckets, cut), SEGMENTS), "split", paths)
        settled.append(left.filter("settled"))
    else:
        cold.append(left.filter("not settled"))
    return reduce(DataFrame.unionByName, cold), reduce(DataFrame.unionByName, settled)


GATHERED = "bucket int, docs binary, starts binary, windows binary, lengths binary, units binary"


def gather_segments(batches) -> Iterator[pa.RecordBatch]:
    """Segments of a task as one row for each bucket."""

    def flush(held) -> Iterator[pa.RecordBatch]:
        bucket, docs, starts, windows = (np.concatenate([h[i] for h in held]) for i in range(4))
        order = np.argsort(bucket, kind="stable")
        units = pa.concat_arrays([h[4] for h in held]).take(pa.array(order))
        begins, _ = groups_of(bucket[order])
        ends = np.append(begins[1:], len(order))
        bounds = bounds_of(units)
        columns = (docs[order], starts[order], windows[order], np.diff(bounds).astype(np.int32))
        packed = [binary_array(c.view(np.uint8), begins * c.itemsize, ends * c.itemsize) for c in columns]
        data = np.frombuffer(units.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        packed.append(binary_array(data, bounds[begins] - bounds[0], bounds[ends] - bounds[0]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[order][begins], pa.int32()), *(p.cast(pa.binary()) for p in packed)],
            names=["bucket", "docs", "starts", "windows", "lengths", "units"],
        )

    held, size = [], 0
    for batch in batches:
        numbers = [batch.column(c).to_numpy() for c in ("bucket", "doc_id", "start", "windows")]
        units = batch.column("units").cast(pa.large_binary())
        if len(units):
            held.append((*numbers, units))
            size += units.nbytes + 20 * len(units)
        if size >= HELD_BYTES:
            yield from flush(held)
            held, size = [], 0
    if held:
        yield from flush(held)


def match_segments(shape):
    """Of one bucket: the stretches of windows that occur earlier."""

    def run(table: pa.Table) -> pa.Table:
        parts = {c: b"".join(table.column(c).to_pylist()) for c in ("docs", "starts", "windows", "lengths", "units")}
        d = np.frombuffer(parts["docs"], np.int64)
        s, n, lengths = (np.frombuffer(parts[c], np.int32).astype(np.int64) for c in ("starts", "windows", "lengths"))
        to = np.cumsum(lengths)
        units = binary_array(np.frombuffer(parts["units"], np.uint8), to - lengths, to)
        segment, at, length = shape.repeats(d, s, n, units)
        docs, begins, ends = joined(d[segment], s[segment] + at, s[segment] + at + length)
        return pa.table({"doc_id": docs, "start": begins.astype(np.int32), "end": ends.astype(np.int32)})

    return run


def joined(docs, begins, ends) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of each document, those that overlap or touch made one."""
    order = np.lexsort((begins, docs))
    docs, begins, ends = docs[order], begins[order], ends[order]
    if not len(docs):
        return docs, begins, ends
    far = np.int64(1) << np.int64(40)
    group = np.cumsum(np.append(True, docs[1:] != docs[:-1]).astype(np.int64)) * far
    reach = np.maximum.accumulate(group + ends) - group
    new = np.append(True, (docs[1:] != docs[:-1]) | (begins[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    return docs[at], begins[at], reach[np.append(at[1:] - 1, len(docs) - 1)]


# The whole ------------------------------------------------------------------


def shared_segments(texts: DataFrame, shape, buckets: int) -> DataFrame:
    """Segments of the windows that hold an anchor which other documents have too."""
    anchors = texts.mapInArrow(pack_anchors(shape, buckets), ANCHORS)
    told = anchors.groupBy("bucket").applyInArrow(match_anchors, "doc_id long, code long")
    shared = told.groupBy("doc_id").agg(F.collect_list("code").alias("codes"))
    known = texts.join(shared, "doc_id").select("doc_id", "text", "codes")
    return known.mapInArrow(pack_segments(shape, buckets, buckets), SEGMENTS)


def matched_stretches(open_: DataFrame, shape, text_bytes: int, paths: list[str], turn_bytes: int = TURN_BYTES) -> DataFrame:
    """What the buckets of the segments find, some of the buckets after others."""
    open_ = open_.select("bucket", "doc_id", "start", "windows", "units")
    segments, windows = open_.agg(F.count(F.lit(1)), F.coalesce(F.sum("windows"), F.lit(0))).first()
    size = shape.unit_bytes(segments, windows) + 20 * segments
    turns = -(-size // max(text_bytes, turn_bytes)) or 1
    found = []
    for turn in range(turns):
        part = open_.filter(F.col("bucket") % turns == turn) if turns > 1 else open_
        gathered = part.mapInArrow(gather_segments, GATHERED)
        found.append(saved(gathered.groupBy("bucket").applyInArrow(match_segments(shape), STRETCHES), "stretches", paths))
    return reduce(DataFrame.union, found)


def all_stretches(texts: DataFrame, shape, buckets: int, text_bytes: int) -> DataFrame:
    """The stretches to remove from each document, written; tables that only led to them are removed."""
    paths: list[str] = []
    open_, settled = routed(shared_segments(texts, shape, buckets), shape, buckets, paths=paths)
    matched = matched_stretches(open_, shape, text_bytes, paths)
    settled = settled.select("doc_id", "start", (F.col("start") + F.col("windows") + shape.width - 1).alias("end"))
    stretches = (
        matched.union(settled)
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("start", "end")).alias("stretches"))
    )
    stretches = saved(stretches, "stretches")
    remove_tables(texts.sparkSession, paths)
    return stretches


def repeated_stretches(docs: DataFrame, shape) -> DataFrame:
    """``docs`` (doc_id long, text) with ``copy`` and ``stretches``.

    ``copy`` is true if all units of the document, at least a window of them,
    are those of a document with a smaller id. ``stretches`` are the start and
    end units of what repeats; they may overlap, and are null if nothing does.
    Null ids take no part: their rows come back with no stretches. A null text
    is empty. Rows that share an id count as one document.
    """
    spark = docs.sparkSession
    # A column without a cast: plans that differ by one don't share a shuffle.
    every = docs.select("doc_id", text_or_empty().alias("text"))
    nameless = every.filter("doc_id is null")
    texts = every.filter("doc_id is not null")
    with brief_shuffles(spark):
        sized = saved(
            texts.select("doc_id", shape.digest(F.col("text")).alias("digest"), F.octet_length("text").alias("n_bytes")),
            "digests",
        )
        copies = earliest_of_copies(sized.filter("digest is not null"), "digest")
        copies = copies.groupBy("doc_id").agg(F.min(F.col("first_id") < F.col("doc_id")).alias("same"))
        total = sized.agg(F.sum("n_bytes")).first()[0] or 0
        buckets = max(shuffle_partitions(spark), total // BUCKET_BYTES)

        # Joins on the id alone, so that a shuffle of the texts serves both passes of a plan.
        texts = texts.join(copies, "doc_id", "left").withColumn("copy", F.coalesce("same", F.lit(False)))
        stretches = all_stretches(texts.filter("not copy").select("doc_id", "text"), shape, buckets, total)
    found = texts.join(stretches, "doc_id", "left").select("doc_id", "text", "copy", "stretches")
    return found.unionByName(nameless.withColumn("copy", F.lit(False)), allowMissingColumns=True)
