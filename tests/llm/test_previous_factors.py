"""Longest previous factors against plain comparison, and buckets of hot strings."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm.repeats import gather_segments, matched_stretches, routed, shared_segments
from tarn.llm.shared import shared_folder
from tarn.llm.substring_dedup import WordWindows, remove_repeated_windows
from tarn.llm.suffix_dedup import ByteWindows, previous_factors, remove_repeated_strings
from tests.llm.test_dedup import brute_strings, brute_windows, strings, texts_of, windows


def plain_factors(segments):
    out = []
    for doc, text in segments:
        for i in range(len(text)):
            longest = 0
            for other, earlier in segments:
                if other < doc:
                    for j in range(len(earlier)):
                        n = 0
                        while i + n < len(text) and j + n < len(earlier) and text[i + n] == earlier[j + n]:
                            n += 1
                        longest = max(longest, n)
            out.append(longest)
    return out


def test_factors_match_plain_comparison():
    pick = np.random.default_rng(5)
    for letters, size in ((1, 30), (2, 40), (3, 60), (4, 25)):
        for _ in range(6):
            segments = [
                (int(pick.integers(0, 6)), bytes(pick.integers(0, letters, int(pick.integers(1, size))).astype(np.uint8) * 97))
                for _ in range(7)
            ]
            data = np.frombuffer(b"".join(t for _, t in segments), np.uint8)
            ends = np.cumsum([len(t) for _, t in segments])
            begins = ends - [len(t) for _, t in segments]
            found = previous_factors(data, begins, ends, np.array([d for d, _ in segments]), ends - begins)
            assert found.tolist() == plain_factors(segments)
    nothing = np.zeros(0, np.int64)
    assert len(previous_factors(np.zeros(0, np.uint8), nothing, nothing, nothing, nothing)) == 0


def around(middle: str, n: int, unit):
    """Documents that hold ``middle`` in surroundings of their own, some of them equal."""
    return [f"{unit(f'left{i % (n - 5)}', i)} {middle} {unit(f'right{i % (n - 3)}', i)}" for i in range(n)]


@pytest.mark.parametrize(("shape", "remove", "plain", "seen"), [
    (ByteWindows(), remove_repeated_strings, brute_strings, strings),
    (WordWindows(), remove_repeated_windows, brute_windows, windows),
])
def test_hot_strings_are_split_and_nothing_is_lost(docs_of, shape, remove, plain, seen):
    """A string shorter than a window in many documents: no bucket gets many of its windows."""
    unit = lambda stem, i: " ".join(f"{stem}.{k * 7919 % 10_007}" for k in range(20))
    middle = "a common string of exactly forty bytes!!" if shape.width == 50 else " ".join(f"common{k}" for k in range(14))
    docs = docs_of(around(middle, 1200, unit)).repartition(40)
    assert seen(remove(docs)) == plain(texts_of(docs))

    segments = shared_segments(docs.select("doc_id", "text"), shape, 211)
    open_, _ = routed(segments, shape, 211, hot_windows=1000)
    sizes = open_.groupBy("bucket").agg(F.sum("windows").alias("n")).agg(F.max("n"), F.sum("n")).first()
    assert sizes[0] < 0.05 * sizes[1]


@pytest.mark.parametrize("shape", [ByteWindows(), WordWindows()])
def test_a_task_sends_each_bucket_one_row(docs_of, shape):
    """With columns of their own segments took 128 bytes and more each, units of 63 for op 9."""
    middle = " ".join(f"common{k}" for k in range(60))
    docs = docs_of([f"{middle} {' '.join(f'own{i}.{k}' for k in range(30))} {middle}" for i in range(60)])
    open_, _ = routed(shared_segments(docs.select("doc_id", "text"), shape, 3), shape, 3, hot_windows=100_000)
    segments = open_.select("bucket", "doc_id", "start", "windows", "units").toArrow()
    assert segments.num_rows > 6
    batches = segments.to_batches(max_chunksize=5)
    (packed,) = gather_segments(iter(batches))
    assert packed.num_rows == len(set(segments.column("bucket").to_pylist())) <= 3
    size = sum(len(v) for c in packed.column_names[1:] for v in packed.column(c).to_pylist())
    assert size == sum(map(len, segments.column("units").to_pylist())) + 20 * segments.num_rows
    sent = {}
    for bucket, doc, start, n, units in zip(*(c.to_pylist() for c in segments.columns), strict=True):
        sent.setdefault(bucket, []).append((doc, start, n, units))
    for row in packed.to_pylist():
        ends = np.cumsum(np.frombuffer(row["lengths"], np.int32)).tolist()
        numbers = (np.frombuffer(row[c], t).tolist() for c, t in (("docs", np.int64), ("starts", np.int32), ("windows", np.int32)))
        units = [row["units"][a:b] for a, b in zip([0, *ends], ends, strict=False)]
        assert sorted(zip(*numbers, units, strict=True)) == sorted(sent[row["bucket"]])


def test_hot_strings_travel_in_runs_of_windows(docs_of):
    """As single windows of 50 bytes, hot segments took many times their own bytes."""
    pick = np.random.default_rng(3)
    own = lambda: "".join(chr(97 + k) for k in pick.integers(0, 26, 60))
    shape, texts = ByteWindows(), [f"{own()} a common string of 30 bytes!! {own()}" for _ in range(400)]
    segments = shared_segments(docs_of(texts).select("doc_id", "text"), shape, 50)
    open_, _ = routed(segments, shape, 50, hot_windows=3000)
    windows, units = open_.agg(F.sum("windows"), F.sum(F.octet_length("units"))).first()
    assert windows > 3000
    assert units < 25 * windows


def test_equal_segments_of_all_tasks_meet_before_they_are_cut(docs_of):
    """Each of 40 tasks sent every window of the passage to its bucket."""
    shape, passage = ByteWindows(), " ".join(f"word{k * 7919 % 10_007}" for k in range(40))
    docs = docs_of([f"{i * 7919:020d} {passage} {i * 104_729:020d}" for i in range(400)]).repartition(40)
    segments = shared_segments(docs.select("doc_id", "text"), shape, 50)
    open_, _ = routed(segments, shape, 50, hot_windows=100)
    inside = open_.filter("start >= 21").filter(F.col("start") + F.col("windows") + shape.width - 1 <= 21 + len(passage))
    assert 0 < inside.agg(F.sum("windows")).first()[0] < 10 * len(passage)


@pytest.mark.parametrize("shape", [ByteWindows(), WordWindows()])
def test_buckets_that_take_turns_find_the_same(docs_of, shape):
    middle = " ".join(f"common{k}" for k in range(60))
    docs = docs_of([f"{middle} {' '.join(f'own{i}.{k}' for k in range(30))} {middle}" for i in range(60)]).repartition(4)
    open_, _ = routed(shared_segments(docs.select("doc_id", "text"), shape, 20), shape, 20)
    at_once, in_turns = [], []
    found = matched_stretches(open_, shape, 1 << 40, at_once).collect()
    assert sorted(found) == sorted(matched_stretches(open_, shape, 1, in_turns, turn_bytes=2000).collect())
    assert found and len(at_once) == 1 and len(in_turns) > 3


@pytest.mark.parametrize("remove", [remove_repeated_strings, remove_repeated_windows])
def test_tables_of_segments_are_removed(spark, docs_of, remove):
    """They lay beside the shuffled texts of the result."""
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    found = remove(docs_of(around("a common string of exactly forty bytes!! " * 5, 30, lambda stem, i: f"{stem}.{i * 7919}")))
    left = {p.name.rpartition("-")[0] for p in set(folder.iterdir()) - before}
    assert "stretches" in left and not left & {"segments", "hot", "split"}
    assert found.count() == found.count() == 30


@pytest.mark.parametrize("shape", [ByteWindows(), WordWindows()])
def test_what_is_hot_depends_on_the_size_of_a_bucket(docs_of, shape):
    """A fixed number made ever more of a larger table hot, and it was cut into single windows."""
    docs = docs_of([" ".join(f"word{k * 7919 % 10_007}" for k in range(2000))] * 60)
    segments = shared_segments(docs.repartition(20).select("doc_id", "text"), shape, 1)
    for buckets in (1, 1000):
        paths: list[str] = []
        routed(segments, shape, buckets, hot_windows=5, paths=paths)
        assert any("/split-" in path for path in paths) == (buckets > 1)
