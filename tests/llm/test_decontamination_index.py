"""The inverted lists of decontamination against sums over all items."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import decontamination
from tarn.llm.decontamination import IS_WORD, Index, Statistics, contaminated, word_list
from tarn.llm.rolling import Words


def items_of(pick, n: int, forms: int) -> list[tuple[int, str, int]]:
    draw = lambda: " ".join(f"t{int(w) % forms}" for w in pick.zipf(1.3, int(pick.integers(1, 40))))
    return [(i, draw(), 1) for i in range(n)]


def statistics(items) -> Statistics:
    words = [word_list(text) for _, text, _ in items]
    return Statistics(len(items), sum(map(len, words)) / len(items), max(map(len, words)), Counter(t for w in words for t in set(w)))


@pytest.mark.parametrize("group_runs", [1, decontamination.GROUP_RUNS])
def test_candidates_are_all_items_above_the_threshold(monkeypatch, group_runs):
    monkeypatch.setattr(decontamination, "GROUP_RUNS", group_runs)
    pick = np.random.default_rng(11)
    items = items_of(pick, 700, 400)
    index = Index(items, statistics(items))
    texts = [" ".join(t for _, t, _ in items_of(pick, 6, 600)) for _ in range(40)] + [items[i][1] for i in range(0, 700, 50)]
    data = np.frombuffer(" ".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    offsets[-1] -= 1
    words = Words(data, offsets, IS_WORD[data])
    rows = words.rows()
    places, hashes = np.arange(len(rows)) - words.first[:-1][rows], words.hashes(data, fold=True)

    dense = np.zeros((len(index.hashes), len(items)))
    term = np.repeat(np.arange(len(index.hashes)), np.diff(index.run_ends[index.lists]))
    dense[term, index.item] = index.impact
    assert np.allclose(dense.sum(axis=0), 1)
    terms = index.terms(hashes)
    for threshold in (0.3, 0.6, 1 - 1e-5):
        expected = []
        for row in range(len(texts)):
            own = terms[words.first[row] : words.first[row + 1]]
            for chunk in range(-(-len(own) // index.span)):
                passage = np.unique(own[chunk * index.span : (chunk + 2) * index.span])
                scores = dense[passage[passage >= 0]].sum(axis=0)
                expected += [(row, chunk, int(i), float(scores[i])) for i in np.flatnonzero(scores >= threshold)]
        assert expected
        assert sorted(index.candidates(rows, places, hashes, threshold)) == sorted(expected)


def test_a_large_benchmark_takes_one_scan(spark, docs_of):
    """5,000 items in one index; each document holds one of them whole, or none."""
    items = [(i, " ".join(f"w{(i * 31 + k * k * 7) % 9_000}" for k in range(12)) + f" only{i}.") for i in range(5_000)]
    benchmark = spark.createDataFrame([(i, text, "z") for i, text in items], "item_id long, text string, times string")
    docs = docs_of([f"lead in {items[i][1]} and on" for i in range(0, 5_000, 250)] + ["none of them", None])
    found = contaminated(docs, benchmark)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan
    assert {(r.doc_id, r.item_id) for r in found.filter("score > 0.99").collect()} == {(i, 250 * i) for i in range(20)}


def test_wide_spaces_very_long_texts_and_clashing_columns(spark, docs_of):
    """Item words are those of texts, also where a wide space follows the end of a sentence."""
    item = "alpha beta gamma delta. epsilon zeta eta? theta iota kappa"
    benchmark = spark.createDataFrame([(1, item, 5, 9)], "item_id long, text string, part long, seen long")
    long = " ".join(f"n{i}" for i in range(400_000))
    docs = docs_of([f"{long} {item}", long, item]).withColumn("item_id", F.lit(9)).withColumn("times", F.lit("x"))
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, benchmark).collect()} == {(0, 1), (2, 1)}
