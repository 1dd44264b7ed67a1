"""The n-gram join against all pairs, and the bounds it rests on."""

from __future__ import annotations

import numpy as np
import pytest

from tarn.llm.parity_join import band_bounds, folded_sketch, hamming, jaccard_join, likely_pairs, most_different, segment_keys, segments_of_band
from tarn.llm.queries import op12_ngram_jaccard_join
from tests.conftest import TESTDATA
from tests.llm.conftest import TEXTS, words
from tests.llm.test_dedup import brute_near, texts_of
from tests.llm.test_rolling import thue_morse

FOLDER = f"{TESTDATA}/sf0.001"


def result(df):
    rows = [tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def brute(docs, n=4, percent=85):
    return {doc: found[:2] for doc, found in brute_near(docs, n, percent).items()}


def test_join_matches_all_pairs(spark, docs_of):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert result(op12_ngram_jaccard_join(spark, FOLDER)) == brute(texts_of(table))
    docs = docs_of([*TEXTS, thue_morse(1024), thue_morse(1024, True), "a " * 70_000])
    assert result(jaccard_join(docs)) == brute(texts_of(docs))


def test_pairs_about_the_bound_in_large_and_small_groups(docs_of):
    """Sets of many sizes, some groups larger than a list, changes on both sides of the bound."""
    pick = np.random.default_rng(7)
    texts = []
    for group in range(30):
        base = [f"g{group}w{i}" for i in range(int(pick.integers(4, 160)))]
        for copy in range(100 if group < 2 else 5):
            changed = list(base)
            for _ in range(int(pick.integers(0, 2 + len(base) // 40))):
                changed[int(pick.integers(len(base)))] = f"x{group}_{copy % 40}_{int(pick.integers(9))}"
            extra = [f"y{copy}_{k}" for k in range(int(pick.integers(0, 1 + len(base) // 12)))]
            texts.append(" ".join(changed + extra))
    docs = docs_of(texts)
    assert result(jaccard_join(docs)) == brute(texts_of(docs))


def test_a_passage_that_most_documents_share(docs_of):
    passage = words(120, "p")
    docs = docs_of([f"{words(i % 50, f'a{i}_')} {passage} {words(i % 7, f'b{i % 90}_')}" for i in range(250)])
    assert result(jaccard_join(docs)) == brute(texts_of(docs))


def test_rows_that_share_an_id_and_empty_tables(spark, docs_of):
    big, small = words(60), words(50, "other")
    rows = [(1, big), (1, small), (2, small), (3, big), (3, big), (None, big), (None, None), (4, None)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, component long, sketch string")
    assert result(jaccard_join(docs)) == {1: (57, 1), 2: (47, 2), 3: (57, 1), 4: (0, 4)}
    assert jaccard_join(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        jaccard_join(docs, percent=50)


def test_bands_hold_the_partners_of_every_size():
    for percent in (70, 85, 95):
        bounds = band_bounds(percent, 5000)
        for n in range(1, 3000):
            band = np.searchsorted(bounds, n, side="right") - 1
            assert n * 100 // percent < bounds[band + 2]
            for m in (n, n * 100 // percent):
                own = np.searchsorted(bounds, m, side="right") - 1
                segments, spare, _ = segments_of_band(bounds, own, percent)
                assert segments == 0 and most_different(n + m, percent) == 0 or segments - spare > most_different(n + m, percent)


def test_sketches_bound_the_difference_from_below():
    pick = np.random.default_rng(3)
    for size in (5, 60, 700):
        base = np.unique(pick.integers(0, 2**63, size).astype(np.uint64))
        other = np.unique(np.concatenate((base[size // 10 :], pick.integers(0, 2**63, size // 2).astype(np.uint64))))
        difference = len(np.setxor1d(base, other))
        assert 0 < hamming(folded_sketch(base), folded_sketch(other)) <= difference
        assert hamming(folded_sketch(base), folded_sketch(base)) == 0
        # Some segment is alike, if only empty: no more differ than bits do.
        one, two = (set(segment_keys(s, 3, difference + 1, 1).tolist()) for s in (base, other))
        assert len(one ^ two) <= 2 * difference


def test_documents_that_share_few_segments_are_not_paired(docs_of, monkeypatch):
    """A passage of all leaves some segments of any two alike, far fewer than a link does."""
    paired = []

    def counted(pairs, *rest):
        paired.append(pairs.count())
        return likely_pairs(pairs, *rest)

    monkeypatch.setattr("tarn.llm.parity_join.likely_pairs", counted)
    passage = words(60, "p")
    texts = [f"{passage} {words(30, f'd{i}_')}" for i in range(60)]
    texts += [f"{passage} {words(30, f'd{i}_')} end" for i in range(0, 60, 7)]
    docs = docs_of(texts)
    assert result(jaccard_join(docs)) == brute(texts_of(docs))
    # The first are pairs with hubs, the second those of short lists.
    # Of the 2,346 pairs of documents 1,596 were compared when one list in common was enough.
    assert paired[1] < 800
