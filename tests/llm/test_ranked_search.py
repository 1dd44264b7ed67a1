"""Ranked search against plain scoring of every document."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa

from tarn.llm.queries import op11_ranked_search
from tarn.llm.ranked_search import Queries, Weights, add_bounds, make_blocks, ranked_documents, reach
from tests.conftest import TESTDATA
from tests.llm.conftest import TEXTS

FOLDER = f"{TESTDATA}/sf0.001"


def plain_terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain_ranks(docs, items, top=50):
    found = [(doc, plain_terms(text)) for doc, text in docs]
    n_docs, n_terms = sum(bool(t) for _, t in found), sum(len(t) for _, t in found)
    seen = {}
    for _, terms in found:
        for term in set(terms):
            seen[term] = seen.get(term, 0) + 1
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(plain_terms(text))
    out = []
    for item, wanted in asked.items():
        scores = []
        for doc, terms in found:
            scale = 100 - 50 + (50 * len(terms) * n_docs) // n_terms if terms else 0
            score = 0
            for term in wanted & set(terms):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * seen[term] + 1)))
                score += weight * ((1_000_000_000 * terms.count(term)) // (1000 * terms.count(term) + 20 * scale))
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if none else doc, -s) for k, (s, none, doc) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def pairs(df, key):
    return [(r[key], r["text"]) for r in df.select(key, "text").collect()]


def test_ranks_match_plain_scores_on_the_table(spark):
    docs, items = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    found = op11_ranked_search(spark, FOLDER)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert result(found) == plain_ranks(pairs(docs, "doc_id"), pairs(items, "item_id"))


def test_ties_nulls_and_many_blocks(spark, docs_of):
    pick = np.random.default_rng(2)
    texts = [" ".join(f"t{w}" for w in pick.zipf(1.4, 1 + i % 30) % 200) for i in range(1500)]
    texts += ["t1 t2 t3"] * 70 + TEXTS + ["É t1 é", "T1 t1-T1_t1", "t5 " * 100_000, "\0t1\0"]
    docs = docs_of(texts).union(docs_of([None, "t1 t2", "t7"], first=4))
    lost = spark.createDataFrame([(None, "t1 t2 t9", "x", 7), (None, "t1", "x", 7)], docs.schema)
    docs = docs.union(lost).repartition(7)
    items = [(1, "t1 t2 t3"), (2, "T1"), (3, ""), (4, None), (5, "unseen"), (6, " ".join(f"t{i}" for i in range(150))), (7, "t3"), (7, "t4 t3"), (None, "t9 é")]
    asked = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, score long, term string")
    expected = plain_ranks(pairs(docs, "doc_id"), items)
    assert result(ranked_documents(docs, asked)) == expected
    assert result(ranked_documents(docs, asked, part_terms=40)) == expected
    assert result(ranked_documents(docs, asked, top=3)) == plain_ranks(pairs(docs, "doc_id"), items, 3)
    assert ranked_documents(docs.limit(0), asked).count() == 0
    assert ranked_documents(docs, asked.limit(0)).count() == 0


def test_pair_bounds_hold_and_are_tighter_than_single_maxima():
    pick = np.random.default_rng(4)
    texts = [" ".join(f"t{w}" for w in pick.integers(0, 60, 12)) for _ in range(40)]
    asked = [(i, f"t{w}".encode()) for i in range(30) for w in pick.permutation(60)[: 2 + i % 7]]
    queries = Queries(pa.table({"item_id": pa.array([i for i, _ in asked]), "term": pa.array([t for _, t in asked], pa.binary())}))

    class Value:
        def __init__(self, value):
            self.value = value

    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(40), pa.int64()), "text": texts})
    (block,) = make_blocks(Value(queries.vocabulary))([batch])
    frequencies = np.bincount(np.frombuffer(block.column("terms")[0].as_py(), np.int32), minlength=len(queries.vocabulary))
    known = Weights(queries, frequencies, 40, 480)
    (index,) = add_bounds(Value(known))([block])
    row = index.to_pylist()[0]
    terms = np.frombuffer(row["terms"], np.int32)
    maxima, pairs_, joint = (np.frombuffer(row[c], np.int64) for c in ("maxima", "pairs", "joint"))
    bound = reach(known, terms, maxima, pairs_, joint)
    single = np.zeros(len(known.weights), np.int64)
    single[terms] = maxima
    tighter = 0
    for query in range(30):
        table = np.zeros((len(known.weights), 40), np.int64)
        at, docs, impacts = np.frombuffer(row["rows"], np.int32), np.frombuffer(row["docs"], np.int32), np.frombuffer(row["impacts"], np.int64)
        table[terms[at], docs] = impacts
        best = table[queries.of(query)].sum(axis=0).max()
        assert best <= bound[query] <= single[queries.of(query)].sum()
        tighter += bound[query] < single[queries.of(query)].sum()
    assert tighter > 10
