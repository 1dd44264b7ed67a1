"""Exact, near and substring duplicates against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm.exact_dedup import exact_duplicates
from tarn.llm.minhash_dedup import near_duplicates
from tarn.llm.near_links import FREQUENCY_BUCKETS, bucket_counts, bucket_of
from tarn.llm.queries import op5_minhash_near_dedup, op8_substring_dedup, op9_suffix_array_dedup
from tarn.llm.shared import connected_components
from tarn.llm.substring_dedup import remove_repeated_windows
from tarn.llm.suffix_dedup import remove_repeated_strings
from tests.conftest import TESTDATA
from tests.llm.conftest import TEXTS, words
from tests.llm.test_rolling import thue_morse

FOLDER = f"{TESTDATA}/sf0.001"


def texts_of(df):
    return sorted((r.doc_id, (r.text or "").encode()) for r in df.select("doc_id", "text").collect())


def brute_windows(docs, width=20):
    seen, out = set(), {}
    for doc, text in docs:
        found = text.split()
        gone = [False] * len(found)
        for s in range(len(found) - width + 1):
            key = tuple(found[s : s + width])
            if key in seen:
                gone[s : s + width] = [True] * width
            seen.add(key)
        kept = [w for w, g in zip(found, gone, strict=True) if not g]
        out[doc] = (len(found), len(found) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def brute_strings(docs, width=50):
    seen, out = set(), {}
    for doc, text in docs:
        gone, new = bytearray(len(text)), set()
        for s in range(len(text) - width + 1):
            key = text[s : s + width]
            if key in seen:
                gone[s : s + width] = b"\1" * width
            new.add(key)
        seen |= new
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[doc] = (len(text), len(text) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


def brute_near(docs, n, percent=80):
    sets = {}
    for doc, text in docs:
        found = text.lower().split() if text.isascii() else re.sub(rb"[A-Z]", lambda m: m[0].lower(), text).split()
        runs = [tuple(found[i : i + n]) for i in range(len(found) - n + 1)] or ([tuple(found)] if found else [])
        sets[doc] = frozenset(runs)
    parent = {doc: doc for doc in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {doc: (len(sets[doc]), find(doc), find(doc) == doc) for doc in ids}


def windows(df):
    rows = df.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    return {r[0]: tuple(r[1:]) for r in rows}


def strings(df):
    rows = df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    return {r[0]: tuple(r[1:]) for r in rows}


def near(df):
    return {r[0]: tuple(r[1:]) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()}


def test_windows_match_brute_force(spark, docs_of):
    docs = docs_of(TEXTS)
    assert windows(remove_repeated_windows(docs)) == brute_windows(texts_of(docs))
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r[0]: tuple(r[1:]) for r in op8_substring_dedup(spark, FOLDER).collect()}
    assert got == brute_windows(texts_of(table))


def test_strings_match_brute_force(spark, docs_of):
    docs = docs_of(TEXTS)
    assert strings(remove_repeated_strings(docs)) == brute_strings(texts_of(docs))
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r[0]: tuple(r[1:]) for r in op9_suffix_array_dedup(spark, FOLDER).collect()}
    assert got == brute_strings(texts_of(table))


def test_near_duplicates_match_brute_force(spark, docs_of):
    docs = docs_of(TEXTS)
    assert near(near_duplicates(docs)) == brute_near(texts_of(docs), 5)
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r[0]: tuple(r[1:]) for r in op5_minhash_near_dedup(spark, FOLDER).collect()}
    assert got == brute_near(texts_of(table), 2)


def test_large_groups_of_near_copies(docs_of):
    """More members than a long list, some of them just beyond the similarity."""
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(300):
        changed = list(base)
        for k in range(1 + i % 4):
            changed[(7 * i + 13 * k) % 60] = f"x{i}_{k}"
        texts.append(" ".join(changed))
    docs = docs_of(texts)
    assert near(near_duplicates(docs, words=2)) == brute_near(texts_of(docs), 2)


def test_large_groups_of_differing_sizes(docs_of):
    """Pairs about the bound whose members are hidden in long lists, of other sizes."""
    base = [f"w{i}" for i in range(50)]
    texts = []
    for i in range(200):
        changed = base + [f"y{k}" for k in range(i % 11)]
        for k in range(i % 5):
            changed[(11 * i + 17 * k) % 50] = f"x{i % 40}_{k}"
        texts.append(" ".join(changed))
    docs = docs_of(texts)
    assert near(near_duplicates(docs, words=2)) == brute_near(texts_of(docs), 2)


def test_rows_that_share_an_id_count_once(spark):
    rows = [(1, words(60)), (1, words(50, "other")), (2, words(50, "other")), (3, words(60)), (3, words(60))]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, component long, value string")
    assert near(near_duplicates(docs)) == {1: (56, 1, True), 2: (46, 2, True), 3: (56, 1, False)}


def test_frequency_table_counts_every_shingle(spark, docs_of):
    sets = spark.range(2000).repartition(5).selectExpr("transform(sequence(1, 20), i -> xxhash64(id % 70, i)) AS shingles")
    values = np.concatenate([np.array(r.shingles) for r in sets.collect()])
    assert (bucket_counts(sets) == np.bincount(bucket_of(values), minlength=FREQUENCY_BUCKETS)).all()
    assert not bucket_counts(sets.limit(0)).any()


def test_exact_groups(docs_of):
    docs = docs_of(["a b", "ab", "a  b", None, "", "c", "A b"])
    rows = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_duplicates(docs).collect()}
    assert rows == {
        0: (2, 3, False), 1: (2, 3, False), 2: (2, 3, True), 3: (3, 2, True), 4: (3, 2, False), 5: (5, 1, True), 6: (6, 1, True),
    }
    full = exact_duplicates(docs, digest_all=True).collect()
    assert {r.doc_id: r.text_sha256 for r in full}[5] == hashlib.sha256(b"c").hexdigest()


def test_exact_groups_do_not_depend_on_the_bit_table(docs_of):
    """A table of one word lets every text through; the rows are the same."""
    texts = [f"{'p' * 70} {i % 50} {i // 100}" for i in range(400)] + [f"single {i} {'q' * (i % 9)}" for i in range(200)] + ["", None]
    docs = docs_of(texts)
    found = sorted(tuple(r) for r in exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", F.coalesce("text_sha256", F.lit("-"))).collect())
    narrow = exact_duplicates(docs, table_words=1).select("doc_id", "keep_id", "group_size", "kept", F.coalesce("text_sha256", F.lit("-")))
    assert sorted(tuple(r) for r in narrow.collect()) == found
    bare = Counter("".join((t or "").split()) for t in texts)
    assert {r[0]: r[2] for r in found} == {i: bare["".join((t or "").split())] for i, t in enumerate(texts)}
    marks = Counter((len("".join((t or "").split())), "".join((t or "").split())[:64]) for t in texts)
    assert {r[0] for r in found if r[4] == "-"} == {i for i, t in enumerate(texts) for b in ["".join((t or "").split())] if marks[len(b), b[:64]] == 1}


@pytest.mark.parametrize("operator", [exact_duplicates, near_duplicates, remove_repeated_windows, remove_repeated_strings])
def test_empty_tables_and_rows_without_id(spark, docs_of, operator):
    assert operator(docs_of([])).count() == 0
    lost = spark.createDataFrame([(None, words(50)), (None, words(50)), (1, words(50)), (1, words(50))], "doc_id long, text string")
    rows = operator(lost).collect()
    assert sorted({r.doc_id for r in rows}, key=str) in ([1, None], [1])


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99)], "a long, b long")
    rows = dict(connected_components(links).collect())
    assert set(rows.values()) == {0, 99} and len(rows) == 43


def test_long_words_of_equal_structure_are_told_apart(docs_of):
    """Words that collide in any polynomial modulo a power of two."""
    texts = []
    for size in (1024, 4096):
        texts += [f"{words(19)} {thue_morse(size)}", f"{words(19)} {thue_morse(size, True)}", thue_morse(size), thue_morse(size, True)]
    docs = docs_of(texts)
    assert windows(remove_repeated_windows(docs)) == brute_windows(texts_of(docs))
    assert near(near_duplicates(docs, words=2)) == brute_near(texts_of(docs), 2)
