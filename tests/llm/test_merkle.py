"""Roots, proofs and logs against a plain tree."""

from __future__ import annotations

import hashlib
import zlib

from tarn.llm import merkle
from tarn.llm.merkle import append_log, depth, leaves_of, log_entries, merkle_manifest, position, ranked, rounds_of_logs
from tarn.llm.queries import op13_merkle_manifest
from tests.conftest import TESTDATA

FOLDER = f"{TESTDATA}/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, digest string, at int, size int"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, lower=False) -> str:
    text = row.text
    if lower and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    values = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_paths(nodes: list[str]) -> tuple[str, list[list[tuple[list[str], list[str]]]]]:
    """The root over ``nodes``, and beside the path of each the siblings, level by level."""
    paths = [[] for _ in nodes]
    own = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, of_above = [], []
        for begin in range(0, len(nodes), 16):
            run = nodes[begin : begin + 16]
            for k in range(len(run)):
                for leaf in own[begin + k]:
                    paths[leaf].append((run[:k], run[k + 1 :]))
            above.append(h(*run))
            of_above.append([leaf for group in own[begin : begin + 16] for leaf in group])
        nodes, own = above, of_above
    return nodes[0], paths


def plain_manifest(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r.source, []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        members = sorted(by_source[s], key=lambda r: (r.doc_id is not None, r.doc_id or 0, plain_leaf(r)))
        trees[s] = (members, *plain_paths([plain_leaf(r) for r in members]))
    root, upper = plain_paths([trees[s][1] for s in order])
    out = []
    for s, above in zip(order, upper, strict=True):
        members, subroot, paths = trees[s]
        for r, path in zip(members, paths, strict=True):
            tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
            node = plain_leaf(r, lower=tampered)
            for before, after in path + above:
                node = h(*before, node, *after)
            proof = h(*(x for before, after in path + above for x in before + after))
            out.append((r.doc_id, plain_leaf(r), subroot, root, proof, node, node == root))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_manifest_matches_a_plain_tree_on_the_table(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    found = op13_merkle_manifest(spark, FOLDER)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert result(found) == plain_manifest(rows)
    assert {r.verified for r in found.collect()} == {True, False}


def test_nulls_ties_long_texts_and_many_sizes(spark, docs_of):
    rows = [(i, f"Text {i}", "en", "big", i, "t", "d", 1, 2) for i in range(700)]
    rows += [(i, "A" * i, None, f"s{i}", None, "t", "d", 1, 2) for i in range(20)]
    rows += [(i, "Tie", "de", "ties", 3, "t", "d", 1, 2) for i in (1, 1, 1, 2) for _ in range(9)]
    rows += [(None, None, None, None, None, None, None, None, None), (5, None, None, None, None, "", "", 0, 0), (None, "Q", None, "ties", 1, "", "", 0, 0)]
    rows += [(10, "Long É " * 200_000, "fr", "é", 9, "t", "d", 1, 2), (0, "", "", "", 0, "", "", 0, 0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert result(merkle_manifest(docs)) == plain_manifest(docs.collect())


def test_one_row_and_no_row(spark, docs_of):
    one = spark.createDataFrame([(5, "A", "en", "s", 1, "", "", 0, 0)], DOCS)
    assert result(merkle_manifest(one)) == plain_manifest(one.collect())
    assert merkle_manifest(one.limit(0)).count() == 0


def test_positions_are_those_of_the_append_log():
    for size in (1, 2, 15, 16, 17, 255, 256, 257, 273, 600):
        nodes, levels = [bytes([i % 256, i // 256]) * 16 for i in range(size)], depth(size)
        log, level_nodes, seen = append_log(nodes, levels), nodes, set()
        for level in range(levels + 1):
            for i, node in enumerate(level_nodes):
                at = position(level, i, size, levels)
                seen.add(at)
                assert log[at] == node
            level_nodes = [merkle.combine(level_nodes[b : b + 16]) for b in range(0, len(level_nodes), 16)]
        assert seen == set(range(len(log)))


def test_the_log_of_a_tree_has_no_gaps(spark, docs_of):
    rows = [(i, f"T{i}", "en", "big" if i % 4 else "x", i, "t", "d", 1, 2) for i in range(1200)]
    leaves = ranked(leaves_of(spark.createDataFrame(rows, DOCS)), "doc_id", "digest", "row")
    rounds = rounds_of_logs(leaves.drop("row"))
    assert len(rounds) == 2
    for tree in ("=big", "=x"):
        found = sorted(tuple(r)[1:] for r in log_entries(rounds).filter(f"tree = '{tree}'").collect())
        nodes = [r.digest for r in leaves.filter(f"tree = '{tree}'").orderBy("at").collect()]
        assert [r[0] for r in found] == list(range(len(found)))
        assert [bytes(r[2]) for r in found] == append_log([bytes(n) for n in nodes], depth(len(nodes)))
