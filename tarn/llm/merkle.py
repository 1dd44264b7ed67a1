"""A Merkle manifest of a table: one tree for each source, one over their roots.

Leaves are ranked within their source by sorting the table by range and adding
what earlier partitions hold, so that no task sees a whole source. *Builders*
then take aligned stretches of ``SPAN`` nodes. A builder appends every node to
its log when the node is complete, that is in postorder; its last node is the
root of the stretch and an input of a builder of the next round, until one node
remains.

Where a node lies in such a log needs no index: the postorder position of a
node follows from its first leaf and the size of its subtree. A proof is read
from the logs by these positions, the siblings of every level from the log of
the builder that made them, from the top round down.
"""

from __future__ import annotations

import hashlib
import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.shared import saved

FAN = 16
# Levels that a builder completes, and the nodes below it.
LEVELS = 2
SPAN = FAN**LEVELS
DIGEST = 32

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


# Leaves ---------------------------------------------------------------------


def framed(values: list[Column]) -> Column:
    """Of all values the UTF-8 length, ``:`` and the value; ``-`` for a null."""
    texts = [v.cast("string") for v in values]
    return F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def digest(values: list[Column]) -> Column:
    return F.unhex(F.sha2(framed(values), 256))


def leaves_of(docs: DataFrame) -> DataFrame:
    """``tree``, ``doc_id``, ``digest`` and ``changed``, the digest after tampering."""
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    values = [F.col(c) for c in COLUMNS]
    tampered = [lowered if c == "text" else F.col(c) for c in COLUMNS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return docs.select(
        # Sorts as the sources do by their bytes, null first.
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        digest(values).alias("digest"),
        F.when(hit, digest(tampered)).alias("changed"),
        F.monotonically_increasing_id().alias("row"),
    )


# Ranks ----------------------------------------------------------------------


def number_rows(batches):
    """The partition, and each row's place among the partition's rows of its tree."""
    import numpy as np
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last, count = None, 0
    for batch in batches:
        trees = batch.column("tree")
        n = len(trees)
        if not n:
            continue
        codes = trees.dictionary_encode().indices.to_numpy()
        begins = np.concatenate(([0], np.flatnonzero(np.diff(codes)) + 1))
        place = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
        if trees[0].as_py() == last:
            place[: begins[1] if len(begins) > 1 else n] += count
        last, count = trees[n - 1].as_py(), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(place.astype(np.int64))],
            names=[*batch.schema.names, "part", "place"],
        )


def ranked(nodes: DataFrame, *order: str) -> DataFrame:
    """``nodes`` with ``at``, the rank in their ``tree``, and ``size``, the tree's nodes.

    ``order`` must tell all rows of a tree apart.
    """
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    rows = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    rows = saved(rows.mapInArrow(number_rows, f"{kind}, part int, place long"), "ranked")
    counts = rows.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n_rows"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("tree")
    starts = counts.select(
        "tree",
        "part",
        F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("first"),
        F.sum("n_rows").over(every).alias("size"),
    )
    placed = rows.join(saved(starts, "starts"), ["tree", "part"])
    return placed.withColumn("at", F.col("first") + F.col("place")).drop("part", "place", "first")


# Logs -----------------------------------------------------------------------


def depth(size: int) -> int:
    """Levels above ``size`` nodes, until one remains."""
    levels = 0
    while size > 1:
        size, levels = -(-size // FAN), levels + 1
    return levels


def position(level: int, index: int, size: int, levels: int) -> int:
    """The place in postorder of a node of a tree with ``size`` leaves.

    Before the first leaf of a node lie the leaves before it and what they
    complete; the node is the last of its own subtree.
    """
    first = index * FAN**level
    below = min(FAN**level, size - first)
    before = first + sum(first // FAN**k for k in range(1, levels + 1))
    return before + sum(-(-below // FAN**k) for k in range(level + 1)) - 1


def combine(run: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(run).hex().encode()).digest()


def append_log(digests: list[bytes], levels: int) -> list[bytes]:
    """All nodes over ``digests`` in the order in which they are complete."""
    log: list[bytes] = []
    waiting: list[list[bytes]] = [[] for _ in range(levels)]

    def add(level: int, node: bytes) -> None:
        log.append(node)
        if level < levels:
            waiting[level].append(node)
            if len(waiting[level]) == FAN:
                close(level)

    def close(level: int) -> None:
        run, waiting[level] = waiting[level], []
        add(level + 1, combine(run))

    for node in digests:
        add(0, node)
    for level in range(levels):
        if waiting[level]:
            close(level)
    return log


def levels_of(size: int) -> int:
    return LEVELS if size > SPAN else depth(size)


LOG = "tree string, builder long, size long, n_nodes int, log binary, ids array<long>, changed binary"


def build(group: pa.Table) -> pa.Table:
    """The log of one builder; of leaves also their ids and digests after tampering."""
    group = group.sort_by("at")
    digests = group.column("digest").to_pylist()
    size = group.column("size")[0].as_py()
    ids, changed = (group.column(c).to_pylist() for c in ("doc_id", "changed"))
    log = append_log(digests, levels_of(size))
    changed = b"".join(c or d for c, d in zip(changed, digests, strict=True))
    return pa.table(
        {
            "tree": group.column("tree").slice(0, 1),
            "builder": pa.array([group.column("at")[0].as_py() // SPAN], pa.int64()),
            "size": pa.array([size], pa.int64()),
            "n_nodes": pa.array([len(digests)], pa.int32()),
            "log": pa.array([b"".join(log)], pa.binary()),
            "ids": pa.array([ids], pa.list_(pa.int64())),
            "changed": pa.array([changed], pa.binary()),
        }
    )


def root_of_log() -> Column:
    return F.expr(f"substring(log, octet_length(log) - {DIGEST - 1}, {DIGEST})")


def rounds_of_logs(placed: DataFrame) -> list[DataFrame]:
    """Logs of all builders, round by round, each a written table.

    ``placed``: tree, at, size, digest, doc_id, changed.
    """
    rounds = []
    while True:
        logs = saved(placed.groupBy("tree", F.floor(F.col("at") / SPAN)).applyInArrow(build, LOG), "logs")
        rounds.append(logs)
        open_ = logs.filter(F.col("size") > SPAN)
        if open_.isEmpty():
            return rounds
        placed = open_.select(
            "tree",
            F.col("builder").alias("at"),
            F.ceil(F.col("size") / SPAN).alias("size"),
            root_of_log().alias("digest"),
            F.lit(None).cast("long").alias("doc_id"),
            F.lit(None).cast("binary").alias("changed"),
        )


def roots_of_trees(rounds: list[DataFrame]) -> DataFrame:
    found = None
    for logs in rounds:
        tops = logs.filter(F.col("size") <= SPAN).select("tree", root_of_log().alias("digest"))
        found = tops if found is None else found.union(tops)
    return found


def log_entries(rounds: list[DataFrame]) -> DataFrame:
    """Every node of every tree: ``tree``, ``position`` in postorder, ``level``, ``digest``.

    Positions are those of one log for the whole tree, without gaps.
    """
    every = None
    for number, logs in enumerate(rounds):
        # Sizes are those of the round's own inputs; leaves have the tree's.
        sizes = rounds[0].groupBy("tree").agg(F.max("size").alias("n_leaves"))
        entries = logs.join(sizes, "tree").mapInArrow(entries_of(number), "tree string, position long, level int, digest binary")
        every = entries if every is None else every.union(entries)
    return every


def entries_of(number: int):
    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                levels, whole = levels_of(row["size"]), depth(row["n_leaves"])
                for level in range(1 if number else 0, levels + 1):
                    for i in range(-(-row["n_nodes"] // FAN**level)):
                        own = position(level, i, row["n_nodes"], levels)
                        index = row["builder"] * FAN ** (LEVELS - level) + i
                        at = position(number * LEVELS + level, index, row["n_leaves"], whole)
                        out.append((row["tree"], at, number * LEVELS + level, row["log"][own * DIGEST : (own + 1) * DIGEST]))
            columns = [list(c) for c in zip(*out, strict=True)] or [[]] * 4
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["tree", "position", "level", "digest"]
            )

    return run


# Proofs ---------------------------------------------------------------------


def own_siblings(log: bytes, n_nodes: int, levels: int, index: int, start: int = 0) -> list[tuple[bytes, bytes]]:
    """What stands before and after the node in its run, from level ``start`` up to the log's root."""
    steps = []
    for level in range(start, levels):
        at, n = index // FAN**level, -(-n_nodes // FAN**level)
        begin = at // FAN * FAN
        run = [position(level, i, n_nodes, levels) * DIGEST for i in range(begin, min(begin + FAN, n))]
        nodes = [log[p : p + DIGEST] for p in run]
        steps.append((b"".join(nodes[: at - begin]), b"".join(nodes[at - begin + 1 :])))
    return steps


def packed(steps: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
    """All siblings, and of each level how many stand before and after."""
    counts = bytes(n // DIGEST for step in steps for n in map(len, step))
    return b"".join(before + after for before, after in steps), counts


def unpacked(siblings: bytes, counts: bytes) -> list[tuple[bytes, bytes]]:
    steps, at = [], 0
    for before, after in zip(counts[::2], counts[1::2], strict=True):
        middle, end = at + before * DIGEST, at + (before + after) * DIGEST
        steps.append((siblings[at:middle], siblings[middle:end]))
        at = end
    return steps


ABOVE = "tree string, builder long, siblings binary, counts binary, subroot binary, root binary"


def paths_of_inputs(batches):
    """For each input of a builder, a node of the round before, what lies beside its path to the root."""
    for batch in batches:
        for row in batch.to_pylist():
            upper = unpacked(row["siblings"], row["counts"])
            levels = levels_of(row["size"])
            found = [packed(own_siblings(row["log"], row["n_nodes"], levels, i) + upper) for i in range(row["n_nodes"])]
            n, first = len(found), row["builder"] * SPAN
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["tree"]] * n, pa.string()),
                    pa.array(range(first, first + n), pa.int64()),
                    pa.array([s for s, _ in found], pa.binary()),
                    pa.array([c for _, c in found], pa.binary()),
                    pa.array([row["subroot"]] * n, pa.binary()),
                    pa.array([row["root"]] * n, pa.binary()),
                ],
                names=["tree", "builder", "siblings", "counts", "subroot", "root"],
            )


def with_paths(rounds: list[DataFrame], above_roots: DataFrame) -> DataFrame:
    """The logs of the first round, with the path above each and the roots.

    ``above_roots``: of each tree the ``siblings`` and ``counts`` above its root,
    and the ``root`` over all trees.
    """
    above = None
    for logs in reversed(rounds):
        tops = logs.filter(F.col("size") <= SPAN).join(above_roots, "tree").withColumn("subroot", root_of_log())
        if above is not None:
            tops = tops.unionByName(logs.filter(F.col("size") > SPAN).join(above, ["tree", "builder"]))
        above = saved(tops.mapInArrow(paths_of_inputs, ABOVE), "paths") if logs is not rounds[0] else None
    return tops


PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def prove(batches):
    """Of every leaf the digest of its proof, and the root to which the tampered row folds."""
    for batch in batches:
        for row in batch.to_pylist():
            log, n, levels = row["log"], row["n_nodes"], levels_of(row["size"])
            upper = unpacked(row["siblings"], row["counts"])
            leaves, proofs, folded = [], [], []
            shared: list[tuple[bytes, bytes]] = []
            for i in range(n):
                if i % FAN == 0:
                    # Above the first level all leaves of a run have the same siblings.
                    shared = [(b.hex().encode(), a.hex().encode()) for b, a in own_siblings(log, n, levels, i, 1) + upper]
                    shared_text = b"".join(b + a for b, a in shared)
                steps = [(b.hex().encode(), a.hex().encode()) for b, a in own_siblings(log, n, min(levels, 1), i)]
                place = position(0, i, n, levels) * DIGEST
                leaves.append(log[place : place + DIGEST].hex())
                proofs.append(hashlib.sha256(b"".join(b + a for b, a in steps) + shared_text).hexdigest())
                node = row["changed"][i * DIGEST : (i + 1) * DIGEST].hex()
                for before, after in steps + shared:
                    node = hashlib.sha256(before + node.encode() + after).hexdigest()
                folded.append(node)
            root = row["root"].hex()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["ids"], pa.int64()),
                    pa.array(leaves),
                    pa.array([row["subroot"].hex()] * n),
                    pa.array([root] * n),
                    pa.array(proofs),
                    pa.array(folded),
                    pa.array([f == root for f in folded], pa.bool_()),
                ],
                names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """Roots and proofs of all rows, and whether tampered rows still verify.

    Takes ``doc_id``, ``source``, ``lang``, ``n_chars`` and ``text``; other columns
    are ignored. A leaf is the SHA-256 of these five values, each as its UTF-8
    length, ``:`` and the value, or ``-`` if it is null. The leaves of a source,
    by id (rows without id first, rows that share one by digest), are combined by
    sixteens until one node remains, the ``subroot``; the subroots, by source
    (null is a source of its own and the first), likewise give ``root``. A node is
    the SHA-256 of its parts' hexadecimal digests. One row for each input row,
    repeated ones too: ``doc_id``, ``leaf``, ``subroot``, ``root``,
    ``proof_sha256`` (of the siblings from the leaf up to the root),
    ``folded_root``, worked out from the siblings and the row after tampering
    (where 5 divides the id's CRC-32, A-Z of the text are lowered), and
    ``verified``, whether it is the root. A row without id is never tampered
    with. Texts of any length leave the scan as a digest. An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    leaves = saved(leaves_of(docs), "leaves")
    rounds = rounds_of_logs(ranked(leaves, "doc_id", "digest", "row").drop("row"))
    no_leaf = (F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("changed"))
    roots = roots_of_trees(rounds).select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest", *no_leaf)
    placed = saved(ranked(saved(roots, "roots"), "source"), "placed")
    nothing = spark.createDataFrame([("", b"", b"", None)], "tree string, siblings binary, counts binary, root binary")
    paths = with_paths(rounds_of_logs(placed.drop("source")), nothing).mapInArrow(paths_of_inputs, ABOVE)
    above_roots = paths.select(F.col("builder").alias("at"), "siblings", "counts", F.col("subroot").alias("root"))
    above_roots = above_roots.join(placed.select("at", F.col("source").alias("tree")), "at").drop("at")
    return with_paths(rounds, saved(above_roots, "roots")).mapInArrow(prove, PROOFS)
