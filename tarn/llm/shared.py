"""Helpers that several operators of this package use."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A list of this many 8-byte ids is about 16 MB as a broadcast.
BROADCAST_ROWS = 1_000_000

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_folder: dict[str, str] = {}
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this library, as ``--py-files`` would; once a session.

    Rows with whole texts are wide: unless the session has its own setting, Arrow
    batches get fewer of them than Spark's default of 10,000.
    """
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, "1000")
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).parents[1]
        archive = shutil.make_archive(
            f"{tempfile.mkdtemp(prefix='tarn-')}/{package.name}", "zip", package.parent, package.name
        )
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only if unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="tarn-")
    return _own_folder[app]


def saved(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage is cut.

    The table outlives the executors that wrote it. With ``paths``, which gets its
    path, it is one to remove later, and packed more closely.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if paths is not None:
        paths.append(path)
        writer = writer.option("compression", "zstd")
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of ``saved`` that nothing reads any more."""
    context = spark.sparkContext
    for path in paths:
        found = context._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(context._jsc.hadoopConfiguration()).delete(found, True)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a query that runs inside go when it ends.

    Otherwise they stay until the driver happens to collect its garbage. What
    reads one of them again makes it anew.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def hint_small(ids: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``ids`` with a broadcast hint if it has at most ``rows`` rows, else as it is.

    ``ids`` must be cheap to count, as a table written by ``saved`` is.
    """
    return F.broadcast(ids) if ids.limit(rows + 1).count() <= rows else ids


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def earliest_of_copies(keyed: DataFrame, *key: str) -> DataFrame:
    """For rows whose key others share: doc_id and first_id, the least id of the key.

    The groups are written first, so that the join meets two plain shuffles and
    Spark can split a group that holds a large share of all rows.
    """
    groups = keyed.groupBy(*key).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_rows"))
    groups = saved(groups.filter("n_rows > 1").drop("n_rows"), "groups")
    return keyed.join(groups, list(key)).select("doc_id", "first_id")


def connected_components(links: DataFrame) -> DataFrame:
    """The least id that each linked id reaches: ``id`` and ``component``.

    ``links`` has ``a`` and ``b``. In each round every id takes the least label
    among itself and its neighbours, then the label of that label, so that
    labels jump along chains; each round is written to the shared folder. Rounds
    grow with the logarithm of the longest chain, mostly, and end when no label
    changes. Ids are counted, never collected.
    """
    links = links.filter("a != b")
    both = saved(links.union(links.select("b", "a")).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("component"))
    labels = saved(labels, "labels")
    while True:
        heard = (
            both.join(labels.select(F.col("id").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("component").alias("heard"))
        )
        nearer = labels.join(heard, "id").select("id", "component", F.least("component", "heard").alias("near"))
        of_label = labels.select(F.col("id").alias("near"), F.col("component").alias("far"))
        stepped = nearer.join(of_label, "near", "left").select(
            "id", F.least("near", "far").alias("component"), F.col("component").alias("before")
        )
        stepped = saved(stepped, "labels")
        labels = stepped.select("id", "component")
        if stepped.filter("component != before").isEmpty():
            return labels
