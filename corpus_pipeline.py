"""From raw documents to piece ids, in stages that each read what the last wrote.

Every stage takes (spark, docs, sf_dir) and judges all rows of ``docs``. All but
the last return the columns of ``docs``, without the rows they reject. Decisions
are by ``doc_id``: rows that share an id stay or go together, and a row without
an id stays. What a stage rejects is written first; the list of ids is broadcast
if it is small, and otherwise joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.decontamination import contaminated
from tarn.llm.exact_dedup import exact_duplicates
from tarn.llm.minhash_dedup import near_duplicates
from tarn.llm.piece_viterbi import decode_pieces, encode_pieces
from tarn.llm.queries import CATEGORIES, table
from tarn.llm.shared import hint_small, saved, ship_package
from tarn.llm.toxicity import toxicity


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` less the rows whose id ``rejected`` has."""
    ids = saved(rejected.select("doc_id").filter("doc_id is not null").distinct(), "rejected")
    return docs.join(hint_small(ids), "doc_id", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return without(docs, toxicity(docs, table(spark, sf_dir, "labels"), categories=CATEGORIES).filter("toxic"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, exact_duplicates(docs).filter("not kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies by five-word shingles at a similarity of 0.8."""
    ship_package(spark)
    return without(docs, near_duplicates(docs).filter("not kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return without(docs, contaminated(docs, table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` of each document, and whether they decode to its text."""
    ship_package(spark)
    decoded = decode_pieces(encode_pieces(docs))
    return decoded.select(
        "doc_id", F.size("ids").alias("n_tokens"), "ids", (F.col("decoded") == F.col("text")).alias("round_trip")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

# The classifier, the components and the best paths have no SQL; see the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
