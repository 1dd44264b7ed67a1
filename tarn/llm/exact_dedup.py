"""Exact duplicates by progressive refinement: length, prefix hash, full hash.

One scan takes the two cheap marks of every text, its length without white space
and a hash of its first characters without white space. Texts alone in their
length, then texts alone in length and prefix, are settled. A second scan reads
the others in full, so that SHA-256 is worked out, and its digests shuffled, for
them only. It tells them by a bit table of a fixed size, which lets some settled
texts through when there are many others; those lose their digest in the exact
join afterwards. Texts themselves are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.shared import hint_small, saved, text_or_empty

SPACES = r"[\x20\x09-\x0D]+"
PREFIX_CHARS = 64
# Words of 64 bits in the bit table: at most 16 MB as rows of a broadcast.
TABLE_WORDS = 1 << 20


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, "")


def crowded(rows: DataFrame, *key: str) -> DataFrame:
    """The values of ``key`` that more than one row has."""
    return saved(rows.groupBy(*key).count().filter("count > 1").drop("count"), "crowded")


def bit_of(words: int) -> Column:
    """The place of a row's length and prefix in a bit table."""
    return F.pmod(F.xxhash64("n_bare", "prefix"), F.lit(64 * words))


def bit_table(prefixes: DataFrame, words: int) -> DataFrame:
    """``word`` and ``bits`` of the table that has the bit of each length and prefix set."""
    place = prefixes.select(bit_of(words).alias("place"))
    bits = F.bit_or(F.expr("shiftleft(1L, int(place % 64))")).alias("bits")
    return place.groupBy(F.floor(F.col("place") / 64).alias("word")).agg(bits)


def exact_duplicates(docs: DataFrame, prefix_chars: int = PREFIX_CHARS, digest_all: bool = False, table_words: int = TABLE_WORDS) -> DataFrame:
    """Which document of equal texts stays.

    Takes ``doc_id`` and ``text``; other columns are ignored. Texts are equal if
    they are so without the characters of ``[\\x20\\x09-\\x0D]``; null counts as
    empty, and empty texts are equal to each other. Of equal texts the one of
    most characters stays, then the one of the smallest id. One row for each
    input row: ``doc_id``, ``keep_id``, ``group_size`` (rows), ``kept`` and
    ``text_sha256``, the digest of the text without white space; it is null for
    texts that cheaper marks settled, unless ``digest_all``. Rows that share id
    and text stay or go together. A row without id stays only if no equal row
    has one. An empty table gives an empty result.
    """
    text = text_or_empty()
    bare = without_space(text)
    marked = docs.select(
        "doc_id",
        F.length(text).alias("n_chars"),
        F.octet_length(bare).alias("n_bare"),
        F.xxhash64(F.substring(bare, 1, prefix_chars)).alias("prefix"),
        bare.alias("bare"),
    )
    marks = saved(marked.drop("bare"), "marks")
    lengths = crowded(marks, "n_bare")
    prefixes = crowded(marks.join(lengths, "n_bare").select("n_bare", "prefix"), "n_bare", "prefix")
    if digest_all:
        hashed = marked.withColumn("text_sha256", F.sha2("bare", 256))
    else:
        # At most table_words rows.
        bits = F.broadcast(saved(bit_table(prefixes, table_words), "bits"))
        place = bit_of(table_words)
        undecided = F.coalesce(F.getbit("bits", (place % 64).cast("int")) == 1, F.lit(False))
        hashed = marked.join(bits, F.floor(place / 64) == F.col("word"), "left")
        hashed = hashed.withColumn("text_sha256", F.when(undecided, F.sha2("bare", 256)))
    hashed = saved(hashed.select("doc_id", "n_chars", "n_bare", "prefix", "text_sha256"), "hashed")
    key = ["n_bare", "prefix"]
    alike = hint_small(prefixes.withColumn("alike", F.lit(True)))
    told = hashed.join(alike, key, "left")
    crowd, alone = told.filter("alike"), told.filter("alike is null")
    best = F.struct("n_chars", F.col("doc_id").isNotNull(), -F.col("doc_id"))
    groups = crowd.groupBy("text_sha256").agg(
        F.max_by("doc_id", best).alias("best_id"), F.count(F.lit(1)).alias("n_rows")
    )
    groups = saved(groups.filter("n_rows > 1"), "groups")
    keep_id = F.when(F.col("n_rows").isNull(), F.col("doc_id")).otherwise(F.col("best_id"))
    # Settled texts go past the join.
    own = F.col("text_sha256") if digest_all else F.lit(None).cast("string")
    settled = alone.select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), own.alias("text_sha256")
    )
    decided = crowd.join(groups, "text_sha256", "left").select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("n_rows", F.lit(1)).alias("group_size"),
        keep_id.eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    )
    return decided.unionByName(settled)
