"""Token totals and quantiles for every context limit, from one histogram.

Documents are encoded once and aggregated by their length in tokens. The exact
histogram has at most one row for each length, whatever the number of documents,
and sums from its top answer, for any limit, how many documents are longer, how
many tokens there are and how many remain when texts are cut at the limit.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.shared import saved

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's public encoder splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Fixed value: the characters that \s stands for there.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# White space from this many characters on is cut out before splitting.
LONG_SPACE = 1000
_LONG_SPACE = re.compile(f"[{SPACES}]{{{LONG_SPACE},}}")
# Lengths summed in one task.
LENGTHS_PER_GROUP = 4096


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def without_long_space(text: str) -> Iterator[tuple[str, bool]]:
    """The text in stretches to split by the pattern, and long white space as pieces (true).

    The pattern looks ahead from white space, which overflows the splitter's
    stack where there is much of it. What it takes there is known: all of it at
    the end of a text, else all but the last character, which goes on.
    """
    done = 0
    for found in _LONG_SPACE.finditer(text):
        end = found.end() if found.end() == len(text) else found.end() - 1
        yield text[done : found.start()], False
        yield text[found.start() : end], True
        done = end
    yield text[done:], False


def token_lengths(docs: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """``doc_id`` and ``n_tokens`` of each row; a null text is empty, with none.

    The ranks are read where the query is planned and broadcast: their size is
    that of the vocabulary.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches):
        import tiktoken

        encoder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={})
        one_piece = tiktoken.Encoding("piece", pat_str=r"(?s:.+)", mergeable_ranks=ranks.value, special_tokens={})

        def length(text: str) -> int:
            if len(text) < LONG_SPACE:
                return len(encoder.encode_ordinary(text))
            return sum(len((one_piece if whole else encoder).encode_ordinary(part)) for part, whole in without_long_space(text))

        for batch in batches:
            lengths = [length(text) if text else 0 for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lengths, pa.int64())], names=["doc_id", "n_tokens"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """``n_tokens`` and ``n_docs``; null lengths are left out."""
    return lengths.filter("n_tokens is not null").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def limit_table(histogram: DataFrame, group: int = LENGTHS_PER_GROUP) -> DataFrame:
    """What holds at each length as a context limit, one row for each.

    ``context_limit``, ``n_docs`` of just that length, ``docs_over`` (longer),
    ``total_tokens`` (the same in each row), ``truncated_tokens`` (what remains if
    texts are cut at the limit) and ``share_within`` (of documents up to the
    limit: the limit is their quantile). Between two rows, ``docs_over`` stays as
    in the lower one, so ``truncated_tokens`` follows for every other limit too.
    Sums run over groups of lengths and then over the groups' totals, so no task
    sees all lengths. An empty histogram gives an empty result.
    """
    rows = histogram.select(
        "n_tokens",
        "n_docs",
        (F.col("n_tokens") * F.col("n_docs")).alias("tokens"),
        F.floor(F.col("n_tokens") / group).alias("part"),
    )
    parts = rows.groupBy("part").agg(F.sum("n_docs").alias("part_docs"), F.sum("tokens").alias("part_tokens"))
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.select(
        "part",
        F.coalesce(F.sum("part_docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("part_tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("part_docs").over(every).alias("all_docs"),
        F.sum("part_tokens").over(every).alias("all_tokens"),
    )
    longer = Window.partitionBy("part").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    docs_over = F.coalesce(F.sum("n_docs").over(longer), F.lit(0)) + F.col("docs_above")
    tokens_over = F.coalesce(F.sum("tokens").over(longer), F.lit(0)) + F.col("tokens_above")
    return (
        rows.join(parts, "part")
        .withColumns({"docs_over": docs_over, "tokens_over": tokens_over})
        .select(
            F.col("n_tokens").alias("context_limit"),
            "n_docs",
            "docs_over",
            F.col("all_tokens").alias("total_tokens"),
            (F.col("all_tokens") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")).alias("truncated_tokens"),
            (1 - F.col("docs_over") / F.col("all_docs")).alias("share_within"),
        )
    )


def token_count_table(docs: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """``limit_table`` of all rows of ``docs`` (``doc_id``, ``text``; others are ignored).

    A null or empty text has no tokens and counts as a document of length 0;
    rows that repeat count each; texts may be of any length, also of white space
    only. An empty table gives an empty result.
    """
    # Written, so that its two uses encode the texts once.
    return limit_table(saved(length_histogram(token_lengths(docs, ranks_path)), "lengths"))
