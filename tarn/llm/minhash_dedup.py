"""Near-duplicate documents from bottom-k sketches of their word shingles.

One hash function orders all shingles; a document retains the ``keep`` least of
its set. Two sets of Jaccard similarity 0.8 share most of what they retain:
each of the least ``keep`` values of the union is in both with probability 0.8,
so fewer than ``AT_LEAST`` of 48 shared ones have a probability under 1e-9. Sets
of up to 25 shingles share 0.8 of what they retain for certain.

Candidates come from inverted lists of the retained values, in one shuffle:

1. Equal sets count once, by their smallest id.
2. Each document is paired with the smallest ids of its lists, those two with
   which it shares most values. Pairs that pass the estimate from their union's
   sketch are verified on the words; what they link makes components.
3. What may still be missing is a link between two components. Members of short
   lists meet if their components differ, and go on if they share as many values
   as a link must outside the long lists.
4. A partner can hide in lists of over ``LONG`` members only from a document that
   retains ``AT_LEAST`` of their values. Where that holds for both of a pair, they
   meet as crowded documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.key_lists import COMMON, KEYS, STARS, best_hubs, lists_of_keys
from tarn.llm.near_links import (
    as_longs, close_sizes, crowded_links, is_link, merged, one_row_each, open_lists, overlaps, set_digests, shingle_sets,
)
from tarn.llm.shared import connected_components, earliest_of_copies, saved, text_or_empty

WORDS = 5
PERCENT = 80
KEEP = 48
AT_LEAST = 20

SIGNED = "doc_id long, mark long, n long, set_1 long, set_2 long, n_bytes long, sketch array<long>"


def sign(words: int, keep: int):
    def run(batches):
        for batch in batches:
            sets, others = (list(shingle_sets(batch.column("text"), words, lane)) for lane in (0, 1))
            sizes, sketch = pa.array([len(s) for s in sets], pa.int64()), as_longs([s[:keep] for s in sets])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), sizes, *set_digests(sets, others), batch.column("n_bytes"), sketch],
                names=["doc_id", "mark", "n", "set_1", "set_2", "n_bytes", "sketch"],
            )

    return run


def retained(keep: int):
    """The values of a set's sketch as its keys; none of them is bad from the start."""
    return lambda hashes: (hashes[:keep], np.zeros(min(keep, len(hashes)), np.uint8), [])


def needed(n: Column, percent: int) -> Column:
    """Retained values that the smaller set of a link shares at least."""
    return F.least(F.lit(AT_LEAST), F.ceil(n * percent / 100)).cast("long")


def likely_pairs(pairs: DataFrame, signed: DataFrame, percent: int, keep: int) -> DataFrame:
    """The pairs (a, b) that their sizes and the sketches of their unions let through."""
    left, right = (
        signed.select(F.col("doc_id").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"s_{s}")) for s in ("a", "b")
    )
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, keep)
    shared = F.size(F.array_intersect(union, F.array_intersect("s_a", "s_b")))
    return saved(
        pairs.join(left, "a")
        .join(right, "b")
        .filter(close_sizes(F.col("n_a"), F.col("n_b"), percent))
        .filter(shared >= needed(F.least("n_a", "n_b"), percent))
        .select("a", "b"),
        "likely",
    )


def pairs_of_lists(open_: DataFrame, counted: DataFrame, percent: int) -> DataFrame:
    """Members of different components of short lists that share enough of these.

    ``open_``: value, doc_id, component. ``counted``: of each document its size and
    how many of its values are in long lists.
    """
    entries = saved(open_.join(counted, "doc_id"), "entries")
    one, two = (
        entries.select("value", *(F.col(c).alias(f"{short}{s}") for c, short in (("doc_id", ""), ("component", "c_"), ("n", "n_"), ("hot", "hot_"))))
        for s in ("a", "b")
    )
    met = one.join(two, "value").filter(
        (F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b")) & close_sizes(F.col("n_a"), F.col("n_b"), percent)
    )
    least = F.greatest(F.lit(1), needed(F.least("n_a", "n_b"), percent) - F.least("hot_a", "hot_b"))
    met = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("lists"), F.min(least).alias("least"))
    return met.filter(F.col("lists") >= F.col("least")).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, keep: int = KEEP) -> DataFrame:
    """Components of documents that are near duplicates.

    Takes ``doc_id`` (long) and ``text``; other columns are ignored. A document's
    set holds its distinct runs of ``words`` words, A-Z as a-z, split at ASCII
    white space. Documents are linked if 100 times the common shingles is
    ``percent`` (80 or more) times those of either or more. Gives one row for each
    id: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest id reachable
    over links) and ``kept`` (it is its own component's). A text that is null,
    empty or white space has an empty set and no links. Rows without id are left
    out; rows that share an id count as one document, that of the largest set.
    An empty table gives an empty result.
    """
    if not 80 <= percent <= 100:
        raise ValueError("the bounds on shared retained values hold from 80 percent on")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).filter("doc_id is not null")
    texts = texts.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    signed = texts.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(sign(words, keep), SIGNED)
    signed = saved(one_row_each(signed, "sketch"), "signed")
    equal = earliest_of_copies(signed.filter("n > 0"), "n", "set_1", "set_2")
    equal = saved(equal.filter("first_id < doc_id"), "equal")
    originals = saved(signed.filter("n > 0").join(equal, "doc_id", "left_anti"), "originals")

    own = texts.join(originals.select("doc_id", "mark"), ["doc_id", "mark"]).select("doc_id", "text")
    found = lists_of_keys(own, words, retained(keep), originals.agg(F.sum("n_bytes")).first()[0] or 0)
    stars = best_hubs(found.filter(F.col("kind") == STARS))
    hubs = overlaps(likely_pairs(stars, originals, percent, keep), originals, texts, words).filter(is_link(percent))
    reached = connected_components(hubs.select("a", "b"))

    hot = found.filter(F.col("kind") == COMMON).groupBy(F.col("a").alias("doc_id")).agg(F.sum("times").alias("hot"))
    counted = originals.select("doc_id", "mark", "n").join(hot, "doc_id", "left").fillna(0, ["hot"])
    counted = saved(counted, "counted")
    listed = found.filter(F.col("kind") == KEYS).select(F.col("a").alias("value"), F.col("b").alias("doc_id")).distinct()
    lists = pairs_of_lists(open_lists(listed, reached), counted.drop("mark"), percent)
    lists = overlaps(likely_pairs(lists, originals, percent, keep), originals, texts, words)
    reached = merged(reached, lists.filter(is_link(percent)))
    crowded = saved(counted.filter(F.col("hot") >= needed(F.col("n"), percent)).select("doc_id", "mark"), "crowded")
    likely = lambda pairs: likely_pairs(pairs, originals, percent, keep)
    reached = crowded_links(crowded, originals, texts, hubs, reached, likely, words, percent)

    # Components are joined by the links between equal sets.
    labels = reached.select(F.col("id").alias("a"), F.col("component").alias("b"))
    sets = equal.select(F.col("doc_id").alias("a"), F.col("first_id").alias("b"))
    whole = connected_components(saved(labels.union(sets), "links"))
    component = F.coalesce("component", "doc_id")
    return signed.join(whole.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (component == F.col("doc_id")).alias("kept")
    )
