"""Documents joined by the Jaccard similarity of their word n-grams, through parity sketches.

A sketch has a bit for each of many places; every shingle flips the bit that its
hash names. A shingle that two sets share flips the same bit in both, so the
Hamming distance of two sketches is at most the size of the symmetric
difference, which the similarity bounds: of sets of n and m shingles a link
leaves (n + m) * (100 - percent) / (100 + percent) at most.

1. Sizes are cut into bands so that linked sets lie in the same or in adjacent
   ones. A band has a bound D on the difference and cuts the sketch into more
   than D segments; a link leaves some of them alike, so equal segments are the
   join's keys. A document has keys in its own band and in the next. There are
   some segments to spare: a document is *covered* in a band if no more than
   these are bad, that is nearly empty or a key of over ``LONG`` documents.
2. Each document is paired with the smallest ids of its lists, those two with
   which it shares most keys. Members of short lists in different components are
   paired with each other, but not in every list: a link leaves not one but a known
   number of good segments alike, so each document leaves out its longest lists, one
   fewer than that. Pairs whose folded sketches
   differ by more than the bound are dropped, the others verified on the words.
3. Partners that are covered neither of them meet as crowded documents.

Tasks send what several of their documents have in common once, so that a key
that a third of all documents have is a few rows for each task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.key_lists import COMMON, KEYS, STARS, best_hubs, lists_of_keys
from tarn.llm.near_links import close_sizes, crowded_links, is_link, merged, one_row_each, open_lists, overlaps, set_digests, shingle_sets
from tarn.llm.rolling import mix
from tarn.llm.shared import connected_components, earliest_of_copies, saved, text_or_empty

WORDS = 4
PERCENT = 85
# Bits of a segment, of which a key is a hash.
SEGMENT_BITS = 256
# Least places of a folded sketch.
LEAST_BITS = 64

THIRTY_TWO = np.uint64(32)


# Bands ----------------------------------------------------------------------


def most_different(total: int, percent: int) -> int:
    """The symmetric difference of two linked sets of ``total`` shingles together, at most."""
    return total - 2 * -(-total * percent // (100 + percent))


def band_bounds(percent: int, largest: int = 1 << 31) -> np.ndarray:
    """Least sizes of the bands: the partners of a band's sets reach the next one at most."""
    bounds = [1, 2]
    while bounds[-1] <= largest:
        bounds.append(max(bounds[-1] + 1, (bounds[-1] - 1) * 100 // percent + 1))
    return np.array(bounds, np.int64)


def segments_of_band(bounds: np.ndarray, band: int, percent: int) -> tuple[int, int, int]:
    """Segments, how many of them may be bad, and the flipped bits of one that is not."""
    most = int(2 * (bounds[band + 1] - 1)) * (100 - percent) // (100 + percent)
    if most == 0:
        return 0, 0, 1
    spare = 1 + most // 12
    return most + 1 + spare, spare, 1 if most < 8 else 2


def segment_keys(hashes: np.ndarray, band: int, segments: int, least: int) -> np.ndarray:
    """A hash of each segment that has ``least`` flipped bits or more."""
    spread = mix(hashes, 5)
    segment = ((spread >> THIRTY_TWO) * np.uint64(segments)) >> THIRTY_TWO
    places, times = np.unique(segment * np.uint64(SEGMENT_BITS) + spread % np.uint64(SEGMENT_BITS), return_counts=True)
    odd = places[times % 2 == 1]
    if not len(odd):
        return odd
    own = odd // np.uint64(SEGMENT_BITS)
    begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    keys = np.add.reduceat(mix(odd, 6), begin)
    full = np.diff(np.append(begin, len(odd))) >= least
    return mix(keys[full] ^ mix(own[begin[full]], 8), 64 + band)


def folded_sketch(hashes: np.ndarray) -> bytes:
    """The parities of at least twice as many places as there are hashes, as bytes."""
    bits = max(LEAST_BITS, 1 << (2 * len(hashes) - 1).bit_length())
    flips = np.bincount((mix(hashes, 9) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((flips & 1).astype(np.uint8), bitorder="little").tobytes()


def hamming(one: bytes, two: bytes) -> int:
    """Of two sketches, the longer one folded: its places are the other's, modulo its size."""
    one, two = (np.frombuffer(x, np.uint64) for x in (one, two))
    if len(one) < len(two):
        one, two = two, one
    one = np.bitwise_xor.reduce(one.reshape(-1, len(two)), axis=0)
    return int(np.bitwise_count(one ^ two).sum())


# Sets -----------------------------------------------------------------------

SIGNED = "doc_id long, mark long, n long, set_1 long, set_2 long, n_bytes long"


def sign(words: int):
    def run(batches):
        for batch in batches:
            sets, others = (list(shingle_sets(batch.column("text"), words, lane)) for lane in (0, 1))
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), sizes, *set_digests(sets, others), batch.column("n_bytes")],
                names=["doc_id", "mark", "n", "set_1", "set_2", "n_bytes"],
            )

    return run


# Keys -----------------------------------------------------------------------


def keys_in_bands(percent: int):
    """Keys of a set in its own band (slot 0) and in the next one, and how many segments are nearly empty."""
    bounds = band_bounds(percent)

    def keys(hashes: np.ndarray):
        keys, slots, bad = [], [], []
        band = int(np.searchsorted(bounds, len(hashes), side="right")) - 1
        for slot in (0, 1):
            segments, _, least = segments_of_band(bounds, band + slot, percent)
            own = segment_keys(hashes, band + slot, segments, least) if segments else np.zeros(0, np.uint64)
            keys.append(own)
            slots.append(np.full(len(own), slot, np.uint8))
            bad.append(segments - len(own))
        return np.concatenate(keys), np.concatenate(slots), bad

    return keys


# Sketches -------------------------------------------------------------------


def sketches(words: int):
    def run(batches):
        for batch in batches:
            made = [folded_sketch(s) for s in shingle_sets(batch.column("text"), words)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.binary())], names=["doc_id", "sketch"])

    return run


def near_sketches(percent: int):
    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "s_a", "s_b")), strict=True)
            near = [hamming(x, y) <= most_different(n + m, percent) for n, m, x, y in rows]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def likely_pairs(pairs: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link."""
    left, right = (
        sketched.select(F.col("doc_id").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"s_{s}")) for s in ("a", "b")
    )
    both = pairs.join(left, "a").join(right, "b").filter(close_sizes(F.col("n_a"), F.col("n_b"), percent))
    return saved(both.mapInArrow(near_sketches(percent), "a long, b long"), "likely")


def of_band(size: Column, slot: Column, percent: int, value: int) -> Column:
    """What ``segments_of_band`` gives at ``value`` for a set's own band (slot 0) or the next."""
    bounds = band_bounds(percent).tolist()
    band = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda bound: bound <= size)) - 1
    values = [segments_of_band(bounds, k, percent)[value] for k in range(len(bounds) - 1)]
    return F.get(F.array(*map(F.lit, values)), band + slot.cast("int"))


def spare_segments(size: Column, slot: Column, percent: int) -> Column:
    """How many segments may be bad in a set's own band (slot 0) or in the next."""
    return of_band(size, slot, percent, 1)


def alike_in_links(percent: int) -> Column:
    """The good segments, at least, that a set shares with any link; of columns ``n``, ``slot`` and ``bad``.

    A link's difference is most with the largest partner, and changes as many
    segments at most. A segment that is alike is bad for both or for neither.
    """
    most = F.expr(f"(n + n * 100 div {percent}) * {100 - percent} div {100 + percent}")
    return of_band(F.col("n"), F.col("slot"), percent, 0) - most - F.col("bad")


def needed_lists(open_: DataFrame, bad: DataFrame, originals: DataFrame, percent: int) -> DataFrame:
    """``open_`` (value, doc_id, slot, times, component) without the longest lists of each document, and with ``n``.

    If a link leaves k good segments alike, then in any order that is the same for
    all documents some list of both is not among the last k - 1 of either. A list
    counts as often as its key is in the document.
    """
    members = F.count(F.lit(1)).over(Window.partitionBy("value"))
    longest = Window.partitionBy("doc_id", "slot").orderBy(F.desc("members"), F.desc("value"))
    placed = open_.withColumn("members", members).withColumn("place", F.sum("times").over(longest))
    known = placed.join(bad, ["doc_id", "slot"], "left").fillna(0, "bad").join(originals.select("doc_id", "n"), "doc_id")
    return saved(known.filter(F.col("place") >= alike_in_links(percent)).select(*open_.columns, "n"), "needed")


def pairs_of_lists(needed: DataFrame, percent: int) -> DataFrame:
    """Members of different components of each list whose sizes allow a link, once each.

    Sets that both have a key of the next band are in one band and meet there.
    """
    one, two = (
        needed.select("value", *(F.col(c).alias(f"{short}{s}") for c, short in (("doc_id", ""), ("component", "c_"), ("n", "n_"), ("slot", "slot_"))))
        for s in ("a", "b")
    )
    met = one.join(two, "value").filter(
        (F.col("a") < F.col("b"))
        & (F.col("c_a") != F.col("c_b"))
        & (F.col("slot_a") + F.col("slot_b") < 2)
        & close_sizes(F.col("n_a"), F.col("n_b"), percent)
    )
    return met.select("a", "b").distinct()


def jaccard_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Components of documents that links of their n-gram sets join.

    Takes ``doc_id`` (long) and ``text``; other columns are ignored. A document's
    set holds its distinct runs of ``words`` words, A-Z as a-z, split at ASCII
    white space; with fewer words it is the whole sequence. Documents are linked
    if 100 times the common shingles is ``percent`` times those of either or more;
    all links count, whatever the texts' lengths. Gives one row for each id:
    ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id reachable over
    links. A text that is null, empty or white space has an empty set and no
    links. Rows without id are left out; of rows that share an id the one with
    the largest set counts. An empty table gives an empty result.
    """
    if not 50 < percent < 100:
        raise ValueError("percent must lie between 50 and 100")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).filter("doc_id is not null")
    texts = texts.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    signed = texts.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(sign(words), SIGNED)
    signed = saved(one_row_each(signed), "signed")
    equal = earliest_of_copies(signed.filter("n > 0"), "n", "set_1", "set_2")
    equal = saved(equal.filter("first_id < doc_id"), "equal")
    originals = saved(signed.filter("n > 0").join(equal, "doc_id", "left_anti").select("doc_id", "mark", "n", "n_bytes"), "originals")

    own = texts.join(originals.select("doc_id", "mark"), ["doc_id", "mark"]).select("doc_id", "text")
    found = lists_of_keys(own, words, keys_in_bands(percent), originals.agg(F.sum("n_bytes")).first()[0] or 0)
    stars = best_hubs(found.filter(F.col("kind") == STARS))
    listed = found.filter(F.col("kind") == KEYS).select(F.col("a").alias("value"), F.col("b").alias("doc_id"), F.col("times").alias("slot"))
    listed = listed.groupBy("value", "doc_id", "slot").agg(F.count(F.lit(1)).alias("times"))

    bad = found.filter(F.col("kind") == COMMON).groupBy(F.col("a").alias("doc_id"), F.col("b").alias("slot")).agg(F.sum("times").alias("bad"))
    over = F.col("bad") > spare_segments(F.col("n"), F.col("slot"), percent)
    crowded = saved(bad.join(originals, "doc_id").filter(over).select("doc_id", "mark").distinct(), "crowded")
    met = crowded.select("doc_id").union(stars.select("a")).union(stars.select("b")).union(listed.select("doc_id"))
    met = saved(met.distinct(), "met")
    sketched = texts.join(originals.join(met, "doc_id").select("doc_id", "mark"), ["doc_id", "mark"]).select("doc_id", "text")
    sketched = sketched.mapInArrow(sketches(words), "doc_id long, sketch binary").dropDuplicates(["doc_id"])
    sketched = saved(sketched.join(originals.select("doc_id", "n"), "doc_id"), "sketches")

    hubs = overlaps(likely_pairs(stars, sketched, percent), originals, texts, words).filter(is_link(percent))
    reached = connected_components(hubs.select("a", "b"))
    needed = needed_lists(open_lists(listed, reached), bad, originals, percent)
    lists = likely_pairs(pairs_of_lists(needed, percent), sketched, percent)
    reached = merged(reached, overlaps(lists, originals, texts, words).filter(is_link(percent)))

    likely = lambda pairs: likely_pairs(pairs, sketched, percent)
    reached = crowded_links(crowded, originals, texts, hubs, reached, likely, words, percent)

    labels = reached.select(F.col("id").alias("a"), F.col("component").alias("b"))
    whole = connected_components(saved(labels.union(equal.select(F.col("doc_id").alias("a"), F.col("first_id").alias("b"))), "links"))
    return signed.join(whole.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )
