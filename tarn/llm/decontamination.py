"""Benchmark items in training texts: BM25 over passages with block-max pruning.

The inverted index is over the benchmark; passages of the training texts are the
queries. A term's impact on an item is its BM25 weight as a share of the item's
own score against itself, so a passage that holds an item scores 1. A term's list
holds its items in order, in blocks with the largest impact of each, and has a
largest impact as a whole. As in block-max WAND, a passage's terms are ordered by
what their lists can give at most, and the pivot is the first term with which the
threshold can be reached: an item on none of the lists from there on is never
looked at. Of the blocks on those lists, one is opened only if the block maxima of
all the passage's terms add up to the threshold. Many passages take each step at
once. Every item above the threshold is retrieved. Then question and answer are
compared word by word.

A text is cut into chunks as long as the longest item, and a passage is a chunk
with the next one: any stretch of an item's length lies whole in a passage. All
texts are read once for each index, and an index takes as much of the benchmark
as its bounds allow. Weights and the longest item are those of the whole benchmark
in every index, so that where it is cut changes nothing. Equal rows are one item.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.rolling import Words, slices
from tarn.llm.shared import saved

THRESHOLD = 0.6
QUESTION_OVERLAP = 0.5
ANSWER_OVERLAP = 0.5
GRAM = 5
BLOCK_ITEMS = 16
# Bounds of an index, which is broadcast: items, entries of its lists (12 bytes
# each and 24 for a run of them), bytes of its texts. It stays under 200 MB.
INDEX_ITEMS = 200_000
INDEX_ENTRIES = 4_000_000
INDEX_BYTES = 32 << 20
# Runs of lists that passages are taken together for.
GROUP_RUNS = 1 << 18
# Sums of bounds in any order differ by less.
SLACK = 1e-6
K1, B = 1.2, 0.75

# Bytes of words: ASCII letters and digits, and all of longer characters.
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_SENTENCE = re.compile(r"(?<=[.?!])\s+", re.ASCII)


def word_list(text: str) -> list[bytes]:
    return re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower())


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """An item's words: the last sentence is the answer, or the last quarter of one sentence."""
    parts = [words for words in map(word_list, _SENTENCE.split(text)) if words]
    if len(parts) > 1:
        return [w for part in parts[:-1] for w in part], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - len(words) // 4
    return words[:cut], words[cut:]


def grams(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


@dataclass
class Statistics:
    """Of all rows of the benchmark that have words; ``seen``: rows with a term."""

    n_items: int
    average: float
    longest: int
    seen: dict[bytes, int]


class Index:
    """Inverted lists: the impact of each term on each item that has it.

    ``items`` are item_id, text and how often the benchmark has them. Items are
    numbered by length, as a term weighs about the same on items of one length,
    and each run of ``BLOCK_ITEMS`` is a block. A term's list ascends by item;
    its entries of one block lie together, with their largest impact.
    """

    def __init__(self, items: list[tuple[int, str, int]], whole: Statistics):
        words = [word_list(text) for _, text, _ in items]
        order = sorted(range(len(items)), key=lambda i: (len(words[i]), i))
        self.ids, self.texts, self.times = ([items[i][k] for i in order] for k in range(3))
        self.span = whole.longest or 1
        vocabulary = sorted({term for w in words for term in w})
        number = {term: t for t, term in enumerate(vocabulary)}
        of_term, of_item, impact = [], [], []
        for at, i in enumerate(order):
            length = K1 * (1 - B + B * len(words[i]) / whole.average)
            weights = {}
            for term, times in Counter(words[i]).items():
                idf = math.log(1 + (whole.n_items - whole.seen[term] + 0.5) / (whole.seen[term] + 0.5))
                weights[term] = idf * times * (K1 + 1) / (times + length)
            total = max(math.fsum(weights.values()), 1e-9)
            of_term.extend(number[term] for term in weights)
            of_item.extend([at] * len(weights))
            impact.extend(weight / total for weight in weights.values())
        term, item = np.array(of_term, np.int64), np.array(of_item, np.int64)
        by_list = np.lexsort((item, term))
        term, self.item = term[by_list], item[by_list]
        self.impact = np.array(impact, np.float32)[by_list]
        # Runs of one list within one block, as keys that ascend.
        self.n_blocks = -(-len(items) // BLOCK_ITEMS)
        key = term * self.n_blocks + self.item // BLOCK_ITEMS
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.runs, self.run_ends = key[first], np.append(first, len(key))
        self.run_blocks = self.runs % self.n_blocks
        self.run_maxima = np.maximum.reduceat(self.impact, first).astype(np.float64)
        self.lists = np.searchsorted(self.runs, np.arange(len(vocabulary) + 1) * self.n_blocks)
        self.maxima = np.maximum.reduceat(self.run_maxima, self.lists[:-1])
        hashes = hash_terms(vocabulary)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def terms(self, hashes: np.ndarray) -> np.ndarray:
        """Term number of each word hash, -1 for other words."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)

    def candidates(self, rows: np.ndarray, places: np.ndarray, hashes: np.ndarray, threshold: float):
        """(row, chunk, item, score) of every passage and item above the threshold."""
        terms = self.terms(hashes)
        known = terms >= 0
        rows, chunk, terms = rows[known].astype(np.int64), places[known] // self.span, terms[known]
        # Each word counts for the passage that starts with its chunk and for the one before.
        wide = int(chunk.max()) + 2 if len(chunk) else 2
        passage = rows * wide + chunk
        passage = np.concatenate((passage, passage[chunk > 0] - 1))
        terms = np.concatenate((terms, terms[chunk > 0]))
        passage, terms = np.divmod(np.unique(passage * len(self.hashes) + terms), len(self.hashes))
        if not len(terms):
            return
        # Each passage's terms by rising bound, up to the pivot: those before it
        # stay below the threshold together, so lists from it on name all blocks.
        order = np.lexsort((self.maxima[terms], passage))
        passage, terms = passage[order], terms[order]
        first = np.flatnonzero(np.diff(passage, prepend=-1))
        last = np.append(first[1:], len(terms))
        reach = np.cumsum(self.maxima[terms])
        reach -= np.repeat(reach[first] - self.maxima[terms[first]], last - first)
        pivot = first + np.add.reduceat(reach < threshold - SLACK, first, dtype=np.int64)
        before = np.where(pivot > first, reach[np.maximum(pivot - 1, 0)], 0)
        # Passages are taken together as long as their lists have few runs.
        runs = np.add.reduceat(self.lists[terms + 1] - self.lists[terms], first)
        able = np.flatnonzero(pivot < last)
        for group in cut_runs(able, runs[able], self.n_blocks):
            for p, item, score in self.reached(terms, first[group], pivot[group], last[group], before[group], threshold):
                row, at = divmod(int(passage[first[group[p]]]), wide)
                yield row, at, item, score

    def reached(self, terms, first, pivot, last, before, threshold):
        """(passage, item, score) above the threshold, for some passages given by their bounds in ``terms``."""
        # Blocks on the lists from the pivot on, with the sum of their maxima there.
        owner, at = spread(pivot, last)
        source, run = spread(self.lists[terms[at]], self.lists[terms[at] + 1])
        place = owner[source] * self.n_blocks + self.run_blocks[run]
        bound = np.bincount(place, self.run_maxima[run], minlength=len(first) * self.n_blocks).reshape(len(first), -1)
        # A block on none of the lists stays below: so do the terms before the pivot.
        owner, block = np.nonzero(bound + before[:, None] >= threshold - SLACK)
        bound = bound[owner, block]
        # The same blocks on the lists before the pivot.
        found, run = self.meet(terms, first, pivot, owner, block)
        bound += np.bincount(found, self.run_maxima[run], minlength=len(bound))
        able = bound >= threshold - SLACK
        owner, block = owner[able], block[able]
        # Items of the blocks that are left, on all lists of the passage.
        found, run = self.meet(terms, first, last, owner, block)
        source, entry = spread(self.run_ends[run], self.run_ends[run + 1])
        place = found[source] * BLOCK_ITEMS + self.item[entry] % BLOCK_ITEMS
        # Sums of 32-bit impacts in 64 bits don't depend on their order.
        scores = np.bincount(place, self.impact[entry], minlength=len(owner) * BLOCK_ITEMS)
        for hit in np.flatnonzero(scores >= threshold):
            at = hit // BLOCK_ITEMS
            yield int(owner[at]), int(block[at] * BLOCK_ITEMS + hit % BLOCK_ITEMS), float(scores[hit])

    def meet(self, terms, begin, end, owner, block):
        """The runs of ``terms[begin:end]`` of each owner in its blocks: number of the block, and run.

        Blocks are looked up in the lists, or the lists read, whichever is less.
        """
        passage, at = spread(begin, end)
        runs = self.lists[terms[at] + 1] - self.lists[terms[at]]
        if (end - begin)[owner].sum() < runs.sum():
            source, at = spread(begin[owner], end[owner])
            key = terms[at] * self.n_blocks + block[source]
            run = np.minimum(np.searchsorted(self.runs, key), len(self.runs) - 1)
            there = self.runs[run] == key
            return source[there], run[there]
        source, run = spread(self.lists[terms[at]], self.lists[terms[at] + 1])
        number = np.full(len(begin) * self.n_blocks, -1)
        number[owner * self.n_blocks + block] = np.arange(len(owner))
        found = number[passage[source] * self.n_blocks + self.run_blocks[run]]
        return found[found >= 0], run[found >= 0]


def spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges one after the other: the range's place, and the number."""
    size = end - begin
    source = np.repeat(np.arange(len(size)), size)
    return source, np.arange(len(source)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)


def cut_runs(passages: np.ndarray, runs: np.ndarray, n_blocks: int):
    """``passages`` in groups with at most ``GROUP_RUNS`` runs and blocks, or of one."""
    total = np.cumsum(runs + n_blocks)
    at = 0
    while at < len(passages):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + GROUP_RUNS, side="right")))
        yield passages[at:to]
        at = to


def hash_terms(terms: list[bytes]) -> np.ndarray:
    """The hashes that ``Words`` gives the same words within texts."""
    data = np.frombuffer(b" ".join(terms), np.uint8)
    words = Words(data, np.array([0, len(data)]), IS_WORD[data])
    return words.hashes(data, fold=True)


def find(index, threshold: float, question: float, answer: float, gram: int):
    def run(batches):
        known = index.value

        @lru_cache(4096)
        def wanted(item):
            asked, answered = question_and_answer(known.texts[item])
            return grams(asked, gram), set(answered)

        names = ["doc_id", "item_id", "first_word", "score", "question_overlap", "answer_overlap", "times"]
        for batch in batches:
            found: dict[tuple[int, int], tuple] = {}
            for first, _, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets, IS_WORD[data])
                rows = words.rows()
                places = np.arange(len(rows)) - words.first[:-1][rows]
                hashes = words.hashes(data, fold=True)
                for row, chunk, item, score in known.candidates(rows, places, hashes, threshold):
                    start = int(words.first[row]) + chunk * known.span
                    end = min(start + 2 * known.span, int(words.first[row + 1]))
                    text = bytes(data[words.starts[start] : words.ends[end - 1]])
                    passage = word_list(text.decode())
                    q, a = wanted(item)
                    share_q = len(q & grams_like(passage, q)) / len(q) if q else 1.0
                    share_a = len(a & set(passage)) / len(a) if a else 1.0
                    if share_q >= question and share_a >= answer:
                        hit = (score, -chunk, share_q, share_a)
                        found[first + row, item] = max(found.get((first + row, item), hit), hit)
            hits = sorted(found.items())
            ids = batch.column("doc_id").take(pa.array([row for (row, _), _ in hits], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([known.ids[item] for (_, item), _ in hits], pa.int64()),
                    pa.array([-hit[1] * known.span for _, hit in hits], pa.int64()),
                    *(pa.array([hit[k] for _, hit in hits], pa.float64()) for k in (0, 2, 3)),
                    pa.array([known.times[item] for (_, item), _ in hits], pa.int64()),
                ],
                names=names,
            )

    return run


def grams_like(words: list[bytes], wanted: set[tuple[bytes, ...]]) -> set[tuple[bytes, ...]]:
    n = len(next(iter(wanted)))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def item_terms(batches):
    """The distinct terms of each item, and as a row without term its words."""
    for batch in batches:
        parts, terms, rows, n_words = [], [], [], []
        for part, text, times in zip(*(batch.column(c).to_pylist() for c in ("part", "text", "times")), strict=True):
            words = word_list(text)
            # Sorted: a task that runs again gives the same rows.
            distinct = [None, *sorted(set(words))] if words else []
            parts.extend([part] * len(distinct))
            terms.extend(distinct)
            rows.extend([times] * len(distinct))
            n_words.extend([len(words)] * len(distinct))
        columns = [pa.array(parts, pa.int64()), pa.array(terms, pa.binary()), pa.array(rows, pa.int64()), pa.array(n_words, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "term", "times", "n_words"])


def most_terms(text: Column) -> Column:
    """At least as many as the terms of ``text``."""
    return F.size(F.split(text, "[^0-9A-Za-z\\x{80}-\\x{10ffff}]+"))


def term_statistics(items: DataFrame) -> tuple[Statistics, DataFrame]:
    """The benchmark's totals, and of each part's terms how many rows of all parts have them."""
    terms = items.mapInArrow(item_terms, "part long, term binary, times long, n_words long")
    of_part = terms.groupBy("part", "term").agg(
        F.sum("times").alias("times"), F.sum(F.col("times") * F.col("n_words")).alias("n_words"), F.max("n_words").alias("longest")
    )
    of_part = saved(of_part, "terms")
    total = of_part.filter("term is null").agg(F.sum("times"), F.sum("n_words"), F.max("longest")).first()
    n_items, n_words, longest = (x or 0 for x in total)
    seen = of_part.filter("term is not null").groupBy("term").agg(F.sum("times").alias("seen"))
    seen = saved(of_part.select("part", "term").join(seen, "term"), "seen")
    return Statistics(n_items, n_words / max(n_items, 1), longest, {}), seen


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = THRESHOLD,
    question: float = QUESTION_OVERLAP,
    answer: float = ANSWER_OVERLAP,
    gram: int = GRAM,
    index_items: int = INDEX_ITEMS,
) -> DataFrame:
    """Documents that hold benchmark items: one row for each pair.

    ``docs`` has ``doc_id`` and ``text``, ``benchmark`` has ``item_id`` and
    ``text``; other columns are ignored. Words are runs of letters and digits,
    A-Z as a-z. A pair is reported if in some passage the item's BM25 share is
    at least ``threshold``, and the passage holds at least ``question`` of the
    question's ``gram``-word runs and ``answer`` of the answer's words. Columns:
    ``doc_id``, ``item_id``, ``first_word`` (of the best passage), ``score``,
    ``question_overlap``, ``answer_overlap``. Texts and items that are null or
    without words match nothing; rows with a null id are treated like others.
    Rows that repeat are reported again. Weights come from all rows of
    ``benchmark``, however many ``index_items`` an index takes at most; a benchmark
    beyond the bounds of one index is taken part by part, each part reading all
    texts once more. Texts may be of any length: passages are told apart within
    them, and a slice of texts is worked on at a time. Empty tables give an empty
    result.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    names = "item_id long, first_word long, score double, question_overlap double, answer_overlap double"
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {names}"
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    items = saved(items.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("times")), "items")
    n, size, entries = items.select(F.count(F.lit(1)), F.sum(F.octet_length("text")), F.sum(most_terms(F.col("text")))).first()
    shares = (n / index_items, (size or 0) / INDEX_BYTES, (entries or 0) / INDEX_ENTRIES)
    parts = max(1, math.ceil(max(shares)))
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    whole, seen = term_statistics(items)
    result = None
    for part in range(parts):
        mine = items.filter(F.col("part") == part).select("item_id", "text", "times")
        rows = sorted((tuple(r) for r in mine.collect() if word_list(r["text"])), key=str)
        if rows:
            terms = seen.filter(F.col("part") == part).select("term", "seen").collect()
            statistics = replace(whole, seen={bytes(r["term"]): r["seen"] for r in terms})
            index = spark.sparkContext.broadcast(Index(rows, statistics))
            pairs = texts.mapInArrow(find(index, threshold, question, answer, gram), f"{schema}, times long")
            result = pairs if result is None else result.unionByName(pairs)
    if result is None:
        return spark.createDataFrame([], schema)
    # A row for each row of the benchmark that the item stands for.
    return result.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times")
