"""Repeated word windows, found through fixed blocks and removed after the first.

Every document is cut into blocks of ``block`` words that do not overlap; their
hashes are the index. A window of ``2 * block`` or more words, wherever it
starts, covers a whole block of the document it first occurs in, so the rolling
hash of ``block`` words, probed at every word, hits that block in each copy.
Hits are extended to both sides as far as whole windows agree, by two 61-bit
fingerprints of the window's words, and touching windows join to maximal repeats.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.repeats import binary_array, expand, groups_of, repeated_stretches, segments_of
from tarn.llm.rolling import Words, mix, run_fingerprints, sliding_min

WINDOW = 20


@dataclass(frozen=True)
class WordWindows:
    """What ``repeats`` needs to know about windows of ``width`` words."""

    width: int = WINDOW
    # A window also repeats one that starts earlier in the same document.
    same_document = True
    # Of a window: fingerprints of its words in two lanes.
    window_bytes = 16

    @property
    def block(self) -> int:
        return self.width // 2

    def unit_bytes(self, segments: int, windows: int) -> int:
        """Of the units of so many segments."""
        return self.window_bytes * windows

    def digest(self, text: Column) -> Column:
        """Equal for equal words; null for texts shorter than a window."""
        words = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
        long_enough = F.length(words) - F.length(F.replace(words, F.lit(" "))) >= self.width - 1
        return F.when(long_enough, F.sha2(words, 256))

    def _grams(self, data, offsets):
        words = Words(data, offsets)
        return words, mix(run_fingerprints(words.fingerprints(data), self.block), 1)

    def anchors(self, data, offsets):
        """Rolling hashes of ``block`` words; those at block bounds are the index."""
        words, grams = self._grams(data, offsets)
        rows = words.rows()[: len(grams)]
        at = np.arange(len(grams))
        inside = at + self.block <= words.first[1:][rows]
        indexed = (at - words.first[:-1][rows]) % self.block == 0
        return rows[inside], grams[inside], indexed[inside]

    def segments(self, data, offsets, is_shared):
        words, grams = self._grams(data, offsets)
        reach = self.width - self.block + 1
        least = sliding_min(grams, reach)
        n = len(least)
        rows = words.rows()
        hit = is_shared(rows[: len(grams)], grams)
        seen = np.concatenate(([0], np.cumsum(hit)))
        inside = np.arange(n) + self.width <= words.first[1:][rows[:n]]
        at = np.flatnonzero((seen[reach : reach + n] > seen[:n]) & inside)
        values = window_fingerprints(words, data, self.width)[at]
        begin, windows = segments_of(at, rows, least)
        ends = np.append(begin[1:], len(at))
        units = binary_array(values, begin * self.window_bytes, ends * self.window_bytes)
        row = rows[at[begin]]
        return row, least[at[begin]], at[begin] - words.first[row], windows, units

    def cut(self, units: bytes, first: int, windows: int) -> bytes:
        return units[first * self.window_bytes : (first + windows) * self.window_bytes]

    # Hot segments are cut into single windows at once: by itself a window has no more units.
    cuts = (0,)

    def pieces(self, units, windows, cut):
        """Each window of the segments by itself: segment, place, windows, units, a hash of it."""
        segment, at = expand(np.arange(len(units)), windows)
        values = np.frombuffer(b"".join(units.to_pylist()), np.uint64).reshape(-1, 2)
        ends = np.arange(len(values) + 1) * self.window_bytes
        single = binary_array(values, ends[:-1], ends[1:])
        return segment, at, np.ones(len(at), np.int64), single, mix(values[:, 0] ^ mix(values[:, 1]))

    def repeats(self, doc, start, windows, units):
        """Windows that equal an earlier one, in order of id and start: segment, place, words."""
        hashes = np.frombuffer(b"".join(units.to_pylist()), np.uint64).reshape(-1, 2)
        segment, at = expand(np.arange(len(doc)), windows)
        order = np.lexsort((start[segment] + at, doc[segment], hashes[:, 1], hashes[:, 0]))
        first, group = groups_of(hashes[order])
        head = order[first][group]
        later = (doc[segment[order]] != doc[segment[head]]) | (
            start[segment[order]] + at[order] > start[segment[head]] + at[head]
        )
        gone = order[later]
        return segment[gone], at[gone], np.full(len(gone), self.width)


def window_fingerprints(words: Words, data: np.ndarray, width: int) -> np.ndarray:
    """Both lanes of every window of ``width`` words."""
    return np.column_stack([run_fingerprints(words.fingerprints(data, lane=k), width, k) for k in (0, 1)])


def keep_rest(width: int):
    """Rows with the words that stay, joined by a space."""

    def run(batches):
        for batch in batches:
            ids, copies, stretches = (batch.column(c).to_pylist() for c in ("doc_id", "copy", "stretches"))
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            out = {"doc_id": ids, "n_words": [], "n_removed": [], "kept_text": []}
            for text, copy, spans in zip(texts, copies, stretches, strict=True):
                words = text.split()  # of bytes: at ASCII white space
                kept = words
                if copy and len(words) >= width:
                    kept = []
                elif spans:
                    gone = np.zeros(len(words) + 1, np.int64)
                    for span in spans:
                        gone[span["start"]] += 1
                        gone[span["end"]] -= 1
                    kept = list(compress(words, (np.cumsum(gone)[:-1] == 0).tolist()))
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["kept_text"].append(b" ".join(kept).decode())
            yield pa.RecordBatch.from_pydict(
                out,
                schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())]),
            )

    return run


def remove_repeated_windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """Texts without the words of windows that also start earlier.

    Takes ``doc_id`` and ``text``; other columns are ignored. Gives ``doc_id``,
    ``n_words``, ``n_removed`` and ``kept_text``, one row for each input row.
    Earlier means a smaller id, or the same document and an earlier word; all
    windows are judged on the input. A null text has no words. A row without id
    is kept whole and counts for no other. Rows that share an id count as one
    document. An empty table gives an empty result. ``width`` is even.
    """
    found = repeated_stretches(docs, WordWindows(width))
    return found.mapInArrow(keep_rest(width), "doc_id long, n_words long, n_removed long, kept_text string")
