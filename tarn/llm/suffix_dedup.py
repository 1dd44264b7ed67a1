"""Repeated byte strings, found by longest previous factors in suffix order.

A suffix array over the whole corpus would move every suffix. Here only those
are sorted whose next ``width`` bytes hold an anchor that another document holds
too. Anchors are the strings of ``ANCHOR`` bytes whose hash is least among those
of some window, so that a window which repeats always holds one that repeats.

A bucket sorts the suffixes of its segments, notes what neighbours in suffix
order share, and takes for every suffix the nearest ones of smaller documents
before and after it in this order. The
longer of the two common prefixes is the longest previous factor: how far the
suffix repeats an earlier document. Where it reaches ``width`` bytes it goes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.repeats import binary_array, bounds_of, expand, groups_of, repeated_stretches, segments_of
from tarn.llm.rolling import byte_prefix, mix, sliding_min

WINDOW = 50
ANCHOR = 24


@dataclass(frozen=True)
class ByteWindows:
    """What ``repeats`` needs to know about windows of ``width`` bytes."""

    width: int = WINDOW
    anchor: int = ANCHOR
    same_document = False

    def digest(self, text: Column) -> Column:
        """Equal for equal bytes; null for texts shorter than a window."""
        return F.when(F.octet_length(text) >= self.width, F.sha2(text, 256))

    def _least(self, data, offsets):
        """Text number of each byte, windows inside one text, least anchor hash."""
        least = sliding_min(mix(byte_prefix(data).rolling(self.anchor), 1), self.width - self.anchor + 1)
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        n = len(least)
        inside = rows[:n] == rows[self.width - 1 : self.width - 1 + n]
        return rows, np.flatnonzero(inside), least

    def anchors(self, data, offsets):
        """The distinct least hashes of each text; each of them is indexed."""
        rows, at, least = self._least(data, offsets)
        begin, _ = segments_of(at, rows, least)
        row, value = rows[at[begin]], least[at[begin]]
        order = np.lexsort((value, row))
        first, _ = groups_of(np.column_stack((row[order].astype(np.uint64), value[order])))
        chosen = order[first]
        return row[chosen], value[chosen], np.ones(len(chosen), bool)

    def segments(self, data, offsets, is_shared):
        rows, at, least = self._least(data, offsets)
        begin, windows = segments_of(at, rows, least)
        hit = is_shared(rows[at[begin]], least[at[begin]])
        start, windows = at[begin][hit], windows[hit]
        row = rows[start]
        return row, least[start], start - offsets[row], windows, self._units(data, start, windows)

    def _units(self, data, start, windows):
        """The bytes of so many windows from each start."""
        lengths = windows + self.width - 1
        to = np.cumsum(lengths)
        source = np.repeat(start - (to - lengths), lengths) + np.arange(to[-1] if len(to) else 0)
        return binary_array(data[source], to - lengths, to)

    @property
    def window_bytes(self) -> int:
        return self.width

    def unit_bytes(self, segments: int, windows: int) -> int:
        """Of the units of so many segments."""
        return windows + (self.width - 1) * segments

    def cut(self, units: bytes, first: int, windows: int) -> bytes:
        return units[first : first + windows + self.width - 1]

    @property
    def cuts(self):
        """Lengths of the anchors by which hot segments are cut again; the last gives single windows."""
        return (self.anchor + self.width) // 2, self.width

    def pieces(self, units, windows, cut):
        """Runs of windows with one least hash of ``cut`` bytes: segment, place, windows, units, hash.

        By itself a window takes ``width`` bytes, in a run little more than one.
        """
        bounds, data = bounds_of(units), np.frombuffer(units.buffers()[2], np.uint8)
        segment, at = expand(np.arange(len(units)), windows)
        place = bounds[segment] + at
        least = sliding_min(mix(byte_prefix(data[: bounds[-1]]).rolling(cut), 4), self.width - cut + 1)
        if cut == self.width:
            begin, n = np.arange(len(place)), np.ones(len(place), np.int64)
        else:
            begin, n = segments_of(place, np.repeat(np.arange(len(units)), np.diff(bounds)), least)
        return segment[begin], at[begin], n, self._units(data, place[begin], n), least[place[begin]]

    def repeats(self, doc, start, windows, units):
        """Suffixes that repeat ``width`` bytes or more of an earlier document, and how many.

        Segments with equal bytes are compared once, for their earliest document;
        in the other documents all their windows repeat.
        """
        key = units.dictionary_encode().indices.to_numpy()
        order = np.lexsort((doc, key))
        first, group = groups_of(key[order])
        head = np.empty(len(doc), np.int64)
        head[order] = order[first][group]
        heads = order[first]
        bounds, data = bounds_of(units), np.frombuffer(units.buffers()[2], np.uint8)
        factors = previous_factors(data, bounds[:-1][heads], bounds[1:][heads], doc[heads], windows[heads])
        lengths = np.diff(bounds)
        # Of every segment the factors of the one that it equals, or its whole length.
        base = np.zeros(len(doc), np.int64)
        base[heads] = np.cumsum(windows[heads]) - windows[heads]
        segment, at = expand(np.arange(len(doc)), windows)
        found = np.where(doc[segment] > doc[head[segment]], lengths[segment] - at, factors[base[head[segment]] + at])
        hit = np.flatnonzero(found >= self.width)
        return segment[hit], at[hit], found[hit]


def eight_bytes(data: np.ndarray, places: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The next eight bytes as one number that sorts as they do; zeros after the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.ndarray((len(data) + 1,), ">u8", padded, strides=(1,))[places].astype(np.uint64)
    rest = np.clip(ends - places, 0, 8)
    beyond = (8 * (8 - np.maximum(rest, 1))).astype(np.uint64)
    return np.where(rest > 0, words >> beyond << beyond, np.uint64(0))


def suffix_order(data: np.ndarray, places: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and how many bytes each shares with the one before it.

    Eight bytes are compared at a time; only suffixes that agree so far take part
    in the next round. Suffixes that are equal up to their ends stay together.
    """
    n = len(places)
    order = np.arange(n)
    shared = np.zeros(n, np.int64)
    # Positions in ``order`` still to be told apart, and the run that each is in.
    at, run, depth = np.arange(n), np.zeros(n, np.int64), 0
    while len(at):
        own = order[at]
        begins = places[own] + depth
        words, rest = eight_bytes(data, begins, ends[own]), np.minimum(ends[own] - begins, 8)
        sort = np.argsort(words) if depth == 0 else np.lexsort((rest, words, run))
        if depth == 0 and rest.min() < 8:
            sort = np.lexsort((rest, words))
        order[at], words, rest = own[sort], words[sort], rest[sort]
        same_run = np.append(False, run[1:] == run[:-1])
        differ = np.append(False, (words[1:] != words[:-1]) | (rest[1:] != rest[:-1]))
        cut = np.flatnonzero(same_run & differ)
        bits = words[cut] ^ words[cut - 1]
        equal = np.zeros(len(cut), np.int64)
        for k in range(8):
            equal += bits >> np.uint64(8 * (7 - k)) == 0
        shared[at[cut]] = depth + np.minimum(equal, np.minimum(rest[cut], rest[cut - 1]))
        # What ends here and equals its neighbour shares all of itself.
        done = same_run & ~differ & (rest < 8)
        shared[at[done]] = depth + rest[done]
        run = np.cumsum(~same_run | differ)
        alone = np.append(run[1:] != run[:-1], True) & np.append(True, run[1:] != run[:-1])
        open_ = ~alone & (rest == 8)
        at, run, depth = at[open_], run[open_], depth + 8
    return order, shared


def nearest_smaller(values: np.ndarray, prefixes: np.ndarray) -> np.ndarray:
    """Shared with the nearest smaller value before each, 0 if there is none.

    ``prefixes[i]`` is what i shares with i - 1. Whoever is not smaller is skipped
    with all that lie between it and its own candidate; all skip at once.
    """
    n = len(values)
    before = np.arange(n) - 1
    shared = np.append(prefixes[:n], 0)
    values = np.append(values, np.iinfo(np.int64).min)
    active = np.flatnonzero(values[before] >= values[:n])
    while len(active):
        onto = before[active]
        shared[active] = np.minimum(shared[active], shared[onto])
        before[active] = before[onto]
        active = active[values[before[active]] >= values[active]]
    return np.where(before >= 0, shared[:n], 0)


def previous_factors(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, docs: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """The longest previous factor of the first ``windows`` suffixes of each segment.

    That is the most bytes that it shares with such a suffix of a segment of a
    smaller document, up to the ends of both segments. Suffixes that are shorter
    than a window can neither repeat nor be repeated.
    """
    segment, at = expand(np.arange(len(begins)), windows)
    if not len(segment):
        return np.zeros(0, np.int64)
    places, stops, owners = begins[segment] + at, ends[segment], docs[segment]
    order, prefixes = suffix_order(data, places, stops)
    sorted_docs = owners[order]
    back = nearest_smaller(sorted_docs, prefixes)
    ahead = nearest_smaller(sorted_docs[::-1], np.append(0, prefixes[:0:-1]))[::-1]
    factors = np.empty(len(order), np.int64)
    factors[order] = np.maximum(back, ahead)
    return factors


def keep_rest(width: int):
    """Rows with the bytes that stay, and how many runs of bytes went."""

    def run(batches):
        for batch in batches:
            ids, copies, stretches = (batch.column(c).to_pylist() for c in ("doc_id", "copy", "stretches"))
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            out = {"doc_id": ids, "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
            for text, copy, spans in zip(texts, copies, stretches, strict=True):
                kept, runs = text, 0
                if copy and len(text) >= width:
                    kept, runs = b"", 1
                elif spans:
                    parts, done = [], 0
                    for begin, end in sorted((s["start"], s["end"]) for s in spans):
                        if begin > done or not runs:
                            runs += 1
                            parts.append(text[done:begin])
                        done = max(done, end)
                    kept = b"".join([*parts, text[done:]])
                out["n_bytes"].append(len(text))
                out["n_removed"].append(len(text) - len(kept))
                out["n_spans"].append(runs)
                out["kept"].append(kept)
            yield pa.RecordBatch.from_pydict(
                out,
                schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]),
            )

    return run


def remove_repeated_strings(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """Texts without the bytes of strings that also start in an earlier document.

    Takes ``doc_id`` and ``text``; other columns are ignored. Gives ``doc_id``,
    ``n_bytes``, ``n_removed``, ``n_spans`` (maximal runs removed) and ``kept``
    (the remaining bytes, which need not be valid UTF-8), one row for each input
    row. Earlier means a smaller id; strings are judged on the input and never
    cross documents. A null text is empty. A row without id is kept whole and
    counts for no other. Rows that share an id count as one document. An empty
    table gives an empty result. ``width`` is over ``ANCHOR``.
    """
    found = repeated_stretches(docs, ByteWindows(width))
    return found.mapInArrow(
        keep_rest(width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )
