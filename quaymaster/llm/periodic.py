"""Periodic runs of words by string synchronising sets.

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are equal) and ``max(least, 2 * q)`` words or
more that no neighbouring word extends.  All runs of a text are found, in time that is nearly linear in its words:

* Periods below ``SMALL`` come from comparing the words with themselves, so many places on.
* For each dyadic scale ``t`` from ``SMALL / 3`` on, the synchronising set holds the places where the smallest hash of all windows
  of ``t`` words that begin in ``[i, i + t]`` belongs to the first or the last of them.  Windows with a period of up to ``t / 3`` have no
  hash; they lie in runs that smaller scales have found.  Whether a place is in the set depends on its context, the next ``2 * t`` words, alone; and
  every ``t`` places hold one of the set, unless they lie in such a highly periodic region.
* So a run of a period from ``3 * t`` to ``6 * t`` has two places of the set, a period apart and with equal contexts, or its period
  consists of highly periodic regions.  Pairs with equal contexts at such distances (at most 18 for each place, since contexts have no
  short period) propose periods; and so do two regions of one small period that touch, once for each
  distance that brings their phases together.
* A proposed period is extended to both sides by names of equal windows of dyadic lengths, from the longest down.

Names are exact (ranks of distinct windows, not hashes), so nothing is found by chance.  The texts of a batch are
searched together, with an end of its own behind each.

Edge cases: a null or empty text has no words and no runs; repeated rows are searched one by one; a very long text is searched
whole, in memory in proportion to its words; extra columns stay out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, mix, slices, take_turn, text_bytes

#: Periods below are looked for one by one; a power of two times three.
SMALL = 48
#: Runs are this long at least.
LEAST = 12
RUNS = "array<struct<start: long, length: long, period: long>>"
_RUNS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _stretches(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every longest stretch of ``least`` true values or more."""
    edge = np.flatnonzero(np.diff(equal.view(np.int8), prepend=0, append=0))
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= least
    return begin[long], end[long]


def _small(words: np.ndarray, least: int) -> list[np.ndarray]:
    """Rows (begin, end, period) of all stretches with periods below ``SMALL``."""
    found = []
    for q in range(1, min(SMALL, len(words) // 2 + 1)):
        begin, end = _stretches(words[q:] == words[:-q], max(least - q, q))
        if len(begin):
            found.append(np.stack([begin, end + q, np.full(len(begin), q)], axis=1))
    return found


def _names(own: np.ndarray, width: int) -> np.ndarray:
    """Names of windows twice as long: equal names for equal windows; windows that reach over the end have none."""
    pairs = own[:-width].astype(np.int64) << 32 | own[width:]
    return np.unique(pairs, return_inverse=True)[1].astype(np.int32) if len(pairs) else np.empty(0, np.int32)


class _Extender:
    """Extends equal places by names of windows of dyadic lengths."""

    def __init__(self, words: np.ndarray):
        self.levels = [words.astype(np.int32)]
        while True:
            own, width = self.levels[-1], 1 << (len(self.levels) - 1)
            if len(own) <= width or len(own) == int(own.max()) + 1:  # all windows differ: longer ones do as well
                break
            self.levels.append(_names(own, width))

    def at(self, level: int) -> np.ndarray:
        return self.levels[level] if level < len(self.levels) else np.empty(0, np.int32)

    def __call__(self, place: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Rows (begin, end, period): the longest stretches of the period around ``place``, without those of under two periods."""
        here, there = place.copy(), place + period
        for level in range(len(self.levels) - 1, -1, -1):
            names, width = self.levels[level], 1 << level
            while True:  # at most twice but on the longest level
                fit = there < len(names)
                fit[fit] = names[here[fit]] == names[there[fit]]
                if not fit.any():
                    break
                here[fit] += width
                there[fit] += width
                if level < len(self.levels) - 1:
                    break
        end, here = there, place.copy()
        for level in range(len(self.levels) - 1, -1, -1):
            names, width = self.levels[level], 1 << level
            while True:
                fit = here >= width
                fit[fit] = names[here[fit] - width] == names[here[fit] - width + period[fit]]
                if not fit.any():
                    break
                here[fit] -= width
                if level < len(self.levels) - 1:
                    break
        rows = np.stack([here, end, period], axis=1)
        return rows[end - here >= 2 * period]


def _smallest(found: list[np.ndarray]) -> np.ndarray:
    """Of rows with the same begin and end the one with the smallest period, in order."""
    if not found:
        return np.empty((0, 3), np.int64)
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[first]


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of ``width + 1`` values from every place on; ``width`` is a power of two."""
    least, step = values, 1
    while step < width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    return np.minimum(least[:-1], values[width:]) if len(least) > 1 else least[:0]


def synchronising(names: np.ndarray, periodic: np.ndarray, t: int, contexts: int) -> np.ndarray:
    """The places of the set of scale ``t``: ``names`` are those of windows of ``t`` words, ``periodic`` marks the highly periodic ones."""
    hashed = mix(names.astype(np.uint64) + np.uint64(1))
    hashed[periodic] = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = _least_of(hashed, t)[:contexts]
    n = len(least)
    some = least != np.uint64(0xFFFFFFFFFFFFFFFF)
    return np.flatnonzero(some & ((least == hashed[:n]) | (least == hashed[t : t + n])))


def _pairs(place: np.ndarray, context: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of all pairs with one context that lie ``low`` to ``high`` (without it) apart."""
    order = np.lexsort((place, context))
    place, context = place[order], context[order]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for lag in range(1, len(place)):
        near = (context[lag:] == context[:-lag]) & (place[lag:] - place[:-lag] < high)
        if not near.any():
            break
        at = np.flatnonzero(near)
        distance = place[at + lag] - place[at]
        out.append((place[at][distance >= low], distance[distance >= low]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 2


def _touching(words: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances at which two regions of one small period that touch or overlap have the same phase."""
    place, distance = [], []
    regions = regions[(regions[:, 1] - regions[:, 0]) >= 9 * regions[:, 2]]
    regions = regions[np.lexsort((regions[:, 0], regions[:, 2]))]
    for (a, a_end, r), (b, b_end, r_b) in zip(regions[:-1].tolist(), regions[1:].tolist(), strict=True):
        if r != r_b or b > a_end:
            continue
        root, first_words = words[b : b + r].tobytes(), words[a : a + 2 * r - 1].tobytes()
        phase = first_words.find(root)  # where the second region's first words stand in the first
        while phase % words.itemsize and phase >= 0:
            phase = first_words.find(root, phase + 1)
        if phase < 0:
            continue
        phase //= words.itemsize
        low, high = max(SMALL, 9 * r), min(a_end - a, b_end - b)
        first = b - a - phase
        q = np.arange(low + (first - low) % r, high + 1, r)
        place.append(np.maximum(a, b - q))
        distance.append(q)
    return tuple(np.concatenate(c) if c else np.empty(0, np.int64) for c in (place, distance))


def _repeats(words: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Documents in which a window of two thirds of ``SMALL`` words stands twice (or, rarely, seems to): only they can have long periods."""
    value, width = mix(words.astype(np.uint64) + np.uint64(1)), 1
    while width < 2 * SMALL // 3:
        value = mix(value[:-width] * np.uint64(0x9E3779B97F4A7C15) + value[width:])
        width *= 2
    order = np.argsort(value, kind="stable")
    same = value[order][1:] == value[order][:-1]
    one, other = document[order[1:][same]], document[order[:-1][same]]
    return np.unique(one[one == other])


def find_runs(words: np.ndarray, count: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (document, start, length, period) of all runs, by document, start and period.

    ``words`` are numbers of the words of all documents, one after the other, ``count`` of which belong to each.
    """
    # an end of its own behind every document
    ends = np.cumsum(count + 1) - 1
    total = int(ends[-1]) + 1 if len(ends) else 0
    text = np.empty(total, np.int32)
    inner = np.ones(total, bool)
    inner[ends] = False
    text[inner] = words
    text[ends] = (int(words.max()) + 1 if len(words) else 0) + np.arange(len(ends))
    document = np.repeat(np.arange(len(count)), count + 1)
    small = _smallest(_small(text, least))
    rows = [small]
    begin = ends - count
    again = _repeats(text, document) if total >= 2 * SMALL else np.empty(0, np.int64)
    again = again[count[again] >= 2 * SMALL]
    if len(again):
        pick = np.isin(document, again)
        own = text[pick]
        # where documents begin in the shorter text, and how far all of them have moved
        moved = begin[again] - (np.cumsum(count[again] + 1) - count[again] - 1)
        starts = begin[again] - moved
        known = small[np.isin(document[small[:, 0]], again)]
        shift = moved[np.searchsorted(again, document[known[:, 0]])]
        known = known - np.stack([shift, shift, np.zeros_like(shift)], axis=1)
        large = _large(np.unique(own, return_inverse=True)[1].astype(np.int32), known)
        back = moved[np.searchsorted(starts, large[:, 0], side="right") - 1]
        rows.append(large + np.stack([back, back, np.zeros_like(back)], axis=1))
    found = _smallest(rows)
    of = document[found[:, 0]]
    out = np.stack([of, found[:, 0] - begin[of], found[:, 1] - found[:, 0], found[:, 2]], axis=1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _large(words: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Rows (begin, end, period) of stretches with periods from ``SMALL`` on; ``known`` are those below."""
    extend = _Extender(words)
    found, t = [], SMALL // 3
    while len(extend.at((2 * t).bit_length() - 1)):
        level = t.bit_length() - 1
        names, contexts = extend.at(level), extend.at(level + 1)
        edge = np.zeros(len(words) + 1, np.int32)
        high = known[(known[:, 2] <= t // 3) & (known[:, 1] - known[:, 0] >= t)]
        np.add.at(edge, high[:, 0], 1)
        np.add.at(edge, high[:, 1] - t + 1, -1)
        place = synchronising(names, np.cumsum(edge[: len(names)]) > 0, t, len(contexts))
        at, period = _pairs(place, contexts[place], 3 * t, 6 * t)
        if len(at):
            new = _smallest([extend(at, period)])
            found.append(new)
            known = np.concatenate([known, new])
        t *= 2
    at, period = _touching(words, known)
    if len(at):
        found.append(extend(at, period))
    return _smallest(found)


def numbered(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of every text, all words' numbers, and how many each text has."""
    split = [t.split() for t in texts]
    places: dict[bytes, int] = {}
    words = np.fromiter((places.setdefault(w, len(places)) for ws in split for w in ws), dtype=np.int32)
    return split, words, np.fromiter(map(len, split), dtype=np.int64, count=len(split))


def _kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of a document's words stay: those that no run holds behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) == 0


def periodic_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, runs (start, length and period in words, by start and period) and collapsed: the text's words without repeats, joined by spaces."""
    slim = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("periodic")
        for batch in slices(batches, "text"):
            split, words, count = numbered(batch.column(1).to_pylist())
            runs = find_runs(words, count, least)
            upto = np.searchsorted(runs[:, 0], np.arange(len(split) + 1))
            collapsed = []
            for i, ws in enumerate(split):
                own = runs[upto[i] : upto[i + 1], 1:]
                if len(own):
                    ws = [w for w, stays in zip(ws, _kept(len(ws), own).tolist(), strict=True) if stays]
                collapsed.append(b" ".join(ws))
            structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(runs[:, k])) for k in (1, 2, 3)], fields=list(_RUNS_ARROW.value_type))
            lists = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), structs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count), lists, pa.array(collapsed, pa.binary())], names=["id", "n_words", "runs", "collapsed"])

    out = arrow_map(slim, find, f"id {kind}, n_words long, runs {RUNS}, collapsed binary")
    return out.select(F.col("id").alias(id_col), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))
