"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are compared as lower-cased words with single spaces (ASCII case, spacing and
punctuation don't count).  A region of ``w`` bytes of an item that stands in a text with at most ``e``
edits shares at least w + 1 - q * (e + 1) of its q-grams with it, on diagonals at most ``e`` apart.
Shared q-grams are counted in overlapping bands of diagonals.  In bands that reach the bound the fewest
edits of every window of ``w`` bytes are found by banded edit distance; a region is a run of windows that
each keep to ``e`` edits.  Windows of 120 to 180 bytes, with 6 to 9 edits, are looked at as well: so every
stretch of ``w`` bytes or more with at most 5 % edits holds a window (one of 200 bytes falls into such parts).

Edge cases: null and empty texts and items have no regions; an item shorter than a q-gram is looked
for as it stands, between word ends; repeated rows give repeated results; an item that stands twice in
a text gives two regions; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow_map, slices, staged, take_turn, text_bytes

Q = 12
#: A region has so many bytes, or is the whole of a shorter item; and so many edits a byte.
REGION, EDITS = 100, 0.05
#: Diagonals in a band, besides the overlap with the next.
BAND = 16
#: Bytes of benchmark text that are sent to the tasks at once; more are taken in blocks.
BLOCK_BYTES = 32 << 20
#: Bytes of text whose q-grams are hashed at once.
STEP = 1 << 20
#: Shared q-grams that are counted at once, about.
HITS = 1 << 21
#: Windows of an item that are aligned at once.
WINDOWS = 1 << 14
_TABLE_BITS = 24
_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1

_FOLDED = np.arange(256, dtype=np.uint8)
for _c in range(128):
    _ch = chr(_c)
    _FOLDED[_c] = ord(_ch.lower()) if _ch.isalnum() else 32


def _normal(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts folded, each ended by a zero byte: the bytes, where each comes from, and where texts begin there and before folding."""
    raw = np.frombuffer(b"\0".join([*texts, b""]), dtype=np.uint8)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    folded = _FOLDED[raw]
    folded[begin[1:] - 1] = 0
    space = folded == 32
    before = np.empty(len(raw), dtype=bool)
    before[:1], before[1:] = True, space[:-1] | (folded[:-1] == 0)
    keep = ~(space & before)
    source = np.flatnonzero(keep)
    out = folded[source]
    # a space before an end goes too
    tail = np.flatnonzero((out[:-1] == 32) & (out[1:] == 0)) if len(out) > 1 else np.empty(0, np.int64)
    out, source = np.delete(out, tail), np.delete(source, tail)
    return out, source, np.searchsorted(source, begin[:-1]), begin[:-1]


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the Q bytes from every place."""
    p = [_U(pow(_P, k, 1 << 64)) for k in (1, 2, 4)]
    one = data.astype(np.uint64) + _U(1)
    two = one[:-1] * p[0] + one[1:]
    four = two[:-2] * p[1] + two[2:]
    eight = four[:-4] * p[2] + four[4:]
    return eight[: len(data) - Q + 1] * p[2] + four[8:]


def budget(size: int) -> tuple[int, int, int]:
    """Region size, edits and shared q-grams at least, for an item of ``size`` bytes."""
    w = min(size, REGION)
    e = int(w * EDITS)
    while e and w + 1 - Q * (e + 1) < 1:
        e -= 1
    return w, e, max(1, w + 1 - Q * (e + 1))


def windows(size: int) -> list[tuple[int, int]]:
    """Windows of an item of ``size`` bytes and their edits: at each size from which on one more edit is allowed."""
    step = round(1 / EDITS)
    return [budget(size)[:2], *((w, w // step) for w in range(REGION + step, min(size, 2 * REGION - 1) + 1, step))]


@dataclass
class Index:
    """The q-grams of a block of items."""

    ids: list
    items: list[bytes]

    def __post_init__(self) -> None:
        kept = [(i, t) for i, t in zip(self.ids, self.items, strict=True) if t]
        data, _, begin, _ = _normal([t for _, t in kept])
        ends = np.append(begin[1:], len(data))[: len(kept)] - 1
        self.ids = [i for i, _ in kept]
        self.items = [data[a:b].tobytes() for a, b in zip(begin, ends, strict=True)]
        rules = [budget(len(t)) for t in self.items]
        self.region, self.edits, self.bound = (np.array(c, dtype=np.int64) for c in zip(*rules, strict=True)) if rules else (np.empty(0, np.int64),) * 3
        self.spread = np.array([windows(len(t))[-1][1] for t in self.items], dtype=np.int64)
        # added to diagonals, so that those of the longest item's end aren't below 0
        self.origin = -(-(max(map(len, self.items), default=0) + BAND + int(self.spread.max(initial=0))) // BAND) * BAND
        self.short = [i for i, t in enumerate(self.items) if 0 < len(t) < Q]
        hashes, item, place = [], [], []
        for i, t in enumerate(self.items):
            if len(t) >= Q:
                h = _grams(np.frombuffer(t, np.uint8))
                hashes.append(h)
                item.append(np.full(len(h), i))
                place.append(np.arange(len(h)))
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.item, self.place = (np.concatenate(c)[order] if c else np.empty(0, np.int64) for c in (item, place))
        self.grams, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.table[(self.grams >> _U(64 - _TABLE_BITS)).astype(np.int64)] = True

    def regions(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits), start and end in characters of the text."""
        data, source, begin, raw_begin = _normal(texts)
        found: set[tuple[int, int, int, int, int]] = set()
        if len(data) >= Q and len(self.grams):
            h = _grams(data)
            at = np.flatnonzero(self.table[(h >> _U(64 - _TABLE_BITS)).astype(np.int64)])
            gram = np.searchsorted(self.grams, h[at])
            gram[gram == len(self.grams)] = 0
            same = self.grams[gram] == h[at]
            at, gram = at[same], gram[same]
            # a piece of the places at a time, so that repetitive texts take no more memory
            cuts = np.searchsorted(np.cumsum(self.count[gram]), np.arange(HITS, self.count[gram].sum() + HITS, HITS), side="right")
            parts = [self._bands(a, g) for a, g in zip(np.split(at, cuts), np.split(gram, cuts), strict=True)]
            key, part = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            shared = np.bincount(part, weights=np.concatenate([n for _, n in parts]), minlength=len(key))
            key = key[shared >= self.bound[key >> 40]]
            for item, band in zip((key >> 40).tolist(), (key & ((1 << 40) - 1)).tolist(), strict=True):
                found.update(self._aligned(data, begin, item, band * BAND - self.origin))
        for item in self.short:
            whole = data.tobytes()
            at = whole.find(self.items[item])
            while at >= 0:
                end = at + len(self.items[item])
                if (at == 0 or whole[at - 1] in b"\0 ") and whole[end] in b"\0 ":
                    found.add((int(np.searchsorted(begin, at, side="right")) - 1, item, at, end, 0))
                at = whole.find(self.items[item], at + 1)
        # of overlapping regions of an item the longest stays, where an edit weighs as much as half of the bytes that allow it; ends may reach over by their edits
        out: list[tuple[int, int, int, int, int]] = []
        taken: dict[tuple[int, int], list[tuple[int, int]]] = {}
        upto: dict[int, np.ndarray] = {}  # characters to each byte of a text
        for text, item, a, b, edits in sorted(found, key=lambda r: (r[0], r[1], r[2] - r[3] + r[4] / EDITS / 2, r[4], r[2])):
            spans = taken.setdefault((text, item), [])
            slack = min(edits, int(self.spread[item]))
            # spans that were taken are longer and hardly overlap each other: only the nearest can meet this one
            near = bisect.bisect_left(spans, (a, b))
            lo = near
            while lo and spans[lo - 1][1] > a + slack and near - lo < 8:
                lo -= 1
            if all(b - slack <= x or a + slack >= y for x, y in spans[lo : near + 8]):
                spans.insert(near, (a, b))
                if text not in upto:
                    upto[text] = np.cumsum((np.frombuffer(texts[text], np.uint8) & 0xC0) != 0x80)
                first, last = int(source[a] - raw_begin[text]), int(source[b - 1] - raw_begin[text])
                out.append((text, item, int(upto[text][first]) - 1, int(upto[text][last]), edits))
        return out

    def _bands(self, at: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bands (item and band in one number) and how many q-grams at these places they share."""
        count = self.count[gram]
        entry = np.repeat(self.first[gram], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at, item, place = np.repeat(at, count), self.item[entry], self.place[entry]
        diagonal = at - place + self.origin
        band = diagonal // BAND
        low = diagonal % BAND < self.spread[item]  # also in the overlap of the band before
        item, band = np.concatenate([item, item[low]]), np.concatenate([band, band[low] - 1])
        return np.unique(item << 40 | band, return_counts=True)

    def _aligned(self, data: np.ndarray, begin: np.ndarray, item: int, diagonal: int) -> Iterator[tuple[int, int, int, int, int]]:
        """Regions of ``item`` on diagonals from ``diagonal`` on, by alignment within the band."""
        pattern = self.items[item]
        edits, spread = int(self.edits[item]), int(self.spread[item])
        lo, hi = max(0, diagonal), min(len(data), diagonal + len(pattern) + BAND + 2 * spread)
        # all texts that the band touches; nearly always one
        first, last = (int(np.searchsorted(begin, x, side="right")) - 1 for x in (lo, max(lo, min(hi, len(data)) - 1)))
        for text in range(first, last + 1):
            a = max(lo, int(begin[text]))
            b = min(hi, int(begin[text + 1]) - 1 if text + 1 < len(begin) else len(data) - 1)
            if b - a < min(len(pattern), int(self.region[item])) - edits:
                continue
            window = data[a:b].tobytes()
            at = window.find(pattern)
            whole = at >= 0
            while at >= 0:
                yield text, item, a + at, a + at + len(pattern), 0
                at = window.find(pattern, at + 1)
            if edits and not whole:  # copies with edits in the same band would overlap the exact one
                for region, most in windows(len(pattern)):
                    for start, end, n in stretches(pattern, data[a:b], diagonal - a, BAND + spread, region, most):
                        yield text, item, a + start, a + end, n


def banded(pattern: bytes, text: np.ndarray, diagonal: int, width: int, region: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``region`` bytes of ``pattern`` that may touch ``text``: place in the pattern, fewest edits, start and end in the text.

    Alignments keep to the diagonals [diagonal, diagonal + width].  All windows advance together, a byte at a
    time; a cell holds its edits and, in the low bits, the diagonal that its alignment began on.
    """
    size = width + 1
    bits = size.bit_length()
    one = 1 << bits
    first, last = max(0, -diagonal - size - region + 1), min(len(pattern) - region, len(text) - diagonal)
    parts = [(np.empty(0, np.int64),) * 4]
    own = np.frombuffer(pattern, np.uint8)
    offsets = np.arange(size, dtype=np.int32)
    for begin in range(first, last + 1, WINDOWS):
        places = np.arange(begin, min(begin + WINDOWS, last + 1))
        # the text's bytes at each place of the band; beyond its ends stands what equals nothing and costs as much as no byte
        base = begin + diagonal
        there = np.full(len(places) + region + size, 256, np.int16)
        lo, hi = max(0, base), min(len(text), base + len(there))
        if lo < hi:
            there[lo - base : hi - base] = text[lo:hi]
        view = np.lib.stride_tricks.sliding_window_view(there, size)
        cell = np.repeat(offsets[None, :], len(places), axis=0)
        for i in range(region):
            byte = own[begin + i : begin + i + len(places), None]
            new = cell + (view[i : i + len(places)] != byte) * np.int32(one)
            # a byte of the pattern without one of the text: from the next diagonal of the row before
            np.minimum(new[:, :-1], cell[:, 1:] + one, out=new[:, :-1])
            # a byte of the text without one of the pattern: along the row, by a running minimum
            cell = np.minimum.accumulate(new - one * offsets, axis=1) + one * offsets
        at = size - 1 - np.argmin(cell[:, ::-1], axis=1)
        best = cell[np.arange(len(places)), at]
        start, end = places + diagonal + (best & (one - 1)), places + diagonal + region + at
        parts.append((places, (best >> bits).astype(np.int64), np.clip(start, 0, len(text)), np.clip(end, 0, len(text))))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def stretches(pattern: bytes, text: np.ndarray, diagonal: int, width: int, region: int, most: int) -> Iterator[tuple[int, int, int]]:
    """Start, end and edits of every longest run of windows of ``pattern`` in ``text`` with ``most`` edits each."""
    places, edits, start, end = banded(pattern, text, diagonal, width, region)
    good = np.flatnonzero(edits <= most)
    for run in np.split(good, np.flatnonzero(np.diff(good) > 1) + 1):
        if not len(run):
            continue
        a, b = int(run[0]), int(run[-1])
        # windows that reach over the ends of the stretch
        while a < b and edits[a + 1] < edits[a]:
            a += 1
        while a < b and edits[b - 1] < edits[b]:
            b -= 1
        if a == b:
            yield int(start[a]), int(end[a]), int(edits[a])
            continue
        whole = pattern[int(places[a]) : int(places[b]) + region]
        _, n, x, y = banded(whole, text, diagonal + int(places[a]), width, len(whole))
        yield int(x[0]), int(y[0]), int(n[0])


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list, list[bytes], bool]]:
    """Ids and texts of the items, about BLOCK_BYTES at a time, and whether there are several blocks.

    What a block finds is written before the next one comes, so that the driver holds one at a time.
    """
    items = benchmark.select(F.col(item_col).alias("item"), text_bytes(text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        yield [r["item"] for r in rows], [bytes(r["text"]) for r in rows], blocks > 1


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any region of the benchmark, with all their columns."""
    place = docs.columns.index(text_col)
    for ids, texts, several in _blocks(benchmark, item_col, item_text_col):

        def keep(batches: Iterator[pa.RecordBatch], ids=ids, texts=texts) -> Iterator[pa.RecordBatch]:
            take_turn("decontaminate")
            index = Index(ids, texts)
            for batch in slices(batches, text_col, STEP):
                found = index.regions([(t or "").encode("utf-8", "surrogatepass") for t in batch.column(place).to_pylist()])
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[r[0] for r in found]] = False
                yield batch.filter(pa.array(clean))

        docs = arrow_map(docs, keep, docs.schema)
        docs = staged(docs, "clean") if several else docs
    return docs


def contaminated_regions(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per region: id, item id, start and end (in characters of the text) and edits."""
    slim = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    id_kind = slim.schema["id"].dataType.simpleString()
    out = None
    item_kind, item_arrow = benchmark.schema[item_col].dataType.simpleString(), to_arrow_type(benchmark.schema[item_col].dataType)
    for ids, texts, several in _blocks(benchmark, item_col, item_text_col):

        def search(batches: Iterator[pa.RecordBatch], ids=ids, texts=texts) -> Iterator[pa.RecordBatch]:
            take_turn("decontaminate")
            index = Index(ids, texts)
            for batch in slices(batches, "text", STEP):
                found = index.regions(batch.column(1).to_pylist())
                if found:
                    text, item, start, end, edits = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(text)), pa.array([index.ids[i] for i in item], item_arrow), *(pa.array(c, pa.int64()) for c in (start, end, edits))],
                        names=["id", "item", "start", "end", "edits"],
                    )

        part = arrow_map(slim, search, f"id {id_kind}, item {item_kind}, start long, end long, edits long")
        part = staged(part, "regions") if several else part
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "start", "end", "edits")
