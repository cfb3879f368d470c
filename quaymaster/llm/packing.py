"""Packing by shortest-pack-first over the length histogram.

Documents are tokenised once, cut into pieces of at most one sequence, and only a small row per piece
goes on.  The histogram of piece lengths (at most ``max_tokens`` rows) is packed on the driver:
lengths longest first, each into the packs that are shortest so far, as counts of packing patterns.
The patterns then go back to the pieces by each piece's rank among those of its length.

Edge cases: a null text is an empty one; an empty text is a piece of one token, the end id; a long text
becomes several pieces; repeated rows and ids are packed one by one; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, keeps_cache, slices, staged, take_turn, text_bytes

#: Words, and parts of words, whose ids a worker keeps at hand: so many of each, none longer than this.
KEPT, KEPT_LENGTH = 200_000, 64
#: Bytes of one text that are split at once.
SPLIT_BYTES = 1 << 20
#: Rows that one window partition ranks, about.
RANK_ROWS = 100_000

#: A tokenizer with these rules is known to cut PLAIN texts, in lower case, into PARTS: all their letters are
#: composed ones, and every part is tokens of its own.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
PLAIN = re.compile(r"[\t-\r !-~À-ÖØ-öø-ÿ]*")
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: Byte-level vocabularies write the bytes that don't show as the characters from 256 on.
_SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}

_encoders: dict[str, Callable[[bytes], bytes]] = {}
_tokenizers: dict[str, object] = {}


def _forget() -> None:
    _encoders.clear()
    _tokenizers.clear()


keeps_cache("packing", _forget)


def _tokenizer(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def _encoder(path: str) -> Callable[[bytes], bytes]:
    """From a text to its ids.  What is kept is bounded by count and length, so a worker's memory is."""
    tokenizer = _tokenizer(path)
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    known = all(rules[k] == v for k, v in RULES.items()) and rules["model"]["type"] == "BPE" and not any(t["normalized"] for t in rules["added_tokens"])
    marks = [t["content"] for t in rules["added_tokens"]]
    model = tokenizer.model

    def plain(text: str) -> bool:
        return known and PLAIN.fullmatch(text) is not None and not any(m in text for m in marks)

    @lru_cache(KEPT)
    def part(chars: str) -> bytes:
        signs = chars if chars.isascii() else chars.encode().decode("latin-1").translate(_SIGNS)
        return array("I", [t.id for t in model.tokenize(signs)]).tobytes()

    @lru_cache(KEPT)
    def word(chars: bytes) -> bytes:
        text = chars.decode("utf-8", "replace")
        return parts(text) if plain(text) else array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def each(f, found: list) -> bytes:
        if max(map(len, found), default=0) > KEPT_LENGTH:
            return b"".join(f(x) if len(x) <= KEPT_LENGTH else f.__wrapped__(x) for x in found)
        return b"".join(map(f, found))

    def parts(text: str) -> bytes:
        return each(part, PARTS.findall(text.lower()))

    def whole(chars: bytes) -> bytes:
        text = chars.decode("utf-8", "replace")
        return parts(text) if plain(text) else each(word, chars.split())

    def encode(text: bytes) -> bytes:
        at, found = 0, []
        while at < len(text):
            to = text.find(b" ", at + SPLIT_BYTES)
            to = len(text) if to < 0 else to
            found.append(whole(text[at:to]))
            at = to
        return b"".join(found)

    return encode


def encode_texts(texts: list[bytes], path: str) -> Iterator[bytes]:
    """Each text's ids as little-endian 32-bit integers.

    The vocabulary never joins across ASCII white space, nor across what the tokenizer's pattern parts;
    so ids of parts, or of words with characters beyond PLAIN, are kept and joined.
    """
    take_turn("packing")
    if path not in _encoders:
        _encoders[path] = _encoder(path)
    return map(_encoders[path], texts)


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 2, max_tokens: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32 and doc_tokens; the tokens themselves don't travel."""
    slim = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows: list[tuple[int, int, int, int, int]] = []
            for at, ids in enumerate(encode_texts(batch.column(1).to_pylist(), tokenizer_path)):
                ids = memoryview(ids + end)
                n = len(ids) // 4
                rows += [(at, s, min(max_tokens, n - s), zlib.crc32(ids[4 * s : 4 * (s + max_tokens)]), n) for s in range(0, n, max_tokens)]
            at, *values = (np.array(c, dtype=np.int64) for c in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *map(pa.array, values)], names=["id", "start", "length", "ids_crc32", "doc_tokens"])

    return arrow_map(slim, cut, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack_histogram(counts: dict[int, int], max_tokens: int) -> list[tuple[int, list[int]]]:
    """Packing patterns and how often each is used: shortest pack first, lengths longest first.

    ``open_packs`` files patterns under the room left in them.  Each step moves as many packs as there
    are pieces left, so the work follows the number of lengths, not the number of documents.
    """
    open_packs: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    done: list[tuple[int, list[int]]] = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        room = max((r for r, packs in open_packs.items() if packs), default=-1)  # no open pack has more
        while left:
            while room >= length and not open_packs.get(room):
                room -= 1
            if room >= length:
                n, pattern = open_packs[room].pop()
                if n > left:
                    open_packs[room].append((n - left, pattern))
                    n = left
                left -= n
                rest = room - length
            else:
                # no pack has room: open as many as hold what is left, several pieces in each
                each = min(left, max_tokens // length)
                n, pattern = left // each, [length] * (each - 1)
                left -= n * (len(pattern) + 1)
                rest = max_tokens - length * (len(pattern) + 1)
            (open_packs[rest] if rest else done).append((n, [*pattern, length]))
    return done + [p for packs in open_packs.values() for p in packs]


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, max_tokens: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its sequence_id and its offset there."""
    cut = staged(pieces(docs, tokenizer_path, end_id, max_tokens, id_col, text_col), "pack-pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most max_tokens rows
    spans: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for n, pattern in pack_histogram(counts, max_tokens):
        offset = 0
        for length in pattern:
            spans[length].append((used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    tables = {length: np.array(rows, dtype=np.int64).T for length, rows in spans.items()}

    salts = max(1, sum(counts.values()) // RANK_ROWS)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("id", "start"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("id", "start", "ids_crc32", "doc_tokens")
    ranked = salted.withColumn("own", F.row_number().over(own) - 1).join(sizes, ["length", "salt"])
    ranked = ranked.select("id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("own")).alias("rank"))
    kind = cut.schema["id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            seq, offset = np.empty_like(rank), np.empty_like(rank)
            for one in np.unique(length):
                at = np.flatnonzero(length == one)
                first, base, place = tables[int(one)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                seq[at], offset[at] = base[k] + rank[at] - first[k], place[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(offset)], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return arrow_map(ranked, place, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
