"""Byte-level BPE by the tiktoken library, with ranks from a local file.

A long text is split beforehand, at places where the pattern surely begins a new match whatever stands around: before ASCII
white space that follows anything else, and between ASCII letters, digits and punctuation (but behind an apostrophe, which may begin a contraction) or
ideographs and their punctuation.  No match reaches over such a place and none looks beyond it, so the pieces' ids in a row are
the text's ids.  A stretch without such a place stays whole, however long it is.  Decoding joins the tokens' bytes and never goes
through characters, since a token may end within one.

Edge cases: a null or empty text has no tokens, and no ids decode to no bytes; names of special tokens are ordinary text; bytes that
are no UTF-8 count as U+FFFD; an id without a token raises an error that names it; repeated rows are encoded one by one; extra
columns stay out; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, keeps_cache, slices, take_turn, text_bytes

#: Characters of a text that the library gets at once, about.
PIECE = 1 << 16
#: Bytes of ids that are decoded at once.
DECODE_STEP = 4 << 20
#: Where the pattern begins a new match in any text.
SAFE = re.compile(
    r"(?<=\S)(?=[\t-\r ])"
    r"|(?<=[A-Za-z])(?=[0-9!-/:-@\[-`{-~])"
    r"|(?<=[0-9])(?=[A-Za-z!-/:-@\[-`{-~])"
    r"|(?<=[!-&(-/:-@\[-`{-~])(?=[A-Za-z0-9])"
    r"|(?<=[一-龥])(?=[、。，！？])|(?<=[、。，！？])(?=[一-龥])"
)

_encodings: dict[tuple[str, str], object] = {}
keeps_cache("byte_bpe", _encodings.clear)


def encoding(path: str, pattern: str):
    """The library's encoding of a rank file; one lives in each Python worker."""
    take_turn("byte_bpe")
    if (path, pattern) not in _encodings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
        _encodings[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in parts of about ``size`` characters that end at safe places."""
    at = 0
    while len(text) - at > size and (cut := SAFE.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def encode_text(text: bytes, codec) -> tuple[int, bytes]:
    """How many ids a text has, and the ids as little-endian unsigned 32-bit integers."""
    parts = [np.array(codec.encode_ordinary(p), dtype="<u4") for p in pieces(text.decode("utf-8", "replace"))]
    ids = parts[0] if len(parts) == 1 else np.concatenate(parts)
    return len(ids), ids.tobytes()


def decode_ids(ids: bytes, codec) -> bytes:
    """The bytes that ids stand for."""
    try:
        return b"".join(codec.decode_bytes(np.frombuffer(ids[at : at + DECODE_STEP], dtype="<u4").tolist()) for at in range(0, len(ids), DECODE_STEP))
    except KeyError as e:
        raise ValueError(f"no token has the id {e}") from None


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens and ids (binary: little-endian unsigned 32-bit integers) of every text."""
    slim = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            codec = encoding(path, pattern)
            counts, ids = zip(*(encode_text(t, codec) for t in batch.column(1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], names=["id", "n_tokens", "ids"])

    return arrow_map(slim, run, f"id {kind}, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that its ids stand for as a further column; null ids give null."""
    place = encoded.columns.index(ids_col)
    schema = encoded.withColumn(name, F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ids_col):
            codec = encoding(path, pattern)
            found = [None if ids is None else decode_ids(ids, codec) for ids in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=schema.names)

    return arrow_map(encoded, run, schema)
