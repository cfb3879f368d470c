"""Media columns: payloads kept as FLAC, read back as PCM blocks with seekable sample offsets.

``write_media`` stores each text's bytes, padded with zeros to a positive multiple of 64, as a mono
8-bit FLAC stream.  ``read_blocks`` decodes streams into PCM blocks, ``media_digests`` into one row of
checks and features per stream.  Reading verifies the frames' checksums and raises on damage.

Edge cases: a null or empty text is 64 zero bytes; equal texts give equal streams; repeated rows and
ids stay separate rows; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flac
from .common import arrow_map, slices, text_bytes

UNIT = 64
STEP = 4 << 20


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media (a FLAC stream)."""
    slim = docs.select(F.col(id_col), text_bytes(text_col).alias("text"))
    kind = slim.schema[0].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", STEP):
            texts = batch.column(1).to_pylist()
            padded = [t.ljust(max(UNIT, -(-len(t) // UNIT) * UNIT), b"\0") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(flac.encode(padded), pa.binary())], names=[id_col, "n_bytes", "media"])

    return arrow_map(slim, write, f"`{id_col}` {kind}, n_bytes long, media binary")


def read_blocks(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per block: id, block, sample_offset, n_samples and pcm (unsigned 8-bit samples)."""
    slim = media.select(F.col(id_col), F.col("media"))
    kind = slim.schema[0].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", STEP):
            rows = [
                (at, block, offset, s.pcm[offset:end])
                for at, s in enumerate(flac.decode(batch.column(1).to_pylist()))
                for block, (offset, end) in enumerate(zip(s.offsets, [*s.offsets[1:], len(s.pcm)], strict=True))
            ]
            at, block, offset, pcm = map(list, zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(block, pa.int32()), pa.array(offset, pa.int64()), pa.array(list(map(len, pcm)), pa.int32()), pa.array(pcm, pa.binary())],
                names=[id_col, "block", "sample_offset", "n_samples", "pcm"],
            )

    return arrow_map(slim, read, f"`{id_col}` {kind}, block int, sample_offset long, n_samples int, pcm binary")


def feature(pcm: bytes) -> str:
    """Mean level, energy, peak and zero crossings of the signed samples, all in whole numbers."""
    x = np.frombuffer(pcm, dtype=np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"sum={x.sum()};energy={(x * x).sum()};low={x.min()};high={x.max()};crossings={crossings}"


def media_digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Checks and features of every stream, from the stored bytes as read back."""
    slim = media.select(F.col(id_col), F.col("n_bytes"), F.col("media"))
    kind = slim.schema[0].dataType.simpleString()
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", STEP):
            stored = batch.column(2).to_pylist()
            rows = [
                (len(s.pcm), hashlib.sha256(s.pcm).hexdigest(), zlib.crc32(s.pcm[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), feature(s.pcm))
                for m, s in zip(stored, flac.decode(stored), strict=True)
            ]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=[id_col, "n_bytes", *names])

    return arrow_map(slim, digest, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
