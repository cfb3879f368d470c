"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes of text that one vectorised step works on; bounds a Python worker's memory.
STEP_BYTES = 2 << 20
#: Bytes of an Arrow batch between Spark and a Python worker.
BATCH_BYTES = 8 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` of the session.  Only a session without that setting (a local
    test) gets a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="quaymaster-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def staged(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors.

    The write's shuffle files go as soon as it has ended, since only the written table is read again.
    ``files`` bounds the number of files of a small result.
    """
    spark = df.sparkSession
    if files is not None:
        df = df.coalesce(files)
    path = f"{shared_dir(spark)}/quaymaster/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    try:
        spark.conf.set(_CLEANUP, "true")
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, f: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with batches of bounded bytes, however long the texts are.

    The bound is a setting of the session, which batches are made under when the result is run.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if not any("." in c for c in df.columns):
        return df.mapInArrow(f, schema)
    # mapInArrow takes a dot in a name for a field of a struct: such tables go by numbers
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    names, out = df.columns, [f"_{i}" for i in range(len(kind))]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in f(b.rename_columns(names) for b in batches):
            yield batch.rename_columns(out)

    found = df.toDF(*[f"_{i}" for i in range(len(names))]).mapInArrow(renamed, StructType([StructField(n, k.dataType) for n, k in zip(out, kind, strict=True)]))
    return found.toDF(*[k.name for k in kind])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def some(spark: SparkSession) -> int:
    """Files for a result that is small beside the input: an eighth of the partitions, and never few tasks on a large cluster."""
    return max(8, partitions(spark) // 8)


def fold(id_col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def text_bytes(text_col: str):
    """The whole text as UTF-8; a null text counts as empty."""
    return F.coalesce(F.col(text_col), F.lit("")).cast("binary")


def slices(batches: Iterator[pa.RecordBatch], text_col: str, step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``step`` bytes of ``text_col`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.binary_length(batch.column(text_col)).fill_null(0), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + step, side="right")))
            yield batch.slice(at, to - at)
            at = to


_caches: dict[str, Callable[[], None]] = {}
_turn = ""


def keeps_cache(name: str, clear: Callable[[], None]) -> None:
    """Name a cache that lives as long as a Python worker."""
    _caches[name] = clear


def take_turn(name: str) -> None:
    """Called where an operator starts in a worker: the caches of others, whose turn is over, are dropped."""
    global _turn
    if _turn != name:
        for other, clear in _caches.items():
            if other != name:
                clear()
        _turn = name
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
            ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
