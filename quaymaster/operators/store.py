"""Stored tables: audited batches, ids from reserved blocks, and current tables that are merged in place.

A table is a folder; what is written at once is a batch, a folder in it.  ``publish`` writes a batch beside the table, counts rows and
broken keys while it writes, and moves the batch into place only if all keys hold: the rows are evaluated once, readers never see a part
of a batch, and a batch that is published again replaces itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas, storage
from ..functions import text as t

#: Bits of an id: rows of a batch, batches of a writer, and above them the writer.  Ids below ``FIRST_BLOCK`` belong to ``state.append``.
ROW_BITS, BATCH_BITS = 24, 24
FIRST_BLOCK = 1 << (ROW_BITS + BATCH_BITS)


class KeyViolation(ValueError):
    """A batch with rows that have no id, or that refer to rows that aren't there; ``counts`` says how many."""

    def __init__(self, table: str, counts: dict[str, int]):
        super().__init__(f"{table}: " + ", ".join(f"{n} of {k}" for k, n in counts.items() if n and k != "rows"))
        self.counts = counts


def claim_writer(spark: SparkSession, root: str, table: str, owner: str) -> int:
    """The number of a writer, the same whenever ``owner`` (say, a checkpoint's path) asks again.  A claim is a file that only one can create."""
    number = 1
    while not storage.create_new(spark, f"{root}/_writers/{table}/{number}", owner):
        if spark.read.text(f"{root}/_writers/{table}/{number}", wholetext=True).first()[0] == owner:
            break
        number += 1
    return number


def with_ids(rows: DataFrame, writer: int, batch: int, order: str) -> DataFrame:
    """``rows`` with ids of the block of a writer's batch, by ``order``: the same rows get the same ids again.

    A batch is ranked in one task, so it is bounded: by the files of a trigger, and by ``2 ** ROW_BITS`` rows.
    """
    if not 0 < writer < 1 << 14 or not 0 <= batch < 1 << BATCH_BITS:
        raise ValueError(f"writer {writer} has no block for batch {batch}")
    first = (writer << (ROW_BITS + BATCH_BITS)) | (batch << ROW_BITS)
    number = F.row_number().over(Window.orderBy(order)).cast("bigint")
    return rows.withColumn("id", F.when(number < 1 << ROW_BITS, number + first))


def _as_stored(rows: DataFrame, table: str) -> DataFrame:
    """The columns of a table: those that are missing are null, created_at is the UTC time."""
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")
    kinds = [c.strip().split(" ") for c in schemas.SCHEMAS[table].split(",")]
    have = {n: F.col(f"`{n}`") if n in rows.columns else now if n == "created_at" else F.lit(None) for n, _ in kinds}
    return rows.select(*[have[n].cast(kind).alias(n) for n, kind in kinds])


def audited(rows: DataFrame, table: str, parents: dict[str, DataFrame]) -> tuple[DataFrame, Observation]:
    """``rows`` and what is counted while they are written: rows, rows without an id, and orphans of every reference to ``parents``."""
    seen = Observation(f"audit-{uuid.uuid4().hex}")
    counts = [F.count(F.lit(1)).alias("rows")] + ([F.count_if(F.col("id").isNull()).alias("rows without an id")] if "id" in rows.columns else [])
    checked, flags = rows, []
    for child, column, parent in schemas.FOREIGN_KEYS:
        if child == table and parent in parents and column in rows.columns:
            flag = t.unused(f"_{column}", checked)
            known = parents[parent].select(F.col("id").alias(column)).distinct().withColumn(flag, F.lit(True))
            checked = checked.join(known, column, "left")
            counts.append(F.count_if(F.col(column).isNotNull() & F.col(flag).isNull()).alias(f"orphans by {column}"))
            flags.append(flag)
    return checked.observe(seen, *counts).select(*[F.col(f"`{c}`") for c in rows.columns]), seen


def publish(rows: DataFrame, root: str, table: str, batch: str) -> dict[str, int]:
    """Write, audit and publish a batch of a domain table; what was counted, or ``KeyViolation``, and then nothing is published."""
    spark = rows.sparkSession
    parents = {p: schemas.read(spark, root, p) for child, _, p in schemas.FOREIGN_KEYS if child == table}
    out, seen = audited(_as_stored(rows, table), table, parents)
    path = f"{root}/_staging/{table}-{uuid.uuid4().hex}"
    out.write.parquet(path)
    counts = {k: int(v) for k, v in seen.get.items()}
    if any(n for k, n in counts.items() if k != "rows"):
        storage.remove(spark, path)
        raise KeyViolation(table, counts)
    storage.move(spark, path, f"{root}/{table}/batch-{batch}")
    return counts


def _parts(key: str, parts: int) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def merge_changes(changes: DataFrame, path: str, key: str = "id", version: str = "version", parts: int = 64) -> list[int]:
    """Keep a current table (the row of the largest version of every key) up to date: the partitions that were rewritten.

    Rows lie in ``parts`` partitions by a hash of their key, so a change of few rows reads and rewrites few partitions.  Of equal versions the
    new row stays; merging a batch again changes nothing.  Rows without a key are left out.  One writer a table at a time.
    """
    spark = changes.sparkSession
    place = t.unused("_part", changes)
    new = storage.staged(changes.where(F.col(key).isNotNull()).withColumn(place, _parts(key, parts)), "changes")
    touched = sorted(r[0] for r in new.select(place).distinct().collect())  # at most ``parts``
    if not touched:
        return []
    rows = new.withColumn("_new", F.lit(True))
    if storage.exists(spark, path):
        kept = spark.read.schema(new.schema).parquet(path).where(F.col(place).isin(touched))
        rows = rows.unionByName(kept.withColumn("_new", F.lit(False)))
    rest = [c for c in new.columns if c not in (key, place)]
    latest = rows.groupBy(place, key).agg(F.max_by(F.struct(*rest), F.struct(version, "_new")).alias("_row"))
    merged = latest.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest], place)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(place).parquet(path)
    return touched


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table that ``merge_changes`` keeps."""
    df = spark.read.parquet(path)
    return df.drop(*[c for c in df.columns if c.rstrip("_") == "_part"])


def upload(files: DataFrame, root: str, table: str, writer: int, batch: int, rows_of: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
    """Documents (path, content) to stored rows in one step: parsed, numbered by their path, audited and published."""
    return publish(with_ids(rows_of(files), writer, batch, "file_path"), root, table, f"{writer}-{batch}")
