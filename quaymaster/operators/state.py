"""State changes as DataFrame functions: logs, upserts, insert-if-absent and key checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import storage
from ..functions import text as t
from ..schemas import FOREIGN_KEYS, SCHEMAS, read


def current_state(log: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """The latest row of every key of an append-only log; one aggregation with partial sums."""
    rest = [c for c in log.columns if c != key]
    latest = log.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("_row"))
    return latest.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*log.columns)


def upsert(rows: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` with the columns of ``changes`` replaced for equal keys; unknown keys change nothing, null keys are inserted with null."""
    columns = [c for c in changes.columns if c != key]
    new = changes.where(F.col(key).isNotNull()).select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns])
    merged = rows.join(new, key, "left").withColumns({c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).select(*rows.columns)
    inserted = changes.where(F.col(key).isNull())
    return merged.unionByName(inserted, allowMissingColumns=True)


def insert_if_absent(existing: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """Rows of ``new`` to insert: non-blank keys that ``existing`` lacks, each once."""
    return new.where(F.col(key).isNotNull() & (F.col(key) != "")).dropDuplicates([key]).join(existing.select(key), key, "left_anti").select(*new.columns)


def foreign_key_violations(child: DataFrame, column: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Rows of ``child`` whose non-null reference has no parent."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(parent_key).alias(column)), column, "left_anti")


def all_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """table, column, id and value of every violated reference of the domain tables."""
    out = None
    for table, column, parent in FOREIGN_KEYS:
        if table in tables and parent in tables:
            bad = foreign_key_violations(tables[table], column, tables[parent]).select(F.lit(table).alias("table"), F.lit(column).alias("column"), "id", F.col(column).alias("value"))
            out = bad if out is None else out.unionByName(bad)
    return out


def numbered(df: DataFrame, key: str = "id", name: str = "number", keys: DataFrame | None = None, bins: int = 128) -> DataFrame:
    """Rows numbered from 1 in the order of a numeric key, null keys last.

    Keys fall into bins between quantiles, so a skewed key makes even bins too; only the bins' counts meet
    in one task, rows are numbered within their bins.  ``keys`` holds the same keys from a cheaper plan.
    Nothing runs before the result does.
    """
    keys = df if keys is None else keys
    at, before, own = (t.unused(c, df) for c in ("_bin", "_before", "_own"))
    bounds = keys.agg(F.percentile_approx(key, [i / bins for i in range(1, bins)], 100 * bins).alias("_bounds"))
    bounds = bounds.select(F.array_distinct(F.coalesce("_bounds", F.array())).alias("_bounds"))

    def binned(rows: DataFrame) -> DataFrame:
        place = F.size(F.filter("_bounds", lambda b: b < F.col(key)))
        return rows.withColumn("_bounds", bounds.scalar()).withColumn(at, F.when(F.col(key).isNull(), bins).otherwise(place)).drop("_bounds")

    counts = binned(keys.select(key)).groupBy(at).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(at, F.coalesce(F.sum("_n").over(Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    rows = binned(df).withColumn(own, F.row_number().over(Window.partitionBy(at).orderBy(key)))
    return rows.join(F.broadcast(counts), at, "left").withColumn(name, F.col(before) + F.col(own)).drop(at, before, own)


def append(rows: DataFrame, root: str, table: str) -> int:
    """Append ``rows`` to a stored domain table: ids above the largest one there, the UTC time as created_at, null for columns that are missing.

    Gives the number of rows, which is counted while they are written.  The rows are evaluated once and staged; their ids have no gaps, since the
    counts of partitions meet before them.  Ids of reserved blocks (``store.with_ids``) don't count.  One writer a table at a time.
    """
    from .store import FIRST_BLOCK

    spark, kinds = rows.sparkSession, [c.strip().split(" ") for c in SCHEMAS[table].split(",")]
    top = read(spark, root, table).where(F.col("id") < FIRST_BLOCK).agg(F.max("id")).first()[0] or 0
    at, first, before = (t.unused(c, rows) for c in ("_at", "_first", "_before"))
    rows = storage.staged(rows.withColumn(at, F.monotonically_increasing_id()), "append")
    counts = rows.groupBy(F.shiftright(at, 33).alias("_range")).agg(F.min(at).alias(first), F.count(F.lit(1)).alias("_n"))
    counts = counts.select("_range", first, F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))  # a row for each partition
    rows = rows.join(F.broadcast(counts), F.shiftright(at, 33) == F.col("_range"))
    new = {"id": F.col(before) + F.col(at) - F.col(first) + (top + 1), "created_at": F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")}
    value = {n: new[n] if n in new else F.col(f"`{n}`") if n in rows.columns else F.lit(None) for n, _ in kinds}
    seen = Observation(f"append-{uuid.uuid4().hex}")
    rows.select(*[value[n].cast(kind).alias(n) for n, kind in kinds]).observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(f"{root}/{table}")
    return int(seen.get["rows"])
