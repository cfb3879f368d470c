"""Sharding by sampled splitters, in DataFrame operations only.

Keys are drawn with a chance proportional to their size; quantiles of the sample become the
boundaries of many more ranges than there are shards.  Exact bytes of every range follow, and ranges
that one key overfills are subdivided: such a key gets cells of its own, dealt by a salt.  Runs of
cells with near-equal bytes become shards.  Rows with equal keys stay in one cell, and so in one
shard, unless their key alone outgrows a range.

Edge cases: a null text has size 1 and the checksum of no bytes; repeated rows and ids each get a
slot of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

#: Ranges at least and at most, and rows per range between; samples per range.
MIN_RANGES, MAX_RANGES, RANGE_ROWS, SAMPLES = 4096, 32768, 500_000, 16
_BIN = 54  # keys are hashes: their ten highest bits make even bins for looking up a range


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard and slot (gapless in its shard) of every row, shards near equal in bytes."""
    text = F.col(text_col)
    slim = staged(
        docs.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
            F.xxhash64(F.col(id_col), F.monotonically_increasing_id()).alias("salt"),
        ),
        "shard-slim",
    )
    total = slim.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).first()
    rows, size = total["n"], total["bytes"] or 1
    ranges = max(MIN_RANGES, min(MAX_RANGES, rows // RANGE_ROWS))

    drawn = slim.where((F.shiftrightunsigned("salt", 11) / float(1 << 53)) < F.col("size") * (ranges * SAMPLES / size))
    quantiles = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = drawn.agg(F.array_sort(F.array_distinct(F.percentile_approx("key", quantiles, 8 * ranges))).alias("cuts"))
    low, high = -(1 << 63), (1 << 63) - 1
    bounds = cuts.select(F.concat(F.array(F.lit(low)), F.coalesce("cuts", F.array().cast("array<bigint>"))).alias("lo"), F.concat(F.coalesce("cuts", F.array().cast("array<bigint>")), F.array(F.lit(high))).alias("hi"))
    spans = bounds.select(F.posexplode(F.arrays_zip("lo", "hi")).alias("range_id", "s")).select("range_id", "s.lo", "s.hi")
    spans = staged(spans.where("lo < hi or lo = hi"), "shard-spans")
    binned = spans.select("range_id", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", _BIN), F.shiftright("hi", _BIN))).alias("bin"))
    placed = slim.withColumn("bin", F.shiftright("key", _BIN)).join(
        F.broadcast(binned), "bin"  # at most MAX_RANGES and 1,024 rows
    ).where((F.col("key") >= F.col("lo")) & ((F.col("key") < F.col("hi")) | (F.col("hi") == high))).select("id", "size", "text_crc32", "key", "salt", "range_id")

    target = max(1, size // ranges)
    full = placed.groupBy("range_id").agg(F.sum("size").alias("b")).where(F.col("b") > 2 * target).select("range_id")
    hot = placed.join(F.broadcast(full), "range_id", "left_semi").groupBy("key").agg(F.sum("size").alias("b")).where(F.col("b") > target)
    hot = staged(hot.select("key", F.ceil(F.col("b") / target).cast("int").alias("parts")), "shard-hot")  # at most as many keys as ranges
    cells = placed.join(F.broadcast(hot), "key", "left").select(
        "id", "size", "text_crc32", "key", "range_id",
        F.when(F.col("parts").isNotNull(), F.col("key")).otherwise(F.lit(low)).alias("hot_key"),
        F.coalesce(F.pmod("salt", "parts"), F.lit(0)).cast("int").alias("part"),
    )
    cell = ["range_id", "hot_key", "part"]
    stats = cells.groupBy(*cell).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    in_order = Window.orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)  # over cells, of which there are a bounded number
    stats = stats.withColumn("before", F.coalesce(F.sum("b").over(in_order), F.lit(0)))
    middle = (F.col("before") + F.col("b") / 2) * n_shards / size
    stats = stats.withColumn("shard", F.least(F.floor(middle), F.lit(n_shards - 1)).cast("int"))
    in_shard = Window.partitionBy("shard").orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.select(*cell, "shard", F.coalesce(F.sum("n").over(in_shard), F.lit(0)).alias("first_slot"))
    ranked = cells.withColumn("rank", F.row_number().over(Window.partitionBy(*cell).orderBy("key", "id", "size")) - 1)
    return ranked.join(F.broadcast(staged(stats, "shard-cells")), cell).select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("first_slot") + F.col("rank")).cast("long").alias("slot")
    )
