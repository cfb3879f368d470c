"""Landing folders as streams that end in stored rows.

``store_applications`` and ``store_vouchers`` parse what arrives and publish each micro-batch as a batch of its domain table: ids come from
a block that belongs to the batch, so a batch that is run again after a failure replaces itself, row by row with the same ids.  ``current_uploads``
lets the latest upload of a name win over all batches.  Parsing keeps no state, so only that one has any.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import store
from ..sources import pdf
from ..sources.documents import application_row, decode_mails, parse_documents, voucher_uploads

UNNAMED = "upload.bin"
_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def landed_files(spark: SparkSession, path: str, files_per_batch: int = 1000, pattern: str = "*") -> DataFrame:
    return spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).load(path)


def landed_applications(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Application rows of mails as they arrive in ``path``."""
    return application_row(decode_mails(landed_files(spark, path, files_per_batch, "*.eml")))


def _path(name: F.Column, folder: str) -> F.Column:
    """Where a file of that name lands: the last part of the name, ``upload.bin`` without one."""
    base = F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/\\]*)$", 1)
    return F.concat(F.lit(folder.rstrip("/") + "/"), F.when(base == "", UNNAMED).otherwise(base))


def land(files: DataFrame, folder: str) -> DataFrame:
    """Files (name, content) with the path that they land under.

    Of equal names the row of the largest ``version`` stays, as a later upload overwrites an earlier one.
    """
    named = files.withColumn("path", _path(F.col("name"), folder))
    return named.groupBy("path").agg(F.max_by("content", "version").alias("content"))


def append_to(rows: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append all files that are there now, then stop."""
    return rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _stored(files: DataFrame, root: str, table: str, checkpoint: str, rows_of: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    writer = store.claim_writer(files.sparkSession, root, table, checkpoint)

    def publish(batch: DataFrame, batch_id: int) -> None:
        store.upload(batch.select("path", "content"), root, table, writer, batch_id, rows_of)

    return files.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def store_applications(spark: SparkSession, path: str, root: str, checkpoint: str, files_per_batch: int = 1000, pdf_text: Callable[[bytes], str] = pdf.text) -> StreamingQuery:
    """Store all documents that are in ``path`` now and weren't before as applications, then stop."""
    return _stored(landed_files(spark, path, files_per_batch), root, "applications", checkpoint, lambda files: parse_documents(files, pdf_text))


def store_vouchers(spark: SparkSession, path: str, root: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Store all scans that are in ``path`` now and weren't before as vouchers to be reviewed, then stop."""
    return _stored(landed_files(spark, path, files_per_batch), root, "vouchers", checkpoint, voucher_uploads)


def latest_uploads(uploads: DataFrame, folder: str) -> DataFrame:
    """path, version and location of the latest of a stream of uploads (name, version, location), over all batches.

    The state is one row a path: where the content lies, not the content.  For output mode update: a batch gives
    the rows of its own paths, and of an older version that comes late the latest one again.
    """
    named = uploads.withColumn("path", _path(F.col("name"), folder))
    return named.groupBy("path").agg(F.max(F.struct("version", "location")).alias("_latest")).select("path", "_latest.version", "_latest.location")


def current_uploads(uploads: DataFrame, folder: str, table: str, checkpoint: str, parts: int = 64) -> StreamingQuery:
    """Keep ``table`` (path, version, location) at the latest upload of every name, with all uploads that are there now; then stop."""
    def merge(batch: DataFrame, _: int) -> None:
        store.merge_changes(batch, table, "path", "version", parts)

    return latest_uploads(uploads, folder).writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
