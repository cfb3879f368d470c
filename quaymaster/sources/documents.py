"""Application documents: mails and text files become typed application rows.

Only decoding runs in Python, on Arrow batches of file contents; labels, dates and numbers are Column
expressions.  Batch reads and the landing stream share ``parse_mails``.
"""

from __future__ import annotations

import email
import email.policy
import email.utils
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from . import pdf

_CELL = "array<struct<pos: int, label: string, value: string>>"
_MAIL = f"subject string, sender string, received_at timestamp_ntz, raw_text string, cells {_CELL}, is_html boolean"
_CELL_ARROW = pa.list_(pa.struct([("pos", pa.int32()), ("label", pa.string()), ("value", pa.string())]))


# Elements whose strings are no text of the page.
_NO_TEXT = frozenset(("script", "style", "template", "rt", "rp"))


class _Tables(HTMLParser):
    """All strings of a page, and the rows of its tables; rows of a nested table count for the outer one too."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.strings: list[str] = []
        self.tables: list[list[list[list[str]]]] = []  # finished or open, in order of their start
        self.open: list[tuple[str, list]] = []  # (tag, what its strings or children go to)
        self.hidden: list[str] = []  # open elements without text

    def _end(self, tag: str, within: str) -> None:
        """Close ``tag`` and what is open inside it, up to the nearest ``within``."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == within:
                return
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _NO_TEXT:
            self.hidden.append(tag)
        elif tag == "table":
            self.tables.append([])
            self.open.append(("table", self.tables[-1]))
        elif tag == "tr":
            row: list[list[str]] = []
            for kind, target in self.open:
                if kind == "table":
                    target.append(row)
            self.open.append(("tr", row))
        elif tag in ("td", "th"):
            cell: list[str] = []
            for kind, target in self.open:
                if kind == "tr":
                    target.append(cell)
            self.open.append((tag, cell))

    def handle_endtag(self, tag: str) -> None:
        if tag in self.hidden:
            del self.hidden[len(self.hidden) - 1 - self.hidden[::-1].index(tag) :]
        if tag in ("table", "tr", "td", "th"):
            self._end(tag, "" if tag == "table" else "table")

    def handle_data(self, data: str) -> None:
        data = data.strip()
        if data and not self.hidden:
            self.strings.append(data)
            for kind, target in self.open:
                if kind in ("td", "th"):
                    target.append(data)


def table_cells(html: str) -> tuple[str, list[dict]]:
    """A page's text, and (pos, label, value) of its table rows: the last two filled cells of a row."""
    page = _Tables()
    page.feed(html)
    page.close()
    cells = []
    for table in page.tables:
        for row in table:
            filled = [c for c in (" ".join(" ".join(cell).split()) for cell in row) if c]
            if len(filled) >= 2 and not filled[-2].isdigit():
                cells.append({"pos": len(cells), "label": filled[-2], "value": filled[-1]})
    return "\n".join(page.strings), cells


def decode_mail(content: bytes) -> dict:
    message = email.message_from_bytes(content, policy=email.policy.default)
    html = text = None
    for part in message.walk():
        kind = part.get_content_type()
        if kind in ("text/html", "text/plain") and not part.is_multipart():
            try:
                found = part.get_content()
            except Exception:  # an unknown charset or a broken body leaves the part out
                continue
            if kind == "text/html":
                html = found if html is None else html
            else:
                text = found if text is None else text
    received = None
    if message.get("date"):
        try:
            received = email.utils.parsedate_to_datetime(str(message["date"])).replace(tzinfo=None)
        except (TypeError, ValueError):
            received = None
    raw, cells = table_cells(html) if html else (text or "", [])
    header = lambda name: str(message[name]) if message[name] is not None else None
    return {"subject": header("subject"), "sender": header("from"), "received_at": received, "raw_text": raw, "cells": cells, "is_html": bool(html)}


def decode_mails(files: DataFrame) -> DataFrame:
    """path and the decoded mail of rows (path, content)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mails = [decode_mail(c or b"") for c in batch.column(1).to_pylist()]
            kinds = {"subject": pa.string(), "sender": pa.string(), "received_at": pa.timestamp("us"), "raw_text": pa.string(), "cells": _CELL_ARROW, "is_html": pa.bool_()}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([m[k] for m in mails], kind) for k, kind in kinds.items())], names=["path", *kinds])

    return files.select("path", "content").mapInArrow(decode, f"path string, {_MAIL}")


def spread(files: DataFrame) -> DataFrame:
    """``files`` dealt over all cores, for inputs that come in few large partitions; folders of files need none of it."""
    return files.repartition(files.sparkSession.sparkContext.defaultParallelism)


def html_fields(df: DataFrame, html_col: str, key_col: str) -> DataFrame:
    """key and cells of a column of HTML."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([table_cells(h or "")[1] for h in batch.column(1).to_pylist()], _CELL_ARROW)], names=[key_col, "cells"])

    kind = df.schema[key_col].dataType.simpleString()
    return df.select(key_col, html_col).mapInArrow(find, f"`{key_col}` {kind}, cells {_CELL}")


def application_row(mails: DataFrame) -> DataFrame:
    """Typed application rows of decoded documents, as an upload stores them; one without a text (a damaged file) has status error."""
    mails = t.with_text_cells(mails, F.when(~F.col("is_html"), F.col("raw_text")), "_text_cells")
    cells = F.when(F.col("is_html"), F.col("cells")).otherwise(F.col("_text_cells").cast(_CELL))
    return t.with_fields(mails, cells).select(
        F.when(F.col("raw_text").isNull(), "error").otherwise("needs_review").alias("status"), F.lit("upload").alias("source"), "sender", "subject", "received_at",
        t.detect_direction(F.col("raw_text"), F.col("subject")).alias("direction"), *t.FIELDS,
        F.lit(None).cast("string").alias("tugs_text"), F.lit(None).cast("string").alias("agent"), "raw_text", F.col("path").alias("file_path"),
    )


def is_pdf(path: Column) -> Column:
    return F.lower(path).endswith(".pdf")


def parse_documents(files: DataFrame, pdf_text: Callable[[bytes], str] = pdf.text) -> DataFrame:
    """Application rows of (path, content): ``.pdf`` by ``pdf_text``, all others as mails.

    ``pdf_text`` turns a file into its pages' text joined by newlines; a file for which it raises ``ValueError`` is a row with status error.
    """

    def text_of(content: bytes | None) -> str | None:
        try:
            return pdf_text(content or b"")
        except ValueError:
            return None

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of(c) for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["path", "raw_text"])

    mails = decode_mails(files.where(~is_pdf(F.col("path"))))
    pdfs = files.where(is_pdf(F.col("path"))).select("path", "content").mapInArrow(pages, "path string, raw_text string")
    empty = {"subject": "string", "sender": "string", "received_at": "timestamp_ntz", "cells": _CELL}
    pdfs = pdfs.withColumns({n: F.lit(None).cast(k) for n, k in empty.items()}).withColumn("is_html", F.lit(False))
    return application_row(mails.unionByName(pdfs))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def voucher_uploads(files: DataFrame) -> DataFrame:
    """Voucher rows of scanned files: stored, not read (recognition is not part of the engine)."""
    return files.select(F.lit("needs_review").alias("status"), F.col("path").alias("file_path"))


VOUCHER_FIELDS = "number string, tug_name string, vessel_name string, agent string, work_type string, left_base_dt timestamp_ntz, arrived_base_dt timestamp_ntz, started_dt timestamp_ntz, finished_dt timestamp_ntz, remarks string, joint_with string"


def parse_vouchers(files: DataFrame) -> DataFrame:
    """The stub of voucher recognition: every field is null."""
    columns = [c.strip().split(" ") for c in VOUCHER_FIELDS.split(",")]
    return files.select("path", *[F.lit(None).cast(kind).alias(name) for name, kind in columns])
