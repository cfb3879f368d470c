"""The 20-column export frame of works, and its CSV and XLSX sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources import xlsx
from .state import numbered

# The export's columns, in order.
COLUMNS = [
    "#", "Буксир", "Объект работ", "Вид работ", "Агент", "Нр. ваучера/наряда", "Выход из базы", "Приход в базу", "Время занятости", "Начало работ",
    "Завершение работ", "Время работ", "Примечания", "Заявка", "Ваучер", "Брутто/нетто", "Сумма", "Валюта", "Курс", "Выручка, руб",
]
SHEET = "Работы"


def works_frame(works: DataFrame, tugs: DataFrame, vouchers: DataFrame, applications: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The export's rows in id order; numbers stay numbers (null prints as blank).

    ``ids`` holds the works' ids from a cheaper plan, where ``works`` is a priced one.
    """
    w = numbered(works, "id", "_number", ids)
    w = w.join(vouchers.select(F.col("id").alias("voucher_id"), F.col("number").alias("_voucher_number"), F.col("file_path").alias("_voucher_file")), "voucher_id", "left")
    w = w.join(applications.select(F.col("id").alias("application_id"), F.col("file_path").alias("_application_file")), "application_id", "left")
    return numbered_frame(w, tugs)


def numbered_frame(works: DataFrame, tugs: DataFrame) -> DataFrame:
    """The export's rows of works that have their _number, _voucher_number, _voucher_file and _application_file already.

    Works that are still to be priced get these first, so that what is shuffled for them are narrow rows.
    """
    w = works.join(F.broadcast(tugs.select(F.col("id").alias("tug_id"), F.col("name").alias("_tug"))), "tug_id", "left")  # a fleet is small
    filled = lambda c: F.coalesce(F.col(c), F.lit(""))
    span = lambda a, b: t.format_hm(t.minutes_between(F.col(a), F.col(b)))
    values = [
        F.col("_number"), filled("_tug"), filled("object_name"), filled("work_type"), filled("agent"), filled("_voucher_number"),
        t.format_date_time(F.col("left_base_dt")), t.format_date_time(F.col("arrived_base_dt")), span("left_base_dt", "arrived_base_dt"),
        t.format_date_time(F.col("started_dt")), t.format_date_time(F.col("finished_dt")), span("started_dt", "finished_dt"), filled("calc_note"),
        filled("_application_file"), filled("_voucher_file"), F.nullif("gross_tonnage", F.lit(0)), F.col("amount"), filled("currency"), F.col("cbr_rate"), F.col("revenue_rub"),
    ]
    return w.select(*[v.alias(c) for v, c in zip(values, COLUMNS, strict=True)])


def _plain(x: str) -> F.Column:
    """A double as the shortest decimal text, never with an exponent."""
    c = F.col(f"`{x}`")
    text = F.regexp_replace(F.call_function("format_number", c, F.lit("0.0##############")), r"(\.\d+?)0+$", "$1")
    return F.coalesce(text, F.lit(""))


def csv_frame(frame: DataFrame) -> DataFrame:
    """All columns as text, as the CSV sink prints them."""
    doubles = {"Сумма", "Курс", "Выручка, руб"}
    return frame.select(*[(_plain(c) if c in doubles else F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(c) for c in frame.columns])


def write_csv(frame: DataFrame, path: str) -> None:
    """One CSV in part files: put together in the order of their names they are the file.

    UTF-8 with one byte-order mark and one header, both in the first part; the rows are in order of their number,
    and no task holds more than its part.
    """
    def quoted(c: str) -> F.Column:
        x = F.col(f"`{c}`")
        return F.when(x.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)

    lines = csv_frame(frame).select(F.col("`#`").cast("long").alias("at"), F.concat_ws(",", *[quoted(c) for c in frame.columns]).alias("value"))
    names = ",".join(f'"{c}"' if "," in c else c for c in frame.columns)
    head = frame.sparkSession.createDataFrame([(0, "\ufeff" + names)], lines.schema)
    lines.unionByName(head).repartitionByRange("at").sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)


def xlsx_bytes(frame: DataFrame) -> bytes:
    """One sheet; a workbook is a file of at most 1,048,576 rows, so the rows do go to the driver."""
    rows = frame.orderBy("#").limit(xlsx.MAX_ROWS).collect()
    if len(rows) >= xlsx.MAX_ROWS:
        raise ValueError(f"a sheet holds {xlsx.MAX_ROWS - 1} rows under its header; use the CSV sink")
    return xlsx.write_sheet(SHEET, frame.columns, [list(r) for r in rows])


def csv_bytes(frame: DataFrame) -> bytes:
    """The whole CSV as one byte string, for a download; bounded like a workbook."""
    import csv
    import io

    rows = csv_frame(frame).orderBy(F.col("`#`").cast("long")).limit(xlsx.MAX_ROWS).collect()
    if len(rows) >= xlsx.MAX_ROWS:
        raise ValueError("too many rows for one download; use write_csv")
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(frame.columns)
    writer.writerows(list(r) for r in rows)
    return out.getvalue().encode("utf-8-sig")
