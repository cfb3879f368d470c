from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quaymaster import dims, schemas
from quaymaster.operators import export, state, views
from quaymaster.sources import documents, forms, rates, reference, xlsx
from quaymaster.streaming import landing

HTML = """<html><head><style>td { content: "на выход" }</style><script>var s = "<p>выход</p>";</script></head><body><h2>Просим принять на вход</h2>
<table><tr><th>Поле</th><th>Значение</th></tr><tr><td>Пункт назначения</td><td></td></tr><tr><td>а)</td><td>Брутто/нетто</td><td> 312 /  90 </td></tr>
<tr><td>Название судна</td><td>ARCTIC TERN</td></tr><tr><td></td><td>Пункт назначения</td><td>Причал  14</td></tr><tr><td>7</td><td>8</td></tr>
<tr><td>Дата/время входа</td><td>03.02.2027 в 23:45</td></tr><tr><td>№ ИМО</td><td>91 234 56<template>7</template></td></tr></table></body></html>"""
MAIL = f"From: a@example.com\r\nSubject: Request\r\nDate: Tue, 2 Feb 2027 08:30:00 +0200\r\nMIME-Version: 1.0\r\nContent-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n{HTML}".encode()
TEXT_MAIL = "Subject: выход\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\nНазвание судна ALPHA\nБрутто/нетто 10\n".encode()


def test_html_tables():
    text, cells = documents.table_cells(HTML)
    assert text.startswith("Просим принять на вход\nПоле\n") and "выход" not in text
    assert [(c["label"], c["value"]) for c in cells] == [("Поле", "Значение"), ("Брутто/нетто", "312 / 90"), ("Название судна", "ARCTIC TERN"), ("Пункт назначения", "Причал 14"), ("Дата/время входа", "03.02.2027 в 23:45"), ("№ ИМО", "91 234 56")]
    _, nested = documents.table_cells("<table><tr><td>a</td><td>b<table><tr><td>c</td><td>d</td></tr></table></td></tr></table>")
    assert [(c["label"], c["value"]) for c in nested] == [("c", "d"), ("c", "d"), ("c", "d")]  # the outer row holds the inner cells; both tables hold the inner row


def test_mail_and_dispatch(spark):
    files = spark.createDataFrame([("in/1.eml", bytearray(MAIL)), ("in/2.EML", bytearray(TEXT_MAIL)), ("in/3.PDF", bytearray(b"%PDF")), ("in/4", None)], "path string, content binary")
    got = {r["file_path"]: r for r in documents.parse_documents(files, lambda b: "Название судна BETA\nна выход").collect()}
    one = got["in/1.eml"]
    assert (one["vessel_name"], one["imo"], one["gross_tonnage"], one["net_tonnage"], one["direction"]) == ("ARCTIC TERN", "9123456", 312, 90, "вход")
    assert one["entry_datetime"] == datetime(2027, 2, 3, 23, 45) and one["received_at"] == datetime(2027, 2, 2, 8, 30) and one["destination"] == "Причал 14"
    assert (got["in/2.EML"]["vessel_name"], got["in/2.EML"]["direction"]) == ("ALPHA", "выход")
    assert (got["in/3.PDF"]["vessel_name"], got["in/3.PDF"]["direction"]) == ("BETA", "выход")
    assert got["in/4"]["vessel_name"] is None
    assert documents.parse_vouchers(files).where("number is not null").count() == 0
    assert {(x["status"], x["file_path"]) for x in documents.voucher_uploads(files).collect()} == {("needs_review", p) for p in got}
    assert documents.parse_documents(files.where("path like '%eml'")).count() == 1
    damaged = documents.parse_documents(files).where("file_path = 'in/3.PDF'").first()
    assert (damaged["status"], damaged["raw_text"], damaged["vessel_name"]) == ("error", None, None)


def test_landing_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.eml").write_bytes(MAIL)
    query = landing.append_to(landing.landed_applications(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    assert [r["vessel_name"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["ARCTIC TERN"]


def test_names_of_landed_files(spark):
    files = spark.createDataFrame([("a.eml", bytearray(b"1"), 1), ("x/a.eml", bytearray(b"2"), 2), (None, bytearray(b"3"), 1), ("", bytearray(b"4"), 2)], "name string, content binary, version int")
    assert {r["path"]: bytes(r["content"]) for r in landing.land(files, "in/").collect()} == {"in/a.eml": b"2", "in/upload.bin": b"4"}


def test_rates_and_calendar(spark, tmp_path):
    xml = '<?xml version="1.0" encoding="windows-1251"?><ValCurs><Valute><CharCode>USD</CharCode><Nominal>1</Nominal><Name>Доллар</Name><Value>78,3987</Value></Valute><Valute><CharCode>JPY</CharCode><Nominal>100</Nominal><Value>1 050,5</Value></Valute></ValCurs>'
    (tmp_path / "r.xml").write_bytes(xml.encode("windows-1251"))
    got = {r["char_code"]: r["rate"] for r in rates.read_rates(spark, str(tmp_path / "r.xml"), "2026-07-20").collect()}
    assert got == {"USD": 78.3987, "JPY": 1050.5 / 100}
    (tmp_path / "many").mkdir()
    for day in ("2026-07-20", "2026-07-21"):
        (tmp_path / f"many/daily-{day}.xml").write_bytes(xml.encode("windows-1251"))
    many = rates.read_rates(spark, str(tmp_path / "many"))
    assert sorted(str(r["rate_date"]) for r in many.where("char_code = 'USD'").collect()) == ["2026-07-20", "2026-07-21"]
    (tmp_path / "c.txt").write_text("20260720 1\nbad\n20260721 0\n")
    assert sorted((str(r["day"]), r["is_day_off"]) for r in rates.read_calendar(spark, str(tmp_path / "c.txt")).collect()) == [("2026-07-20", True), ("2026-07-21", False)]


def test_workbook_round_trip_and_import(spark):
    data = xlsx.write_sheet("Буксиры", ["Код", "Название"], [["k", " БК <Азов> "], [1, None], [2.5, "БК Пионер"]])
    assert xlsx.read_sheets(data)["Буксиры"][1:] == [["k", " БК <Азов> "], [1], [2.5, "БК Пионер"]]
    tugs, agents = spark.createDataFrame([("БК Пионер",)], "name string"), spark.createDataFrame([("x",)], "name string")
    new = reference.import_workbook(spark, data, tugs, agents)
    assert [r["name"] for r in new["tugs"].collect()] == ["БК <Азов>"] and new["agents"].count() == 0
    first, second = reference.seed(spark, tugs, agents)
    assert [r["code"] for r in first.collect()] == ["k"] and second.count() == 3


def test_start_append_and_import(spark, tmp_path):
    settings, root = dims.Settings(data_dir=str(tmp_path)), f"{tmp_path}/tables"
    for _ in range(2):
        reference.start(spark, settings)
    table = lambda name: schemas.read(spark, root, name)
    assert table("tugs").count() == 2 and table("agents").count() == 3
    data = xlsx.write_sheet("Агенты", ["Название"], [["A"], ["A"], ["МореСервис"]])
    assert reference.import_into(spark, data, root) == {"tugs": 0, "agents": 1} and table("agents").count() == 4
    files = spark.createDataFrame([(f"in/{i}.eml", bytearray(MAIL)) for i in range(5)], "path string, content binary")
    for _ in range(2):
        state.append(documents.parse_documents(files), root, "applications")
    rows = table("applications").collect()
    assert len({r["id"] for r in rows}) == 10 and all(r["created_at"] is not None and r["status"] == "needs_review" for r in rows)
    assert dims.Settings.from_conf(spark).gross_tonnage_threshold == 2000 and settings.vouchers_dir.endswith("/incoming/vouchers")


def test_voucher_form(spark):
    fields = ["voucher_id", "number", "tug_id", "vessel_name", "agent", "work_type", "left_base_dt", "arrived_base_dt", "started_dt", "finished_dt", "remarks", "joint_with", "is_ice", "escort_hours"]
    rows = spark.createDataFrame([("7", " V1 ", " 2 ", "", "A", "x", "2026-07-20T08:15", "20.07.2026 09:30", "bad", "", "", "t", "on", "1,5"), ("", *[""] * 13)], ", ".join(f"{f} string" for f in fields))
    one, two = forms.voucher_forms(rows).orderBy(F.desc_nulls_last("id")).collect()
    assert (one["id"], one["number"], one["tug_id"], one["vessel_name"], one["is_ice"], one["escort_hours"]) == (7, " V1 ", 2, None, True, 1.5)
    assert (one["left_base_dt"], one["arrived_base_dt"], one["started_dt"]) == (datetime(2026, 7, 20, 8, 15), datetime(2026, 7, 20, 9, 30), None)
    assert two["id"] is None and two["status"] == "confirmed" and two["is_ice"] is False


def _tables(spark):
    works = schemas.empty(spark, "works").unionByName(
        spark.createDataFrame([(7, "calculated", 1, 2, 1, "A", None, "X", None, None, datetime(2026, 7, 20, 6), datetime(2026, 7, 20, 7, 10), 0, 4223.0, "USD", 78.4, 12345678.9, 'q"x, y', False, None, None), (3, "matched", None, None, None, *[None] * 16)], schemas.SCHEMAS["works"])
    )
    vouchers = spark.createDataFrame([(2, "V2", "b.pdf")], "id bigint, number string, file_path string")
    return works, spark.createDataFrame([(1, "БК", "k")], schemas.SCHEMAS["tugs"]), vouchers, spark.createDataFrame([(1, "a.eml")], "id bigint, file_path string")


def test_export(spark, tmp_path):
    frame = export.works_frame(*_tables(spark))
    assert frame.columns == export.COLUMNS
    text = export.csv_bytes(frame)
    assert text.startswith(b"\xef\xbb\xbf#,")
    lines = text.decode("utf-8-sig").splitlines()
    assert lines[1].startswith("1,,,,,,,,00:00,,,00:00,") and '"q""x, y"' in lines[2] and "4223.0,USD,78.4,12345678.9" in lines[2] and "01:10" in lines[2] and "a.eml,b.pdf,," in lines[2]
    sheet = xlsx.read_sheets(export.xlsx_bytes(frame))[export.SHEET]
    assert sheet[0] == export.COLUMNS and sheet[2][16:] == [4223.0, "USD", 78.4, 12345678.9]
    export.write_csv(frame, str(tmp_path / "csv"))
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "csv").glob("part-*")))
    assert whole == text  # the parts in order are the download


def test_views(spark):
    works, tugs, _, _ = _tables(spark)
    rows = views.works_list(works, tugs).collect()
    assert [r["id"] for r in rows] == [7, 3] and (rows[0]["tug"], rows[0]["grt"], rows[0]["amount"], rows[0]["started"]) == ("БК", "—", "4223.00", "20.07 06:00")
    assert (rows[1]["tug"], rows[1]["amount"], rows[1]["note"]) == ("—", "—", "")
    assert tuple(views.dashboard(tugs, tugs.limit(0), works).first()) == (1, 0, 2)
