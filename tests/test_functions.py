from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaymaster.functions import text as t


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("03.11.2031 в 17:25", datetime(2031, 11, 3, 17, 25)), ("03.11.2031  7:05", datetime(2031, 11, 3, 7, 5)), ("31.02.2031 10:00", None), ("20.13.2031 10:00", None), ("нет", None), ("", None), (None, None)],
)
def test_parse_date_time(spark, raw, want):
    assert one(spark, raw, t.parse_date_time) == want


@pytest.mark.parametrize(("raw", "want"), [("615 / 90", (615, 90)), ("12 615 / 7 090", (12615, 7090)), ("615.5/90", (5, 90)), ("GRT 77", (77, None)), ("нет", (None, None))])
def test_int_pair(spark, raw, want):
    assert tuple(one(spark, raw, t.int_pair)) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [(None, None), ("", None), ("  ", ""), ("Швартовка", "швартовка"), ("отшвартовка", "отшвартовка"), ("отшвартовка судна", "швартовка"), ("перешвартовка", "перестановка"), ("перешвартовка судна", "швартовка"), (" вход ", "швартовка"), ("выход в море", "отшвартовка"), ("буксировка", "буксировка")],
)
def test_normalize_work_type(spark, raw, want):
    assert one(spark, raw, t.normalize_work_type) == want


@pytest.mark.parametrize(("raw", "want"), [(None, 1), ("", 1), ("  ", 1), ("БК Пионер", 2), ("БК Пионер, БК Коммунар", 3), ("Пионер и Коммунар", 3), ("Пионер+Коммунар/Азов;", 4), ("Илия", 2)])
def test_tug_count(spark, raw, want):
    assert one(spark, raw, t.tug_count) == want


@pytest.mark.parametrize(("minutes", "want"), [(70, "01:10"), (0, "00:00"), (6185, "103:05")])
def test_format_hm(spark, minutes, want):
    assert one(spark, minutes, t.format_hm, "bigint") == want


def test_minutes_between(spark):
    df = spark.sql("SELECT timestamp_ntz'2026-07-16 08:00:00' a, timestamp_ntz'2026-07-16 11:50:59' b")
    got = df.select(t.minutes_between(F.col("a"), F.col("b")), t.minutes_between(F.col("b"), F.col("a")), t.minutes_between(F.lit(None).cast("timestamp_ntz"), F.col("a"))).first()
    assert tuple(got) == (230, 0, 0)


@pytest.mark.parametrize(("text", "subject", "want"), [("ЗАЯВКА НА ВХОД", None, "вход"), ("готов, выход завтра", None, "выход"), ("выходной", None, "прочее"), ("выход", "на вход", "вход"), ("", None, "прочее"), (None, None, "прочее"), ("x" * 400 + " вход", None, "прочее")])
def test_detect_direction(spark, text, subject, want):
    df = spark.createDataFrame([(text, subject)], "t string, s string")
    assert df.select(t.detect_direction(F.col("t"), F.col("s"))).first()[0] == want


def test_norm_name(spark):
    assert one(spark, "M/V «Мария-2» ", t.norm_name) == "mvмария2"
    assert one(spark, None, t.norm_name) == ""


def test_forms(spark):
    assert one(spark, "2026-07-20T04:05", t.form_date_time) == datetime(2026, 7, 20, 4, 5)
    assert one(spark, "20.07.2026 04:05", t.form_date_time) == datetime(2026, 7, 20, 4, 5)
    assert one(spark, "2026-07-20 04:05", t.form_date_time) is None
    assert [one(spark, x, t.form_int) for x in (" 12 ", "1.5", "", None)] == [12, None, None, None]
    assert [one(spark, x, t.form_decimal) for x in ("1,5", "1.5d", " 2 ", "", "x")] == [1.5, None, 2.0, None, None]
    assert [one(spark, x, t.checkbox) for x in ("on", "", None)] == [True, False, False]


def test_text_fields_and_last_wins(spark):
    text = "Просим принять\n\nНазвание судна\n  LADOGA  QUAY\n№ ИМО : 70 15\r\nБрутто/нетто 615 / 90\nДата/время входа 03.11.2031 в 17:25"
    got = t.with_fields(t.with_text_cells(spark.createDataFrame([(text,)], "x string"), F.col("x")), F.col("cells")).first()
    assert (got["vessel_name"], got["imo"], got["gross_tonnage"], got["net_tonnage"]) == ("LADOGA QUAY", ":7015", 615, 90)
    assert got["entry_datetime"] == datetime(2031, 11, 3, 17, 25) and got["exit_datetime"] is None
    cells = "array(named_struct('pos', 0, 'label', 'Дата входа', 'value', '20.07.2026 04:00'), named_struct('pos', 1, 'label', 'Стоимость', 'value', '1 2'), named_struct('pos', 2, 'label', 'Порт входа', 'value', 'x'), named_struct('pos', 3, 'label', 'Стоимость', 'value', '3 4'))"
    got = t.with_fields(spark.range(1), F.expr(cells)).first()
    assert got["entry_datetime"] is None and got["imo"] == "34"


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(min_value=0, max_value=1e9, allow_nan=False), min_size=1, max_size=200))
def test_py_round_is_exact(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double").select("x", t.py_round(F.col("x"), 2).alias("y"), t.py_round(F.col("x"), 4).alias("z"))
    for r in df.collect():
        assert r["y"] == round(r["x"], 2) and r["z"] == round(r["x"], 4)


def test_settings_from_session_and_environment(spark, monkeypatch):
    from quaymaster.dims import Settings

    assert Settings.from_conf(spark) == Settings()
    monkeypatch.setenv("QUAYMASTER_NIGHT_START_HOUR", "21")
    monkeypatch.setenv("QUAYMASTER_DATA_DIR", "/shared/port")
    got = Settings.from_conf(spark)
    assert (got.night_start_hour, got.night_end_hour, got.applications_dir) == (21, 6, "/shared/port/incoming/applications")
    spark.conf.set("spark.quaymaster.night_start_hour", "20")
    try:
        assert Settings.from_conf(spark).night_start_hour == 20
    finally:
        spark.conf.unset("spark.quaymaster.night_start_hour")
