from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from quaymaster import schemas
from quaymaster.operators.pricing import price_works, recalculate, recalculate_stored

WORKS = "id bigint, agent string, work_type string, gross_tonnage int, started_dt timestamp_ntz, finished_dt timestamp_ntz, left_base_dt timestamp_ntz, arrived_base_dt timestamp_ntz, is_ice boolean, escort_hours double, tug_count int"
RATE = 78.3987
T = "Транс-Агро"


def price(spark, agent=T, work_type="швартовка", grt=None, start=datetime(2026, 7, 20, 6), end=datetime(2026, 7, 20, 6, 50), ice=False, escort=None, tugs=1, rate=RATE, off=False):
    works = spark.createDataFrame([(1, agent, work_type, grt, start, end, start, end, ice, escort, tugs)], WORKS)
    days = [date(2026, 7, d) for d in range(1, 32)]
    fx = spark.createDataFrame([(d, "USD", rate) for d in days] if rate else [], "rate_date date, char_code string, rate double")
    calendar = spark.createDataFrame([(d, off) for d in days], "day date, is_day_off boolean")
    return price_works(works, fx, calendar).first()


def test_per_hour(spark):
    r = price(spark, work_type="обслуживание морских сооружений", start=datetime(2026, 7, 17, 10, 10), end=datetime(2026, 7, 17, 11, 20))
    assert (r["amount"], r["currency"], r["work_minutes"]) == (688.33, "USD", 70)
    assert r["calc_note"] == "590.00 USD x 01:10 = 688.33"


def test_per_ton_and_revenue(spark):
    r = price(spark, grt=8446)
    assert r["amount"] == 4223.00 and r["cbr_rate"] == RATE and r["revenue_rub"] == round(4223.00 * RATE, 2)
    assert r["calc_note"] == "8446 x 0.50 USD = 4223.00"


def test_rubles(spark):
    r = price(spark, agent="МореСервис", work_type="отшвартовка", start=datetime(2026, 7, 16, 8), end=datetime(2026, 7, 16, 11, 50))
    assert (r["amount"], r["currency"], r["cbr_rate"], r["revenue_rub"]) == (245333.33, "RUB", 1.0, 245333.33)


def test_escort(spark):
    r = price(spark, work_type="отшвартовка", grt=24199, escort=1.0)
    assert r["amount"] == round(24199 * 0.50 + 1508, 2) and r["calc_note"].endswith("; Сопровождение: 01:00 x 1508.00 = 1508.00")


def test_shared_tugs(spark):
    r = price(spark, grt=8446, tugs=2)
    assert r["amount"] == 2111.50 and "/ 2 букс." in r["calc_note"]


@pytest.mark.parametrize(
    ("hour", "off", "ice", "amount", "label"),
    [(12, False, False, 1000.0, "будни"), (12, True, False, 1500.0, "праздник/ночь"), (23, False, False, 1500.0, "праздник/ночь"), (5, False, True, 1800.0, "праздник/ночь (лёд)"), (12, False, True, 1200.0, "будни (лёд)")],
)
def test_per_operation(spark, hour, off, ice, amount, label):
    r = price(spark, grt=0, start=datetime(2026, 7, 20, hour), end=None, off=off, ice=ice)
    assert r["amount"] == amount and r["calc_note"] == f"швартовка <2000 GRT, {label}: {amount:.2f} USD за операцию"


def test_small_ship_without_operation_tariff_falls_through(spark):
    assert price(spark, work_type="околка льда", grt=100, ice=True)["calc_note"] == "200.00 USD x 00:50 (лёд) = 166.67"


@pytest.mark.parametrize(
    ("change", "error"),
    [
        ({"work_type": None}, "Не указан вид работ"),
        ({"work_type": "", "start": None, "end": None}, "Не указан вид работ"),
        ({"start": None, "end": None}, "Не указаны даты работ"),
        ({"agent": None}, "Нет тарифов для агента: "),
        ({"agent": "X"}, "Нет тарифов для агента: X"),
        ({"work_type": "  "}, "Нет тарифа для вида работ '' у агента 'Транс-Агро'"),
        ({"work_type": "буксировка"}, "Нет тарифа для вида работ 'буксировка' у агента 'Транс-Агро'"),
        ({}, "Для тарифа за тонну нужен GRT из заявки"),
        ({"grt": 5000, "rate": None}, "Курс USD на 2026-07-20 не найден в ответе ЦБ"),
    ],
)
def test_errors_in_order(spark, change, error):
    r = price(spark, **change)
    assert r["calc_error"] == error and r["amount"] is None and r["calc_note"] is None


def test_zero_minutes_and_empty_tables(spark):
    assert price(spark, work_type="сопровождение", end=None)["amount"] == 0.0
    empty = spark.createDataFrame([], WORKS)
    fx = spark.createDataFrame([], "rate_date date, char_code string, rate double")
    assert price_works(empty, fx, spark.createDataFrame([], "day date, is_day_off boolean")).count() == 0


def test_recalculate_keeps_old_amounts(spark):
    works = spark.createDataFrame([(1, "matched", 5.0, "USD", 1.0, 5.0, "old"), (2, "matched", 6.0, "USD", 1.0, 6.0, "old"), (3, "matched", None, None, None, None, None)], "id bigint, status string, amount double, currency string, cbr_rate double, revenue_rub double, calc_note string")
    priced = spark.createDataFrame([(1, 9.0, "RUB", 1.0, 9.0, "new", None), (2, None, None, None, None, None, "беда")], "id bigint, amount double, currency string, cbr_rate double, revenue_rub double, calc_note string, calc_error string")
    got = {r["id"]: r for r in recalculate(works, priced).collect()}
    assert (got[1]["amount"], got[1]["status"], got[1]["calc_note"]) == (9.0, "calculated", "new")
    assert (got[2]["amount"], got[2]["status"], got[2]["calc_note"]) == (6.0, "error", "Ошибка расчёта: беда")
    assert (got[3]["status"], got[3]["amount"]) == ("matched", None)


def test_stored_works_and_clashing_names(spark):
    day = datetime(2026, 7, 20, 6)
    row = {"id": 1, "status": "matched", "voucher_id": 5, "work_type": "швартовка", "agent": T, "started_dt": day, "finished_dt": day, "gross_tonnage": 8446, "amount": 3.0, "currency": "OLD", "calc_note": "old", "is_ice": False}
    names = [c.strip().split(" ")[0] for c in schemas.SCHEMAS["works"].split(",")]
    works = spark.createDataFrame([tuple((row | c).get(n) for n in names) for c in ({}, {"id": 2, "agent": "X"}, {"id": 3, "voucher_id": None})], schemas.SCHEMAS["works"])
    fx, calendar = spark.createDataFrame([(day.date(), "USD", RATE)], "rate_date date, char_code string, rate double"), spark.createDataFrame([], "day date, is_day_off boolean")
    vouchers = spark.createDataFrame([(5, "БК Пионер")], "id bigint, joint_with string")
    clashing = works.withColumns({c: F.lit("mine") for c in ("_ice", "_agent", "_type", "_off", "_new", "_work", "_fx", "a.b")})
    for given in (works, clashing):
        done = recalculate_stored(given, vouchers, fx, calendar)
        assert done.columns == given.columns
        got = {r["id"]: r for r in done.collect()}
        assert (got[1]["amount"], got[1]["currency"], got[1]["status"]) == (2111.5, "USD", "calculated") and got[3]["amount"] == 4223.0
        assert (got[2]["amount"], got[2]["status"]) == (3.0, "error") and got[2]["calc_note"].startswith("Ошибка расчёта: ")
    assert {r["_ice"] for r in done.collect()} == {"mine"}
    some = recalculate_stored(works, vouchers, fx, calendar, ids=works.where("id = 3").select("id"))
    assert {r["id"]: r["status"] for r in some.collect()} == {1: "matched", 2: "matched", 3: "calculated"}
