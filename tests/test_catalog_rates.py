"""Bucketed tables and the source of daily rates: results and plans."""

import datetime
import re

from quaymaster.operators import catalog, pricing
from quaymaster.plans import adapters as ad
from quaymaster.sources import rate_service

D = datetime.date


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_buckets_join_without_a_shuffle(spark):
    works = spark.createDataFrame([(i, i % 40, i % 30) for i in range(100)] + [(200, None, None)], "id bigint, voucher_id bigint, application_id bigint")
    vouchers = spark.createDataFrame([(i, f"V{i}") for i in range(40)], "id bigint, number string")
    apps = spark.createDataFrame([(i, f"in/{i}") for i in range(25)], "id bigint, file_path string")
    catalog.save({"works": works, "vouchers": vouchers, "applications": apps}, "quay_test", 8)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.sources.bucketing.autoBucketedScan.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        both = catalog.works_with_vouchers(spark, "quay_test", ["number"])
        assert "Exchange" not in plan_of(both) and "SortMergeJoin" in plan_of(both)
        assert {r["id"]: r["voucher_number"] for r in both.collect()} == {**{i: f"V{i % 40}" for i in range(100)}, 200: None}
        other = catalog.works_with_applications(spark, "quay_test", ["file_path"])
        assert "Exchange" not in plan_of(other)
        assert {r["id"]: r["application_file_path"] for r in other.collect()} == {**{i: f"in/{i % 30}" if i % 30 < 25 else None for i in range(100)}, 200: None}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    one = catalog.lookup(spark, "quay_test", "works", 7)
    try:  # the planner prunes in any case, and tells only of buckets that it keeps
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
        told = one._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert "SelectedBucketsCount: 1 out of 8" in re.sub(r"\s+", " ", told)
    finally:
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", before["spark.sql.sources.bucketing.autoBucketedScan.enabled"])
    assert [r["voucher_id"] for r in one.collect()] == [7]
    catalog.save({"works": works.limit(0)}, "quay_test", 8)
    assert catalog.lookup(spark, "quay_test", "works", 7).count() == 0


def document_of():
    """A function that travels to the tasks by its value, as this module can't be imported there."""

    def document(day, value="78,3987", nominal="1"):
        usd = f"<Valute><CharCode>USD</CharCode><Nominal>{nominal}</Nominal><Value>{value}</Value></Valute>"
        return f'<?xml version="1.0" encoding="windows-1251"?><ValCurs Date="{day}"><Name>Курс</Name>{usd}<Valute><CharCode>JPY</CharCode><Nominal>100</Nominal><Value>1 250,5</Value></Valute></ValCurs>'.encode("cp1251")

    return document


def test_only_asked_days_are_fetched(spark, tmp_path):
    folder, document = str(tmp_path), document_of()

    def fetch(day):
        open(f"{folder}/{day}", "w").close()
        if day.day == 3:
            raise TimeoutError("no answer")
        return b"<broken" if day.day == 4 else document(day)

    every = rate_service.rates(spark, fetch, D(2026, 7, 1), D(2026, 7, 31), "rates_test")
    fetched = lambda: sorted(p.name for p in tmp_path.iterdir())
    rows = every.where("rate_date = DATE '2026-07-02' AND char_code IN ('JPY', 'EUR')").collect()
    assert [tuple(r) for r in rows] == [(D(2026, 7, 2), "JPY", 100, 1250.5, 12.505, None)]
    assert fetched() == ["2026-07-02"]
    rows = every.where("rate_date >= DATE '2026-07-03' AND rate_date < DATE '2026-07-06'").orderBy("rate_date", "char_code").collect()
    assert [(r["rate_date"].day, r["char_code"]) for r in rows] == [(3, None), (4, None), (5, "JPY"), (5, "USD")]
    assert rows[0]["error"] == "TimeoutError: no answer" and rows[1]["error"].startswith("ParseError")
    assert fetched() == ["2026-07-02", "2026-07-03", "2026-07-04", "2026-07-05"]
    days = spark.createDataFrame([(D(2026, 7, 9),), (D(2026, 7, 9),), (None,), (D(2031, 1, 1),)], "day date")
    assert rate_service.rates_of(days, "day", every).count() == 2 and fetched()[-1] == "2026-07-09" and len(fetched()) == 5
    assert rate_service.rates_of(days.where("day IS NULL"), "day", every).count() == 0


def test_works_are_priced_from_the_service(spark):
    kind = "id int, agent string, work_type string, gross_tonnage int, started_dt timestamp_ntz, finished_dt timestamp_ntz, left_base_dt timestamp_ntz, arrived_base_dt timestamp_ntz, is_ice boolean, escort_hours double, tug_count int"
    at = datetime.datetime(2026, 7, 20, 6)
    works = spark.createDataFrame([(i, "Транс-Агро", "швартовка", 8446, at + datetime.timedelta(days=i), None, None, None, False, None, 1) for i in range(3)], kind)
    document = document_of()
    every = rate_service.rates(spark, lambda day: document(day, "783,987", "10"), D(2026, 7, 1), D(2026, 7, 21), "rates_priced")
    got = pricing.price_works(works, rate_service.rates_of(works, "started_dt", every), ad.calendar_day(spark)).orderBy("id").collect()
    assert [r["cbr_rate"] for r in got] == [78.3987, 78.3987, None] and got[0]["revenue_rub"] == round(4223.0 * 78.3987, 2)
    assert got[2]["calc_error"] == "Курс USD на 2026-07-22 не найден в ответе ЦБ"
