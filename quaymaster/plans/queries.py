"""Registered queries of the engine's own operators, each with its SQL where SQL can express it."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from .. import schemas
from .. import dims
from ..operators import aliases, export, matching, pricing, state, views
from ..sources import documents, forms, rate_service, reference
from . import adapters as ad
from . import oracle as o

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def _show(x: str) -> str:
    return f"coalesce(strftime({x}, '%d.%m.%Y %H:%M'), '—')"


_OR = "coalesce(nullif({0}, ''), '—')".format
_GRT = "coalesce(CAST(nullif(gross_tonnage, 0) AS VARCHAR), '—')"


@_query("dashboard_counts", f"WITH {ad.WORKS_SQL} SELECT (SELECT count(*) FROM applications) AS applications, (SELECT count(*) FROM vouchers) AS vouchers, (SELECT count(*) FROM works) AS works")
def dashboard_counts(spark: SparkSession, d: str) -> DataFrame:
    return views.dashboard(ad.applications(spark, d), ad.vouchers(spark, d), ad.works(spark, d))


@_query("applications_list", f"WITH {ad.APPLICATIONS_SQL} SELECT id, {_OR('vessel_name')} AS vessel, direction, {_GRT} AS grt, {_show('entry_datetime')} AS entry, {_show('exit_datetime')} AS exit, status FROM applications")
def applications_list(spark: SparkSession, d: str) -> DataFrame:
    return views.applications_list(ad.applications(spark, d))


@_query("vouchers_list", f"WITH {ad.VOUCHERS_SQL}, {ad.TUGS_SQL} SELECT v.id, {_OR('number')} AS number, {_OR('t.name')} AS tug, {_OR('vessel_name')} AS vessel, {_OR('work_type')} AS work_type, {_show('started_dt')} AS started, {_show('finished_dt')} AS finished, status FROM vouchers v LEFT JOIN tugs t ON v.tug_id = t.id")
def vouchers_list(spark: SparkSession, d: str) -> DataFrame:
    return views.vouchers_list(ad.vouchers(spark, d), ad.tugs(spark))


def _priced(spark: SparkSession, d: str, **made) -> DataFrame:
    w = ad.works(spark, d, **made).withColumn("tug_count", t.tug_count(F.col("joint_with"))).drop("joint_with")
    return pricing.price_works(w, ad.fx_rate(spark), ad.calendar_day(spark))


_RESULT = ["id", "work_minutes", "busy_minutes", "amount", "currency", "cbr_rate", "revenue_rub", "calc_note", "calc_error", "pricing"]


@_query("price_works", f"{o.PRICED} SELECT {', '.join(_RESULT)} FROM priced")
def price_works(spark: SparkSession, d: str) -> DataFrame:
    return _priced(spark, d).select(*_RESULT)


def _part(name: str, condition: str, columns: list[str]) -> None:
    @_query(name, f"{o.PRICED} SELECT {', '.join(columns)} FROM priced WHERE {condition}")
    def part(spark: SparkSession, d: str) -> DataFrame:
        return _priced(spark, d).where(condition).select(*columns)


_part("price_per_ton", "pricing = 'per_ton'", ["id", "amount", "currency", "calc_note"])
_part("price_per_hour", "pricing = 'per_hour'", ["id", "work_minutes", "amount", "currency", "calc_note"])
_part("price_per_operation", "pricing = 'per_operation'", ["id", "amount", "currency", "calc_note"])
_part("price_escort", "calc_note LIKE '%Сопровождение%' AND calc_error IS NULL", ["id", "amount", "calc_note"])
_part("price_ice", "is_ice AND calc_error IS NULL", ["id", "amount", "calc_note"])
_part("price_errors", "calc_error IS NOT NULL", ["id", "calc_error"])
_part("fx_revenue", "calc_error IS NULL", ["id", "amount", "cbr_rate", "revenue_rub"])
_part("calc_notes", "calc_note IS NOT NULL", ["id", "calc_note"])


@_query(
    "works_list",
    f"""{o.PRICED}, {ad.TUGS_SQL} SELECT p.id, {_OR('t.name')} AS tug, {_OR('object_name')} AS object, {_OR('p.work_type')} AS work_type, {_OR('p.agent')} AS agent,
    coalesce(strftime(started_dt, '%d.%m %H:%M'), '—') AS started, coalesce(strftime(finished_dt, '%d.%m %H:%M'), '—') AS finished, {_GRT} AS grt, coalesce({o.money('amount')}, '—') AS amount,
    {_OR('currency')} AS currency, cbr_rate, coalesce({o.money('revenue_rub')}, '—') AS revenue, coalesce(calc_note, '') AS note, status FROM priced p LEFT JOIN tugs t ON p.tug_id = t.id""",
)
def works_list(spark: SparkSession, d: str) -> DataFrame:
    # rows are dealt out in the list's order before they are priced, so none of the texts that pricing makes is shuffled
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return views.works_list(_priced(spark, d, dealt=lambda rows: rows.repartitionByRange(parts, F.desc("id"))), ad.tugs(spark))


@_query("point_lookup", f"WITH {ad.APPLICATIONS_SQL} SELECT id, direction, gross_tonnage FROM applications WHERE id = 7")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return views.application_detail(ad.applications(spark, d).withColumn("raw_text", F.lit("")), 7).select("id", "direction", "gross_tonnage")


@_query(
    "voucher_detail",
    f"WITH {ad.VOUCHERS_SQL} SELECT id, number, strftime(left_base_dt, '%Y-%m-%dT%H:%M') AS left_base_dt, strftime(arrived_base_dt, '%Y-%m-%dT%H:%M') AS arrived_base_dt, strftime(started_dt, '%Y-%m-%dT%H:%M') AS started_dt, strftime(finished_dt, '%Y-%m-%dT%H:%M') AS finished_dt FROM vouchers WHERE id = (SELECT min(id) FROM vouchers)",
)
def voucher_detail(spark: SparkSession, d: str) -> DataFrame:
    v = ad.vouchers(spark, d)
    return views.voucher_detail(v, v.agg(F.min("id")).first()[0]).select("id", "number", "left_base_dt", "arrived_base_dt", "started_dt", "finished_dt")


_VOUCHER_FORM = {
    "voucher_id": "CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE CAST(l_orderkey AS {s}) END", "number": "CASE WHEN l_partkey % 4 = 0 THEN '' ELSE concat('V', CAST(l_partkey AS {s})) END",
    "tug_id": "CASE l_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN concat(' ', CAST(l_suppkey AS {s}), ' ') ELSE 'tug 1' END", "remarks": "CASE WHEN l_suppkey % 2 = 0 THEN '' ELSE l_returnflag END",
    "is_ice": "CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'on' END", "escort_hours": "CASE l_partkey % 3 WHEN 0 THEN '1,5' WHEN 1 THEN '' ELSE '2h' END",
}


@_query(
    "voucher_forms",
    f"""WITH x AS (SELECT {ad.VOUCHER_ID} AS row_id, l_shipdate, {", ".join(f"{e.format(s='VARCHAR')} AS {n}" for n, e in _VOUCHER_FORM.items())} FROM lineitem)
    SELECT row_id, TRY_CAST(nullif(voucher_id, '') AS BIGINT) AS id, 'confirmed' AS status, nullif(number, '') AS number, CASE WHEN regexp_full_match(trim(tug_id), '[0-9]+') THEN CAST(trim(tug_id) AS BIGINT) END AS tug_id,
    strftime(l_shipdate, '%Y-%m-%d') || ' 08:15' AS started, nullif(remarks, '') AS remarks, coalesce(is_ice, '') <> '' AS is_ice, TRY_CAST(replace(nullif(escort_hours, ''), ',', '.') AS DOUBLE) AS escort_hours FROM x""",
)
def voucher_forms(spark: SparkSession, d: str) -> DataFrame:
    blank = {c: F.lit("") for c in ("vessel_name", "agent", "work_type", "left_base_dt", "arrived_base_dt", "finished_dt", "joint_with")}
    rows = ad.load(spark, d, "lineitem").withColumns({"row_id": F.expr(ad.VOUCHER_ID), "started_dt": F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T08:15")), **{n: F.expr(e.format(s="STRING")) for n, e in _VOUCHER_FORM.items()}, **blank})
    made = forms.voucher_forms(rows, "row_id")
    return made.select("row_id", "id", "status", "number", "tug_id", F.date_format("started_dt", "yyyy-MM-dd HH:mm").alias("started"), "remarks", "is_ice", "escort_hours")


_FORM_TEXT = "CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE p_brand END"


@_query("form_blanks", f"WITH x AS (SELECT p_partkey, {_FORM_TEXT} AS f FROM part) SELECT p_partkey, nullif(f, '') AS filled, coalesce(f, '') <> '' AS checked FROM x")
def form_blanks(spark: SparkSession, d: str) -> DataFrame:
    text = F.expr(_FORM_TEXT)
    return ad.load(spark, d, "part").select("p_partkey", t.blank_to_null(text).alias("filled"), t.checkbox(text).alias("checked"))


_XML_NUMBER = "CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat('1 ', CAST(100 + p_size AS {s}), ',25') ELSE concat(CAST(p_size AS {s}), ',5') END"


@_query("xml_number", f"WITH x AS (SELECT p_partkey, coalesce(nullif({_XML_NUMBER.format(s='VARCHAR')}, ''), '1') AS f FROM part) SELECT p_partkey, CAST(replace(replace(f, ' ', ''), ',', '.') AS DOUBLE) AS value FROM x")
def xml_number(spark: SparkSession, d: str) -> DataFrame:
    return ad.load(spark, d, "part").select("p_partkey", t.xml_number(F.expr(_XML_NUMBER.format(s="STRING")), "1").alias("value"))


def _rate_document(day: datetime.date) -> bytes:
    n = (day - datetime.date(1970, 1, 1)).days
    if n % 11 == 0:
        raise LookupError(f"no rates of {day}")
    return f'<?xml version="1.0" encoding="windows-1251"?><ValCurs><Valute><CharCode>USD</CharCode><Nominal>10</Nominal><Value>{700 + n % 1000 / 4:.2f}</Value></Valute></ValCurs>'.replace(".", ",").replace("1,0", "1.0").encode()


@_query(
    "rates_from_xml",
    """WITH d AS (SELECT o_orderdate AS day, count(*) AS orders, CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS BIGINT) AS n FROM orders GROUP BY o_orderdate)
    SELECT strftime(day, '%Y-%m-%d') AS day, orders, CASE WHEN n % 11 <> 0 THEN (700 + (n % 1000) / 4.0) / 10 END AS rate, CASE WHEN n % 11 = 0 THEN 'LookupError: no rates of ' || strftime(day, '%Y-%m-%d') END AS error FROM d""",
)
def rates_from_xml(spark: SparkSession, d: str) -> DataFrame:
    days = ad.load(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("rate_date")).agg(F.count(F.lit(1)).alias("orders"))
    every = rate_service.rates(spark, _rate_document, datetime.date(1990, 1, 1), datetime.date(2003, 12, 31))
    found = days.join(rate_service.rates_of(days, "rate_date", every), "rate_date", "left")
    return found.select(F.date_format("rate_date", "yyyy-MM-dd").alias("day"), "orders", "rate", "error")


_ICE = "WHERE is_ice AND gross_tonnage >= 2000 AND work_type IN ('Швартовка', 'отшвартовка') AND started_dt IS NOT NULL"


@_query("ice_rates", f"WITH {ad.WORKS_SQL} SELECT id, {o.rounded("CAST(gross_tonnage AS DOUBLE) * CASE work_type WHEN 'Швартовка' THEN CAST(0.75 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END", 2)} AS amount FROM works {_ICE}")
def ice_rates(spark: SparkSession, d: str) -> DataFrame:
    """Works in ice under a tariff that has an ice rate, and under one that has none."""
    works = ad.works(spark, d).where(_ICE.removeprefix("WHERE ")).withColumns({"agent": F.lit("ice"), "tug_count": F.lit(1), "escort_hours": F.lit(None).cast("double")})
    tariffs = spark.createDataFrame([("ice", "швартовка", "per_ton", "RUB", 0.5, 0.75), ("ice", "отшвартовка", "per_ton", "RUB", 0.5, None)], "agent string, work_type string, unit string, currency string, rate double, rate_ice double")
    return pricing.price_works(works, ad.fx_rate(spark), ad.calendar_day(spark), tariffs=tariffs).select("id", "amount")


_ODD = "CASE o_orderkey % 4 WHEN 0 THEN 'вход' WHEN 1 THEN 'Вход' WHEN 2 THEN 'nowhere' ELSE '' END"


@_query("form_directions", f"SELECT o_orderkey AS row_id, CASE WHEN {_ODD} = 'вход' THEN 'вход' ELSE 'прочее' END AS direction FROM orders")
def form_directions(spark: SparkSession, d: str) -> DataFrame:
    """Directions that the domain lacks become the rest."""
    return ad.load(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), t.coerce_domain(F.expr(_ODD), dims.DIRECTIONS, "прочее").alias("direction"))


@_query("norm_vessel_name", f"SELECT c_custkey, {o.norm_name('c_name')} AS name FROM customer")
def norm_vessel_name(spark: SparkSession, d: str) -> DataFrame:
    return ad.load(spark, d, "customer").select("c_custkey", t.norm_name(F.col("c_name")).alias("name"))


@_query("normalize_work_type", f"WITH {ad.VOUCHERS_SQL} SELECT id, {o.work_type('work_type')} AS canonical FROM vouchers")
def normalize_work_type(spark: SparkSession, d: str) -> DataFrame:
    return t.with_work_type(ad.vouchers(spark, d).select("id", "work_type"), F.col("work_type"), "canonical").select("id", "canonical")


@_query("alias_table", f"WITH {ad.VOUCHERS_SQL} SELECT id, {o.work_type('work_type')} AS canonical FROM vouchers")
def alias_table(spark: SparkSession, d: str) -> DataFrame:
    return aliases.normalize(ad.vouchers(spark, d).select("id", "work_type"), "work_type", dims.work_type_aliases(spark), "canonical").select("id", "canonical")


@_query("tug_count", f"WITH {ad.VOUCHERS_SQL} SELECT id, {o.tugs_in('joint_with')} AS tugs FROM vouchers")
def tug_count(spark: SparkSession, d: str) -> DataFrame:
    return ad.vouchers(spark, d).select("id", t.tug_count(F.col("joint_with")).alias("tugs"))


_DT_TEXT = "CASE o_orderkey % 4 WHEN 0 THEN concat('прибытие ', {day}, ' в 04:', lpad(CAST(o_orderkey % 70 AS {s}), 2, '0')) WHEN 1 THEN concat({day}, '  7:05') WHEN 2 THEN '31.02.2026 в 10:00' ELSE 'нет даты' END"


@_query(
    "parse_datetime",
    rf"""WITH x AS (SELECT o_orderkey, regexp_replace({_DT_TEXT.format(day="strftime(o_orderdate, '%d.%m.%Y')", s='VARCHAR')}, '\s+', '', 'g') AS c FROM orders),
    y AS (SELECT o_orderkey, regexp_extract(c, '(\d{{2}})\.(\d{{2}})\.(\d{{4}}).{{0,3}}?(\d{{1,2}}):(\d{{2}})', ['d', 'mo', 'y', 'h', 'mi']) AS g FROM x)
    SELECT o_orderkey, strftime(try_strptime(g.d || '.' || g.mo || '.' || g.y || ' ' || lpad(g.h, 2, '0') || ':' || g.mi, '%d.%m.%Y %H:%M'), '%Y-%m-%d %H:%M') AS parsed FROM y""",
)
def parse_datetime(spark: SparkSession, d: str) -> DataFrame:
    text = F.expr(_DT_TEXT.format(day="date_format(o_orderdate, 'dd.MM.yyyy')", s="STRING"))
    return ad.load(spark, d, "orders").select("o_orderkey", F.date_format(t.parse_date_time(text), "yyyy-MM-dd HH:mm").alias("parsed"))


_FORM_DT = "CASE o_orderkey % 4 WHEN 0 THEN concat({iso}, 'T08:15') WHEN 1 THEN concat({dotted}, ' 09:30') WHEN 2 THEN '' ELSE concat({iso}, ' 08:15') END"


@_query(
    "form_datetime",
    f"""WITH x AS (SELECT o_orderkey, {_FORM_DT.format(iso="strftime(o_orderdate, '%Y-%m-%d')", dotted="strftime(o_orderdate, '%d.%m.%Y')")} AS f FROM orders)
    SELECT o_orderkey, strftime(coalesce(try_strptime(f, '%Y-%m-%dT%H:%M'), try_strptime(f, '%d.%m.%Y %H:%M')), '%Y-%m-%d %H:%M') AS parsed FROM x""",
)
def form_datetime(spark: SparkSession, d: str) -> DataFrame:
    text = F.expr(_FORM_DT.format(iso="date_format(o_orderdate, 'yyyy-MM-dd')", dotted="date_format(o_orderdate, 'dd.MM.yyyy')"))
    return ad.load(spark, d, "orders").select("o_orderkey", F.date_format(t.form_date_time(text), "yyyy-MM-dd HH:mm").alias("parsed"))


_PAIR = "CASE l_linenumber % 3 WHEN 0 THEN concat(CAST(l_partkey AS {s}), ' / ', CAST(l_suppkey AS {s})) WHEN 1 THEN concat('GRT ', CAST(l_partkey AS {s})) ELSE 'нет' END"


@_query(
    "int_pair",
    rf"""WITH x AS (SELECT {ad.VOUCHER_ID} AS id, regexp_replace({_PAIR.format(s='VARCHAR')}, '\s+', '', 'g') AS c FROM lineitem)
    SELECT id, coalesce(TRY_CAST(nullif(regexp_extract(c, '(\d+)/(\d+)', 1), '') AS BIGINT), TRY_CAST(nullif(regexp_extract(c, '(\d+)', 1), '') AS BIGINT)) AS gross, TRY_CAST(nullif(regexp_extract(c, '(\d+)/(\d+)', 2), '') AS BIGINT) AS net FROM x""",
)
def int_pair(spark: SparkSession, d: str) -> DataFrame:
    pair = t.int_pair(F.expr(_PAIR.format(s="STRING")))
    return ad.load(spark, d, "lineitem").select(F.expr(ad.VOUCHER_ID).alias("id"), pair["first"].alias("gross"), pair["second"].alias("net"))


_FORM_NUMBER = "CASE l_linenumber % 4 WHEN 0 THEN concat(' ', CAST(l_partkey AS {s}), ' ') WHEN 1 THEN concat(CAST(l_suppkey AS {s}), ',5') WHEN 2 THEN '1.5d' ELSE '' END"


@_query(
    "form_number",
    rf"""WITH x AS (SELECT {ad.VOUCHER_ID} AS id, trim({_FORM_NUMBER.format(s='VARCHAR')}) AS f FROM lineitem)
    SELECT id, CASE WHEN regexp_full_match(f, '[0-9]+') THEN TRY_CAST(f AS INT) END AS whole, CASE WHEN regexp_full_match(replace(f, ',', '.'), '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN TRY_CAST(replace(f, ',', '.') AS DOUBLE) END AS part FROM x""",
)
def form_number(spark: SparkSession, d: str) -> DataFrame:
    text = F.expr(_FORM_NUMBER.format(s="STRING"))
    return ad.load(spark, d, "lineitem").select(F.expr(ad.VOUCHER_ID).alias("id"), t.form_int(text).alias("whole"), t.form_decimal(text).alias("part"))


_MAIL_TEXT = "CASE o_orderkey % 5 WHEN 0 THEN 'Заявка на вход судна' WHEN 1 THEN 'судно готово, ВЫХОД завтра' WHEN 2 THEN 'выходной день' WHEN 3 THEN 'вход и выход' ELSE o_orderpriority END"
_WORD = r"(^|[^\p{L}\p{N}_])%s($|[^\p{L}\p{N}_])"


@_query(
    "detect_direction",
    f"""WITH x AS (SELECT o_orderkey, lower(' ' || substring({_MAIL_TEXT}, 1, 400)) AS h FROM orders)
    SELECT o_orderkey, CASE WHEN contains(h, 'на вход') OR regexp_matches(h, '{_WORD % 'вход'}') THEN 'вход' WHEN contains(h, 'на выход') OR regexp_matches(h, '{_WORD % 'выход'}') THEN 'выход' ELSE 'прочее' END AS direction FROM x""",
)
def detect_direction(spark: SparkSession, d: str) -> DataFrame:
    return ad.load(spark, d, "orders").select("o_orderkey", t.detect_direction(F.expr(_MAIL_TEXT), F.lit(None).cast("string")).alias("direction"))


@_query(
    "fields_from_text",
    "SELECT o_orderkey, 'VESSEL ' || CAST(o_custkey AS VARCHAR) AS vessel_name, CAST(o_orderkey AS VARCHAR) AS imo, CAST(o_custkey AS INT) AS gross_tonnage, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') || ' 04:30' END AS entry FROM orders",
)
def fields_from_text(spark: SparkSession, d: str) -> DataFrame:
    when = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" в 04:30")))
    text = F.concat(F.lit("Заявка\n\nНазвание судна\n  VESSEL  "), F.col("o_custkey"), F.lit("\n№ ИМО "), F.col("o_orderkey"), F.lit("\r\nБрутто/нетто "), F.col("o_custkey"), F.lit(" / 10\nДата/время входа "), when, F.lit("\n"))
    rows = t.with_fields(t.with_text_cells(ad.load(spark, d, "orders"), text), F.col("cells"))
    return rows.select("o_orderkey", "vessel_name", "imo", "gross_tonnage", F.date_format("entry_datetime", "yyyy-MM-dd HH:mm").alias("entry"))


@_query(
    "label_last_wins",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'second' ELSE 'other' END AS vessel_name, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '2026-07-20 04:00' END AS entry FROM orders""",
)
def label_last_wins(spark: SparkSession, d: str) -> DataFrame:
    cell = lambda pos, label, value: F.struct(F.lit(pos).alias("pos"), F.lit(label).alias("label"), value.cast("string").alias("value"))
    even = F.col("o_orderkey") % 2 == 0
    cells = F.array(
        cell(0, "Название судна", F.lit("first")),
        cell(1, "Дата/время входа", F.lit("20.07.2026 в 04:00")),
        cell(2, "Название судна", F.lit("second")),
        cell(3, "Порт входа", F.when(F.col("o_orderkey") % 3 == 0, "Азов").otherwise("20.07.2026 04:00")),
    )
    cells = F.when(even, cells).otherwise(F.concat(cells, F.array(cell(4, "название судна 2", F.lit("other")))))
    rows = t.with_fields(ad.load(spark, d, "orders"), cells)
    return rows.select("o_orderkey", "vessel_name", F.date_format("entry_datetime", "yyyy-MM-dd HH:mm").alias("entry"))


@_query("durations_hm", f"WITH {ad.VOUCHERS_SQL} SELECT id, {o.hm(o.minutes('left_base_dt', 'arrived_base_dt'))} AS busy, {o.hm(o.minutes('started_dt', 'finished_dt') + ' * 97')} AS work FROM vouchers")
def durations_hm(spark: SparkSession, d: str) -> DataFrame:
    return ad.vouchers(spark, d).select("id", t.format_hm(t.minutes_between(F.col("left_base_dt"), F.col("arrived_base_dt"))).alias("busy"), t.format_hm(t.minutes_between(F.col("started_dt"), F.col("finished_dt")) * 97).alias("work"))


@_query("night_holiday", f"WITH {ad.DAYS_SQL} SELECT event_id, hour(ts) >= 22 OR hour(ts) < 6 AS night, coalesce(is_day_off, isodow(ts) >= 6) AS day_off FROM events LEFT JOIN calendar_day ON CAST(ts AS DATE) = day")
def night_holiday(spark: SparkSession, d: str) -> DataFrame:
    from ..dims import Settings

    e = pricing.with_day_off(ad.load(spark, d, "events").select("event_id", "ts"), F.to_date("ts"), ad.calendar_day(spark))
    return e.select("event_id", pricing.is_night(F.col("ts"), Settings()).alias("night"), "day_off")


def _match_sql(min_score: float, only: str = "") -> str:
    kind = o.work_type("CASE direction WHEN 'вход' THEN 'швартовка' WHEN 'выход' THEN 'отшвартовка' ELSE direction END")
    return f"""WITH {ad.APPLICATIONS_SQL}, {ad.VOUCHERS_SQL},
    a AS (SELECT id AS application_id, {o.norm_name('vessel_name')} AS a_name, {kind} AS a_type, CAST(coalesce(entry_datetime, exit_datetime) AS DATE) AS a_day FROM applications {only}),
    v AS (SELECT id AS voucher_id, {o.norm_name('vessel_name')} AS v_name, {o.work_type('work_type')} AS v_type, CAST(coalesce(started_dt, finished_dt) AS DATE) AS v_day FROM vouchers),
    s AS (SELECT application_id, voucher_id, coalesce(a_name = v_name AND a_name <> '', false) AS n, coalesce(a_type = v_type AND a_type <> '', false) AS w, coalesce(abs(a_day - v_day) <= 1, false) AS d FROM a, v {'' if min_score <= 0.3 else "WHERE a_name = v_name AND a_name <> ''" if min_score > 0.5 else "WHERE (a_name = v_name AND a_name <> '') OR (a_type = v_type AND abs(a_day - v_day) <= 1)"}),
    p AS (SELECT *, (CASE WHEN n THEN 5 ELSE 0 END + CASE WHEN w THEN 3 ELSE 0 END + CASE WHEN d THEN 2 ELSE 0 END) AS points FROM s)
    SELECT application_id, voucher_id, CAST(points AS DOUBLE) / 10 AS score, concat_ws(', ', CASE WHEN n THEN 'совпадает судно' END, CASE WHEN w THEN 'совпадает вид работ' END, CASE WHEN d THEN 'совпадает дата' END) AS reasons
    FROM p WHERE points >= {round(min_score * 10)}"""


def _matches(spark: SparkSession, d: str, min_score: float, only: int | None = None) -> DataFrame:
    apps = ad.applications(spark, d)
    apps = apps if only is None else apps.where(F.col("id") == only)
    return matching.match_candidates(apps, ad.vouchers(spark, d), min_score).withColumn("reasons", F.array_join("reasons", ", "))


@_query("match_min_0_2", _match_sql(0.2, "WHERE id = 7"))
def match_min_0_2(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d, 0.2, only=7)


@_query("match_min_0_7", _match_sql(0.7))
def match_min_0_7(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d, 0.7)


@_query("match_min_0_8", _match_sql(0.8))
def match_min_0_8(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d, 0.8)


@_query("match_min_0_5", _match_sql(0.5))
def match_min_0_5(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d, 0.5)


@_query("match_min_1_0", _match_sql(1.0))
def match_min_1_0(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d, 1.0)


@_query("match_ranked", f"SELECT application_id, voucher_id, score, row_number() OVER (PARTITION BY application_id ORDER BY score DESC, voucher_id) AS rank FROM ({_match_sql(0.7)})")
def match_ranked(spark: SparkSession, d: str) -> DataFrame:
    return matching.ranked(_matches(spark, d, 0.7)).select("application_id", "voucher_id", "score", F.col("rank").cast("bigint").alias("rank"))


@_query("match_min_0_5_all", _match_sql(0.5))
def match_min_0_5_all(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d, 0.5)


def _top_sql(k: int) -> str:
    """The best ``k`` of every application: all pairs by name or by type and day, and of a type or a day alone the first ``k``."""
    kind = o.work_type("CASE direction WHEN 'вход' THEN 'швартовка' WHEN 'выход' THEN 'отшвартовка' ELSE direction END")
    return f"""WITH {ad.APPLICATIONS_SQL}, {ad.VOUCHERS_SQL},
    a AS (SELECT id AS application_id, {o.norm_name('vessel_name')} AS a_name, {kind} AS a_type, CAST(coalesce(entry_datetime, exit_datetime) AS DATE) AS a_day FROM applications),
    v AS (SELECT id AS voucher_id, {o.norm_name('vessel_name')} AS v_name, {o.work_type('work_type')} AS v_type, CAST(coalesce(started_dt, finished_dt) AS DATE) AS v_day FROM vouchers),
    near AS (SELECT v.*, v_day + i AS day FROM v, (VALUES (-1), (0), (1)) n(i)),
    of_type AS (SELECT * FROM v WHERE v_type <> '' QUALIFY row_number() OVER (PARTITION BY v_type ORDER BY voucher_id) <= {k}),
    of_day AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY day ORDER BY voucher_id) <= {k}),
    s AS (SELECT application_id, a_name, a_type, a_day, voucher_id, v_name, v_type, v_day FROM a JOIN v ON a_name = v_name AND a_name <> ''
          UNION SELECT application_id, a_name, a_type, a_day, voucher_id, v_name, v_type, v_day FROM a JOIN near ON a_type = v_type AND a_day = day AND a_type <> ''
          UNION SELECT application_id, a_name, a_type, a_day, voucher_id, v_name, v_type, v_day FROM a JOIN of_type ON a_type = v_type
          UNION SELECT application_id, a_name, a_type, a_day, voucher_id, v_name, v_type, v_day FROM a JOIN of_day ON a_day = day),
    f AS (SELECT application_id, voucher_id, coalesce(a_name = v_name AND a_name <> '', false) AS n, coalesce(a_type = v_type AND a_type <> '', false) AS w, coalesce(abs(a_day - v_day) <= 1, false) AS d FROM s),
    p AS (SELECT *, (CASE WHEN n THEN 5 ELSE 0 END + CASE WHEN w THEN 3 ELSE 0 END + CASE WHEN d THEN 2 ELSE 0 END) AS points FROM f)
    SELECT application_id, row_number() OVER (PARTITION BY application_id ORDER BY points DESC, voucher_id) AS rank, voucher_id, CAST(points AS DOUBLE) / 10 AS score,
           concat_ws(', ', CASE WHEN n THEN 'совпадает судно' END, CASE WHEN w THEN 'совпадает вид работ' END, CASE WHEN d THEN 'совпадает дата' END) AS reasons
    FROM p WHERE points >= 2 QUALIFY rank <= {k}"""


@_query("match_top", _top_sql(20))
def match_top(spark: SparkSession, d: str) -> DataFrame:
    return matching.top_candidates(ad.applications(spark, d), ad.vouchers(spark, d), 20, 0.2).withColumn("reasons", F.array_join("reasons", ", "))


@_query(
    "match_view",
    f"""WITH m AS ({_match_sql(0.2, "WHERE id = 7")}), {ad.APPLICATIONS_SQL}, {ad.VOUCHERS_SQL}, {ad.TUGS_SQL}
    SELECT m.application_id, m.voucher_id, {o.money('score')} AS score, reasons, {_OR('a.vessel_name')} AS application, direction, {_GRT.replace('gross', 'a.gross')} AS grt, coalesce(strftime(coalesce(entry_datetime, exit_datetime), '%d.%m.%Y %H:%M'), 'без даты') AS date,
    {_OR('number')} AS number, {_OR('t.name')} AS tug, {_OR('v.vessel_name')} AS vessel, {_OR('v.work_type')} AS work_type
    FROM m JOIN applications a ON a.id = m.application_id JOIN vouchers v ON v.id = m.voucher_id LEFT JOIN tugs t ON v.tug_id = t.id""",
)
def match_view(spark: SparkSession, d: str) -> DataFrame:
    apps, v = ad.applications(spark, d), ad.vouchers(spark, d)
    return views.match_view(apps, v.drop("application_id"), ad.tugs(spark), matching.match_candidates(apps.where("id = 7"), v, 0.2))


@_query("create_works", f"WITH {ad.WORKS_SQL} SELECT id, status, application_id, tug_id, object_name, work_type, agent, gross_tonnage, is_ice, escort_hours FROM works")
def create_works(spark: SparkSession, d: str) -> DataFrame:
    return ad.works(spark, d).select("id", "status", "application_id", "tug_id", "object_name", "work_type", "agent", "gross_tonnage", "is_ice", "escort_hours")


@_query("mark_matched", f"WITH {ad.APPLICATIONS_SQL} SELECT id, CASE WHEN id IN (SELECT l_orderkey FROM lineitem) THEN 'matched' ELSE status END AS status FROM applications")
def mark_matched(spark: SparkSession, d: str) -> DataFrame:
    ids = ad.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"))
    return matching.mark_matched(ad.applications(spark, d), ids).select("id", "status")


@_query(
    "recalc_merge",
    f"""{o.PRICED} SELECT id, CASE WHEN calc_error IS NULL THEN amount ELSE CAST(111 AS DOUBLE) END AS amount, CASE WHEN calc_error IS NULL THEN currency ELSE 'OLD' END AS currency, CASE WHEN calc_error IS NULL THEN cbr_rate END AS cbr_rate,
    CASE WHEN calc_error IS NULL THEN revenue_rub END AS revenue_rub, CASE WHEN calc_error IS NULL THEN calc_note ELSE 'Ошибка расчёта: ' || calc_error END AS calc_note, CASE WHEN calc_error IS NULL THEN 'calculated' ELSE 'error' END AS status FROM priced""",
)
def recalc_merge(spark: SparkSession, d: str) -> DataFrame:
    made = ad.works(spark, d).withColumns({"amount": F.lit(111.0), "currency": F.lit("OLD")})
    kinds = [c.strip().split(" ") for c in schemas.SCHEMAS["works"].split(",")]
    stored = made.select(*[(F.col(n) if n in made.columns else F.lit(None)).cast(kind).alias(n) for n, kind in kinds])
    done = pricing.recalculate_stored(stored, ad.vouchers(spark, d), ad.fx_rate(spark), ad.calendar_day(spark))
    return done.select("id", "amount", "currency", "cbr_rate", "revenue_rub", "calc_note", "status")


@_query("seed_anti_join", "SELECT n_name AS name FROM nation WHERE n_name NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0) GROUP BY n_name")
def seed_anti_join(spark: SparkSession, d: str) -> DataFrame:
    nation = ad.load(spark, d, "nation")
    there = nation.where("n_nationkey % 2 = 0").selectExpr("n_name AS name")
    return state.insert_if_absent(there, nation.selectExpr("n_name AS name"))


@_query("ensure_ship", "SELECT c_name AS name, CAST(min(c_custkey) AS VARCHAR) AS imo FROM customer WHERE c_custkey % 3 <> 0 GROUP BY c_name")
def ensure_ship(spark: SparkSession, d: str) -> DataFrame:
    c = ad.load(spark, d, "customer")
    ships = c.where("c_custkey % 3 = 0").selectExpr("c_name AS name")
    return reference.ensure_ships(ships, c.selectExpr("c_name AS vessel_name", "CAST(c_custkey AS STRING) AS imo"))


@_query("fk_violations", f"WITH {ad.VOUCHERS_SQL} SELECT id, tug_id AS value FROM vouchers WHERE tug_id NOT IN (1, 2)")
def fk_violations(spark: SparkSession, d: str) -> DataFrame:
    return state.all_violations({"vouchers": ad.vouchers(spark, d), "tugs": ad.tugs(spark)}).select("id", "value")


@_query("upsert_latest", "SELECT o_custkey AS id, max(o_orderkey) AS version, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    return state.current_state(ad.load(spark, d, "orders").selectExpr("o_custkey AS id", "o_orderkey AS version", "o_orderstatus AS status"))


@_query("upsert_forms", f"WITH {ad.APPLICATIONS_SQL} SELECT id, CASE WHEN id % 2 = 0 THEN 'вход' ELSE direction END AS direction, CASE WHEN id % 2 = 0 THEN CAST(id % 5000 AS INT) ELSE gross_tonnage END AS gross_tonnage FROM applications")
def upsert_forms(spark: SparkSession, d: str) -> DataFrame:
    apps = ad.applications(spark, d).select("id", "direction", "gross_tonnage")
    fields = ["vessel_name", "imo", "agent", "entry_datetime", "exit_datetime", "destination"]
    rows = apps.where("id % 2 = 0").select(F.col("id").cast("string").alias("application_id"), F.lit("вход").alias("direction"), (F.col("id") % 5000).cast("string").alias("gross_tonnage"), *[F.lit("").alias(f) for f in fields])
    return state.upsert(apps, forms.application_forms(rows).select("id", "direction", "gross_tonnage"))


def _export_sql() -> str:
    text = lambda x: f"coalesce({x}, '')"
    dt = lambda x: f"coalesce(strftime({x}, '%d.%m.%Y %H:%M'), '')"
    values = [
        "row_number() OVER (ORDER BY p.id)", text("t.name"), text("object_name"), text("p.work_type"), text("p.agent"), text("number"), dt("p.left_base_dt"), dt("p.arrived_base_dt"),
        o.hm(o.minutes("p.left_base_dt", "p.arrived_base_dt")), dt("p.started_dt"), dt("p.finished_dt"), o.hm(o.minutes("p.started_dt", "p.finished_dt")), text("calc_note"), text("a.file_path"),
        text("v.file_path"), "nullif(p.gross_tonnage, 0)", "amount", text("currency"), "cbr_rate", "revenue_rub",
    ]
    columns = ", ".join(f'{v} AS "{c}"' for v, c in zip(values, export.COLUMNS, strict=True))
    return f"{o.PRICED}, {ad.TUGS_SQL} SELECT {columns} FROM priced p LEFT JOIN tugs t ON p.tug_id = t.id LEFT JOIN vouchers v ON v.id = p.voucher_id LEFT JOIN applications a ON a.id = p.application_id"


@_query("export_works", _export_sql())
def export_works(spark: SparkSession, d: str) -> DataFrame:
    # numbered before they are priced; a work's voucher and application are at hand where it is made, so neither is joined again
    ids = ad.works(spark, d).select("id")
    works = _priced(spark, d, dealt=lambda rows: state.numbered(rows, "id", "_number", ids), keep=["joint_with", "number", "file_path", "application_file", "_number"])
    of_voucher = lambda c: F.when(F.col("voucher_id").isNotNull(), F.col(c))
    works = works.withColumns({"_voucher_number": of_voucher("number"), "_voucher_file": of_voucher("file_path"), "_application_file": F.col("application_file")})
    return export.numbered_frame(works, ad.tugs(spark))


@_query("export_csv", f"""SELECT {", ".join(f'coalesce(CAST("{c}" AS VARCHAR), {chr(39)*2}) AS "{c}"' for c in export.COLUMNS)} FROM ({_export_sql()})""")
def export_csv(spark: SparkSession, d: str) -> DataFrame:
    return export.csv_frame(export_works(spark, d))


@_query("works_per_application", f"WITH {ad.WORKS_SQL} SELECT a.id, count(w.id) AS n, coalesce(string_agg(CAST(w.id AS VARCHAR), ',' ORDER BY w.id), '') AS works FROM applications a LEFT JOIN works w ON w.application_id = a.id GROUP BY a.id")
def works_per_application(spark: SparkSession, d: str) -> DataFrame:
    grouped = views.works_per_application(ad.applications(spark, d), ad.works(spark, d))
    return grouped.select("id", F.size("works").cast("long").alias("n"), F.array_join(F.transform("works", lambda w: w["id"].cast("string")), ",").alias("works"))


_HTML = "concat('<h3>Приём судна</h3><table><tr><td>поз.</td><td>что</td><td>значение</td></tr><tr><td>1</td><td>Название судна</td><td>', c_name, '</td></tr><tr><td>2</td><td>Брутто/нетто</td><td>', CAST(c_custkey AS {0}), ' / 7</td></tr></table>')"


@_query("html_table_fields", "SELECT c_custkey, c_name AS vessel_name, CAST(c_custkey AS INT) AS gross_tonnage, CAST(7 AS INT) AS net_tonnage FROM customer")
def html_table_fields(spark: SparkSession, d: str) -> DataFrame:
    page = ad.load(spark, d, "customer").select("c_custkey", F.expr(_HTML.format("STRING")).alias("html"))
    return t.with_fields(documents.html_fields(page, "html", "c_custkey"), F.col("cells")).select("c_custkey", "vessel_name", "gross_tonnage", "net_tonnage")


# Mails of six kinds: HTML, plain text, both, a bad date, styles with repeated and nested rows, and base64.
_DAY = "lpad(CAST(1 + c_custkey % 28 AS {0}), 2, '0')"
_TWICE = "concat('<style>p {{ content: \"на выход\" }}</style><script>var a = \"<p>выход</p>\";</script><template>выход</template><p>вход</p><table><tr><td>Название судна</td><td>FIRST</td></tr><tr><td></td><td>Название судна</td><td>', c_name, '</td></tr><tr><td>x<table><tr><td>Брутто/нетто</td><td>', CAST(c_custkey AS {0}), ' / 7</td></tr></table></td></tr></table>')"


def _mail() -> F.Column:
    kind, html = F.col("c_custkey") % 6, F.concat(F.lit("<p>на вход</p>"), F.expr(_HTML.format("STRING")))
    plain = F.concat(F.lit("Название судна "), F.col("c_name"), F.lit("\nБрутто/нетто\n"), F.col("c_custkey"), F.lit(" / 7\n"))
    head = F.concat(F.lit("From: agent@example.com\nSubject: "), F.when(kind == 1, "судно: выход").otherwise("Request"), F.lit("\nDate: "), F.when(kind == 3, "some day").otherwise(F.concat(F.lit("Sun, "), F.expr(_DAY.format("STRING")), F.lit(" Jul 2026 10:00:00 +0300"))), F.lit("\nMIME-Version: 1.0\n"))
    part = lambda sub, body: F.concat(F.lit(f"Content-Type: text/{sub}; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), body)
    both = F.concat(F.lit('Content-Type: multipart/alternative; boundary="b"\n\n--b\n'), part("plain", F.lit("Название судна PLAIN\n")), F.lit("\n--b\n"), part("html", html), F.lit("\n--b--\n"))
    coded = F.concat(F.lit("Content-Type: text/html; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"), F.base64(html.cast("binary")))
    body = F.when(kind == 1, part("plain", plain)).when(kind == 2, both).when(kind == 4, part("html", F.expr(_TWICE.format("STRING")))).when(kind == 5, coded).otherwise(part("html", html))
    return F.concat(head, body).cast("binary")


@_query("eml_ingest", f"SELECT c_custkey, CASE WHEN c_custkey % 6 = 1 THEN 'выход' ELSE 'вход' END AS direction, c_name AS vessel_name, CAST(c_custkey AS INT) AS gross_tonnage, CAST(7 AS INT) AS net_tonnage, CASE WHEN c_custkey % 6 <> 3 THEN '2026-07-' || {_DAY.format('VARCHAR')} || ' 10:00' END AS received FROM customer")
def eml_ingest(spark: SparkSession, d: str) -> DataFrame:
    files = documents.spread(ad.load(spark, d, "customer").select("c_custkey", "c_name")).select(F.concat(F.lit("in/"), F.col("c_custkey"), F.lit(".eml")).alias("path"), _mail().alias("content"))
    rows = documents.parse_documents(files)
    return rows.select(F.regexp_extract("file_path", r"(\d+)", 1).cast("bigint").alias("c_custkey"), "direction", "vessel_name", "gross_tonnage", "net_tonnage", F.date_format("received_at", "yyyy-MM-dd HH:mm").alias("received"))


@_query("format_dispatch", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'выход' ELSE 'вход' END AS direction, c_custkey % 3 <> 0 AS from_mail, c_name AS vessel_name FROM customer")
def format_dispatch(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("c_custkey") % 3
    page = F.concat(F.lit("на выход\nНазвание судна "), F.col("c_name"))
    mail = F.concat(F.lit("Subject: in\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\nна вход\nНазвание судна "), F.col("c_name"))
    name = F.concat(F.lit("in/"), F.col("c_custkey"), F.when(kind == 0, F.when(F.col("c_custkey") % 2 == 0, ".PDF").otherwise(".pdf")).when(kind == 1, ".eml").otherwise(".pdf.msg"))
    files = ad.load(spark, d, "customer").select(name.alias("path"), F.when(kind == 0, page).otherwise(mail).cast("binary").alias("content"))
    rows = documents.parse_documents(files, lambda content: content.decode())
    return rows.select(F.regexp_extract("file_path", r"(\d+)", 1).cast("bigint").alias("c_custkey"), "direction", F.col("subject").isNotNull().alias("from_mail"), "vessel_name")


# A file of one page whose font maps UTF-16; every fifth one is cut before its pages.
_PDF = "%PDF-1.4\n1 0 obj\n<</Type/Catalog/Pages 2 0 R>>\nendobj\n2 0 obj\n<</Type/Pages/Kids[3 0 R]/Count 1>>\nendobj\n3 0 obj\n<</Type/Page/Parent 2 0 R/Resources<</Font<</F1 5 0 R>>>>/Contents 4 0 R>>\nendobj\n5 0 obj\n<</Type/Font/Subtype/Type0/Encoding/Identity-H/ToUnicode 6 0 R>>\nendobj\n6 0 obj\n<<>>\nstream\n1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange\nendstream\nendobj\n4 0 obj\n<<>>\nstream\nBT /F1 12 Tf 14 TL 40 700 Td "


@_query("pdf_ingest", "SELECT c_custkey, c_custkey % 5 = 4 AS damaged, CASE WHEN c_custkey % 5 = 4 THEN 'прочее' WHEN c_custkey % 2 = 0 THEN 'вход' ELSE 'выход' END AS direction, CASE WHEN c_custkey % 5 <> 4 THEN c_name END AS vessel_name, CAST(CASE WHEN c_custkey % 5 <> 4 THEN c_custkey END AS INT) AS gross_tonnage FROM customer")
def pdf_ingest(spark: SparkSession, d: str) -> DataFrame:
    line = lambda *parts: F.concat(F.lit("<"), F.hex(F.encode(F.concat(*parts), "UTF-16BE")), F.lit("> Tj T* "))
    lines = [line(F.lit("на "), F.when(F.col("c_custkey") % 2 == 0, "вход").otherwise("выход")), line(F.lit("Название судна "), F.col("c_name")), line(F.lit("Брутто/нетто")), line(F.col("c_custkey").cast("string"), F.lit(" / 7"))]
    whole = F.concat(F.lit(_PDF), *lines, F.lit("ET\nendstream\nendobj\ntrailer\n<</Root 1 0 R>>\n%%EOF\n"))
    content = F.when(F.col("c_custkey") % 5 == 4, F.substring(whole, 1, 50)).otherwise(whole).cast("binary")
    files = documents.spread(ad.load(spark, d, "customer").select("c_custkey", "c_name")).select(F.concat(F.lit("in/"), F.col("c_custkey"), F.lit(".pdf")).alias("path"), content.alias("content"))
    rows = documents.parse_documents(files)
    return rows.select(F.regexp_extract("file_path", r"(\d+)", 1).cast("bigint").alias("c_custkey"), (F.col("status") == "error").alias("damaged"), "direction", "vessel_name", "gross_tonnage")
