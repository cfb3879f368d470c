"""Pricing of works: tariffs, periods, exchange rates and errors in one projection over broadcast dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as t


#: What pricing reads of a work, what it results in, and all columns that it sets.
INPUTS = ["agent", "work_type", "gross_tonnage", "started_dt", "finished_dt", "left_base_dt", "arrived_base_dt", "is_ice", "escort_hours", "tug_count"]
RESULTS = ["amount", "currency", "cbr_rate", "revenue_rub"]
PRICED = {*RESULTS, "work_minutes", "busy_minutes", "calc_note", "calc_error", "pricing"}


def is_night(ts: Column, settings: dims.Settings) -> Column:
    return (F.hour(ts) >= settings.night_start_hour) | (F.hour(ts) < settings.night_end_hour)


def with_day_off(df: DataFrame, day: Column, calendar_day: DataFrame, name: str = "day_off") -> DataFrame:
    """Whether ``day`` is a day off: by the calendar, else Saturday and Sunday are."""
    calendar = calendar_day.select(F.col("day").alias("_day"), F.col("is_day_off").alias("_listed"))
    joined = df.withColumn("_of", day).join(calendar, F.col("_of") == F.col("_day"), "left")
    return joined.withColumn(name, F.coalesce("_listed", F.weekday("_of") >= 5)).drop("_of", "_day", "_listed")


def price_works(works: DataFrame, fx_rate: DataFrame, calendar_day: DataFrame, settings: dims.Settings | None = None, tariffs: DataFrame | None = None, operation_tariffs: DataFrame | None = None) -> DataFrame:
    """``works`` with work_minutes, busy_minutes, amount, currency, cbr_rate, revenue_rub, calc_note, calc_error and pricing.

    ``works`` has agent, work_type, gross_tonnage, started_dt, finished_dt, left_base_dt, arrived_base_dt,
    is_ice, escort_hours and tug_count; its other columns stay, but for results of an earlier pricing, which the
    new ones replace.  Where calc_error is set, the results are null.  The fixed tariffs are small and broadcast;
    for tables that are passed, and for the rates and the calendar, Spark decides by size.
    """
    spark = works.sparkSession
    settings = settings or dims.Settings.from_conf(spark)
    tariffs = F.broadcast(dims.tariffs(spark)) if tariffs is None else tariffs
    operation_tariffs = F.broadcast(dims.operation_tariffs(spark)) if operation_tariffs is None else operation_tariffs
    kept = [c for c in works.columns if c.lower() not in PRICED]

    # all columns ride under numbers, so that no name of theirs can meet one of these; a plain column keeps the rows dealt out as they are
    df = works.select(*[F.col(f"`{c}`").alias(f"_work{i}") for i, c in enumerate(kept)], *INPUTS)
    ice, agent = F.coalesce("is_ice", F.lit(False)), F.coalesce("agent", F.lit(""))
    df = t.with_work_type(df, F.col("work_type"), "_type").withColumns({
        "_ice": ice, "_agent": agent, "_ref": F.coalesce("started_dt", "finished_dt"),
        "work_minutes": t.minutes_between(F.col("started_dt"), F.col("finished_dt")), "busy_minutes": t.minutes_between(F.col("left_base_dt"), F.col("arrived_base_dt")),
    })
    df = with_day_off(df, F.to_date("_ref"), calendar_day, "_off").withColumn("_off", is_night(F.col("_ref"), settings) | F.col("_off"))
    small = F.coalesce(F.col("gross_tonnage") < settings.gross_tonnage_threshold, F.lit(False))

    by_operation = operation_tariffs.select(F.col("agent").alias("_agent"), F.col("work_type").alias("_type"), F.col("night_or_holiday").alias("_off"), F.col("is_ice").alias("_ice"), F.col("currency").alias("_op_currency"), F.col("amount").alias("_op_amount"))
    rule = tariffs.select(F.col("agent").alias("_agent"), F.col("work_type").alias("_type"), F.col("unit").alias("_unit"), F.col("currency").alias("_rule_currency"), F.col("rate").alias("_plain"), F.col("rate_ice").alias("_ice_rate"))
    escort = tariffs.where(F.col("work_type") == "сопровождение").select(F.col("agent").alias("_agent"), F.col("rate").alias("_escort_rate"))
    agents = tariffs.select(F.col("agent").alias("_agent")).distinct().withColumn("_known", F.lit(True))
    df = df.join(by_operation, ["_agent", "_type", "_off", "_ice"], "left").join(rule, ["_agent", "_type"], "left")
    df = df.join(escort, "_agent", "left").join(agents, "_agent", "left")

    per_operation = small & F.col("_op_amount").isNotNull()
    divisor = F.when(F.col("tug_count") > 0, F.col("tug_count")).otherwise(1)
    ice_label = F.when(F.col("_ice"), " (лёд)").otherwise("")
    df = df.withColumns({"_rate": F.when(F.col("_ice") & (F.coalesce("_ice_rate", F.lit(0.0)) != 0), F.col("_ice_rate")).otherwise(F.col("_plain")), "_per_op": per_operation, "_divisor": divisor})
    base = (
        F.when(F.col("_per_op"), F.col("_op_amount"))
        .when(F.col("_unit") == "per_ton", F.col("gross_tonnage").cast("double") * F.col("_rate") / F.col("_divisor").cast("double"))
        .when(F.col("_unit") == "per_hour", F.col("_rate") * (F.col("work_minutes") / F.lit(60.0)))
    )
    df = df.withColumns({"_base": base, "_currency": F.when(F.col("_per_op"), F.col("_op_currency")).otherwise(F.col("_rule_currency"))})
    period = F.when(F.col("_off"), "праздник/ночь").otherwise("будни")
    note = (
        F.when(F.col("_per_op"), F.concat(F.col("_type"), F.lit(f" <{settings.gross_tonnage_threshold} GRT, "), period, ice_label, F.lit(": "), t.money(F.col("_base")), F.lit(" "), F.col("_currency"), F.lit(" за операцию")))
        .when(
            F.col("_unit") == "per_ton",
            F.concat(F.col("gross_tonnage").cast("string"), F.lit(" x "), t.money(F.col("_rate")), F.lit(" "), F.col("_currency"), F.when(F.col("_divisor") != 1, F.format_string(" / %d букс.", F.col("_divisor"))).otherwise(""), ice_label, F.lit(" = "), t.money(F.col("_base"))),
        )
        .when(F.col("_unit") == "per_hour", F.concat(t.money(F.col("_rate")), F.lit(" "), F.col("_currency"), F.lit(" x "), t.format_hm(F.col("work_minutes")), ice_label, F.lit(" = "), t.money(F.col("_base"))))
    )
    extra = F.when(F.coalesce(F.col("escort_hours") > 0, F.lit(False)) & F.col("_escort_rate").isNotNull(), F.col("_escort_rate") * F.col("escort_hours"))
    df = df.withColumns({"_note": note, "_extra": extra})
    escort_note = F.concat(F.lit("; Сопровождение: "), t.format_hm((F.col("escort_hours") * 60).cast("bigint")), F.lit(" x "), t.money(F.col("_escort_rate")), F.lit(" = "), t.money(F.col("_extra")))
    df = df.withColumns({
        "_note": F.when(F.col("_extra").isNotNull(), F.concat("_note", escort_note)).otherwise(F.col("_note")),
        "_amount": t.py_round(F.when(F.col("_extra").isNotNull(), F.col("_base") + F.col("_extra")).otherwise(F.col("_base")), 2),
        "_fx_date": F.to_date(F.coalesce("finished_dt", "_ref")),
    })
    rates = fx_rate.select(F.col("rate_date").alias("_fx_date"), F.upper("char_code").alias("_code"), F.col("rate").alias("_fx"))
    df = df.withColumn("_code", F.upper("_currency")).join(rates, ["_fx_date", "_code"], "left").withColumn("_fx", F.when(t.is_ruble(F.col("_currency")), 1.0).otherwise(F.col("_fx")))
    error = (
        F.when(F.col("_type").isNull(), "Не указан вид работ")
        .when(F.col("_ref").isNull(), "Не указаны даты работ")
        .when(~F.col("_per_op") & F.col("_known").isNull(), F.concat(F.lit("Нет тарифов для агента: "), F.col("_agent")))
        .when(~F.col("_per_op") & F.col("_unit").isNull(), F.concat(F.lit("Нет тарифа для вида работ '"), F.col("_type"), F.lit("' у агента '"), F.col("_agent"), F.lit("'")))
        .when(~F.col("_per_op") & (F.col("_unit") == "per_ton") & F.col("gross_tonnage").isNull(), "Для тарифа за тонну нужен GRT из заявки")
        .when(~F.col("_per_op") & ~F.col("_unit").isin("per_ton", "per_hour"), F.concat(F.lit("Неизвестная единица тарификации: "), F.col("_unit")))
        .when(~t.is_ruble(F.col("_currency")) & ~t.has_fx_code(F.col("_currency")), F.concat(F.lit("Неизвестный код валюты для ЦБ: "), F.col("_currency")))
        .when(F.col("_fx").isNull(), F.concat(F.lit("Курс "), F.col("_currency"), F.lit(" на "), F.col("_fx_date").cast("string"), F.lit(" не найден в ответе ЦБ")))
    )
    df = df.withColumn("calc_error", error)
    ok = F.col("calc_error").isNull()
    return df.select(
        *[F.col(f"_work{i}").alias(c) for i, c in enumerate(kept)], "work_minutes", "busy_minutes",
        F.when(ok, F.col("_amount")).alias("amount"), F.when(ok, F.col("_currency")).alias("currency"), F.when(ok, t.py_round(F.col("_fx"), 4)).alias("cbr_rate"),
        F.when(ok, t.py_round(F.col("_amount") * F.col("_fx"), 2)).alias("revenue_rub"), F.when(ok, F.col("_note")).alias("calc_note"), "calc_error",
        F.when(ok, F.when(F.col("_per_op"), "per_operation").otherwise(F.col("_unit"))).alias("pricing"),
    )


def recalculate(works: DataFrame, priced: DataFrame) -> DataFrame:
    """Results merged into ``works`` by id: a failed work keeps its old amounts and gets the error as its note."""
    name = t.unused("_new", works)
    new = F.col(name)
    merged = works.join(priced.select("id", F.struct(*RESULTS, "calc_note", "calc_error").alias(name)), "id", "left")
    hit, failed = new.isNotNull(), new["calc_error"].isNotNull()
    change = {c: F.when(hit & ~failed, new[c]).otherwise(F.col(c)) for c in RESULTS}
    change["calc_note"] = F.when(hit & failed, F.concat(F.lit("Ошибка расчёта: "), new["calc_error"])).when(hit, new["calc_note"]).otherwise(F.col("calc_note"))
    change["status"] = F.when(hit & failed, "error").when(hit, "calculated").otherwise(F.col("status"))
    return merged.withColumns(change).select(*[F.col(f"`{c}`") for c in works.columns])


def recalculate_stored(works: DataFrame, vouchers: DataFrame, fx_rate: DataFrame, calendar_day: DataFrame, ids: DataFrame | None = None, settings: dims.Settings | None = None) -> DataFrame:
    """Stored works (``schemas.SCHEMAS["works"]``) priced anew with the tugs of their vouchers; ``ids`` (column id) names those to do, None all."""
    chosen = works.select("id", "voucher_id", *[c for c in INPUTS if c != "tug_count"])
    chosen = chosen if ids is None else chosen.join(ids.select("id").distinct(), "id", "left_semi")
    joint = vouchers.select(F.col("id").alias("voucher_id"), t.tug_count(F.col("joint_with")).alias("_tugs"))
    chosen = chosen.join(joint, "voucher_id", "left").withColumn("tug_count", F.coalesce("_tugs", F.lit(1))).drop("_tugs")
    return recalculate(works, price_works(chosen, fx_rate, calendar_day, settings))
