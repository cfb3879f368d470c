"""Pieces of the oracle's SQL: the scalar functions and pricing in DuckDB's dialect."""

from __future__ import annotations

from .. import dims
from .adapters import DAYS_SQL, WORKS_SQL

STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def strip(x: str) -> str:
    return STRIP.format(x=x)


def work_type(x: str) -> str:
    low = f"lower({strip(x)})"
    exact = " ".join(f"WHEN {low} = '{a}' THEN '{c}'" for a, c in dims.WORK_TYPE_ALIASES)
    held = " ".join(f"WHEN contains({low}, '{a}') THEN '{c}'" for a, c in dims.WORK_TYPE_ALIASES)
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN NULL {exact} {held} ELSE {low} END"


def norm_name(x: str) -> str:
    return rf"regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}]', '', 'g')"


def tugs_in(x: str) -> str:
    marked = rf"regexp_replace(regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}_])и($|[^\p{{L}}\p{{N}}_])', '\1,\2', 'g'), '[,;/+]', ',', 'g')"
    return f"CASE WHEN {x} IS NULL THEN 1 ELSE CAST(len(list_filter(string_split({marked}, ','), lambda p: trim(p) <> '')) + 1 AS INT) END"


def minutes(a: str, b: str) -> str:
    return f"greatest(coalesce(date_sub('minute', {a}, {b}), 0), 0)"


def hm(x: str) -> str:
    return f"printf('%02d:%02d', CAST(({x}) // 60 AS BIGINT), CAST(({x}) % 60 AS BIGINT))"


def money(x: str) -> str:
    return f"printf('%.2f', {x})"


def rounded(x: str, n: int) -> str:
    return f"CAST(printf('%.{n}f', {x}) AS DOUBLE)"


def _values(rows: list[tuple]) -> str:
    show = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"CAST({v!r} AS DOUBLE)"
    return "VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


TARIFFS = f"tariffs(agent, work_type, unit, currency, rate) AS ({_values(dims.TARIFFS)})"
OPERATIONS = "operations(agent, work_type, currency, night_or_holiday, is_ice, amount) AS (" + _values(
    [(a, k, c, off, ice, amounts[2 * ice + off]) for a, k, c, *amounts in dims.OPERATION_TARIFFS for ice in (False, True) for off in (False, True)]
) + ")"

PRICED = f"""
WITH {WORKS_SQL}, {DAYS_SQL}, {TARIFFS}, {OPERATIONS},
features AS (
    SELECT w.*, coalesce(is_ice, false) AS ice, coalesce(agent, '') AS who, {work_type('work_type')} AS canonical, coalesce(started_dt, finished_dt) AS ref,
           {minutes('started_dt', 'finished_dt')} AS work_minutes, {minutes('left_base_dt', 'arrived_base_dt')} AS busy_minutes, {tugs_in('joint_with')} AS tug_count
    FROM works w),
periods AS (
    SELECT f.*, hour(ref) >= 22 OR hour(ref) < 6 OR coalesce(c.is_day_off, isodow(ref) >= 6) AS off FROM features f LEFT JOIN calendar_day c ON CAST(ref AS DATE) = c.day),
ruled AS (
    SELECT p.*, o.amount AS op_amount, o.currency AS op_currency, r.unit, r.currency AS rule_currency, r.rate, e.rate AS escort_rate, k.agent IS NOT NULL AS known,
           coalesce(gross_tonnage < 2000, false) AND o.amount IS NOT NULL AS per_op
    FROM periods p
    LEFT JOIN operations o ON p.who = o.agent AND p.canonical = o.work_type AND p.off = o.night_or_holiday AND p.ice = o.is_ice
    LEFT JOIN tariffs r ON p.who = r.agent AND p.canonical = r.work_type
    LEFT JOIN tariffs e ON p.who = e.agent AND e.work_type = 'сопровождение'
    LEFT JOIN (SELECT DISTINCT agent FROM tariffs) k ON p.who = k.agent),
base AS (
    SELECT *, CASE WHEN per_op THEN op_currency ELSE rule_currency END AS cur,
           CASE WHEN per_op THEN op_amount WHEN unit = 'per_ton' THEN CAST(gross_tonnage AS DOUBLE) * rate / CAST(tug_count AS DOUBLE) WHEN unit = 'per_hour' THEN rate * (CAST(work_minutes AS DOUBLE) / CAST(60 AS DOUBLE)) END AS base,
           CASE WHEN coalesce(escort_hours > 0, false) AND escort_rate IS NOT NULL THEN escort_rate * escort_hours END AS extra
    FROM ruled),
noted AS (
    SELECT *, CASE WHEN per_op THEN canonical || ' <2000 GRT, ' || CASE WHEN off THEN 'праздник/ночь' ELSE 'будни' END || CASE WHEN ice THEN ' (лёд)' ELSE '' END || ': ' || {money('base')} || ' ' || cur || ' за операцию'
                   WHEN unit = 'per_ton' THEN CAST(gross_tonnage AS VARCHAR) || ' x ' || {money('rate')} || ' ' || cur || CASE WHEN tug_count <> 1 THEN ' / ' || CAST(tug_count AS VARCHAR) || ' букс.' ELSE '' END || CASE WHEN ice THEN ' (лёд)' ELSE '' END || ' = ' || {money('base')}
                   WHEN unit = 'per_hour' THEN {money('rate')} || ' ' || cur || ' x ' || {hm('work_minutes')} || CASE WHEN ice THEN ' (лёд)' ELSE '' END || ' = ' || {money('base')} END
              || CASE WHEN extra IS NOT NULL THEN '; Сопровождение: ' || {hm('CAST(trunc(escort_hours * 60) AS BIGINT)')} || ' x ' || {money('escort_rate')} || ' = ' || {money('extra')} ELSE '' END AS note,
           {rounded('CASE WHEN extra IS NOT NULL THEN base + extra ELSE base END', 2)} AS total
    FROM base),
rated AS (
    SELECT n.*, CASE WHEN cur = 'RUB' THEN CAST(1 AS DOUBLE) ELSE x.rate END AS fx, CAST(coalesce(finished_dt, ref) AS DATE) AS fx_date
    FROM noted n LEFT JOIN fx_rate x ON CAST(coalesce(finished_dt, ref) AS DATE) = x.rate_date AND cur = 'USD'),
checked AS (
    SELECT *, CASE WHEN canonical IS NULL THEN 'Не указан вид работ' WHEN ref IS NULL THEN 'Не указаны даты работ'
                   WHEN NOT per_op AND NOT known THEN 'Нет тарифов для агента: ' || who
                   WHEN NOT per_op AND unit IS NULL THEN 'Нет тарифа для вида работ ''' || canonical || ''' у агента ''' || who || ''''
                   WHEN NOT per_op AND unit = 'per_ton' AND gross_tonnage IS NULL THEN 'Для тарифа за тонну нужен GRT из заявки'
                   WHEN fx IS NULL THEN 'Курс ' || cur || ' на ' || CAST(fx_date AS VARCHAR) || ' не найден в ответе ЦБ' END AS calc_error
    FROM rated),
priced AS (
    SELECT * EXCLUDE (rate), CASE WHEN calc_error IS NULL THEN total END AS amount, CASE WHEN calc_error IS NULL THEN cur END AS currency, CASE WHEN calc_error IS NULL THEN {rounded('fx', 4)} END AS cbr_rate,
           CASE WHEN calc_error IS NULL THEN {rounded('total * fx', 2)} END AS revenue_rub, CASE WHEN calc_error IS NULL THEN note END AS calc_note,
           CASE WHEN calc_error IS NULL THEN CASE WHEN per_op THEN 'per_operation' ELSE unit END END AS pricing
    FROM checked)"""
