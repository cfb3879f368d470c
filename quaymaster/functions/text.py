"""Scalar functions as Column expressions: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import FX_CODES, RUBLE_CODES, WORK_TYPE_ALIASES

_SPACE = r"(?U)\s+"
_LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_DATE_TIME = r"(\d{2})\.(\d{2})\.(\d{4}).{0,3}?(\d{1,2}):(\d{2})"
# Labels that the plain-text form of an application may hold.
TEXT_LABELS = ["Название судна", "№ ИМО", "Брутто/нетто", "Дата/время входа", "Дата/время выхода", "Пункт назначения"]


#: White space at the ends of a text, the information separators among it.
_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    return F.trim(x, F.lit(_BLANKS))


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, or a longer one where a column of ``frames`` has it already."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def clean(x: Column) -> Column:
    """Every run of white space is one space, none at the ends."""
    return strip(F.regexp_replace(x, _SPACE, " "))


def compact(x: Column) -> Column:
    return F.regexp_replace(x, _SPACE, "")


def blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(blank_to_null(c) for c in columns))


def _part(x: Column, pattern: str, group: int, kind: str = "int") -> Column:
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit("")).try_cast(kind)


def parse_date_time(x: Column) -> Column:
    """The first ``dd.mm.yyyy``, up to three characters and ``h:mm`` of a text without its spaces; null if it is no time."""
    d, mo, y, h, mi = (_part(compact(x), _DATE_TIME, i) for i in range(1, 6))
    return F.try_make_timestamp_ntz(y, mo, d, h, mi, F.lit(0).cast("decimal(16,6)"))


def int_pair(x: Column) -> Column:
    """``n / m`` as (first, second), else the first number alone."""
    c = compact(x)
    first = F.coalesce(_part(c, r"(\d+)/(\d+)", 1, "bigint"), _part(c, r"(\d+)", 1, "bigint"))
    return F.struct(first.alias("first"), _part(c, r"(\d+)/(\d+)", 2, "bigint").alias("second"))


def detect_direction(text: Column, subject: Column) -> Column:
    """Entry is looked for before exit, in the subject and the first 400 characters."""
    hay = F.lower(F.concat(F.coalesce(subject, F.lit("")), F.lit(" "), F.substring(F.coalesce(text, F.lit("")), 1, 400)))
    case = None
    for word in ("вход", "выход"):
        found = hay.contains(f"на {word}") | hay.rlike(rf"(?U)\b{word}\b")
        case = F.when(found, word) if case is None else case.when(found, word)
    return case.otherwise("прочее")


def norm_name(x: Column) -> Column:
    """Lower-cased letters and digits only; null is ''."""
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]", "")


def same_day(a: Column, b: Column, tolerance: int = 1) -> Column:
    return F.coalesce(F.abs(F.datediff(a, b)) <= tolerance, F.lit(False))


def direction_to_work_type(x: Column) -> Column:
    return F.when(x == "вход", "швартовка").when(x == "выход", "отшвартовка").otherwise(x)


def _canonical(low: Column) -> Column:
    case = F.when(low.isNull(), low)
    for alias, canonical in WORK_TYPE_ALIASES:
        case = case.when(low == alias, canonical)
    for alias, canonical in WORK_TYPE_ALIASES:
        case = case.when(low.contains(alias), canonical)
    return case.otherwise(low)


def _low(x: Column) -> Column:
    return F.when(x != "", F.lower(strip(x)))


def normalize_work_type(x: Column) -> Column:
    """The exact alias, else the first alias that the text holds, else the text; null and '' are null, blanks are ''."""
    return F.transform(F.array(_low(x)), _canonical)[0]  # bound once, however many aliases look at it


def with_work_type(df: DataFrame, x: Column, name: str) -> DataFrame:
    """``df`` with the normalised ``x``: the same in two projections, which generated code runs."""
    return df.withColumn(name, _low(x)).withColumn(name, _canonical(F.col(name)))


def tug_count(joint_with: Column) -> Column:
    """One more than the tugs named in ``joint_with``."""
    others = F.filter(F.transform(F.split(joint_with, r"(?U)[,;/]|\bи\b|\+"), strip), lambda p: p != "")
    return F.when(joint_with.isNull(), 1).otherwise(F.size(others) + 1)


def minutes_between(start: Column, end: Column) -> Column:
    return F.greatest(F.coalesce(F.timestamp_diff("MINUTE", start, end), F.lit(0)), F.lit(0))


def format_hm(minutes: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(minutes / 60), F.pmod(minutes, F.lit(60)))


def format_date_time(x: Column, pattern: str = "dd.MM.yyyy HH:mm", empty: str = "") -> Column:
    return F.coalesce(F.date_format(x, pattern), F.lit(empty))


def py_round(x: Column, digits: int) -> Column:
    """Rounds the exact binary value half to even."""
    return F.call_function("format_number", x, F.lit("0." + "0" * digits)).cast("double")


def money(x: Column) -> Column:
    return F.call_function("format_number", x, F.lit("0.00"))


def form_date_time(x: Column) -> Column:
    """``yyyy-mm-ddThh:mm`` or ``dd.mm.yyyy hh:mm``, else null."""
    iso = [_part(x, r"^(\d{4})-(\d{1,2})-(\d{1,2})T(\d{1,2}):(\d{1,2})$", i) for i in range(1, 6)]
    dotted = [_part(x, r"^(\d{1,2})\.(\d{1,2})\.(\d{4}) (\d{1,2}):(\d{1,2})$", i) for i in range(1, 6)]
    zero = F.lit(0).cast("decimal(16,6)")
    return F.coalesce(F.try_make_timestamp_ntz(*iso, zero), F.try_make_timestamp_ntz(dotted[2], dotted[1], dotted[0], dotted[3], dotted[4], zero))


def form_int(x: Column) -> Column:
    return F.when(strip(x).rlike("^[0-9]+$"), strip(x).try_cast("int"))


def form_decimal(x: Column) -> Column:
    t = F.replace(strip(x), F.lit(","), F.lit("."))
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))


def checkbox(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) != ""


def coerce_domain(x: Column, domain: list[str], other: str) -> Column:
    return F.when(x.isin(domain), x).otherwise(other)


def xml_number(x: Column, default: str) -> Column:
    return F.replace(F.replace(first_filled(x, F.lit(default)), F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def is_ruble(currency: Column) -> Column:
    return F.upper(currency).isin(RUBLE_CODES)


def has_fx_code(currency: Column) -> Column:
    return F.upper(currency).isin(FX_CODES)


def with_text_cells(df: DataFrame, text: Column, name: str = "cells") -> DataFrame:
    """``df`` with the known labels of a plain text as an array of (pos, label, value), without missing ones.

    A value is what follows its label on the line, or the next line, within 60 characters.
    """
    lines = F.filter(F.transform(F.split(text, _LINES), strip), lambda line: line != "")
    df = df.withColumn("_joined", F.array_join(lines, "\n"))
    places = {f"_at{i}": F.instr(F.col("_joined"), label) for i, label in enumerate(TEXT_LABELS)}
    tails = {f"_tail{i}": F.when(F.col(f"_at{i}") > 0, F.split(F.substr(F.col("_joined"), F.col(f"_at{i}") + len(label), F.lit(60)), "\n")) for i, label in enumerate(TEXT_LABELS)}
    found = []
    for i, label in enumerate(TEXT_LABELS):
        tail = F.col(f"_tail{i}")
        value = F.coalesce(blank_to_null(clean(F.get(tail, F.lit(0)))), blank_to_null(clean(F.get(tail, F.lit(1)))))
        found.append(F.struct(F.lit(i).alias("pos"), F.lit(label).alias("label"), value.alias("value")))
    df = df.withColumns(places).withColumns(tails).withColumn(name, F.filter(F.array(*found), lambda f: f["value"].isNotNull()))
    return df.drop("_joined", *places, *tails)


def label_field(label: Column) -> Column:
    """Which field a label feeds; the first that its lower-cased text holds."""
    low = F.lower(label)
    return (
        F.when(low.contains("название судна"), "vessel_name")
        .when(low.contains("имо"), "imo")
        .when(low.contains("брутто"), "tonnage")
        .when(low.contains("входа"), "entry")
        .when(low.contains("выхода") & ~low.contains("пункт"), "exit")
        .when(low.contains("назначения"), "destination")
    )


def last_wins(cells: Column) -> Column:
    """Of repeated labels the last value, at the first one's place: an array of (pos, label, value) in order."""
    labels = F.array_distinct(F.transform(cells, lambda c: c["label"]))
    return F.transform(
        labels,
        lambda label, i: F.struct(i.alias("pos"), label.alias("label"), F.element_at(F.filter(cells, lambda c: c["label"] == label), -1)["value"].alias("value")),
    )


def labelled(resolved: Column) -> Column:
    """(field, value) of the labels that feed a field, of resolved cells, in label order."""
    known = F.filter(resolved, lambda c: label_field(c["label"]).isNotNull())
    return F.transform(known, lambda c: F.struct(label_field(c["label"]).alias("field"), c["value"].alias("value")))


def with_fields(df: DataFrame, cells: Column) -> DataFrame:
    """``df`` with the typed application fields of (pos, label, value) cells.

    Of the labels that feed a field the last in label order wins, also where its value fails to parse.
    The cells are resolved once, in a column of their own that all fields read.
    """
    value = lambda field: F.try_element_at(F.filter("_fields", lambda c: c["field"] == field), F.lit(-1))["value"]
    texts = {f"_{f}": value(f) for f in ("imo", "tonnage", "entry", "exit")}
    df = df.withColumn("_cells", cells).withColumn("_cells", last_wins(F.col("_cells"))).withColumn("_fields", labelled(F.col("_cells"))).withColumns({"vessel_name": value("vessel_name"), "destination": value("destination"), **texts})
    df = df.withColumn("_pair", int_pair(F.col("_tonnage"))).withColumns({
        "imo": compact(F.col("_imo")), "gross_tonnage": F.col("_pair.first").try_cast("int"), "net_tonnage": F.col("_pair.second").try_cast("int"),
        "entry_datetime": parse_date_time(F.col("_entry")), "exit_datetime": parse_date_time(F.col("_exit")),
    })
    return df.drop("_cells", "_fields", "_pair", *texts)


#: The columns that ``with_fields`` adds.
FIELDS = ["vessel_name", "imo", "gross_tonnage", "net_tonnage", "entry_datetime", "exit_datetime", "destination"]
