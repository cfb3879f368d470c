"""Fixed reference data: tariffs, aliases, titles and settings, kept as data and not as code."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Tariffs (agent, work type, unit, currency, rate); there are no separate ice rates.
TARIFFS = [
    ("Транс-Агро", "швартовка", "per_ton", "USD", 0.50),
    ("Транс-Агро", "отшвартовка", "per_ton", "USD", 0.50),
    ("Транс-Агро", "перестановка", "per_hour", "USD", 100.0),
    ("Транс-Агро", "сопровождение", "per_hour", "USD", 1508.0),
    ("Транс-Агро", "обслуживание судна", "per_hour", "USD", 590.0),
    ("Транс-Агро", "обслуживание морских сооружений", "per_hour", "USD", 590.0),
    ("Транс-Агро", "околка льда", "per_hour", "USD", 200.0),
    ("МореСервис", "отшвартовка", "per_hour", "RUB", 64000.0),
    ("МореСервис", "швартовка", "per_hour", "RUB", 64000.0),
]
# Amounts per operation of small ships on weekdays, on holidays or at night, and both in ice.
OPERATION_TARIFFS = [
    ("Транс-Агро", "швартовка", "USD", 1000.0, 1500.0, 1200.0, 1800.0),
    ("Транс-Агро", "отшвартовка", "USD", 1000.0, 1500.0, 1200.0, 1800.0),
    ("Транс-Агро", "перестановка", "USD", 800.0, 1200.0, 1000.0, 1400.0),
]
# Spellings of work types; the first that a text holds decides, so the order counts.
WORK_TYPE_ALIASES = [
    ("вход", "швартовка"),
    ("швартовка", "швартовка"),
    ("выход", "отшвартовка"),
    ("отшвартовка", "отшвартовка"),
    ("перешвартовка", "перестановка"),
    ("перестановка", "перестановка"),
    ("сопровождение", "сопровождение"),
    ("обслуживание судна", "обслуживание судна"),
    ("обслуживание морских сооружений", "обслуживание морских сооружений"),
    ("околка льда", "околка льда"),
]
# Rows that a new installation starts with.
DEFAULT_TUGS = [("БК Коммунар", "k"), ("БК Пионер", "p")]
DEFAULT_AGENTS = ["Транс-Агро", "Содружество - Соя", "МореСервис"]
# Domains.
DIRECTIONS = ["вход", "выход", "прочее"]
STATUSES = ["new", "needs_review", "parsed", "confirmed", "matched", "calculated", "done", "error", "cancelled"]
RUBLE_CODES = ["RUB", "РУБ", "РУБЛЬ"]
FX_CODES = ["USD", "EUR"]


@dataclass(frozen=True)
class Settings:
    """Settings of an installation; ``from_conf`` reads each from ``spark.quaymaster.*``, else from the driver's environment (``QUAYMASTER_NIGHT_START_HOUR``).

    The thresholds steer pricing; ``data_dir`` is the root of the domain tables and of the landing folders.
    """

    night_start_hour: int = 22
    night_end_hour: int = 6
    gross_tonnage_threshold: int = 2000
    ue_currency: str = "USD"
    data_dir: str = "data"
    application_sender: str = ""

    @classmethod
    def from_conf(cls, spark: SparkSession) -> Settings:
        kinds = {f: type(getattr(cls, f)) for f in cls.__dataclass_fields__}
        given = {f: spark.conf.get(f"spark.quaymaster.{f}", os.environ.get(f"QUAYMASTER_{f.upper()}")) for f in kinds}
        return cls(**{f: kinds[f](value) for f, value in given.items() if value is not None})

    @property
    def applications_dir(self) -> str:
        return f"{self.data_dir}/incoming/applications"

    @property
    def vouchers_dir(self) -> str:
        return f"{self.data_dir}/incoming/vouchers"


def tariffs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*t, None) for t in TARIFFS], "agent string, work_type string, unit string, currency string, rate double, rate_ice double")


def operation_tariffs(spark: SparkSession) -> DataFrame:
    """One row per (agent, work type, night or holiday, ice), so that pricing is an equality join."""
    rows = [
        (agent, kind, currency, off, ice, amounts[2 * ice + off])
        for agent, kind, currency, *amounts in OPERATION_TARIFFS
        for ice in (False, True)
        for off in (False, True)
    ]
    return spark.createDataFrame(rows, "agent string, work_type string, currency string, night_or_holiday boolean, is_ice boolean, amount double")


def work_type_aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, a, c) for i, (a, c) in enumerate(WORK_TYPE_ALIASES, 1)], "ord int, alias string, canonical string")
