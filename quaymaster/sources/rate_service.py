"""Daily exchange rates of a service as a Spark data source: one partition a day, and only the days that are asked for.

How a day's document is got is a function that is passed in (a client of the service, a folder, a test); nothing else is known of it here.
"""

from __future__ import annotations

import datetime
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

NAME = "quaymaster_rates"
SCHEMA = "rate_date date, char_code string, nominal int, value double, rate double, error string"
_DAY = datetime.timedelta(days=1)


def _number(text: str | None, default: str) -> float:
    return float((text or default).replace(" ", "").replace("\xa0", "").replace(",", "."))


def parse_day(document: bytes) -> list[tuple[str | None, int, float, float | None]]:
    """char_code, nominal, value and the value of one unit, of each currency of a day's document."""
    out = []
    for one in ET.fromstring(document).iter("Valute"):
        nominal, value = _number(one.findtext("Nominal"), "1"), _number(one.findtext("Value"), "0")
        out.append((one.findtext("CharCode"), int(nominal), value, value / nominal if nominal else None))
    return out


class _Day(InputPartition):
    def __init__(self, day: datetime.date):
        super().__init__(day)
        self.day = day


class _Reader(DataSourceReader):
    def __init__(self, fetch: Callable[[datetime.date], bytes], first: datetime.date, last: datetime.date):
        self.fetch, self.first, self.last = fetch, first, last
        self.days: set[datetime.date] | None = None
        self.codes: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("rate_date",) and isinstance(f, (EqualTo, In)):
                asked = {value} if isinstance(f, EqualTo) else set(value)
                self.days = asked if self.days is None else self.days & asked
            elif column == ("rate_date",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, value + _DAY * isinstance(f, GreaterThan))
            elif column == ("rate_date",) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.last = min(self.last, value - _DAY * isinstance(f, LessThan))
            elif column == ("char_code",) and isinstance(f, (EqualTo, In)):
                asked = {value} if isinstance(f, EqualTo) else set(value)
                self.codes = asked if self.codes is None else self.codes & asked
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if self.days is not None:
            return [_Day(d) for d in sorted(d for d in self.days if d is not None and self.first <= d <= self.last)]
        return [_Day(self.first + _DAY * i) for i in range((self.last - self.first).days + 1)]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:  # no day is asked for
            return
        try:
            rows = parse_day(self.fetch(partition.day))
        except Exception as e:  # whatever the service does, a day without rates is a row that says so
            yield (partition.day, None, None, None, None, f"{type(e).__name__}: {e}")
            return
        for code, nominal, value, rate in rows:
            if self.codes is None or code in self.codes:
                yield (partition.day, code, nominal, value, rate, None)


def rates(spark: SparkSession, fetch: Callable[[datetime.date], bytes], first: datetime.date, last: datetime.date, name: str = NAME) -> DataFrame:
    """rate_date, char_code, nominal, value, rate and error of all days from ``first`` to ``last``, a day a task.

    ``fetch`` gives a day's XML document and runs in the tasks.  Filters on days and codes reach the source, so other days aren't fetched;
    a day that can't be fetched or read is one row with an error and no code (which a filter on codes leaves out).
    """

    class Rates(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Reader(fetch, first, last)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Rates)
    return spark.read.format(name).load()


def rates_of(days: DataFrame, column: str, every: DataFrame) -> DataFrame:
    """The rows of ``every`` (``rates``) for the different days of a column; a century has 36,525 of them, so they are collected."""
    asked = [r[0] for r in days.select(F.to_date(column).alias("day")).where("day IS NOT NULL").distinct().collect()]
    return every.where(F.col("rate_date").isin(asked)) if asked else every.where(F.lit(False))
