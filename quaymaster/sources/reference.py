"""Reference data: first rows of a new installation, and imports from a workbook."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import dims, schemas
from ..operators.state import append, insert_if_absent
from . import xlsx


def seed(spark: SparkSession, tugs: DataFrame, agents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Default tugs and agents that are not there yet."""
    new_tugs = insert_if_absent(tugs, spark.createDataFrame(dims.DEFAULT_TUGS, "name string, code string"))
    return new_tugs, insert_if_absent(agents, spark.createDataFrame([(a,) for a in dims.DEFAULT_AGENTS], "name string"))


def ensure_ships(ships: DataFrame, forms: DataFrame) -> DataFrame:
    """Ships (name, imo) of saved application forms that are not there yet; known ships keep their number."""
    return insert_if_absent(ships, forms.selectExpr("vessel_name AS name", "imo"))


def start(spark: SparkSession, settings: dims.Settings | None = None) -> dims.Settings:
    """A new or known installation made ready: tables that are missing, and default tugs and agents that are."""
    settings = settings or dims.Settings.from_conf(spark)
    root = f"{settings.data_dir}/tables"
    schemas.create_all(spark, root)
    for name, rows in zip(("tugs", "agents"), seed(spark, schemas.read(spark, root, "tugs"), schemas.read(spark, root, "agents")), strict=True):
        append(rows, root, name)
    return settings


def import_workbook(spark: SparkSession, data: bytes, tugs: DataFrame, agents: DataFrame) -> dict[str, DataFrame]:
    """New names of the sheets of tugs and agents; repeated and blank names are left out."""
    sheets = xlsx.read_sheets(data)
    names = lambda sheet: spark.createDataFrame([(n,) for n in xlsx.named_column(sheets, sheet, "Название")], "name string")
    return {"tugs": insert_if_absent(tugs, names("Буксиры")), "agents": insert_if_absent(agents, names("Агенты"))}


def import_into(spark: SparkSession, data: bytes, root: str) -> dict[str, int]:
    """Append a workbook's new tugs and agents to the stored tables; how many of each were added, counted while they are written."""
    new = import_workbook(spark, data, schemas.read(spark, root, "tugs"), schemas.read(spark, root, "agents"))
    return {name: append(rows, root, name) for name, rows in new.items()}
