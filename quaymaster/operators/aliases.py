"""Spellings in an alias table: the first one that a text holds decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def normalize(df: DataFrame, column: str, aliases: DataFrame, name: str) -> DataFrame:
    """``df`` with the canonical spelling of ``column`` as ``name``; ``aliases`` has ord, alias (lower case) and canonical.

    The text's own alias wins, else the one of the smallest ``ord`` that the text holds, else the lower-cased text stays; null and '' are null.

    Only different texts are looked up.  Of each all parts as long as some alias meet the aliases by equality, so thousands of aliases cost one
    join, whatever they begin with; the work follows the text's length and the number of alias lengths, not the number of aliases.
    Blank aliases are left out.
    """
    low, n, hit = (t.unused(c, df) for c in ("_low", "_length", "_canonical"))
    known = aliases.where(F.col("alias") != "").select("ord", "alias", F.col("canonical").alias(hit))
    lengths = known.agg(F.collect_set(F.length("alias")).alias("_lengths"))
    rows = df.withColumn(low, F.when(F.col(column) != "", F.lower(t.strip(F.col(column)))))
    texts = rows.select(low).where(F.col(low).isNotNull()).distinct()
    sized = texts.withColumn(n, F.explode(lengths.scalar())).where(F.col(n) <= F.length(low))
    starts = F.sequence(F.lit(1), F.length(low) - F.col(n) + 1)
    parts = sized.select(low, F.explode(F.array_distinct(F.transform(starts, lambda i: F.substr(F.col(low), i, F.col(n))))).alias("alias"))
    first = F.struct(F.col("alias") != F.col(low), "ord")
    found = parts.join(known, "alias").groupBy(low).agg(F.min_by(hit, first).alias(hit))
    return rows.join(found, low, "left").withColumn(name, F.coalesce(hit, low)).select(*[F.col(f"`{c}`") for c in df.columns if c != name], name)
