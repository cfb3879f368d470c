"""The corpus pipeline: five stages, each written as Parquet and read again before the next.

Edge cases, for every stage: null and empty texts are clean, have no near copies and stay (as one end token each
in the last stage); rows without an id stay; of repeated rows of an id one stays after ``join_near_copies``, and
before it each is judged alike; very long texts are judged whole; extra columns stay as they are, whatever their
names, up to the last stage, which has its own; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymaster.llm import decontaminate, ngram_join, packing, pii, toxicity
from quaymaster.llm.common import staged, table
from quaymaster.llm.queries import pii_key, tokenizer_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain model scores as toxic go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by near copies, the one with the smallest id stays."""
    return ngram_join.keep_one_per_component(docs, width=5, percent=80)


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a region of the benchmark go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data get surrogates; n_chars follows the new text."""
    columns = docs.columns
    out = pii.replace_pii(docs, pii_key(spark)).select(*[f"`{c}`" for c in columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces of sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("ngram_join", join_near_copies),
    ("decontamination", reject_contaminated),
    ("pii", replace_private),
    ("packing", pack_sequences),
]

#: SQL can express neither the fitted chain nor the tokenizer; tests check the stages by brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
