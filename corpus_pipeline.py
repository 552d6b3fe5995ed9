"""Training corpus from raw documents: five stages, each applying one operator of ``wattshare.llm``.

A stage is a function (spark, docs, sf_dir) -> DataFrame.  It works on all that its predecessor kept; ``run`` writes each
stage's rows as Parquet to the session's shared folder and reads them back for the next.  All but the last return the
columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wattshare.llm import stages
from wattshare.session import staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", stages.drop_toxic),
    ("line_dedup", stages.drop_repeated_lines),
    ("near_duplicates", stages.drop_near_duplicates),
    ("mixing", stages.mix_sources),
    ("packing", stages.pack),
]

#: Learned scores, edit distances and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
