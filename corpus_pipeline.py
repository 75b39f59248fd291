"""A training corpus from documents: toxicity, quality, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the shared folder and
reads again as the next stage's docs.  Every stage sees all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import stages
from factloom.llm.common import rested, stored, table

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("quality", stages.drop_low_quality),
    ("near duplicates", stages.drop_near_duplicates),
    ("mixing", stages.mix_sources),
    ("tokens", stages.encode),
]

#: SQL can't express the trained stages, the schedule or the encoding; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rested(spark)
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = stored(docs, f"stage{number}")
            rested(spark)
    return docs
