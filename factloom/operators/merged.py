"""Rows of a filing and a deck as one list, and their export form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numeric as N
from ..functions import text as T
from ..plans.dims import MERGED_ORDER


def export_rows(rows: DataFrame, filing: bool) -> DataFrame:  # D19, O-51, O-168
    """pos, term, value, term_found, page, note, is_percent, is_scaled of summary rows; a filing's amounts in millions."""
    percent = F.col("is_percent") if filing else F.col("kind") == "ratio"
    value = N.exported(F.col("value"), percent) if filing else F.col("value")
    return rows.select("folder", F.col("ord").alias("pos"), "term", value.alias("value"), F.col("matched_label").alias("term_found"), T.page_num(F.col("source_file")).alias("page"), "note", percent.alias("is_percent"), F.lit(filing).alias("is_scaled"))


def merged(filing: DataFrame, deck: DataFrame, order: tuple[str, ...] = MERGED_ORDER) -> DataFrame:  # O-121
    """Rows of both sides (pos, term, ...) in the fixed order, the filing's before the deck's for a term; then unlisted terms, filing first.

    A listed term that a side repeats counts as its last; a deck row is dropped where the filing has its listed term.
    """
    spark = filing.sparkSession
    listed = F.broadcast(spark.createDataFrame([(t, i) for i, t in enumerate(order)], "term string, place int"))
    both = filing.withColumn("side", F.lit(0)).unionByName(deck.withColumn("side", F.lit(1))).join(listed, "term", "left")
    pick = Window.partitionBy("term").orderBy("side", F.desc("pos"))
    x = both.withColumn("n", F.row_number().over(pick)).where("place IS NULL OR n = 1")
    return x.withColumn("place", F.coalesce("place", F.lit(len(order)) + F.col("side"))).drop("n")


def combined(statements: DataFrame, ratios: DataFrame) -> DataFrame:  # O-16, O-154
    """Statement rows and ratio rows under one header, with a leading section; columns that a side lacks are null."""
    return statements.unionByName(ratios.withColumn("section", F.lit("ratios")), allowMissingColumns=True)


def folders_once(paths: DataFrame) -> DataFrame:  # O-138: the first of paths that are equal in lower case
    key = Window.partitionBy(F.lower("path")).orderBy("pos")
    return paths.withColumn("n", F.row_number().over(key)).where("n = 1").drop("n")
