"""Literal cases: inputs with the results that they must give, evaluated by both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import period as P
from ..functions import text as T

NUMBERS = [("1,234", 1234.0), ("(1.5)", -1.5), ("（2）", -2.0), ("-", None), ("–", None), ("N/A", None), ("", None), ("2萬", 2.0), ("12.5%", 12.5), ("1d", None), ("−3", -3.0), ("abc", None), (" 7 ", 7.0), ("NT$ 1,000", 1000.0), ("　8　", 8.0), ("(0)", 0.0), ("+4", 4.0), ("1.2.3", None), ("５", None), ("1e3", 1000.0)]
PERIODS = [("FY25", 2025, 5.0, False), ("2024", 2024, 5.0, False), ("4Q25", 2025, 4.0, False), ("5Q25", None, None, None), ("1H25", 2025, 2.0, False), ("9M25", 2025, 3.0, True), ("15M25", 2025, 5.0, True), ("Dec 24", 2024, 4.0, False), ("Mar-25", 2025, 1.0, False), ("2025.12", 2025, 4.0, False), ("2025/13", None, None, None), ("2Q25¹", 2025, 2.0, False), ("Jun 25<sup>1</sup>", 2025, 2.0, False), ("FY25/FY24 % Chg", None, None, None), ("4Q114", 2025, 4.0, False), ("企業放款", None, None, None)]
DATES = [("114年12月31日", 114, 12, 31, 4), ("114年1月1日至9月30日", 114, 9, 30, 3), ("113.12.31", 113, 12, 31, None), ("113 年度", 113, 12, 31, None), ("項目", None, None, None, None), ("114 年 3 月 31 日", 114, 3, 31, 1)]
SIGNS = [(-5.0, "營業費用", True, 5.0), (5.0, "減：所得稅費用", True, 5.0), (5.0, "減:所得稅", True, 5.0), (5.0, "所得稅", True, -5.0), (5.0, "淨收益", False, 5.0), (None, "營業費用", True, None), (3.0, None, True, -3.0)]
TEXTS = [("玉 山　銀 行", "玉山銀行"), ("總資產(註 3)", "總資產"), ("淨收益（附註四、五）", "淨收益"), ("玉山 Bank 銀行", "玉山 Bank 銀行"), ("本 行（註12）", "本行"), ("　前後　", "前後")]
TIERS = [("玉山銀行", "玉山銀", 2), ("玉山金控", "玉山銀", 0), ("放款結構", "玉山銀", 1), (None, "玉山銀", 1), ("玉山銀行", None, 2), ("某金控", None, 0), ("其他公司", None, 1)]
RATIOS = [(0.8, None, None, 0.8, None, False), (0.8, None, 0.7, 0.8, 0.7, False), (0.8, None, 2.0, 0.8, 2.0, True), (None, 1.1, 1.0, 1.1, 1.0, False), (None, None, 1.0, 1.0, None, False), (None, None, None, None, None, False), (0.8, None, -0.8, 0.8, -0.8, True), (0.0, None, 1.0, 0.0, 1.0, False), (0.8, 2.0, 0.0, 0.8, 0.0, True)]


def frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """Literal rows as a local relation, without Python on the executors."""
    return spark.createDataFrame(rows, schema)


def values(rows: list, columns: str, types: list[str]) -> str:
    """SELECT ... FROM VALUES for DuckDB."""

    def one(v, t: str) -> str:
        if v is None:
            return f"CAST(NULL AS {t})"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({str(v).upper() if isinstance(v, bool) else v} AS {t})"

    body = ", ".join("(" + ", ".join(one(v, t) for v, t in zip(r, types)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) t({columns})"


def parse_numeric_cases(spark: SparkSession, _: str) -> DataFrame:
    return frame(spark, [r[:1] for r in NUMBERS], "cell string").select("cell", N.parse_numeric(F.col("cell")).alias("value"))


def period_label_rank(spark: SparkSession, _: str) -> DataFrame:
    p = frame(spark, [r[:1] for r in PERIODS], "cell string").withColumn("p", P.parse_period_label(F.col("cell")))
    return p.select("cell", F.col("p.year").alias("year"), F.col("p.rank").alias("rank"), F.col("p.cumulative").alias("cumulative"))


def period_header_date(spark: SparkSession, _: str) -> DataFrame:
    p = frame(spark, [r[:1] for r in DATES], "cell string").withColumn("d", P.parse_header_date(F.col("cell")))
    return p.select("cell", "d.y", "d.m", "d.d", P.quarter_of_label(F.col("cell")).alias("quarter"))


def cost_sign(spark: SparkSession, _: str) -> DataFrame:
    return frame(spark, [r[:3] for r in SIGNS], "value double, label string, is_cost boolean").select("value", "label", "is_cost", N.apply_cost_sign(F.col("value"), F.col("label"), F.col("is_cost")).alias("shown"))


def cjk_normalise(spark: SparkSession, _: str) -> DataFrame:
    clean = T.strip_footnote_suffix(T.strip_footnote(T.despace_cjk(F.col("raw"))))
    return frame(spark, [r[:1] for r in TEXTS], "raw string").select("raw", clean.alias("clean"))


def entity_tier_filter(spark: SparkSession, _: str) -> DataFrame:
    from ..operators.matching import entity_tier

    primary = F.when(F.col("alias").isNotNull(), F.array("alias"))
    return frame(spark, [r[:2] for r in TIERS], "entity string, alias string").select("entity", "alias", entity_tier(F.col("entity"), primary).alias("tier"))


def roa_roe_priority(spark: SparkSession, _: str) -> DataFrame:
    from ..operators.profitability import prioritised

    x = frame(spark, [(i, *r[:3]) for i, r in enumerate(RATIOS)], "id int, disclosed double, deck double, manual double")
    p = prioritised("ROA", F.col("disclosed"), F.col("deck"), F.col("manual"), F.lit("114年12月31日"), F.lit("a.md"))
    return x.select("id", p["value"].alias("value"), p["crosscheck_value"].alias("crosscheck"), p["diverges"].alias("diverges"))


QUERIES = {f.__name__: f for f in (parse_numeric_cases, period_label_rank, period_header_date, cost_sign, cjk_normalise, entity_tier_filter, roa_roe_priority)}
ORACLES = {
    "parse_numeric_cases": values(NUMBERS, "cell, value", ["VARCHAR", "DOUBLE"]),
    "period_label_rank": values(PERIODS, "cell, year, rank, cumulative", ["VARCHAR", "INTEGER", "DOUBLE", "BOOLEAN"]),
    "period_header_date": values(DATES, "cell, y, m, d, quarter", ["VARCHAR", "INTEGER", "INTEGER", "INTEGER", "INTEGER"]),
    "cost_sign": values(SIGNS, "value, label, is_cost, shown", ["DOUBLE", "VARCHAR", "BOOLEAN", "DOUBLE"]),
    "cjk_normalise": values(TEXTS, "raw, clean", ["VARCHAR", "VARCHAR"]),
    "entity_tier_filter": values(TIERS, "entity, alias, tier", ["VARCHAR", "VARCHAR", "INTEGER"]),
    "roa_roe_priority": values([(i, r[3], r[4], r[5]) for i, r in enumerate(RATIOS)], "id, value, crosscheck, diverges", ["INTEGER", "DOUBLE", "DOUBLE", "BOOLEAN"]),
}
