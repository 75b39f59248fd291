"""Values of account codes and labels: equi-joins and first-wins aggregates over all codes in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numeric import nth_value


def code_facts(entries: DataFrame, period: int = 1) -> DataFrame:
    """entries with label (second cell, else the code) and value of a period."""
    label = F.coalesce(F.get("cells", F.lit(1)), F.col("code"))
    return entries.select("folder", "file_ord", "file_name", "entry_ord", "code", label.alias("label"), nth_value(F.col("cells"), period, F.col("stride")).alias("value"))


def in_periods(facts: DataFrame, periods: tuple[int, ...]) -> DataFrame:
    """A row for each row of facts (cells, stride) and period, with the value of that period."""
    each = F.array(*[F.struct(F.lit(p).alias("period"), nth_value(F.col("cells"), p, F.col("stride")).alias("value")) for p in periods])
    return facts.withColumn("p", F.explode(each)).select("*", "p.period", "p.value").drop("p")


def _first(facts: DataFrame, *keys: str) -> DataFrame:
    """The first fact with a value by file and line: label, value, file_name."""
    best = F.min_by(F.struct("label", "value", "file_name"), F.struct("file_ord", "entry_ord"))
    return facts.where("value IS NOT NULL").groupBy(*keys).agg(best.alias("f")).select(*keys, "f.label", "f.value", "f.file_name")


def find_codes(entries: DataFrame, codes: DataFrame, period: int = 1) -> DataFrame:  # O-80, O-82, O-100
    """folder, code, label, value, file_name for codes (code): a left semi join, then the first entry with a value."""
    return _first(code_facts(entries.join(codes.select("code").distinct(), "code", "left_semi"), period), "folder", "code")


def label_facts(rows: DataFrame, period: int = 1, second_only: bool = False) -> DataFrame:  # O-81
    """A fact for each table line of two or more cells: the label in its second cell, and unless second_only also that in its first (side 1)."""
    some = rows.where(F.col("line").startswith("|") & (F.size("cells") >= 2)).withColumn("value", nth_value(F.col("cells"), period, F.col("stride")))
    sides = [F.struct(F.lit(s).alias("side"), T.strip_footnote_suffix(F.get("cells", F.lit(1 - s))).alias("label")) for s in ((0,) if second_only else (0, 1))]
    return some.select("folder", "file_ord", "file_name", F.col("line_no").alias("entry_ord"), "value", F.explode(F.array(*sides)).alias("x")).select("*", "x.side", "x.label").drop("x")


def find_labels(rows: DataFrame, aliases: DataFrame, period: int = 1) -> DataFrame:  # O-101
    """folder, term, label, value, file_name for aliases (term, label): second cell before first cell within a line."""
    facts = label_facts(rows, period).join(aliases, "label").where("value IS NOT NULL")
    best = F.min_by(F.struct("label", "value", "file_name"), F.struct("file_ord", "entry_ord", "side"))
    return facts.groupBy("folder", "term").agg(best.alias("f")).select("folder", "term", "f.label", "f.value", "f.file_name")


def code_index(lines_rows: DataFrame, entries: DataFrame, codes: DataFrame, fallbacks: DataFrame, period: int = 1) -> DataFrame:  # O-102
    """folder, code, label, value, file_name for codes (folder, code): by code, and what has none by a label of fallbacks (folder, code, label) in the second cell."""
    by_code = _first(code_facts(entries, period).join(codes, ["folder", "code"], "left_semi"), "folder", "code")
    rest = fallbacks.join(by_code, ["folder", "code"], "left_anti")
    by_label = _first(label_facts(lines_rows, period, True).join(rest, ["folder", "label"]), "folder", "code")
    return by_code.unionByName(by_label)


def statement_rows(entries: DataFrame, dictionary: DataFrame, period: int = 1) -> DataFrame:  # O-107
    """Statement lines: for each file the first entry of each code of dictionary (code, name), low confidence without a value."""
    facts = code_facts(entries, period).join(dictionary, "code")
    first = F.min_by(F.struct("name", "label", "value", "entry_ord"), "entry_ord")
    one = facts.groupBy("folder", "file_ord", "file_name", "code").agg(first.alias("f"))
    confidence: Column = F.when(F.col("f.value").isNull(), "low").otherwise("high")
    return one.select("folder", "file_ord", "file_name", F.col("f.entry_ord").alias("entry_ord"), "code", "f.name", F.col("f.label").alias("label_in_doc"), "f.value", confidence.alias("confidence"))
