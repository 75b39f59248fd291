"""What each line and cell costs: trimming and sorting without a regular expression or a comparator for each place, with the results of before."""

from pyspark.sql import functions as F

from factloom.functions import numeric as N
from factloom.functions import text as T
from factloom.operators import segments
from factloom.operators import tables as X


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_trimming_by_characters_is_that_by_pattern(spark):
    points = [i for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([(chr(i) + " a" + chr(i) + "b 　" + chr(i),) for i in points] + [("",), (" \n",), (None,)], "s string")
    old = F.regexp_replace("s", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    assert df.where(~T.strip(F.col("s")).eqNullSafe(old)).count() == 0
    assert "regexp_replace" not in plan(df.select(T.strip(F.col("s"))))


def test_rows_dividers_and_numbers(spark):
    lines = ["|", "||", "| a | b |", "a | b", "|--|:-:|", "| - | |", "--|--", "---", "|---|x|", "　|--|　", "| :|- |", "|:::|", ""]
    df = spark.createDataFrame([(x,) for x in lines], "s string")
    found = {r.s: (r.c, r.d) for r in df.select("s", T.split_row(F.col("s")).alias("c"), T.is_divider(F.col("s")).alias("d")).collect()}
    assert {s for s, (_, d) in found.items() if d} == {"|", "||", "|--|:-:|", "| - | |", "--|--", "　|--|　"}
    assert found["|"][0] == [""] and found["||"][0] == [""] and found["| a | b |"][0] == ["a", "b"] and found["a | b"][0] == ["a", "b"]
    cells = {"(1,234)": -1234.0, "（ 5 ）": -5.0, "1.2%": 1.2, "-": None, "N/A": None, "3千元": 3.0, "−7": -7.0, "+.5": 0.5, "1e3": 1000.0, "-0": 0.0, "元": None, "a1": None, "1 2": 12.0, "": None, "NT$ 9": 9.0, "(x)": None}
    got = spark.createDataFrame([(c,) for c in cells], "c string").select("c", N.parse_numeric(F.col("c")).alias("v")).collect()
    assert {r.c: r.v for r in got} == cells


def test_entries_are_sorted_without_a_comparator(spark):
    lines = spark.createDataFrame([("a", 1, "f", i, f"| A{i:03d} | x | {i} |") for i in range(5)], "folder string, file_ord int, file_name string, line_no int, line string")
    entries = X.code_entries(X.row_lines(lines))
    assert "lambdafunction(if" not in plan(entries) and [r.code for r in entries.orderBy("entry_ord").collect()] == [f"A{i:03d}" for i in range(5)]


def test_scans_of_segments_stage_no_cells(spark, monkeypatch):
    made, stage = {}, segments.staged
    monkeypatch.setattr(segments, "staged", lambda df, name: made.setdefault(name, df) and stage(df, name))
    lines = spark.createDataFrame([("a", 1, "f", i, line) for i, line in enumerate(["| 代碼 | 項目 | 代碼 |", "|--|--|--|", "| A001 | x | 1 |", "| | y | 2 |"])], "folder string, file_ord int, file_name string, line_no int, line string")
    table = segments.table_lines(lines, 2)
    assert {(r.line_no, r.row_idx, r.right, len(r.cells)) for r in table.where("row_idx >= 0").collect()} == {(2, 0, 2, 3), (3, 1, 2, 3)}
    assert [(r.code, r.label, r.value) for r in segments.code_facts(segments.row_lines(lines, 2), 2).where("code = 'A001'").collect()] == [("A001", "x", 2.0)]
    assert all("cells" not in made[name].columns for name in ("runs", "headers", "stops", "entries", "islands"))
