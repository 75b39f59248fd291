"""Which axis of a table has the periods, where figures look like years."""

import pytest

from factloom.operators import matching
from factloom.operators import tables as X
from factloom.plans import dims


def table(spark, *lines):
    docs = spark.createDataFrame([("f", 1, "a.md", "\n".join(lines))], "folder string, file_ord int, file_name string, content string")
    return X.tables(X.doc_lines(docs))


@pytest.mark.parametrize("figure", [1898, 1900, 1950, 2025, 2098, 2100])
def test_figures_below_periods_are_no_years(spark, figure):
    t = table(spark, "## 玉山銀行－企業放款", "| 項目 | 4Q24 | 4Q25 |", "|--|--|--|", f"| 全行 | {figure} | {figure + 1} |", "| 占比 | 1% | 2% |")
    found = matching.candidates(t, matching.wanted([dims.curated_terms()["企業放款"]], require_absolute=True)).collect()
    assert [(r.value, r.period_label) for r in found] == [(float(figure + 1), "4Q25")]


def test_years_down_a_column(spark):
    t = table(spark, "| 項目 | 年 | 2024 |", "|--|--|--|", "| 企業放款 | 2023 | 5 |", "| 企業放款 | 2024 | 6 |")
    assert [(r.period_col, r.by_column) for r in matching.with_orientation(t).collect()] == [(1, False)]
