"""A filing and a deck end to end, with the values that their text states; and invariance to the order of files."""

import pytest
from pyspark.sql import functions as F

from factloom import cli
from factloom.operators import deck, matching, merged, summary
from factloom.operators import tables as X
from factloom.plans import dims
from factloom.sources.documents import ordered

SHEET = """# 資產負債表

114年12月31日

| 資產代碼 | 資產 | 金額 | % | 負債代碼 | 負債及權益 | 金額 | % |
|---|---|---|---|---|---|---|---|
| 13000 | 放款 | 3,900 | 63.7 | 20000 | 負債合計 | 5,600 | 91.5 |
| 10000 | 資產總計 | 6,120 | 100.0 | 30000 | 權益總計 | 520 | 8.5 |
"""
INCOME = """| 代碼 | 項目 | 金額 | % |
|---|---|---|---|
| 4xxxx | 淨收益 | 200 | 100.0 |
| 58500 | 員工福利費用 | (60) | 30.0 |
| 59000 | 折舊費用 | (30) | 15.0 |
| 59500 | 其他費用 | (10) | 5.0 |
| 61003 | 減：所得稅費用 | 8 | 4.0 |
|  | 本期稅後淨利（附註三） | 46 | 23.0 |
"""
DECK = """## 玉山銀行－放款結構
單位：新台幣百萬元
| 項目 | 4Q24 | 4Q25 |
|---|---|---|
| 企業放款占比 | 12.1% | 12.8% |
| 企業放款 | 1000 | 1050 |
| 房貸 | 800 | 830 |
| 個人擔保貸款 | 10 | 20 |
| ROA | 0.7 | 0.9 |
"""


def docs(spark, folder, files, seed=None):
    d = spark.createDataFrame([(folder, n, c) for n, c in files.items()], "folder string, path string, content string")
    return ordered(d if seed is None else d.repartition(3).orderBy(F.rand(seed)))


@pytest.mark.parametrize("seed", [None, 5])
def test_filing(spark, seed):
    files = {"1.md": "# 玉山商業銀行股份有限公司\n114年12月31日", "2.md": SHEET, "3.md": INCOME}
    got = {r.term: r for r in summary.filing_summary(docs(spark, "f", files, seed)).collect()}
    spark.catalog.clearCache()
    assert len(got) == 18
    want = {"總資產": 6120.0, "淨收益": 200.0, "營業費用": 100.0, "員工福利費用": 60.0, "所得稅費用": 8.0, "稅後淨利": 46.0, "CIR": 50.0, "評價及已實現": None, "ROA": None}
    assert {k: got[k].value for k in want} == want
    assert got["營業費用"].note.startswith("derived") and "49200" in got["評價及已實現"].note and got["稅後淨利"].matched_label == "本期稅後淨利" and got["ROA"].note


def test_deck_and_merge(spark):
    d = docs(spark, "d", {"1.md": "# 玉山金控 2025年第四季法人說明會", "2.md": DECK})
    rows = deck.deck_summary(d).cache()
    got = {r.term: r for r in rows.collect()}
    assert len(got) == 12 and got["企業放款"].value == pytest.approx(1.05) and got["房貸"].value == pytest.approx(0.85) and got["個人放款"].value is None
    assert deck.deck_ratios(d).first().roa == 0.9
    every = matching.all_matches(X.doc_lines(d), [dims.curated_terms()["企業放款"]]).collect()
    assert [(r.value, r.period_label) for r in every] == [(1050.0, "4Q25")]
    out = merged.merged(merged.export_rows(rows.limit(0).withColumn("is_percent", F.lit(True)), True), merged.export_rows(rows, False)).orderBy("place").collect()
    assert [r.term for r in out] == [t for t in dims.MERGED_ORDER if t in got]
    spark.catalog.clearCache()


def test_statement_falls_back_to_whole_files(spark):
    d = docs(spark, "f", {"1.md": SHEET, "2.md": "| 10000 | 資產 | - | 5.0 |"})
    dictionary = spark.createDataFrame([("10000", "資產總額"), ("30000", "權益")], "code string, name string")
    got = sorted((r.file_name, r.code, r.value, r.confidence) for r in cli.statement(d, dictionary, "balance_sheet").collect())
    assert got == [("1.md", "10000", 6120.0, "high"), ("1.md", "30000", 520.0, "high"), ("2.md", "10000", 5.0, "high")]


def test_ratios_from_the_formula(spark):
    sheet = SHEET.replace("%", "113年").replace("100.0", "5,880").replace("8.5", "480")
    d = docs(spark, "f", {"1.md": "# 玉山商業銀行股份有限公司", "2.md": sheet, "3.md": INCOME})
    rows = cli.ratios(d).collect()
    assert len(rows) == 1 and rows[0].used_fallback and rows[0].roa_posttax_annualized == pytest.approx(46 / 6000)
