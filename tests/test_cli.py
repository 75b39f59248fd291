"""The command line's automatic mode: codes, code tables by folder, skipped folders."""

import pytest

from factloom import cli
from factloom.operators import summary
from factloom.plans import dims
from factloom.sinks import files
from factloom.sources.documents import ordered

PAGE = "玉山商業銀行股份有限公司\n" + "| 77777 | 某項目 | 5 |\n" * 5
ROWS = "folder string, ord int, term string, value double, matched_label string, source_file string, is_percent boolean, crosscheck_value double, note string"


def coding(path, code, sheet):
    return f"file://{files.write_workbook([(sheet, [('原會計項目及代碼', None, '', '', '', False, False), (code, None, '某項目', '', '', False, False)])], str(path))}"


def test_codes_are_the_union_of_workbooks_and_statements(spark, tmp_path):
    (balance, *_), (income, *_) = dims.STATEMENTS["balance_sheet"], dims.STATEMENTS["income_statement"]
    uris = [coding(tmp_path / "a.xlsx", "77777", balance), coding(tmp_path / "b.xlsx", "88888", balance), coding(tmp_path / "c.xlsx", "66666", income), coding(tmp_path / "d.xlsx", "55555", "other")]
    assert sorted(r.code for r in cli.all_codes(spark, uris).collect()) == ["66666", "77777", "88888"]


def test_each_filing_has_its_own_code_table_and_skipped_folders_are_named(spark, monkeypatch, capsys):
    pages = {"full": PAGE, "short": PAGE + "活期性存款比率", "nobank": PAGE.replace("玉山", "某某"), "text": "nothing"}
    docs = ordered(spark.createDataFrame([(f, "1.md", c) for f, c in pages.items()], "folder string, path string, content string"))
    asked = {}

    def filing_summary(some, kind, deck_ratios=None):
        asked[kind] = sorted(r.folder for r in some.collect())
        return spark.createDataFrame([(f, 1, "總資產", 1.0, "", "", False, None, "") for f in asked[kind]], ROWS)

    monkeypatch.setattr(summary, "filing_summary", filing_summary)
    monkeypatch.setattr(cli.deck, "deck_summary", lambda *a: spark.createDataFrame([], "folder string, ord int, term string, kind string, value double, matched_label string, period_label string, source_file string, note string"))
    codes = spark.createDataFrame([("77777",)], "code string")
    assert sorted({r.folder for r in cli.auto(docs, codes).collect()}) == ["full", "nobank", "short"]
    assert asked == {"full": ["full", "nobank"], "summarised": ["short"]}
    err = capsys.readouterr().err
    assert "skipped text: not a filing or deck (coded rows: 0, files with deck wording: 0)" in err and "skipped nobank: no bank is named" in err


def test_a_third_folder_is_refused(spark, tmp_path, capsys):
    with pytest.raises(SystemExit):
        cli.main([str(tmp_path / x) for x in "abc"])
    assert "at most 2 folders" in capsys.readouterr().err


def test_unpaired_folders_have_a_sheet_each(spark):
    rows = [("/x/a", "t", 1.0, "", "", "", False, True), ("/x/b", "t", 2.0, "", "", "", False, True)]
    out = spark.createDataFrame(rows, "folder string, term string, value double, term_found string, page string, note string, is_percent boolean, is_scaled boolean")
    assert [(n, len(r)) for n, r in cli.sheets_of(out, "/x/a")] == [("a", 1), ("b", 1)]
    assert [(n, len(r)) for n, r in cli.sheets_of(out.withColumn("place", cli.F.lit(1)), "/x/a")] == [("a", 2)]


def test_gaps_are_told_before_a_summary(spark, capsys):
    cli.warn_of_gaps(spark.createDataFrame([("f", 1, "甲", None), ("f", 2, "乙", None), ("f", 3, "丙", 1.0)], "folder string, ord int, term string, value double"))
    assert "2 of 3 summary rows are N/A for f" in capsys.readouterr().err


def test_all_statements_and_an_approximated_ratio(spark, tmp_path, monkeypatch):
    uri = coding(tmp_path / "coding.xlsx", "10000", dims.STATEMENTS["balance_sheet"][0])
    folder = tmp_path / "filing"
    folder.mkdir()
    (folder / "1.md").write_text("| 10000 | 資產總計 | 6,120 |", encoding="utf-8")
    approximated = spark.createDataFrame([(str(folder), None, None, None, None, None, "(approximated)", 4, None, 0.0077, None, 0.09, None, None, True)], "folder string, file_ord int, layout int, pos int, col int, period string, entity string, quarter int, roa_posttax double, roa_posttax_annualized double, roe_posttax double, roe_posttax_annualized double, profit_margin double, source_file string, used_fallback boolean")
    monkeypatch.setattr(cli, "ratios", lambda docs: approximated)
    out = tmp_path / "out.csv"
    read = lambda: out.read_text(encoding="utf-8-sig").splitlines()
    cli.main(["acct", str(folder), "all", "--coding", uri, "--csv", str(out)])
    assert read()[0].startswith("section,code,name,label_in_doc,value,confidence,page,period,entity") and read()[1].startswith("balance_sheet,10000,") and read()[-1] == "ratios,,,,,,,,(approximated),4,,0.77%,,9.00%,"
    cli.main(["acct", str(folder), "ratios", "--csv", str(out)])
    assert read() == ["metric,value_annualized_approximated", "ROA(稅後年化),0.77%", "ROE(稅後年化),9.00%"]
    monkeypatch.setattr(cli, "ratios", lambda docs: approximated.limit(0))
    cli.main(["acct", str(folder), "ratios", "--csv", str(out)])
    assert len(read()) == 1 and read()[0].startswith("error,")
    spark.catalog.clearCache()


DECK = "# 玉山金控 2025年第四季法人說明會\n## 放款結構\n單位：新台幣百萬元\n| 項目 | 4Q24 | 4Q25 |\n|---|---|---|\n| 企業放款 | 1000 | 1050 |\n"


def refused(url, timeout):
    raise OSError("no network")


@pytest.fixture
def deck_folder(tmp_path):
    (tmp_path / "deck").mkdir()
    (tmp_path / "deck" / "001.md").write_text(DECK)
    return tmp_path


@pytest.mark.filterwarnings("ignore")
def test_all_rows_are_printed_and_reports_written(spark, deck_folder, capsys):
    at = str(deck_folder / "deck")
    cli.main([at, "--landing", str(deck_folder / "l")], refused)
    lines = [line for line in capsys.readouterr().out.splitlines() if line.strip()]
    assert len(lines) == 13 and lines[0].startswith("folder") and any("企業放款" in line and "1.05" in line for line in lines)
    cli.main([at, "--landing", str(deck_folder / "l"), "--csv", str(deck_folder / "c"), "--reports", str(deck_folder / "r"), "--excel", str(deck_folder / "x.xlsx")], refused)
    made = {p.suffix for d in ("c", "r") for p in (deck_folder / d).iterdir()}
    assert made == {".csv", ".xlsx"} and (deck_folder / "x.xlsx").exists()
    cli.main(["call", "summary", "--folder", at, "--landing", str(deck_folder / "l"), "--reports", str(deck_folder / "k"), "--bank", "玉山"], refused)
    (only,) = (deck_folder / "k").iterdir()
    text = only.read_text(encoding="utf-8-sig").splitlines()
    assert len(text) == 13 and text[0] == "row,term,value,label_in_doc,period,page,note"
    spark.catalog.clearCache()


@pytest.mark.filterwarnings("ignore")
def test_npl_shows_the_published_figures(spark, tmp_path, capsys):
    cli.main(["npl", "--landing", str(tmp_path / "l"), "--year", "2025", "--quarter", "4"], refused)
    lines = capsys.readouterr().out.splitlines()
    assert len(lines) == 1 + len(dims.REGULATOR_NAMES) and "N/A" in lines[1]
    with pytest.raises(SystemExit):
        cli.main(["npl", "--year", "2025"], refused)


def test_coding_workbooks_are_found_by_industry(spark, tmp_path):
    docs = ordered(spark.createDataFrame([("f", "1.md", "玉山商業銀行股份有限公司")], "folder string, path string, content string"))
    for name in ("代碼-金融業.xlsx", "代碼-保險業.xlsx", "notes.txt"):
        (tmp_path / name).write_bytes(b"")
    assert cli.coding_path(docs, None, str(tmp_path), None).endswith("代碼-金融業.xlsx")
    assert cli.coding_path(docs, None, str(tmp_path), "保險業").endswith("代碼-保險業.xlsx")
    assert cli.coding_path(docs, ["x.xlsx"], str(tmp_path), "保險業") == "x.xlsx"
    with pytest.raises(ValueError, match="金控業"):
        cli.coding_path(docs, None, str(tmp_path), "金控業")
    assert [r.bank for r in cli.known(docs, "中國信託").collect()] == ["中信"] and cli.known(docs, None) is None
