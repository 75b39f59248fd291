"""Decks with the regulator's figures, by a fake transport."""

import csv
import io
import zipfile

import pytest

from factloom import cli
from factloom.operators import deck
from factloom.sources import regulator, workbooks
from factloom.sources.documents import ordered

DECK = "## 玉山銀行－放款結構\n單位：新台幣百萬元\n| 項目 | 4Q24 | 4Q25 |\n|---|---|---|\n| 企業放款 | 1000 | 1050 |\n"


def book(*sheets):
    """An .xlsx of sheets, each a list of rows of text."""
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    cell = lambda r, c, v: f'<c r="{chr(65 + c)}{r + 1}" t="inlineStr"><is><t>{v}</t></is></c>' if v else ""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="s{i}" r:id="r{i}"/>' for i in range(len(sheets))) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{main}"><sheetData>' + "".join(f"<row>{''.join(cell(r, c, v) for c, v in enumerate(row))}</row>" for r, row in enumerate(rows)) + "</sheetData></worksheet>")
    return out.getvalue()


def npl(ratio, coverage):
    head = [["資產品質"], ["銀行別", "逾期放款總額", "逾放", "備抵呆帳/"], ["", "", "比率", "逾期放款"], ["", "", "(%)", "(%)"]]
    other = [["銀行別", "逾期放款總額", "逾放比率(%)", "備抵呆帳/逾期放款(%)"], ["玉山商業銀行", "9", "99", "9999"]]
    return book([*head, ["玉山商業銀行", "1,234", ratio, coverage]], other)


def zipped(data):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.ods", b"")
        z.writestr("a.xlsx", data)
    return out.getvalue()


FILES = {
    "%E8%A1%A8114_12(2).xlsx": npl("0.15", "900.5"),
    "%E8%A1%A8114_09.xlsx": npl("5.0000000000000003E-2", "800"),
    "11412_x.zip": zipped(book([["金融機構名稱", "循環信用餘額"], ["玉山商業銀行", "17,911,768"]])),
}


def transport(broken=(), calls=None):
    def get(url, _):
        if calls is not None:
            calls.append(url)
        if url in (regulator.NPL.page, regulator.CARD.page):
            return "".join(f'<a href="/f/{n}">x</a>' for n in FILES).encode()
        name = url.rpartition("/")[2]
        if name in broken:
            raise RuntimeError("down")
        return FILES[name]

    return get


@pytest.fixture(scope="module")
def decks(spark):
    covers = {"q4": "玉山金控 2025年第四季法人說明會", "q3": "玉山金控 2025年第3季法人說明會", "new": "玉山金控 法人說明會", "none": "某公司 法人說明會"}
    rows = [(f, n, c) for f, cover in covers.items() for n, c in (("1.md", cover), ("2.md", DECK.replace("玉山銀行", "某公司") if f == "none" else DECK))]
    return ordered(spark.createDataFrame(rows, "folder string, path string, content string"))


def summary(docs, landing, get):
    rows = deck.deck_summary(docs, cli.official(docs, landing, get)).collect()
    docs.sparkSession.catalog.clearCache()
    assert len(rows) == 12 * docs.select("folder").distinct().count()
    return {(r.folder, r.term): r for r in rows}


def test_decks_take_the_figures_of_their_own_quarter(decks, tmp_path):
    calls = []
    with pytest.warns(UserWarning, match="114年9月"):  # cards of the third quarter: none so early, so the oldest
        got = summary(decks, str(tmp_path), transport(calls=calls))
    at = lambda f, t: (got[f, t].value, got[f, t].period_label)
    assert at("q4", "逾放比率") == at("new", "逾放比率") == (0.15, "114年12月") and at("q3", "逾放比率") == (0.05, "114年9月")
    assert at("q4", "備抵呆帳/逾期放款") == (900.5, "114年12月") and at("q3", "備抵呆帳/逾期放款") == (800.0, "114年9月")
    assert at("q4", "信用卡循環") == (pytest.approx(17.911768), "114年12月") and got["q3", "信用卡循環"].matched_label == "循環信用餘額（金管會114年12月）"
    assert at("none", "逾放比率") == (None, None) and got["none", "逾放比率"].note
    assert len(calls) == len(set(calls)) == 5


def test_a_dataset_fails_alone(decks, tmp_path):
    with pytest.warns(UserWarning, match="循環信用餘額 of 114年12月 is unavailable: down"):
        got = summary(decks.where("folder = 'q4'"), str(tmp_path / "a"), transport(["11412_x.zip"]))
    assert got["q4", "逾放比率"].value == 0.15 and got["q4", "信用卡循環"].value is None
    with pytest.warns(UserWarning, match="逾期放款總額"):
        got = summary(decks.where("folder IN ('q4', 'q3')"), str(tmp_path / "b"), transport(["%E8%A1%A8114_12(2).xlsx"]))
    assert got["q4", "逾放比率"].value is None and got["q3", "逾放比率"].value == 0.05 and got["q4", "信用卡循環"].value is not None


def test_a_changed_layout_is_an_error(spark, tmp_path):
    (tmp_path / "x.xlsx").write_bytes(book([["銀行別", "逾期放款總額"], ["玉山商業銀行", "1"]]))
    assert len(list(workbooks.cells((tmp_path / "x.xlsx").read_bytes()))) == 4
    with pytest.raises(RuntimeError, match="逾放比率"):
        regulator.sheet_figures(spark, str(tmp_path / "x.xlsx"), regulator.NPL, ["玉山商業銀行"])


def test_command_line_asks_the_regulator(spark, tmp_path, monkeypatch):
    folder = tmp_path / "deck"
    folder.mkdir()
    (folder / "1.md").write_text("玉山金控 2025年第四季法人說明會", encoding="utf-8")
    (folder / "2.md").write_text(DECK, encoding="utf-8")
    out = tmp_path / "out.csv"
    cli.main(["call", "--folder", str(folder), "--landing", str(tmp_path / "land"), "--csv", str(out)], transport())
    rows = {r["term"]: r["value"] for r in csv.DictReader(out.open(encoding="utf-8-sig"))}
    assert rows["逾放比率"] == "0.15" and rows["備抵呆帳/逾期放款"] == "900.5"
    both = {r.term: r.value for r in cli.auto(cli.documents.scan(spark, str(folder)), spark.createDataFrame([("10000",)], "code string"), str(tmp_path / "land"), transport()).collect()}
    assert both["逾放比率"] == 0.15
    spark.catalog.clearCache()
