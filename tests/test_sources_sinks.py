"""Sources, sinks and validation: scan order, workbooks there and back, landing, streaming, terms."""

import pyarrow as pa
import pytest

from factloom.operators import grid
from factloom.plans import dims
from factloom.sinks import files, markdown
from factloom.sources import documents, regulator, workbooks
from factloom.streaming import ingest

ROWS = [("總資產", 6120.884, "資產總計", "007", "", False, True), ("CIR", 52.5, "x", "", "", True, False), ("活存比", None, None, "", "none <found>", True, False), ("件數", 3.0, "n", "1", "", False, False)]


def write(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode(encoding))


def test_scan_orders_by_path_parts_and_drops_bad_bytes(spark, tmp_path):
    folder = tmp_path / "filing"
    write(folder, "a/b.md", "one")
    write(folder, "a-x/b.md", b"t\xffwo")
    write(folder, "0.md", "zero")
    write(folder, "note.txt", "no")
    found = {r.file_ord: r.content for r in documents.scan(spark, str(folder)).collect()}
    assert found == {1: "zero", 2: "one", 3: "two"}


def test_documents_pass_in_arrow_batches(spark, tmp_path):
    uri = f"file://{tmp_path}/docs"
    writer = markdown.DocumentWriter(uri)
    batch = pa.RecordBatch.from_arrays([pa.array(["f", "f", "g"]), pa.array(["b.md", "sub/a.md", "n.md"]), pa.array([b"\xffone\r\n", b"zero", None], pa.binary())], ["folder", "path", "content"])
    writer.commit([writer.write(iter([batch]))])
    rows = spark.createDataFrame([("g", "n.md", b"two"), ("h", "é+%41.md", b"a\xffb")], "folder string, path string, content binary")
    markdown.write_documents(rows, uri)  # replaces a file, leaves the others
    found = {p.relative_to(tmp_path / "docs").as_posix(): p.read_bytes() for p in (tmp_path / "docs").rglob("*") if p.is_file()}
    assert found == {"f/b.md": b"\xffone\r\n", "f/sub/a.md": b"zero", "g/n.md": b"two", "h/é+%41.md": b"a\xffb"}
    assert {r.file_ord: (r.file_name, r.content) for r in documents.scan(spark, uri).collect()} == {1: ("b.md", "one\r\n"), 2: ("a.md", "zero"), 3: ("n.md", "two"), 4: ("é+%41.md", "ab")}


def test_lines_of_written_documents(spark, tmp_path):
    uri = f"file://{tmp_path}/docs"
    rows = [("f", "b é+%41.md", b"one\xff\n\n 2 \r\n"), ("f", "docs/a.md", b"# head\n| a | b |\n"), ("f", "c.txt", b"no"), ("g", "a.md", b"last")]
    markdown.write_documents(spark.createDataFrame(rows, "folder string, path string, content binary"), uri)
    found = {(r.file_ord, r.file_name, r.line_no, r.line) for r in documents.scan_lines(spark, uri).collect()}
    assert found == {(1, "b é+%41.md", 0, "one"), (1, "b é+%41.md", 1, "2"), (2, "a.md", 0, "# head"), (2, "a.md", 1, "| a | b |"), (3, "a.md", 0, "last")}


def test_workbook_is_read_back_as_a_grid(spark, tmp_path):
    path = files.write_workbook([("甲", ROWS)], str(tmp_path / "out.xlsx"))
    got = {(r.r, r.c): r.value for r in workbooks.read_grid(spark, f"file://{path}").collect()}
    assert got[1, 0] == "總資產" and float(got[1, 1]) == 6120.884 and float(got[2, 1]) == 0.525 and got[3, 4] == "none <found>" and (3, 1) not in got
    assert workbooks.read_grid(spark, f"file://{path}", merged=True).count() == 0


def test_sheet_names():
    taken: set[str] = set()
    assert [files.sheet_name("/x/a:b", taken), files.sheet_name("/y/a:b", taken), len(files.sheet_name("z" * 40, taken))] == ["a_b", "a_b_2", 31]


def test_landing_fetches_once_and_lists_links(spark, tmp_path):
    calls = []

    def transport(url, _):
        calls.append(url)
        return b'<a href="/f/11301.xlsx">x</a><a href="/g/11301.xlsx">y</a><a href="/f/readme.xlsx">z</a>'

    for _ in range(2):
        regulator.landed("http://h/f/%E7%94%B2.xlsx", str(tmp_path / "land"), transport)
    assert len(calls) == 1 and (tmp_path / "land" / "甲.xlsx").exists()
    found = regulator.links(spark, "http://h", "xlsx", r"^(\d{3})(\d{2})\.xlsx$", transport).collect()
    assert [(r.y, r.m, r.url) for r in found] == [(113, 1, "/g/11301.xlsx")]
    with pytest.raises(RuntimeError):
        regulator.links(spark, "http://h", "ods", r"(\d{3})(\d{2})", transport)


def test_streaming_extracts_changed_folders(spark, tmp_path):
    root = tmp_path / "root"
    write(root, "f1/a.md", "| 10000 | x | 5 |")
    write(root, "f2/a.md", "text")
    count = lambda docs: docs.groupBy("folder").count()
    args = spark, f"file://{root}", str(tmp_path / "ck"), str(tmp_path / "out"), count
    ingest.extract_changed(*args).awaitTermination()
    write(root, "f1/b.md", "more")
    ingest.extract_changed(*args).awaitTermination()
    rows = lambda: sorted((r.folder, r["count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert rows() == [("f1", 2), ("f2", 1)]
    write(root, "f2/b.md", "more")
    none = lambda docs: count(docs).where("folder <> 'f2'")
    ingest.extract_changed(*args[:-1], none).awaitTermination()
    assert rows() == [("f1", 2)]


@pytest.mark.parametrize("spec", [{"aliases": [" "]}, {"components": [{"terms": []}]}, {"type": "fuzzy"}])
def test_malformed_terms_are_refused(spec):
    with pytest.raises(ValueError, match="t1"):
        dims.Term.of("t1", spec)


def test_banks_are_resolved_or_refused():
    assert dims.resolve_bank("中國信託") == "中信"
    with pytest.raises(ValueError):
        dims.resolve_bank("無")


def test_period_falls_forward_only_when_nothing_is_earlier(spark):
    links = spark.createDataFrame([(113, 2, "b"), (113, 5, "e")], "y int, m int, url string")
    asked = spark.createDataFrame([(1, None, None), (2, 113, 4), (3, 112, 1), (4, 113, 5)], "id int, y int, m int")
    got = {r.id: (r.url, r.exact) for r in grid.resolve_period(links, asked).collect()}
    assert got == {1: ("e", True), 2: ("b", False), 3: ("b", False), 4: ("e", True)}
