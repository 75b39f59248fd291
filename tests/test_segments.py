"""Scans in segments against the scans of whole documents."""

import random
from collections import Counter

from pyspark.sql import functions as F

from factloom.operators import lookup, segments
from factloom.operators import tables as X
from factloom.sources import documents

CELLS = ["10000", "11000", "A123", "現金", "(1,234)", "5.5", "-", "", "1.2%", "備註 x"]
LINES = ["text", "# Head", "## 玉山－結構", "|---|---|", "|--|", "--|--", "---", "單位：千元", "\x0b", "| 代碼 | 項目 | 金額 | % |", "| 代碼 | 項目 | 金額 |", "| 資產代碼 | 名 | 數 | 負債代碼 | 名 | 數 |"]


def written(tmp_path, rng, n):
    folder = tmp_path / "docs"
    for k in range(n):
        lines = [rng.choice(LINES) if rng.random() < 0.45 else "| " + " | ".join(rng.choice(CELLS) for _ in range(rng.randint(1, 7))) + " |" for _ in range(rng.choice([1, 3, 40, 90]))]
        path = folder / ("sub" if k % 3 else "docs") / f"{k:02d} a+b%.md"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(rng.choice(["\n", "\r\n"]).join(lines).encode() + rng.choice([b"", b"\n\n", b"\xff"]))
    (folder / "empty.md").write_bytes(b"")
    return str(folder)


def rows(df, *columns):
    return Counter(tuple(str(r[c]) for c in columns) for r in df.collect())


def test_segments_give_what_whole_documents_give(spark, tmp_path):
    at = written(tmp_path, random.Random(2), 24)
    docs = documents.scan(spark, at)
    whole = X.split_lines(docs).persist()
    key = ["folder", "file_ord", "file_name", "line_no"]
    found = documents.scan_lines(spark, at).persist()
    assert rows(found, *key, "line") == rows(whole, *key, "line")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")  # files are cut within lines
    try:
        assert rows(documents.scan_lines(spark, at), *key, "line") == rows(whole, *key, "line")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for size in (1, 3, 1 << 14):
        t = segments.table_lines(found, size).persist()
        assert rows(t, *key, "cells", "pipe", "divider", "header", "header_line", "row_idx") == rows(X.table_lines(whole), *key, "cells", "pipe", "divider", "header", "header_line", "row_idx")
        heads = X.tables(whole).select("folder", "file_ord", "header_line", "heading")
        assert rows(t.where("header"), "folder", "file_ord", "header_line", "heading") == rows(heads, "folder", "file_ord", "header_line", "heading")
    plain = X.doc_lines(docs).persist()
    new = segments.unfolded(found, 3).persist()
    assert rows(new, *key, "line") == rows(plain, *key, "line")
    plain_rows, own_rows = X.row_lines(plain).persist(), segments.row_lines(new, 4).persist()
    assert rows(own_rows, *key, "cells", "stride") == rows(plain_rows, *key, "cells", "stride")
    entries = X.code_entries(plain_rows)
    for period in (1, 2, 3):
        fact = ("folder", "file_ord", "file_name", "entry_ord", "code", "label", "value")
        assert rows(segments.code_facts(own_rows, period), *fact) == rows(lookup.code_facts(entries, period), *fact)
    assert segments.code_facts(segments.row_lines(segments.unfolded(found.limit(0)))).count() == 0
    spark.catalog.clearCache()


def test_a_subfolder_named_like_its_root(spark, tmp_path):
    for name in ("docs/001.md", "docs/docs/001.md", "docs/it's [x]/docs/2.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    found = {r.content: r.file_ord for r in documents.scan(spark, str(tmp_path / "docs")).collect()}
    assert found == {"docs/001.md": 1, "docs/docs/001.md": 2, "docs/it's [x]/docs/2.md": 3}
    inner = documents.scan(spark, str(tmp_path / "docs/it's [x]")).collect()
    assert [r.content for r in inner] == ["docs/it's [x]/docs/2.md"]


def test_scans_and_numbers(spark):
    data = [(d, i, None if i % 3 else i, 1) for d in ("a", "b") for i in range(50)]
    df = spark.createDataFrame(data, "folder string, line_no long, v long, n int").repartition(5)
    got = segments.scanned(segments.cut(df, 7), "t", {"f": F.col("v")}, {"s": F.col("n")}, ["folder"]).collect()
    assert all(r.f == r.line_no - r.line_no % 3 and r.s == r.line_no for r in got) and len(got) == 100
    again = segments.numbered(df.withColumnRenamed("line_no", "o").withColumn("seg", F.floor(F.col("o") / 9)), ["folder"], ["o"], "seg")
    assert all(r.line_no == r.o for r in again.collect())
