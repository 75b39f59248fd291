"""Streams of changed files against batch results over the files as they stand."""

from pyspark.sql import functions as F

from factloom.operators import lookup
from factloom.operators import tables as X
from factloom.sinks import markdown
from factloom.sources.documents import ordered
from factloom.streaming import facts, ingest


def write(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_keys_of_folders_named_like_the_root(spark, tmp_path):
    root = tmp_path / "do'cs"
    for name in ("bankA/do'cs/1.md", "do'cs/do'cs/2.md", "3.md", "b[x]/4.md"):
        write(root, name, name)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(root))
    got = {(r.folder, r.path): r.content for r in ingest.keyed(raw, str(root)).collect()}
    assert got == {("bankA", "do'cs/1.md"): "bankA/do'cs/1.md", ("do'cs", "do'cs/2.md"): "do'cs/do'cs/2.md", ("b[x]", "4.md"): "b[x]/4.md"}
    count = lambda docs: docs.groupBy("folder").count()
    ingest.extract_changed(spark, str(root), str(tmp_path / "ck"), str(tmp_path / "out"), count).awaitTermination()
    assert {(r.folder, r["count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("bankA", 1), ("do'cs", 1), ("b[x]", 1)}


def test_state_replays_to_the_batch_result_and_parses_changed_files_only(spark, tmp_path):
    root, landing = tmp_path / "root", str(tmp_path / "landing")
    head = "| code | item | amount |\n|--|--|--|\n"

    def step():
        facts.parse_changed(spark, f"file://{root}", landing, most_files=3)
        facts.fold(spark, landing, str(tmp_path / "c2"), str(tmp_path / "sink")).awaitTermination()
        found = {tuple(r) for r in facts.facts(spark, str(tmp_path / "sink")).collect()}
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(str(root))
        docs = ordered(ingest.keyed(raw, str(root)))
        entries = X.code_entries(X.row_lines(X.doc_lines(docs)))
        batch = lookup.find_codes(entries, entries.select("code"))
        assert found == {(r.folder, r.code, r.label, r.value, r.file_name) for r in batch.collect()}
        return {(r.folder, r.path, r.version) for r in spark.read.schema(facts.LANDED).option("recursiveFileLookup", "true").parquet(landing).collect()}

    write(root, "f1/b.md", head + "| 10000 | x | 5 |\n| 11000 | y | - |\n| 12000 | z | 7 |")
    write(root, "f1/sub/c.md", head + "| 10000 | late | 6 |\n| 11000 | y2 | 8 |")
    write(root, "f2/a.md", head + "| 10000 | other | 1 |\n| 10000 | again | 2 |")
    write(root, "f2/empty.md", "text only")
    first = step()
    assert {(f, p) for f, p, _ in first} == {("f1", "b.md"), ("f1", "sub/c.md"), ("f2", "a.md"), ("f2", "empty.md")}
    write(root, "f1/a.md", head + "| 12000 | first | 1 |")  # comes before b.md
    write(root, "f2/a.md", head + "| 13000 | changed | 9 |")  # says something else now
    second = step()
    assert {(f, p) for f, p, _ in second - first} == {("f1", "a.md"), ("f2", "a.md")}
    (root / "f2/a.md").unlink()
    third = step()
    assert {(f, p) for f, p, _ in third - second} == {("f2", "a.md")}
    assert facts.parse_changed(spark, f"file://{root}", landing) == 0
    assert facts.facts(spark, str(tmp_path / "sink")).where(F.col("folder") == "f2").count() == 0


def test_written_documents_are_parsed_and_parsed_again_when_replaced(spark, tmp_path):
    root, landing, sink = (f"file://{tmp_path}/{n}" for n in ("root", "landing", "sink"))
    head = "| code | item | amount |\n|--|--|--|\n"

    def step(*files):
        markdown.write_documents(spark.createDataFrame(files, "folder string, path string, content string"), root)
        parsed = facts.parse_changed(spark, root, landing)
        facts.fold(spark, landing, f"file://{tmp_path}/ck", sink).awaitTermination()
        return parsed, {(r.folder, r.code, r.value, r.file_name) for r in facts.facts(spark, sink).collect()}

    kept = ("n2", "11000", 7.0, "b.md")
    assert step(("n1", "a.md", head + "| 10000 | x | 5 |"), ("n2", "b.md", head + "| 11000 | y | 7 |")) == (2, {("n1", "10000", 5.0, "a.md"), kept})
    assert step(("n1", "a.md", head + "| 10000 | x | 50 |")) == (1, {("n1", "10000", 50.0, "a.md"), kept})
    assert step(("n1", "a/0.md", head + "| 10000 | x | 500 |")) == (1, {("n1", "10000", 500.0, "0.md"), kept})


def test_the_root_is_not_listed_for_each_round(spark, tmp_path, monkeypatch):
    root, landing = tmp_path / "root", str(tmp_path / "landing")
    listed, real = [], facts._listed
    monkeypatch.setattr(facts, "_listed", lambda s, r, *paths: listed.append(len(paths)) or real(s, r, *paths))
    head = "| code | item | amount |\n|--|--|--|\n"
    for k in range(9):
        write(root, f"f{k % 2}/{k}.md", head + f"| 1000{k} | x | 5 |")
    assert facts.parse_changed(spark, f"file://{root}", landing, most_files=2) == 9
    assert listed == [0, 0]  # the listing, and one pass
    write(root, "f0/0.md", head + "| 10000 | changed | 15 |")
    write(root, "f0/2.md", head + "| 10002 | changed | 15 |")
    listed.clear()
    assert facts.parse_changed(spark, f"file://{root}", landing, most_files=1) == 2
    assert listed == [0, 1, 1]
