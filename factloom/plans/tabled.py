"""Queries whose documents, cells and sheets grow with the tables: keyed by order, part, customer, supplier and page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import period as P
from ..functions import text as T
from ..operators import classify, deck, grid, matching, merged, profitability, rules
from ..operators import tables as X
from ..sinks import console, files, markdown, reports
from ..sources import documents, workbooks
from ..sources.staged import shared_dir, staged
from ..streaming import facts
from . import dims
from . import rendered as R


def _of(key: str, *forms: Column | str | None) -> Column:
    """One of several forms, by the key."""
    made = [F.lit(f).cast("string") if f is None or isinstance(f, str) else f for f in forms]
    return F.element_at(F.array(*made), (F.pmod(F.col(key), F.lit(len(made))) + 1).cast("int"))


def number_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of parts in eight notations, read back, and an eighth of price times size shown as a percentage."""
    p = R.table(spark, sf_dir, "part")
    n = F.call_function("format_number", F.round("p_retailprice").cast("long"), F.lit("#,##0"))
    wrap = lambda a, b: F.concat(F.lit(a), n, F.lit(b))
    cell = _of("p_partkey", n, wrap("(", ")"), wrap("（", "）"), wrap("NT$ ", ""), wrap("−", ""), F.concat(F.col("p_size"), F.lit(".5%")), "-", wrap("", "萬"))
    x = p.select("p_partkey", "p_size", cell.alias("cell")).withColumn("value", N.parse_numeric(F.col("cell")))
    return x.select("p_partkey", "value", N.format_pct(F.col("value") * F.col("p_size") / 8).alias("shown"))


def _labelled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = R.table(spark, sf_dir, "orders").withColumns({"y": F.year("o_orderdate"), "m": F.month("o_orderdate"), "q": F.quarter("o_orderdate")})
    yy = F.lpad(F.pmod("y", F.lit(100)).cast("string"), 2, "0")
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    half, month = F.ceil(F.col("q") / 2), F.date_format("o_orderdate", "MMM")
    label = _of("o_orderkey", say("FY", yy), say(F.col("q"), "Q", yy, "¹"), say(half, "H", yy), say(F.col("m"), "M", yy), F.col("y").cast("string"), say(month, "-", yy), say(F.col("y"), ".", F.lpad(F.col("m").cast("string"), 2, "0")), "企業放款")
    return o.withColumn("label", label)


def period_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of orders as period labels in seven forms, and one that is none."""
    x = _labelled_orders(spark, sf_dir).withColumn("p", P.parse_period_label(F.col("label")))
    return x.select("o_orderkey", "label", F.col("p.year").alias("year"), F.col("p.rank").alias("rank"), F.col("p.cumulative").alias("cumulative"))


def period_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of each customer's orders, the most recent period first; even customers prefer a fourth quarter."""
    x = _labelled_orders(spark, sf_dir).withColumn("period", P.parse_period_label(F.col("label"))).where("period IS NOT NULL")
    g = x.groupBy("o_custkey").agg(F.collect_list(F.struct("period", F.col("o_orderkey").alias("pos"), "label")).alias("items"))
    ranked = P.ranked(F.col("items"), F.pmod("o_custkey", F.lit(2)) == 0)
    return g.select("o_custkey", F.array_join(F.transform(ranked, lambda i: i.label), ",").alias("labels"))


def statement_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of orders as headers of statements: a day, a range, a dotted date, a fiscal year."""
    o = R.table(spark, sf_dir, "orders").withColumns({"y": F.year("o_orderdate") - 1911, "m": F.month("o_orderdate"), "d": F.dayofmonth("o_orderdate")})
    cell = _of("o_orderkey", F.format_string("%d年%d月%d日", "y", "m", "d"), F.format_string(" %d年1月1日 至 %d月%d日", "y", "m", "d"), F.format_string("%d.%02d.%02d", "y", "m", "d"), F.format_string("%d 年度", "y"), "項目")
    x = o.select("o_orderkey", cell.alias("cell")).withColumn("at", P.parse_header_date(F.col("cell")))
    return x.select("o_orderkey", "at.y", "at.m", "at.d", P.quarter_of_label(F.col("cell")).alias("quarter"))


def clean_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names as account labels with blanks between characters and footnotes."""
    c = R.table(spark, sf_dir, "customer")
    raw = _of("c_custkey", F.concat(F.lit("　總 資 產 "), "c_name"), F.concat("c_name", F.lit(" 淨收益（附註四、"), "c_nationkey", F.lit("）")), F.concat(F.lit("本 行(註 "), "c_nationkey", F.lit(")")), F.concat(F.lit("玉山 "), "c_name", F.lit(" 銀行")))
    shown = T.strip_footnote_suffix(T.strip_footnote(T.despace_cjk(F.col("raw"))))
    signed = N.apply_cost_sign(F.col("c_acctbal"), F.concat(_of("c_custkey", "減：", "", "減:"), "clean"), F.pmod("c_custkey", F.lit(5)) < 3)
    return c.withColumn("raw", raw).withColumn("clean", shown).select("c_custkey", "clean", signed.alias("shown"), T.display_width(F.col("clean")).alias("width"))


def entity_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the entities above tables, for a known and an unknown reporting bank."""
    c = R.table(spark, sf_dir, "customer")
    entity = _of("c_custkey", F.concat(F.lit("玉山銀行 "), "c_name"), "玉山金控", F.concat("c_name", F.lit(" Holdings")), "c_name", None, "國泰世華銀行", "", "某人壽")
    x = c.withColumn("entity", F.when(entity == "c_name", F.col("c_name")).otherwise(entity))
    primary = F.when(F.pmod("c_nationkey", F.lit(2)) == 0, F.array(F.lit("玉山銀"), F.lit("ESUN")))
    return x.select("c_custkey", matching.entity_tier(F.col("entity"), primary).alias("tier"))


def ratio_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' balances as a disclosed ratio, a deck's and a formula's: which counts, what checks it, and whether it can be."""
    s = R.table(spark, sf_dir, "supplier")
    some = lambda m, c: F.when(F.pmod("s_suppkey", F.lit(m)) != 0, c)
    disclosed, told, manual = some(3, F.col("s_acctbal") / 1000), some(4, F.col("s_acctbal") / 900), some(5, F.col("s_nationkey") / 4)
    p = profitability.prioritised("ROA", disclosed, told, manual, F.lit("114年12月31日"), F.col("s_name"))
    return s.select("s_suppkey", *[v.alias(n) for n, v in p.items()])


def ratio_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratio tables of suppliers' filings; those without a disclosure have one approximated row."""
    s = R.table(spark, sf_dir, "supplier").withColumn("folder", F.format_string("s%06d", "s_suppkey"))
    k = F.col("s_suppkey")
    text = R.text("獲利能力", "| 項目 | 稅別 | 114年9月30日 | 113年12月31日 |", "|--|--|--|--|", R.pipe("資產報酬率", "稅後", F.concat(F.col("s_nationkey"), F.lit(".5")), "0.5"), R.pipe("純益率", "", F.concat(k, F.lit(".25")), "-"))
    docs = R.documents(s.where("s_suppkey % 3 <> 0"), F.col("folder"), "a.md", text)
    manual = s.select("folder", F.lit(3).alias("quarter"), F.when(k % 2 == 0, F.col("s_acctbal") / 100).alias("manual_roa"), (F.col("s_acctbal") / 10).alias("manual_roe"))
    rows = profitability.ratio_rows(profitability.entries(docs, X.doc_lines(docs)), manual)
    return rows.select("folder", "period", "entity", "quarter", "roa_posttax", F.round("roa_posttax_annualized", 6).alias("roa_annualized"), F.round("roe_posttax_annualized", 6).alias("roe_annualized"), "profit_margin", "used_fallback")


def lone_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables whose heading names the term and whose rows don't: its value is that of the only row, and none where there are two."""
    s = R.table(spark, sf_dir, "supplier")
    row = lambda name, n: R.pipe(name, F.col("s_suppkey") * n, F.col("s_suppkey") * n + 1)
    text = R.text("## 玉山銀行－企業放款", "| 項目 | 4Q24 | 4Q25 |", "|--|--|--|", row("全行", 2), F.when(F.pmod("s_suppkey", F.lit(2)) == 1, row("海外", 3)), R.pipe("占比", "1%", "2%"))
    docs = R.documents(s, F.format_string("s%06d", "s_suppkey"), "a.md", text)
    found = matching.candidates(X.tables(X.doc_lines(docs)), matching.wanted([dims.curated_terms()["企業放款"]], require_absolute=True))
    return found.select("folder", "value", "matched_label", "period_label", "strength")


_BANKS = tuple(dims.REGULATOR_NAMES)


def deck_regulator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' decks, of four banks and one without, joined with a regulator's table made of each bank's quarters."""
    s = R.table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    year, quarter = F.lit(2020) + F.pmod(F.floor(k / 5), F.lit(4)), F.pmod(F.floor(k / 20), F.lit(4)) + 1
    cover = F.concat(F.lit("# "), _of("s_suppkey", *[f"{b}金控" for b in _BANKS], "某公司"), F.lit(" "), year.cast("string"), F.lit("年第"), quarter.cast("string"), F.lit("季法人說明會"))
    docs = R.documents(s, F.format_string("s%06d", "s_suppkey"), "001.md", R.text(cover, "", "## 放款結構", "單位：新台幣百萬元", "| 項目 | 3Q | 4Q24 |", "|--|--|--|", R.pipe("企業放款", "1", k)))
    n = R.nations(spark, sf_dir).agg(F.sum("cnt").alias("cnt"))
    quarters = [(name, y, q) for name in dims.REGULATOR_NAMES.values() for y in range(2020, 2024) for q in range(1, 4)]
    table = n.join(F.broadcast(spark.createDataFrame([(i, *x) for i, x in enumerate(quarters)], "i int, bank string, year int, quarter int")))
    at = F.format_string("%d/%d", "year", "quarter")
    table = table.select("bank", "year", "quarter", at.alias("card_period"), ((F.col("cnt") + F.col("i")) * 1000).cast("double").alias("revolving"), at.alias("npl_period"), (F.col("i") / 4).alias("npl_ratio"), F.when(F.col("i") % 3 > 0, F.col("cnt") / 8).alias("coverage"))
    rows = deck.deck_summary(docs, table).where(F.col("term").isin("信用卡循環", *deck.REGULATOR))
    return rows.select("folder", "term", F.round("value", 6).alias("value"), "period_label", (F.col("note") != "").alias("noted"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grid.page_links(R.table(spark, sf_dir, "pages").select(F.col("page_id").alias("page_url"), "html"))
    return found.select(F.col("page_url").alias("page_id"), "pos", "url", "name")


def coding_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coding sheet for each nation, of its customers' codes; those of every third are renamed in the revised block."""
    c = R.table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name")
    sheet, code = F.format_string("n%02d", "c_nationkey"), F.format_string("C%06d", "c_custkey")
    heads = [(0, 0, "資產負債表"), (1, 0, "修正前會計項目及代碼"), (1, 2, "修正後會計項目及代碼"), (1, 4, "修正說明"), (2, 0, "代碼"), (2, 1, "會計項目")]
    top = c.select(sheet.alias("sheet")).distinct()
    head = top.join(F.broadcast(spark.createDataFrame(heads, "r int, c int, value string")))
    renamed = F.pmod("c_custkey", F.lit(3)) == 0
    note = F.when(renamed, "a long remark on what the name was before, and why")
    cells = F.array(*[F.struct(F.lit(i).alias("c"), v.alias("value")) for i, v in enumerate((code, F.col("c_name"), F.when(renamed, code), F.when(renamed, F.concat(F.lit("new "), "c_name")), note))])
    body = c.select(sheet.alias("sheet"), (F.col("c_custkey") + 3).cast("int").alias("r"), F.explode(cells).alias("x")).select("sheet", "r", "x.c", "x.value").where("value IS NOT NULL")
    merges = top.join(F.broadcast(spark.createDataFrame([(1, 0, 1, 1), (1, 2, 1, 3)], "r0 int, c0 int, r1 int, c1 int")))
    return grid.coding_dictionary(grid.unmerged(head.unionByName(body), merges)).select("sheet", "code", "name")


def regulator_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet with a row for each supplier, under a stacked and a plain header; every fourth is missing."""
    s = R.table(spark, sf_dir, "supplier")
    heads = spark.createDataFrame([("s", 0, 0, "統計表"), ("s", 1, 0, "銀行 名稱"), ("s", 1, 1, "逾放"), ("s", 2, 1, "比率"), ("s", 1, 2, "餘額")], "sheet string, r int, c int, value string")
    shown = F.when(F.pmod("s_suppkey", F.lit(7)) == 0, "x").otherwise(F.call_function("format_number", F.col("s_acctbal"), F.lit("#,##0.00")))
    cells = F.array(*[F.struct(F.lit(i).alias("c"), v.alias("value")) for i, v in enumerate((F.concat(F.lit(" "), "s_name"), (F.col("s_suppkey") / 4).cast("string"), shown))])
    body = s.where("s_suppkey % 4 > 0").select(F.lit("s").alias("sheet"), (F.col("s_suppkey") + 4).cast("int").alias("r"), F.explode(cells).alias("x")).select("sheet", "r", "x.c", "x.value")
    headers = spark.createDataFrame([("逾放比率",), ("餘額",)], "header string")
    return grid.columns_by_bank(heads.unionByName(body), "銀行名稱", headers, s.select(F.col("s_name").alias("bank")))


def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as entities with planted faults: missing, extra, malformed, repeated and unknown values."""
    s = R.table(spark, sf_dir, "supplier")
    drop = lambda m, c: F.when(F.pmod("s_suppkey", F.lit(m)) != 0, c.cast("string"))
    name = F.when(F.pmod("s_suppkey", F.lit(13)) == 0, "Supplier#shared").otherwise(F.col("s_name"))
    code = F.when(F.pmod("s_suppkey", F.lit(17)) == 0, "bad code").otherwise(F.format_string("S%05d", "s_suppkey"))
    fields = {"name": name, "nation": drop(11, F.when(F.pmod("s_suppkey", F.lit(19)) == 0, 99).otherwise(F.col("s_nationkey"))), "code": code, "remark": F.when(F.pmod("s_suppkey", F.lit(23)) == 0, "x")}
    facts = s.select(F.format_string("e%06d", "s_suppkey").alias("entity"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in fields.items()])).alias("x")).select("entity", "x.field", "x.value")
    table = [("required", "name", None), ("required", "nation", None), ("required", "code", None), ("listed", None, None), ("pattern", "code", "^S[0-9]+$"), ("unique", "name", None), ("member", "nation", "nations")]
    nations = R.table(spark, sf_dir, "nation").select(F.lit("nations").alias("name"), F.col("n_nationkey").cast("string").alias("value"))
    return rules.violations(facts, spark.createDataFrame(table, "kind string, field string, argument string"), nations)


def paths_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' folders, of which some differ in case only: the first of each."""
    c = R.table(spark, sf_dir, "customer")
    segment = F.when(F.pmod("c_custkey", F.lit(2)) == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    return merged.folders_once(c.select(F.concat(F.lit("/in/"), segment, F.lit("/"), "c_nationkey").alias("path"), F.col("c_custkey").alias("pos"))).select("path", "pos")


def terms_by_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of parts and words of documents against many wordings at once: matches by term and strength."""
    p = R.table(spark, sf_dir, "part").select(F.col("p_type").alias("label"))
    d = R.table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("label"))
    labels = staged(p.union(d).where("label <> ''").groupBy("label").agg(F.count("*").alias("n")), "labels")
    found = matching.strengths(labels, automaton_terms())
    return found.join(labels, "label").groupBy("term", "strength").agg(F.count("*").alias("labels"), F.sum("n").alias("n"))


def automaton_terms() -> list[dims.Term]:
    return [
        dims.Term("brushed", aliases=("BRUSHED", "polished"), negatives=("TIN",)), dims.Term("small copper", True, ("SMALL PLATED COPPER",), ((("SMALL", "MEDIUM"), 0.5), (("COPPER",), 0.4)), 0.8), dims.Term("endings", aliases=("tion", "ment", "keit", "ción", "ing"), negatives=("the",)),
        dims.Term("articles", aliases=("the", "der", "la", "le", "el")), dims.Term("pairs", True, (), ((("en", "er"), 0.4), (("on", "an"), 0.3), (("th", "sch"), 0.3)), 0.7, ("zz",)),
    ]


def report_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook for each supplier with a row for each of its parts, written by the report sink and read back by the workbook source."""
    li = R.table(spark, sf_dir, "lineitem").repartition("l_suppkey").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("value"), F.max("l_returnflag").alias("flag"))
    k = F.col("l_partkey")
    rows = li.select(F.format_string("/in/s%06d", "l_suppkey").alias("folder"), k.alias("pos"), k.cast("string").alias("term"), "value", F.col("flag").alias("term_found"), F.lit("").alias("page"), F.when(k % 7 == 0, 'a "note" & <more>').alias("note"), (k % 3 == 0).alias("is_percent"), (k % 2 == 0).alias("is_scaled"))
    uri = f"{shared_dir(spark)}/reports"
    reports.write_reports(rows, uri, order=["pos"])
    cells = workbooks.read_grid(spark, uri).where("r > 0")
    at = lambda c: F.max(F.when(F.col("c") == c, F.col("value")))
    return cells.groupBy("sheet", "r").agg(at(0).cast("long").alias("part"), F.round(at(1).cast("double"), 6).alias("value"), at(2).alias("found"), at(4).alias("note")).select("sheet", "part", "value", "found", "note")


def console_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as lines of a terminal table, every second with wide characters."""
    c = R.table(spark, sf_dir, "customer")
    x = c.select("c_custkey", F.when(F.pmod("c_custkey", F.lit(2)) == 0, F.concat(F.lit("銀行　"), "c_name")).otherwise(F.col("c_name")).alias("name"), F.when(F.pmod("c_custkey", F.lit(3)) > 0, F.col("c_mktsegment")).alias("segment"), F.col("c_nationkey").alias("nation"))
    return console.laid_out(x, ["name", "segment", "nation"], ["c_custkey"])


def _files(spark: SparkSession, sf_dir: str) -> str:
    """Two files for each supplier, one in a subfolder named like the root, one with bytes that are no UTF-8; the root's URI."""
    s = R.table(spark, sf_dir, "supplier").withColumn("folder", F.format_string("s%06d", "s_suppkey"))
    one = F.concat(F.col("s_name").cast("binary"), F.lit(b"\xff\n\n 2 "), F.col("s_nationkey").cast("string").cast("binary"), F.lit(b"\r\n"))
    two = F.concat(F.lit("# head\n"), F.repeat(F.lit("| a | b |\n"), F.pmod("s_suppkey", F.lit(5)).cast("int"))).cast("binary")
    files = F.array(F.struct(F.lit("b é+%41.md").alias("path"), one.alias("content")), F.struct(F.lit("docs/a.md").alias("path"), two.alias("content")), F.struct(F.lit("c.txt").alias("path"), two.alias("content")))
    uri = f"{shared_dir(spark)}/docs"
    markdown.write_documents(s.select("folder", F.explode(files).alias("f")).select("folder", "f.path", "f.content"), uri)
    return uri


def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root as one document set: a file's place, name and text."""
    return documents.scan(spark, _files(spark, sf_dir)).select("file_ord", "file_name", F.md5(F.col("content").cast("binary")).alias("md5"))


def scanned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.scan_lines(spark, _files(spark, sf_dir)).select("file_ord", "file_name", "line_no", "line")


def streamed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' balances in files of 50 for each nation: read, then every third file changed, every fifth customer's nation given one more file, and only these read again."""
    c = R.table(spark, sf_dir, "customer").withColumns({"k": F.col("c_custkey"), "b": F.floor(F.col("c_custkey") / 50)})

    def files(factor: Column, some: Column, name: str) -> DataFrame:
        line = R.pipe(F.format_string("C%06d", "k"), F.col("c_name"), F.round(F.col("c_acctbal") * factor).cast("long"))
        rows = R.grouped_rows(c.where(some), ["c_nationkey", "b"], "k", line)
        return rows.select(F.format_string("n%02d", "c_nationkey").alias("folder"), F.format_string(name, "b").alias("path"), R.text("| 代碼 | 項目 | 金額 |", "|--|--|--|", F.col("rows")).alias("content"))

    base = shared_dir(spark)
    root, landing, sink = (f"{base}/{n}" for n in ("root", "landing", "sink"))
    for number, new in enumerate((files(F.lit(1), F.lit(True), "f%05d.md"), files(F.lit(10), F.col("b") % 3 == 0, "f%05d.md").unionByName(files(F.lit(7), F.col("k") % 5 == 0, "a/%05d.md")))):
        markdown.write_documents(new, root)
        facts.parse_changed(spark, root, landing)
        facts.fold(spark, landing, f"{base}/checkpoint", sink).awaitTermination()
    return facts.facts(spark, sink)


def csv_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of suppliers' parts in four shapes, written by tasks as a file for each supplier, and read back."""
    li = R.table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("value"))
    k = F.col("l_partkey")
    rows = li.select(
        F.format_string("s%06d", "l_suppkey").alias("folder"), k.cast("string").alias("code"), F.concat(F.lit("零件, "), k).alias("name"), F.concat(F.lit('say "'), k, F.lit('"')).alias("label_in_doc"), F.when(k % 4 > 0, F.col("value")).alias("value"), F.lit("high").alias("confidence"),
        F.format_string("%03d_x.md", F.pmod(k, F.lit(100))).alias("file_name"), k.cast("string").alias("term"), F.concat(F.lit("label "), k).alias("matched_label"), (k % 3 == 0).alias("is_percent"), F.when(k % 2 == 0, F.col("value") / 8).alias("crosscheck_value"), F.when(k % 6 == 0, "noted").otherwise("").alias("note"), F.lit("4Q25").alias("period_label"),
    )
    rows = staged(rows.withColumn("source_file", F.col("file_name")), "rows")  # four reports are written of them
    out, base = None, shared_dir(spark)
    for kind in ("statement", "filing", "deck", "matches"):
        written = files.with_folder(kind, rows)
        reports.write_reports(written, f"{base}/{kind}", "csv", [files.ORDER])
        read = reports.read_csv_reports(rows, f"{base}/{kind}", [c for c in written.columns if c != "folder"])
        key = F.col("code" if kind == "statement" else "term")
        label = {"statement": "label_in_doc", "filing": "term_found", "deck": "label_in_doc", "matches": "label_in_doc"}[kind]
        one = read.select(F.lit(kind).alias("kind"), "folder", key.cast("long").alias("part"), F.col(label).alias("label"), "value", "page", (F.col("note") if "note" in read.columns else F.lit(None).cast("string")).alias("note"), (F.col("crosscheck_value") if kind == "filing" else F.lit(None).cast("string")).alias("checked"))
        out = one if out is None else out.unionByName(one)
    return out


def term_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as the terms of a JSON file, looked for in a table of each supplier: every match with its period."""
    import json
    import os
    import tempfile

    p = R.table(spark, sf_dir, "part")
    brands = sorted(r[0] for r in p.select("p_brand").distinct().limit(1000).collect())  # a term file is small
    with tempfile.TemporaryDirectory() as at:
        path = os.path.join(at, "terms.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"_remark": 1} | {b: {"aliases": [f"{b.lower()} total"], "negative_terms": ["gone"]} for b in brands}, f)
        terms = dims.load_terms(path)
    s = R.table(spark, sf_dir, "supplier")
    x = s.join(p, s.s_suppkey == p.p_partkey - 1)
    docs = R.documents(x, F.format_string("s%06d", "s_suppkey"), "001.md", R.text("| 項目 | 4Q24 | FY24 |", "|--|--|--|", R.pipe(F.concat("p_brand", F.lit(" total")), F.col("p_size"), F.col("p_size") + 1), R.pipe(F.concat("p_brand", F.lit(" total, gone")), "1", "2")))
    found = matching.all_matches(X.doc_lines(docs), list(terms.values()))
    return found.select("folder", "term", "value", "period_label", "strength")


def deck_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROA and ROE of suppliers' decks, of the latest quarter or, for every third, only a year."""
    s = R.table(spark, sf_dir, "supplier")
    head = F.when(F.pmod("s_suppkey", F.lit(3)) == 0, "| 項目 | FY23 | FY24 |").otherwise("| 項目 | FY25 | 4Q25 |")
    v = lambda a, b: F.concat(F.col("s_nationkey") + a, F.lit(b))
    docs = R.documents(s, F.format_string("s%06d", "s_suppkey"), "001.md", R.text("## 獲利能力", head, "|--|--|--|", R.pipe("ROA", v(1, ".5"), v(2, ".25")), R.pipe("ROE", v(11, ".5"), F.when(F.pmod("s_suppkey", F.lit(4)) > 0, v(12, ".25%")).otherwise("-"))))
    banks = s.select(F.format_string("s%06d", "s_suppkey").alias("folder"), F.lit(None).cast("string").alias("bank"))
    return deck.deck_ratios(docs, banks).select("folder", "roa", "roe")


def bank_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' banks by name, alias or neither."""
    c = R.table(spark, sf_dir, "customer")
    name = _of("c_custkey", "玉山", "中國信託", "台北富邦", "無此銀行", "臺新", "國泰", "c_name")
    return classify.resolved(c.select("c_custkey", F.when(name == "c_name", F.col("c_name")).otherwise(name).alias("name"))).select("c_custkey", "name", "bank")


def shown_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals grouped by thousands and in billions, their ROC year and quarter's last month, and which lines are of a table of contents."""
    o = R.table(spark, sf_dir, "orders")
    line = _of("o_orderkey", F.concat(F.lit("一、財務報告 "), "o_custkey"), F.concat(F.lit("十二. 附註"), F.repeat(F.lit("…"), 5), "o_custkey", F.lit("-")), "一、財務報告", F.concat(F.lit("1、財務報告 "), "o_custkey"))
    return o.select("o_orderkey", N.format_value(F.floor("o_totalprice").cast("double")).alias("grouped"), N.thousands_to_billions(F.col("o_totalprice")).alias("billions"), N.roc_year(F.year("o_orderdate")).alias("roc"), N.quarter_end_month(F.quarter("o_orderdate")).alias("month"), T.is_toc_like(line).alias("contents"), N.add_all(F.col("o_totalprice"), F.when(F.col("o_orderkey") % 3 > 0, F.lit(1.0))).alias("added"))


QUERIES = {f.__name__: f for f in (number_cells, period_labels, period_preference, statement_dates, clean_labels, entity_tiers, ratio_priority, ratio_table, lone_candidates, deck_regulator, page_links, coding_sheets, regulator_columns, rule_violations, paths_once, terms_by_automaton, report_roundtrip, console_lines, scanned_files, scanned_lines, streamed_facts, csv_reports, term_matches, deck_figures, bank_names, shown_amounts)}

_LABELS = """WITH o AS (
  SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(quarter(o_orderdate) AS INT) AS q, o_orderkey % 8 AS f, strftime(o_orderdate, '%b') AS mon FROM orders
), p AS (
  SELECT o_orderkey, o_custkey, CASE f WHEN 0 THEN printf('FY%02d', y % 100) WHEN 1 THEN printf('%dQ%02d¹', q, y % 100) WHEN 2 THEN printf('%dH%02d', (q + 1) // 2, y % 100) WHEN 3 THEN printf('%dM%02d', m, y % 100)
    WHEN 4 THEN CAST(y AS VARCHAR) WHEN 5 THEN printf('%s-%02d', mon, y % 100) WHEN 6 THEN printf('%d.%02d', y, m) ELSE '企業放款' END AS label,
    CASE WHEN f IN (4, 6) THEN y WHEN f < 7 THEN 2000 + y % 100 END AS year, CASE WHEN f IN (0, 4) THEN 5.0 WHEN f IN (1, 5, 6) THEN q WHEN f = 2 THEN 2 * ((q + 1) // 2) WHEN f = 3 THEN m / 3 END::DOUBLE AS rank, CASE WHEN f < 7 THEN f = 3 END AS cumulative FROM o
)
"""
_TERM_ROWS = ", ".join(
    f"({i}, '{t.name}', {'true' if t.composite else 'false'}, {t.threshold}, {[*map(str.lower, t.aliases)]}::VARCHAR[], {[*map(str.lower, t.negatives)]}::VARCHAR[], {[[*map(str.lower, w)] for w, _ in t.components]}::VARCHAR[][], {[x for _, x in t.components]}::DOUBLE[])" for i, t in enumerate(automaton_terms())
)
_ACCT = "s_acctbal / 1000"
ORACLES = {
    "number_cells": """WITH p AS (SELECT p_partkey, p_size, CAST(round(p_retailprice) AS DOUBLE) AS n, p_partkey % 8 AS f FROM part),
v AS (SELECT *, CASE WHEN f IN (0, 3, 7) THEN n WHEN f IN (1, 2, 4) THEN -n WHEN f = 5 THEN p_size + 0.5 END AS value FROM p)
SELECT p_partkey, CAST(value AS DOUBLE) AS value, CASE WHEN value IS NULL THEN 'N/A' ELSE printf('%.2f%%', CAST(value * p_size / 8 AS DOUBLE)) END AS shown FROM v""",
    "period_labels": _LABELS + "SELECT o_orderkey, label, year, rank, cumulative FROM p",
    "period_preference": _LABELS + """, k AS (
  SELECT *, CASE WHEN o_custkey % 2 = 0 AND year = max(year) OVER (PARTITION BY o_custkey) AND rank = 4 AND NOT cumulative THEN 0 ELSE 1 END AS a FROM p WHERE year IS NOT NULL)
SELECT o_custkey, string_agg(label, ',' ORDER BY a, year DESC, rank DESC, o_orderkey) AS labels FROM k GROUP BY o_custkey""",
    "statement_dates": """SELECT o_orderkey, CASE WHEN f < 4 THEN y END AS y, CASE WHEN f < 3 THEN m WHEN f = 3 THEN 12 END AS m, CASE WHEN f < 3 THEN d WHEN f = 3 THEN 31 END AS d, CASE WHEN f < 2 THEN q END AS quarter
FROM (SELECT o_orderkey, o_orderkey % 5 AS f, CAST(year(o_orderdate) - 1911 AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(quarter(o_orderdate) AS INT) AS q FROM orders)""",
    "clean_labels": """WITH c AS (
  SELECT *, CASE c_custkey % 4 WHEN 0 THEN '總資產 ' || c_name WHEN 1 THEN c_name || ' 淨收益' WHEN 2 THEN '本行' ELSE '玉山 ' || c_name || ' 銀行' END AS clean FROM customer)
SELECT c_custkey, clean, CASE WHEN c_custkey % 5 < 3 AND c_custkey % 3 = 1 THEN -c_acctbal ELSE c_acctbal END AS shown, CAST(length(clean) + length(regexp_replace(clean, '[^一-鿿]', '', 'g')) AS INT) AS width FROM c""",
    "entity_tiers": """SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN CASE c_custkey % 8 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 5 THEN 0 WHEN 7 THEN 0 ELSE 1 END
  ELSE CASE c_custkey % 8 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 5 THEN 2 ELSE 1 END END AS tier FROM customer""",
    "ratio_priority": """WITH s AS (
  SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal / 1000 END AS d, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal / 900 END AS t, CASE WHEN s_suppkey % 5 <> 0 THEN s_nationkey / 4 END AS m FROM supplier
), v AS (SELECT *, coalesce(d, t, m) AS value, CASE WHEN d IS NOT NULL OR t IS NOT NULL THEN m END AS checked FROM s)
SELECT s_suppkey, value, CASE WHEN d IS NOT NULL THEN 'ROA(年) 稅後 @ 114年12月31日' WHEN value IS NOT NULL THEN 'ROA' END AS matched_label, CASE WHEN d IS NOT NULL THEN s_name END AS source_file, checked AS crosscheck_value,
  coalesce(value <> 0 AND ((value > 0) <> (checked > 0) OR greatest(abs(value), abs(checked)) / least(abs(value), CASE WHEN checked = 0 THEN 1e-9 ELSE abs(checked) END) > 2), false) AS diverges, coalesce(value NOT BETWEEN -5 AND 5, false) AS implausible FROM v""",
    "ratio_table": """SELECT printf('s%06d', s_suppkey) AS folder, '114年9月30日' AS period, '(this filing)' AS entity, 3 AS quarter, s_nationkey + 0.5::DOUBLE AS roa_posttax, round((s_nationkey + 0.5::DOUBLE) * 4 / 3, 6) AS roa_annualized, NULL::DOUBLE AS roe_annualized, s_suppkey + 0.25::DOUBLE AS profit_margin, false AS used_fallback FROM supplier WHERE s_suppkey % 3 <> 0
UNION ALL SELECT printf('s%06d', s_suppkey), '113年12月31日', '(this filing)', 4, 0.5, 0.5, NULL, NULL, false FROM supplier WHERE s_suppkey % 3 <> 0
UNION ALL SELECT printf('s%06d', s_suppkey), NULL, '(approximated)', 3, NULL, round(s_acctbal / 100 / 100, 6), round(s_acctbal / 10 / 100, 6), NULL, true FROM supplier WHERE s_suppkey % 6 = 0""",
    "lone_candidates": "SELECT printf('s%06d', s_suppkey) AS folder, CAST(s_suppkey * 2 + 1 AS DOUBLE) AS value, '企業放款' AS matched_label, '4Q25' AS period_label, 3 AS strength FROM supplier WHERE s_suppkey % 2 = 0",
    "deck_regulator": f"""WITH s AS (
  SELECT printf('s%06d', s_suppkey) AS folder, s_suppkey AS k, s_suppkey % 5 AS b, 2020 + (s_suppkey // 5) % 4 AS y, (s_suppkey // 20) % 4 + 1 AS q, (SELECT count(*) FROM customer) AS cnt FROM supplier
), r AS (SELECT *, CASE WHEN b < 4 AND q < 4 THEN b * 12 + (y - 2020) * 3 + q - 1 END AS i, printf('%d/%d', y, q) AS at_ FROM s)
SELECT folder, '信用卡循環' AS term, round((cnt + i) / 1000, 6) AS value, CASE WHEN i IS NOT NULL THEN at_ END AS period_label, i IS NULL AND b = 4 AS noted FROM r
UNION ALL SELECT folder, '{deck.REGULATOR[0]}', round(i / 4, 6), CASE WHEN i IS NOT NULL THEN at_ END, i IS NULL AND b = 4 FROM r
UNION ALL SELECT folder, '{deck.REGULATOR[1]}', CASE WHEN i % 3 > 0 THEN round(cnt / 8, 6) END, CASE WHEN i % 3 > 0 THEN at_ END, i IS NULL AND b = 4 FROM r""",
    "page_links": """SELECT page_id, CAST(i - 1 AS INT) AS pos, u[i] AS url, url_decode(regexp_extract(regexp_replace(u[i], '[?#].*$', ''), '[^/]*$')) AS name
FROM (SELECT page_id, u, unnest(range(1, len(u) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS u FROM pages))""",
    "coding_sheets": "SELECT printf('n%02d', c_nationkey) AS sheet, printf('C%06d', c_custkey) AS code, CASE WHEN c_custkey % 3 = 0 THEN 'new ' ELSE '' END || c_name AS name FROM customer",
    "regulator_columns": """SELECT s_name AS bank, '逾放比率' AS header, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey / 4 END AS value FROM supplier
UNION ALL SELECT s_name, '餘額', CASE WHEN s_suppkey % 4 > 0 AND s_suppkey % 7 <> 0 THEN round(s_acctbal, 2) END FROM supplier""",
    "rule_violations": """WITH s AS (SELECT printf('e%06d', s_suppkey) AS entity, * FROM supplier), n AS (SELECT count(*) FILTER (s_suppkey % 13 = 0) AS n FROM supplier)
SELECT 'missing' AS problem, entity, 'nation' AS field, NULL AS value FROM s WHERE s_suppkey % 11 = 0
UNION ALL SELECT 'extra', entity, 'remark', 'x' FROM s WHERE s_suppkey % 23 = 0
UNION ALL SELECT 'malformed', entity, 'code', 'bad code' FROM s WHERE s_suppkey % 17 = 0
UNION ALL SELECT 'repeated', entity, 'name', 'Supplier#shared' FROM s, n WHERE s_suppkey % 13 = 0 AND n > 1
UNION ALL SELECT 'unknown', entity, 'nation', '99' FROM s WHERE s_suppkey % 19 = 0 AND s_suppkey % 11 <> 0""",
    "paths_once": """SELECT path, pos FROM (SELECT '/in/' || CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END || '/' || c_nationkey AS path, c_custkey AS pos FROM customer)
QUALIFY row_number() OVER (PARTITION BY lower(path) ORDER BY pos) = 1""",
    "terms_by_automaton": f"""WITH l AS (
  SELECT label, lower(label) AS x, count(*) AS n FROM (SELECT p_type AS label FROM part UNION ALL SELECT unnest(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+')) FROM documents) WHERE label <> '' GROUP BY label
), t(i, term, composite, threshold, aliases, vetoes, parts, weights) AS (VALUES {_TERM_ROWS}),
f AS (SELECT l.*, term, CASE WHEN len(list_filter(vetoes, lambda v: contains(x, v))) > 0 THEN 0 WHEN list_contains(aliases, trim(x)) THEN 3 WHEN len(list_filter(aliases, lambda a: contains(x, a))) > 0 THEN 2
  WHEN composite AND list_sum([CASE WHEN len(list_filter(parts[j], lambda w: contains(x, w))) > 0 THEN weights[j] ELSE 0 END FOR j IN range(1, len(parts) + 1)]) >= threshold THEN 1 ELSE 0 END AS strength FROM l, t)
SELECT term, strength, count(*) AS labels, CAST(sum(n) AS BIGINT) AS n FROM f WHERE strength > 0 GROUP BY term, strength""",
    "report_roundtrip": """SELECT printf('s%06d', l_suppkey) AS sheet, l_partkey AS part, round(CASE WHEN l_partkey % 3 = 0 THEN sum(l_quantity) / 100 ELSE sum(l_quantity) END, 6) AS value, max(l_returnflag) AS found, CASE WHEN l_partkey % 7 = 0 THEN 'a "note" & <more>' END AS note
FROM lineitem GROUP BY l_suppkey, l_partkey""",
    "console_lines": """WITH x AS (
  SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '銀行　' || c_name ELSE c_name END AS name, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment ELSE 'N/A' END AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer
), w AS (SELECT *, length(name) + CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 0 END AS wide, max(wide) OVER () AS a, max(length(segment)) OVER () AS b FROM x)
SELECT c_custkey, name || repeat(' ', a - wide) || '  ' || rpad(segment, CAST(b AS INT), ' ') || '  ' || nation AS line FROM w""",
    "scanned_files": """SELECT CAST(row_number() OVER (ORDER BY folder, name) AS INT) AS file_ord, CASE name WHEN 'b' THEN 'b é+%41.md' ELSE 'a.md' END AS file_name, md5(content) AS md5 FROM (
  SELECT printf('s%06d', s_suppkey) AS folder, 'b' AS name, s_name || chr(10) || chr(10) || ' 2 ' || s_nationkey || chr(13) || chr(10) AS content FROM supplier
  UNION ALL SELECT printf('s%06d', s_suppkey), 'docs', '# head' || chr(10) || repeat('| a | b |' || chr(10), s_suppkey % 5) FROM supplier)""",
    "scanned_lines": """WITH f AS (
  SELECT s_suppkey, s_name, s_nationkey, CAST(2 * (row_number() OVER (ORDER BY s_suppkey) - 1) AS INT) AS n FROM supplier)
SELECT n + 1 AS file_ord, 'b é+%41.md' AS file_name, 0 AS line_no, s_name AS line FROM f UNION ALL SELECT n + 1, 'b é+%41.md', 1, '2 ' || s_nationkey FROM f
UNION ALL SELECT n + 2, 'a.md', 0, '# head' FROM f UNION ALL SELECT n + 2, 'a.md', CAST(i AS INT), '| a | b |' FROM (SELECT n, unnest(range(1, s_suppkey % 5 + 1)) AS i FROM f)""",
    "streamed_facts": """SELECT printf('n%02d', c_nationkey) AS folder, printf('C%06d', c_custkey) AS code, c_name AS label, CAST(round(c_acctbal * CASE WHEN c_custkey % 5 = 0 THEN 7 WHEN (c_custkey // 50) % 3 = 0 THEN 10 ELSE 1 END) AS DOUBLE) AS value,
  printf(CASE WHEN c_custkey % 5 = 0 THEN '%05d.md' ELSE 'f%05d.md' END, c_custkey // 50) AS file_name FROM customer""",
    "csv_reports": """WITH x AS (SELECT printf('s%06d', l_suppkey) AS folder, l_partkey AS k, sum(l_quantity) AS q FROM lineitem GROUP BY l_suppkey, l_partkey),
v AS (SELECT *, CASE WHEN k % 4 > 0 THEN q END AS value, format('{:03d}', k % 100) AS page FROM x)
SELECT 'statement' AS kind, folder, k AS part, 'say "' || k || '"' AS label, coalesce(format('{:,}', CAST(value AS BIGINT)), 'N/A') AS value, page, NULL AS note, NULL AS checked FROM v
UNION ALL SELECT 'filing', folder, k, 'label ' || k, CASE WHEN value IS NULL THEN 'N/A' WHEN k % 3 = 0 THEN printf('%.2f%%', value) ELSE format('{:,}', CAST(value AS BIGINT)) END, page, CASE WHEN k % 6 = 0 THEN 'noted' END, CASE WHEN k % 6 = 0 THEN printf('%.2f%%', q / 8) END FROM v
UNION ALL SELECT 'deck', folder, k, 'label ' || k, CAST(value AS VARCHAR), page, CASE WHEN k % 6 = 0 THEN 'noted' END, NULL FROM v
UNION ALL SELECT 'matches', folder, k, 'label ' || k, CAST(value AS VARCHAR), page, NULL, NULL FROM v""",
    "term_matches": "SELECT printf('s%06d', s_suppkey) AS folder, p_brand AS term, CAST(p_size + 1 AS DOUBLE) AS value, 'FY24' AS period_label, 3 AS strength FROM supplier JOIN part ON p_partkey = s_suppkey + 1",
    "deck_figures": """SELECT printf('s%06d', s_suppkey) AS folder, s_nationkey + 2.25::DOUBLE AS roa, CASE WHEN s_suppkey % 4 > 0 THEN s_nationkey + 12.25 ELSE s_nationkey + 11.5 END::DOUBLE AS roe FROM supplier""",
    "bank_names": """SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN '玉山' WHEN 1 THEN '中國信託' WHEN 2 THEN '台北富邦' WHEN 3 THEN '無此銀行' WHEN 4 THEN '臺新' WHEN 5 THEN '國泰' ELSE c_name END AS name,
  CASE c_custkey % 7 WHEN 0 THEN '玉山' WHEN 1 THEN '中信' WHEN 2 THEN '北富銀' WHEN 4 THEN '台新' WHEN 5 THEN '國泰' END AS bank FROM customer""",
    "shown_amounts": """SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS grouped, o_totalprice / 1e6 AS billions, CAST(year(o_orderdate) - 1911 AS INT) AS roc, CAST(quarter(o_orderdate) * 3 AS INT) AS month, o_orderkey % 4 < 2 AS contents, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice + 1 END AS added FROM orders""",
}
