"""Queries over the base tables: documents rendered from them go through the extractor, and SQL computes the result directly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numeric as N
from ..functions import period as P
from ..functions import text as T
from ..operators import classify, deck, grid, lookup, matching, merged, profitability, segments, summary
from ..operators import tables as X
from ..sources.staged import staged
from . import dims
from . import rendered as R
from .cases import frame


def filing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = summary.filing_summary(R.filings(spark, sf_dir))
    return rows.select("folder", "ord", "term", F.round("value", 6).alias("value"), F.round("crosscheck_value", 6).alias("crosscheck_value"), "source_file", "is_percent")


_AMOUNTS = """WITH n AS (
  SELECT n_nationkey AS k, count(c_custkey) AS cnt FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey
), a AS (SELECT *, printf('filing%03d', k) AS folder, k % 2 AS bank FROM n)
"""


def _v(m: int) -> str:
    return f"CAST(cnt * 10 * {m} + k AS DOUBLE)"


def _filing_oracle() -> str:
    terms = [
        (1, "總資產", _v(1000), "'007_bs.md'"), (2, "淨收益", _v(90), None), (3, "利息淨收益", _v(1), None), (4, "手續費淨收益", _v(2), None),
        (5, "評價及已實現", f"CASE WHEN bank = 0 THEN {_v(3)} + {_v(4)} + {_v(6)} ELSE {_v(3)} + {_v(4)} + {_v(5)} + {_v(6)} END", None),
        (6, "其他非利息收益", f"CASE WHEN bank = 0 THEN {_v(7)} + {_v(8)} + {_v(10)} ELSE {_v(7)} + {_v(8)} + {_v(9)} END", None),
        (7, "營業費用", f"CASE WHEN k % 3 <> 0 THEN {_v(60)} ELSE {_v(30)} + {_v(12)} + {_v(18)} END", None), (8, "員工福利費用", _v(30), None), (9, "折舊及攤銷費用", _v(12), None), (10, "其他費用", _v(18), None),
        (11, "呆帳提存(收回)", _v(11), None), (12, "稅前淨利", _v(25), None), (13, "所得稅費用", _v(5), None), (14, "稅後淨利", _v(20), None),
    ]
    parts = [f"SELECT folder, {o} AS ord, '{t}' AS term, {v} AS value, NULL::DOUBLE AS crosscheck_value, {f or chr(39) + '008_is.md' + chr(39)} AS source_file, false AS is_percent FROM a" for o, t, v, f in terms]
    parts.append("SELECT folder, 15, '活存比', NULL, NULL, NULL, true FROM a")
    cost = f"(CASE WHEN k % 3 <> 0 THEN {_v(60)} ELSE {_v(30)} + {_v(12)} + {_v(18)} END)"
    parts.append(f"SELECT folder, 16, 'CIR', round({cost} / nullif({_v(90)}, 0) * 100, 6), NULL, NULL, true FROM a")
    for o, term, now, then, said in ((17, "ROA", 1000, 900, "(10 + k) / 100.0"), (18, "ROE", 200, 140, "k + 0.5")):
        manual = f"round({_v(20)} / nullif(({_v(now)} + {_v(then)}) / 2, 0) / 4 * 4 * 100, 6)"
        parts.append(f"SELECT folder, {o}, '{term}', CASE WHEN k % 5 = 0 THEN CAST({said} AS DOUBLE) ELSE {manual} END, CASE WHEN k % 5 = 0 THEN {manual} END, CASE WHEN k % 5 = 0 THEN '010_prof.md' END, true FROM a")
    return _AMOUNTS + " UNION ALL ".join(parts)


def derived_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders, _, lines, entries = summary.parsed(R.filings(spark, sf_dir))
    rows = summary.layout_rows(folders, lines, entries).where(F.col("term") == "營業費用")
    return rows.select("folder", "value", F.col("note").startswith("derived").alias("derived"))


def coverage_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = R.nations(spark, sf_dir)
    rows = n.select("folder", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i >= F.pmod("k", F.lit(10)), i.cast("double")))).alias("ord", "value")).withColumn("term", F.concat(F.lit("t"), F.col("ord")))
    return summary.coverage(rows).select("folder", "missing", "n", "terms")


def table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nation_tables(spark, sf_dir, False)


def adjacent_tables_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables a region, set apart by a blank line only: nations, and the region itself."""
    return _nation_tables(spark, sf_dir, True)


def _nation_tables(spark: SparkSession, sf_dir: str, two: bool) -> DataFrame:
    n, r = R.table(spark, sf_dir, "nation"), R.table(spark, sf_dir, "region")
    rows = R.grouped_rows(n, ["n_regionkey"], "n_nationkey", R.pipe(F.col("n_nationkey"), F.col("n_name")))
    x = r.join(rows, r.r_regionkey == rows.n_regionkey)
    lines = ["| key | name |", "|---|:--|", F.col("rows")] + (["", "| region | label |", "|--|--|", R.pipe(F.col("r_regionkey"), F.col("r_name"))] if two else [])
    t = X.tables(X.doc_lines(R.documents(x, F.col("r_name"), "a.md", R.text(*lines))))
    return t.select("folder", F.array_join("header", ",").alias("header"), F.explode("rows").alias("r")).select("folder", "header", F.get("r", F.lit(0)).try_cast("int").alias("key"), F.get("r", F.lit(1)).alias("name"))


def dual_column_unfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers on the left and parts on the right of one table; a supplier without a part leaves the right half blank."""
    s, p = R.table(spark, sf_dir, "supplier"), R.table(spark, sf_dir, "part")
    x = s.join(p, s.s_suppkey == p.p_partkey - 1, "left")
    has = F.pmod("s_suppkey", F.lit(3)) != 0
    right = [F.when(has, c).otherwise("") for c in (F.format_string("P%05d", "p_partkey"), F.col("p_size").cast("string"))]
    row = R.pipe(F.format_string("S%05d", "s_suppkey"), F.col("s_name"), F.col("s_nationkey"), *right)
    docs = R.grouped_rows(x, ["s_nationkey"], "s_suppkey", row)
    lines = X.doc_lines(R.documents(docs, F.col("s_nationkey").cast("string"), "a.md", R.text("| 資產代碼 | 名 | 國 | 負債代碼 | 數 |", "|--|--|--|--|--|", F.col("rows"))))
    e = X.code_entries(X.row_lines(lines))
    return e.select("folder", "code", N.nth_value(F.col("cells"), 1, 1).alias("value"), F.size("cells").alias("width"))


def _part_docs(spark: SparkSession, sf_dir: str, percent: bool) -> DataFrame:
    p = R.table(spark, sf_dir, "part")
    price = F.round("p_retailprice").cast("long")
    one = [R.pipe(F.format_string("P%06d", "p_partkey"), F.col("p_name"), R.amount(price), *(["1.5"] if percent else []), R.amount(F.col("p_size").cast("long"), -1), *(["2.5"] if percent else []))]
    wrapped = F.concat(one[0], F.when(F.pmod("p_partkey", F.lit(4)) == 0, F.lit("\n| （附註四） | |")).otherwise(""))
    head = "| 代碼 | 項目 | 114年 | % | 113年 | % |" if percent else "| 代碼 | 項目 | 114年 | 113年 |"
    docs = R.grouped_rows(p.withColumn("b", F.floor(F.col("p_partkey") / 200)), ["b"], "p_partkey", wrapped)
    return R.documents(docs, F.col("b").cast("string"), "a.md", R.text(head, "|" + "---|" * (6 if percent else 4), F.col("rows")))


def code_extract_first_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.code_entries(X.row_lines(X.doc_lines(_part_docs(spark, sf_dir, True))))
    codes = R.table(spark, sf_dir, "part").select(F.format_string("P%06d", "p_partkey").alias("code"))
    return lookup.find_codes(e, codes).select("code", "label", "value")


def stride_period2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for percent in (True, False):
        e = X.code_entries(X.row_lines(X.doc_lines(_part_docs(spark, sf_dir, percent))))
        one = lookup.code_facts(e, 2).select(F.lit(percent).alias("percent"), "code", "value")
        out = one if out is None else out.unionByName(one)
    return out


def code_index_with_label_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' balances by code; every seventh row has lost its code and is found by its label."""
    c = R.table(spark, sf_dir, "customer").withColumn("b", F.floor(F.col("c_custkey") / 200).cast("string"))
    code = F.format_string("C%06d", "c_custkey")
    blank = F.pmod("c_custkey", F.lit(7)) == 0
    docs = R.grouped_rows(c, ["b"], "c_custkey", R.pipe(F.when(blank, "").otherwise(code), F.col("c_name"), F.round("c_acctbal", 2)))
    rows = X.row_lines(X.doc_lines(R.documents(docs, F.col("b"), "a.md", R.text("| code | name | value |", "|--|--|--|", F.col("rows")))))
    codes = c.select(F.col("b").alias("folder"), code.alias("code"))
    fall = c.select(F.col("b").alias("folder"), code.alias("code"), F.col("c_name").alias("label"))
    return lookup.code_index(rows, X.code_entries(rows), codes, fall).select("code", "label", F.round("value", 2).alias("value"))


def statement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as statement rows: the first of each part in each file of orders, dictionary of even parts."""
    li = R.table(spark, sf_dir, "lineitem").withColumn("b", F.floor(F.col("l_orderkey") / 100).cast("string"))
    shown = F.when(F.pmod("l_linenumber", F.lit(5)) == 0, "-").otherwise(R.amount(F.col("l_quantity").cast("long")))
    docs = R.grouped_rows(li.withColumn("o", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")), ["b"], "o", R.pipe(F.format_string("%06d", "l_partkey"), F.lit("item"), shown))
    e = X.code_entries(X.row_lines(X.doc_lines(R.documents(docs, F.col("b"), "a.md", R.text("| 代碼 | 項目 | 金額 |", "|--|--|--|", F.col("rows"))))))
    dictionary = R.table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.format_string("%06d", "p_partkey").alias("code"), F.col("p_name").alias("name"))
    return lookup.statement_rows(e, dictionary).select("folder", "code", "name", "value", "confidence")


def annualize_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = R.table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    return o.select("y", "q", N.annualize(F.col("cents"), F.col("q")).alias("annualized"))


def term_match_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = [dims.Term("brushed", False, ("BRUSHED",), (), 0.8, ("TIN",)), dims.Term("small copper", True, ("SMALL PLATED COPPER",), ((("SMALL", "MEDIUM"), 0.5), (("COPPER",), 0.4)), 0.8)]
    labels = R.table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("parts"))
    x = labels.withColumn("t", F.explode(dims.term_column(terms)))
    return x.select("p_type", "parts", F.col("t.name").alias("term"), matching.strength(F.col("t"), F.col("p_type")).alias("strength"))


def deck_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deck.deck_summary(R.decks(spark, sf_dir))
    return rows.select("folder", "ord", "term", F.round("value", 6).alias("value"), "period_label")


def _deck_oracle() -> str:
    v = lambda m: f"(cnt * {m} + k) * s"
    rows = [
        (1, "NIM", "1.45", "'4Q25'"), (2, "放款均率", None, None), (3, "存款均率", None, None), (4, "存放利差", None, None), (5, "企業放款", v(2), "'4Q25'"), (6, "房貸", f"{v(4)} + {v(6)}", "'4Q25'"), (7, "個人放款", v(8), "'4Q25'"),
        (8, "信用卡循環", v(10), "'4Q25'"), (9, "法說會放款餘額合計", f"{v(2)} + ({v(4)} + {v(6)}) + {v(8)} + {v(10)}".replace("(" + v(4) + " + " + v(6) + ")", v(4) + " + " + v(6)), None), (10, "法說會外幣放款", v(12), "'4Q25'"), (11, "逾放比率", None, None), (12, "備抵呆帳/逾期放款", None, None),
    ]
    head = _AMOUNTS.rstrip() + ", d AS (SELECT k, cnt, printf('deck%03d', k) AS folder, CASE k % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.001 ELSE 0.1 END::DOUBLE AS s FROM n)\n"
    return head + " UNION ALL ".join(f"SELECT folder, {o} AS ord, '{t}' AS term, {'NULL::DOUBLE' if x is None else f'round(CAST({x} AS DOUBLE), 6)'} AS value, {p or 'NULL'} AS period_label FROM d" for o, t, x, p in rows)


def orientation_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order counts by quarter, for half of the priorities down the rows and for half across the header."""
    o = R.table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    g = o.groupBy("o_orderpriority").agg(F.array_sort(F.collect_list(F.struct("y", "n"))).alias("x"))
    down = F.array_join(F.transform("x", lambda r: F.concat(F.lit("| FY"), r.y, F.lit(" | "), r.n, F.lit(" |"))), "\n")
    head = F.concat(F.lit("| item | "), F.array_join(F.transform("x", lambda r: F.concat(F.lit("FY"), r.y)), " | "), F.lit(" |"))
    across = R.text(head, "|--|--|", F.concat(F.lit("| orders | "), F.array_join(F.transform("x", lambda r: r.n.cast("string")), " | "), F.lit(" |")))
    by_row = F.substring("o_orderpriority", 1, 1).cast("int") % 2 == 1
    docs = R.documents(g, F.col("o_orderpriority"), "a.md", F.when(by_row, R.text("| year | orders |", "|--|--|", down)).otherwise(across))
    t = matching.with_orientation(X.tables(X.doc_lines(docs)))
    found = matching.candidates(X.tables(X.doc_lines(docs)), matching.wanted([dims.Term("orders", aliases=("orders",))]))
    return t.select("folder", F.coalesce("period_col", F.lit(-1)).alias("period_col")).join(found.select("folder", "value", "period_label", "strength"), "folder")


def heading_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = R.table(spark, sf_dir, "nation"), R.table(spark, sf_dir, "region")
    x = n.join(r, n.n_regionkey == r.r_regionkey)
    body = R.grouped_rows(x, ["r_name"], "n_nationkey", R.text(F.when(F.pmod("n_nationkey", F.lit(2)) == 0, F.concat(F.lit("## "), F.col("n_name"), F.lit("－topic"))).otherwise("text"), "| key |", "|--|", R.pipe(F.col("n_nationkey"))))
    t = X.tables(X.doc_lines(R.documents(body, F.col("r_name"), "a.md", F.col("rows"))))
    return t.select("folder", F.get(F.get("rows", F.lit(0)), F.lit(0)).cast("int").alias("key"), "heading", "topic")


def row_sections_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts under bare rows of their brand, the first rows without one."""
    p = R.table(spark, sf_dir, "part").withColumn("b", F.floor(F.col("p_partkey") / 200).cast("string"))
    line = R.text(F.when(F.pmod("p_partkey", F.lit(5)) == 0, F.concat(F.lit("| "), F.col("p_brand"), F.lit(" | |"))), R.pipe(F.format_string("P%06d", "p_partkey"), F.col("p_size")))
    t = X.tables(X.doc_lines(R.documents(R.grouped_rows(p, ["b"], "p_partkey", line), F.col("b"), "a.md", R.text("| part | size |", "|--|--|", F.col("rows")))))
    z = t.select(F.explode(F.arrays_zip("rows", X.row_sections(F.col("rows")).alias("section"))).alias("z")).where("z.rows[1] <> ''")
    return z.select(F.get("z.rows", F.lit(0)).alias("part"), F.col("z.section").alias("section"))


def section_restrict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each nation's customers, one a line by key, those from the first of BUILDING to before the next of MACHINERY."""
    c = R.table(spark, sf_dir, "customer").withColumn("folder", F.col("c_nationkey").cast("string"))
    docs = R.grouped_rows(c, ["folder"], "c_custkey", F.concat_ws(" ", "c_custkey", "c_mktsegment"))
    lines = X.doc_lines(R.documents(docs, F.col("folder"), "a.md", F.col("rows")))
    kept = X.restrict_section(lines, F.array(F.lit("building")), F.array(F.lit("machinery")))
    return kept.select("folder", F.substring_index("line", " ", 1).cast("long").alias("c_custkey"))


def loan_recomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _loan_values(spark, sf_dir)
    return deck.recomposed(v, dims.loan_formulas(spark)).select("folder", "bank", "term", "value")


def _loan_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = [t for t in (*dims.BALANCE_TERMS, *dims.HELPER_TERMS)]
    n = R.nations(spark, sf_dir)
    bank = F.element_at(F.array(*[F.lit(b) for b in ("北富銀", "中信", "玉山", "國泰")]), F.pmod("k", F.lit(4)) + 1)
    each = F.array(*[F.struct(F.lit(t).alias("term"), F.when(F.pmod(F.col("k") + i, F.lit(11)) != 0, (F.col("cnt") * (i + 1) + F.col("k")).cast("double")).alias("value")) for i, t in enumerate(terms)])
    return n.select("folder", bank.alias("bank"), F.explode(each).alias("x")).select("folder", "bank", "x.term", "x.value")


def loan_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deck.reconciled(_loan_values(spark, sf_dir).select("folder", "term", "value"))


def resolve_period_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order months of an even number as the published ones; each month of the range, and one before and one after it, is asked for."""
    m = R.table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).distinct()
    links = m.where("m % 2 = 0").withColumn("url", F.format_string("%d-%02d.xlsx", "y", "m"))
    asked = m.unionByName(m.agg(F.min("y").alias("y")).select((F.col("y") - 1).alias("y"), F.lit(1).alias("m"))).unionByName(m.agg(F.max("y").alias("y")).select((F.col("y") + 1).alias("y"), F.lit(1).alias("m")))
    found = grid.resolve_period(links, asked.withColumn("id", F.col("y") * 100 + F.col("m")))
    return found.select("id", "y", "m", "exact")


def export_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = R.table(spark, sf_dir, "orders").where("o_orderkey IS NOT NULL")
    percent = F.pmod("o_orderkey", F.lit(3)) == 0
    value = F.floor("o_totalprice").cast("double")
    scaled = N.exported(value, percent)
    return o.select("o_orderkey", scaled.alias("value"), N.number_format(scaled, percent, F.pmod("o_orderkey", F.lit(2)) == 0).alias("number_format"))


def page_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.table(spark, sf_dir, "part").select("p_partkey", F.when(F.pmod("p_partkey", F.lit(3)) == 0, F.concat("p_brand", F.lit(".md"))).otherwise(F.concat(F.lpad("p_partkey", 3, "0"), F.lit("_"), "p_brand", F.lit(".md"))).alias("file"))
    return p.select("p_partkey", T.page_num(F.col("file")).alias("page"))


def classify_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = R.filings(spark, sf_dir).unionByName(R.decks(spark, sf_dir))
    codes = frame(spark, [(c,) for c, *_ in (*R.INCOME, *R.SHEET)] + [("64000",), ("63000",)], "code string")
    return classify.classified(docs, codes).select("folder", "kind", "code_hits", "con_hits")


def bank_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.identity(R.filings(spark, sf_dir)).select("folder", "industry", "bank")


def merged_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filing row for each term but every fourth, a deck row for each but every third, and an unlisted one on either side."""
    terms = [*dims.MERGED_ORDER]
    f = [(i, t, float(i)) for i, t in enumerate(terms) if i % 4] + [(90, "甲", 90.0)]
    d = [(i, t, float(-i)) for i, t in enumerate(terms) if i % 3] + [(91, "乙", 91.0)]
    rows = merged.merged(frame(spark, f, "pos int, term string, value double"), frame(spark, d, "pos int, term string, value double"))
    return rows.select("place", "term", "value", "side")


def combined_sections_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = statement_rows(spark, sf_dir).withColumn("section", F.lit("balance_sheet"))
    ra = R.nations(spark, sf_dir).select("folder", (F.col("cnt") / 4).alias("roa_posttax"))
    return merged.combined(st, ra).select("section", "folder", "code", "value", "roa_posttax")


def profitability_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three layouts for each nation: entities under a date range, a numbered bank's table, the filing's own table."""
    n = R.nations(spark, sf_dir)
    k = F.col("k")
    one = R.text("獲利能力", "114年1月1日至9月30日", R.pipe("合併（註3）", F.concat(k, F.lit(".1")), F.concat(k, F.lit(".2")), "-", F.concat(k, F.lit(".4")), "5.5"), R.pipe("本公司", "1.1", "1.2", "1.3", F.concat(F.lit("("), k + 1, F.lit(")")), "1.5"))
    two = R.text("獲利能力", "1. 玉山商業銀行", "| 項目 | 稅別 | 114年12月31日 | 113年12月31日 |", "|--|--|--|--|", R.pipe("資產報酬率", "稅後", F.concat(k, F.lit(".7")), "0.5"), R.pipe("純益率", "", "33.3", F.concat(k, F.lit(".9"))))
    three = R.text("獲利能力", "| 項目 | 稅別 | 114.12.31 | 113年度 |", "|--|--|--|--|", R.pipe("淨值報酬率", "稅 後", F.concat(k, F.lit(".25")), "7"))
    files = F.array(*[F.struct(F.lit(f"{i}.md").alias("path"), c.alias("content")) for i, c in enumerate((one, two, three))])
    from ..sources.documents import ordered

    docs = ordered(n.select("folder", F.explode(files).alias("f")).select("folder", "f.path", "f.content"))
    e = profitability.entries(docs, X.doc_lines(docs))
    return e.select("folder", "layout", "entity", "period_label", "quarter_num", "roa_posttax", "roe_posttax", "profit_margin")


def _long_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of one document with all order lines: an order is an entry that begins with its first line, each 997th begins a table, with a % column where it is even, and each 1777th has a heading."""
    li = R.table(spark, sf_dir, "lineitem")
    order, row = F.col("l_orderkey"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = staged(li.select(order, row.alias("_row")).repartitionByRange(tasks, "l_orderkey", "_row").withColumn("_range", F.spark_partition_id()), "ranges")
    first = li.select(order, row.alias("_row")).groupBy("l_orderkey").agg(F.min("_row").alias("_first"))
    x = ranges.join(first, "l_orderkey")
    opens, percent = F.col("_row") == F.col("_first"), F.pmod("l_orderkey", F.lit(2)) == 0
    twin = F.row_number().over(Window.partitionBy("_range", "l_orderkey", "_row").orderBy(F.lit(1))) == 1
    line = R.pipe(F.when(opens, F.format_string("N%07d", "l_orderkey")).otherwise(""), "item", F.col("_row.l_quantity").cast("long"), F.when(F.pmod(F.floor(order / 997), F.lit(2)) == 0, F.col("_row.l_linenumber").cast("string")).otherwise("-"))
    x = x.withColumn("_new", opens & twin)
    head = F.when(F.col("_new") & (F.pmod(order, F.lit(1777)) == 0), F.format_string("## part－%d", "l_orderkey"))
    table = F.when(F.col("_new") & (F.pmod(order, F.lit(997)) == 0), F.when(percent, "| 代碼 | item | amount | % |").otherwise("| 代碼 | item | amount | n |"))
    lines = F.array_compact(F.array(head, table, F.when(table.isNotNull(), "|---|---|---|---|"), line))
    each = x.select("_range", "l_orderkey", "_row", F.posexplode(lines).alias("_part", "line"))
    named = each.select(F.lit("all").alias("folder"), F.lit(1).alias("file_ord"), F.lit("all.md").alias("file_name"), "_range", "l_orderkey", "_row", "_part", "line")
    return segments.numbered(named, X.KEY, ["l_orderkey", "_row", "_part"], "_range").select(*X.KEY, "file_name", "line_no", "line")


def long_document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second figures of all orders, from one document that no task holds."""
    rows = segments.row_lines(_long_document(spark, sf_dir), 4096)
    return segments.code_facts(rows, 2).select("code", "label", "value")


def long_document_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each table of one long document, its heading, the number of its rows, and the sum of their amounts."""
    t = segments.table_lines(_long_document(spark, sf_dir), 4096).where("row_idx IS NOT NULL")
    return t.groupBy("header_line").agg(F.max("heading").alias("heading"), (F.max("row_idx") + 1).alias("n_rows"), F.count("*").alias("n"), F.sum(N.parse_numeric(F.get("cells", F.lit(2)))).alias("amount"))


GRID = [("s", 0, 0, "資產負債表"), ("s", 1, 0, "修正前會計項目及代碼"), ("s", 1, 2, "修正後會計項目及代碼"), ("s", 1, 4, "修正說明"), ("s", 2, 0, "代碼"), ("s", 2, 1, "會計項目"), ("s", 3, 0, "10000"), ("s", 3, 1, "資產總計"), ("s", 3, 2, "10000"), ("s", 3, 3, "資產總額"), ("s", 3, 4, "改名改名改名"), ("s", 4, 0, "11000"), ("s", 4, 1, "現金"), ("s", 5, 2, "12000"), ("s", 5, 3, "存放央行及拆借"), ("s", 6, 0, "13000")]
CODES = [("s", "10000", "資產總額"), ("s", "11000", "現金"), ("s", "12000", "存放央行及拆借")]
SHEET = [("s", 0, 0, "統計表"), ("s", 1, 0, "銀行 名稱"), ("s", 1, 1, "逾放"), ("s", 2, 1, "比率"), ("s", 1, 2, "餘額"), ("s", 4, 0, "甲銀行"), ("s", 4, 1, "0.15"), ("s", 4, 2, "1,234"), ("s", 5, 0, "乙銀行"), ("s", 5, 2, "x"), ("s", 6, 0, "甲銀行"), ("s", 6, 2, "9")]


def coding_grid_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = frame(spark, GRID, "sheet string, r int, c int, value string")
    merges = frame(spark, [("s", 1, 0, 1, 1), ("s", 1, 2, 1, 3)], "sheet string, r0 int, c0 int, r1 int, c1 int")
    return grid.coding_dictionary(grid.unmerged(cells, merges)).select("sheet", "code", "name")


def regulator_header_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = frame(spark, SHEET, "sheet string, r int, c int, value string")
    return grid.columns_by_bank(cells, "銀行名稱", frame(spark, [("逾放比率",), ("餘額",)], "header string"), frame(spark, [("甲銀行",), ("乙銀行",), ("丙銀行",)], "bank string"))


QUERIES = {f.__name__: f for f in (long_document_facts, long_document_tables, filing_summary, derived_total, coverage_warning, table_roundtrip, adjacent_tables_split, dual_column_unfold, code_extract_first_value, stride_period2, code_index_with_label_fallback, statement_rows, annualize_orders, term_match_strength, deck_summary, orientation_detect, heading_asof, row_sections_ffill, section_restrict, loan_recomposition, loan_reconciliation, resolve_period_asof, export_scaling, page_num, classify_folders, bank_detection, merged_order, combined_sections_union, profitability_layouts, coding_grid_blocks, regulator_header_lookup)}
