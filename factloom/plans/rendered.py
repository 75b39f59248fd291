"""Documents rendered from the base tables, so that the extractor can be held against SQL on those tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BANKS = {0: ("玉山商業銀行股份有限公司", "64000"), 1: ("國泰世華商業銀行股份有限公司", "63000")}
#: code, label, sign, and the number that makes its amount.
INCOME = (
    ("49010", "利息淨收益", 1, 1), ("49100", "手續費淨收益", 1, 2), ("49200", "金融資產損益", 1, 3), ("49310", "兌換損益", 1, 4), ("49450", "採權益法損益", 1, 5), ("49600", "處分利益", 1, 6),
    ("49700", "其他利益", 1, 7), ("49750", "租金收入", 1, 8), ("49800", "其他收入", 1, 9), ("49899", "其他淨收益", 1, 10), ("4xxxx", "淨收益", 1, 90), ("58200", "呆帳費用", -1, 11), ("58400", "營業費用合計", -1, 60),
    ("58500", "員工福利費用", -1, 30), ("59000", "折舊及攤銷費用", -1, 12), ("59500", "其他業務及管理費用", -1, 18), ("61001", "稅前淨利", 1, 25), ("61003", "減：所得稅費用", 1, 5), ("NET", "本期稅後淨利", 1, 20),
)
SHEET = (("10000", "資產總計", 1000, 900), ("20000", "負債合計", 800, 760), ("30000", "權益總計", 200, 140))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pipe(*cells: Column | str) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.lit(c) if isinstance(c, str) else c.cast("string") for c in cells]), F.lit(" |"))


def text(*lines: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])


def amount(c: Column, sign: int = 1) -> Column:
    shown = F.call_function("format_number", c, F.lit("#,##0"))
    return F.concat(F.lit("("), shown, F.lit(")")) if sign < 0 else shown


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, cnt (customers), bank (0 or 1), folder of each nation."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("cnt"))
    return n.join(c, "k", "left").select("k", F.coalesce("cnt", F.lit(0)).alias("cnt"), F.pmod("k", F.lit(2)).alias("bank"), F.format_string("filing%03d", "k").alias("folder"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files for each nation: cover, balance sheet of two periods with dual columns, income statement; every third nation states no total of operating costs, every fifth discloses ratios."""
    n = nations(spark, sf_dir)
    by = lambda a: F.col("cnt") * 10 * a + F.col("k")
    name = F.when(F.col("bank") == 0, BANKS[0][0]).otherwise(BANKS[1][0])
    cover = text(F.concat(F.lit("# "), name), "", "114年12月31日 個體財務報告")
    (a, al, a1, a2), (b, bl, b1, b2), (e, el, e1, e2) = SHEET
    sheet = text(
        "# 資產負債表", "", "114年12月31日", "", "| 資產代碼 | 資產 | 114年 | 113年 | 負債代碼 | 負債 | 114年 | 113年 |", "|---|---|---|---|---|---|---|---|",
        pipe("11000", "現金", amount(by(3)), amount(by(2)), b, bl, amount(by(b1)), amount(by(b2))), pipe(a, al, amount(by(a1)), amount(by(a2)), e, el, amount(by(e1)), amount(by(e2))),
    )
    rows = []
    for code, label, sign, m in INCOME:
        shown = F.when(F.col("bank") == 0, "64000").otherwise("63000") if code == "NET" else code
        line = pipe(shown, label, amount(by(m), sign), "1.0")
        rows.append(F.when(F.pmod("k", F.lit(3)) != 0, line) if code == "58400" else line)
    income = text("# 綜合損益表", "", "| 代碼 | 項目 | 金額 | % |", "|---|---|---|---|", *rows)
    ratio = text(
        "# 財務資訊", "", "| 項目 | 稅別 | 114年12月31日 | 113年12月31日 |", "|---|---|---|---|", pipe("資產報酬率", "稅後", F.format_string("%d.%02d", F.lit(0), F.col("k") + 10), "0.10"),
        pipe("淨值報酬率", "稅後", F.format_string("%d.5", F.col("k")), "1.0"), "", "獲利能力",
    )
    files = F.array_compact(F.array(*[F.struct(F.lit(f).alias("path"), c.alias("content")) for f, c in (("001_cover.md", cover), ("007_bs.md", sheet), ("008_is.md", income))], F.when(F.pmod("k", F.lit(5)) == 0, F.struct(F.lit("010_prof.md").alias("path"), ratio.alias("content")))))
    from ..sources.documents import ordered

    return ordered(n.select("folder", F.explode(files).alias("f")).select("folder", "f.path", "f.content"))


def decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cover and a loan table for each nation, in units that differ by nation."""
    n = nations(spark, sf_dir)
    unit = F.element_at(F.array(F.lit("拾億元"), F.lit("百萬元"), F.lit("億元")), F.pmod("k", F.lit(3)) + 1)
    v = lambda m: F.col("cnt") * m + F.col("k")
    cover = F.lit("# 玉山金控 2025年第四季法人說明會")
    loans = text(
        "## 玉山銀行－放款結構", "", F.concat(F.lit("單位：新台幣"), unit), "", "| 項目 | 4Q24 | 4Q25 |", "|---|---|---|", pipe("企業放款", v(1), v(2)), pipe("企業放款占比", "12.1%", "12.8%"), pipe("房貸", v(3), v(4)),
        pipe("個人擔保貸款", v(5), v(6)), pipe("小額信貸", v(7), v(8)), pipe("信用卡循環", v(9), v(10)), pipe("外幣放款", v(11), v(12)), pipe("NIM", "1.42", "1.45"),
    )
    from ..sources.documents import ordered

    files = F.array(F.struct(F.lit("001.md").alias("path"), cover.alias("content")), F.struct(F.lit("002.md").alias("path"), loans.alias("content")))
    return ordered(n.withColumn("folder", F.format_string("deck%03d", "k")).select("folder", F.explode(files).alias("f")).select("folder", "f.path", "f.content"))


def documents(rows: DataFrame, folder: Column, file_name: Column | str, content: Column) -> DataFrame:
    name = F.lit(file_name) if isinstance(file_name, str) else file_name
    return rows.select(folder.alias("folder"), name.alias("file_name"), F.lit(1).alias("file_ord"), content.alias("content"))


def grouped_rows(df: DataFrame, keys: list[str], order: str, line: Column) -> DataFrame:
    """One text of lines for each group, in order."""
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x.l), "\n").alias("rows"))
