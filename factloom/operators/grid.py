"""Spreadsheets as long tables (sheet, r, c, value): coding dictionaries and regulator sheets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.numeric import parse_plain

# Wording of coding sheets.
ORIGINAL = ("原會計項目及代碼", "修正前會計項目及代碼", "修訂前現金流量表項目及代碼", "修正前")
REVISED = ("修正後會計項目及代碼", "修訂後現金流量表項目及代碼", "修正後")
HINTS = ("代碼", "會計項目", "一級", "二級", "三級", "四級")
STOPS = ("修正說明", "備註")


def unmerged(grid: DataFrame, ranges: DataFrame) -> DataFrame:  # O-69
    """grid with the top-left value in every cell of each merged range (sheet, r0, c0, r1, c1); ranges are spread to cells, so the join is an equi-join."""
    cells = ranges.select("sheet", "r0", "c0", F.explode(F.sequence("r0", "r1")).alias("r"), "c1").select("sheet", "r0", "c0", "r", F.explode(F.sequence("c0", "c1")).alias("c"))
    top = grid.select("sheet", F.col("r").alias("r0"), F.col("c").alias("c0"), F.col("value").alias("top"))
    filled = cells.join(top, ["sheet", "r0", "c0"]).select("sheet", "r", "c", "top")
    return grid.join(filled, ["sheet", "r", "c"], "full").select("sheet", "r", "c", F.coalesce("top", "value").alias("value"))


def coding_blocks(grid: DataFrame, scan: int = 10) -> DataFrame:  # O-70
    """sheet, original (first, last column), revised, data_row: where the code blocks of a sheet are; rows and columns count from 0."""

    def any_of(words: tuple[str, ...]) -> Column:
        return reduce(lambda a, b: a | b, [F.col("value").contains(w) for w in words])

    head = grid.where((F.col("r") < scan) & F.col("value").isNotNull())
    first = lambda cond: F.min(F.when(cond, F.struct("r", "c"))).getField("c")
    is_hint = T.strip(F.col("value")).isin(*HINTS)
    # a marker counts as a hint only where it is the first of its kind
    x = head.groupBy("sheet").agg(first(any_of(ORIGINAL)).alias("o"), first(any_of(REVISED)).alias("v"), first(any_of(STOPS)).alias("s"), F.max("c").alias("width"), F.max(F.when(is_hint, F.col("r"))).alias("hint"), *[F.min(F.when(any_of(w), F.col("r"))).alias(n) for w, n in ((ORIGINAL, "ro"), (REVISED, "rv"), (STOPS, "rs"))])
    limit = F.coalesce(F.col("s") - 1, F.col("width"))
    end = F.when(F.col("v") > F.col("o"), F.col("v") - 1).otherwise(limit)
    span = lambda a, b: F.when(a.isNotNull(), F.struct(a.alias("first"), b.alias("last")))
    last_head = F.coalesce(F.greatest("hint", "ro", "rv", "rs"), F.lit(0))
    return x.select("sheet", span(F.col("o"), end).alias("original"), span(F.col("v"), limit).alias("revised"), (last_head + 1).alias("data_row"))


def coding_dictionary(grid: DataFrame) -> DataFrame:  # O-08, O-71, O-72, O-155
    """sheet, code, name: of each row and block the first code-shaped cell and the longest other text; a later row replaces an earlier, the revised block the original."""
    blocks = coding_blocks(grid)
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(n).alias("span")) for i, n in enumerate(("original", "revised"))])
    spans = blocks.select("sheet", "data_row", F.explode(sides).alias("x")).select("sheet", "data_row", "x.side", "x.span.first", "x.span.last").where("first IS NOT NULL")
    cells = grid.withColumn("value", T.strip(F.col("value"))).where("value <> ''").join(F.broadcast(spans), "sheet").where("r >= data_row AND c BETWEEN first AND last")
    shaped = T.looks_like_code(F.col("value"))
    rows = cells.groupBy("sheet", "side", "r").agg(
        F.min_by("value", F.when(shaped, F.col("c"))).alias("code"), F.min(F.when(~shaped, F.struct((-F.length("value")).alias("n"), "c", "value"))).getField("value").alias("name")
    )
    known = rows.where("code IS NOT NULL AND name IS NOT NULL")
    return known.groupBy("sheet", "code").agg(F.max_by("name", F.struct("side", "r")).alias("name"))


def header_column(grid: DataFrame, headers: DataFrame, scan: int = 10) -> DataFrame:  # O-75
    """sheet, header, c for headers (header): the first cell equal to it without white space; else a column whose three header rows run together to it."""
    bare = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    head = grid.where((F.col("r") < scan) & F.col("value").isNotNull()).withColumn("bare", bare(F.col("value")))
    want = headers.withColumn("bare", bare(F.col("header")))
    single = head.join(F.broadcast(want), "bare").groupBy("sheet", "header").agg(F.min(F.struct("r", "c")).getField("c").alias("one"))
    start = head.groupBy("sheet", "r").agg(F.count("*").alias("n")).where("n >= 2").groupBy("sheet").agg(F.min("r").alias("r0"))
    band = head.join(start, "sheet").where("r BETWEEN r0 AND r0 + 2").groupBy("sheet", "c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "bare"))), lambda x: x.bare), "").alias("bare"), F.min("r").alias("r"))
    stacked = band.join(F.broadcast(want), "bare").groupBy("sheet", "header").agg(F.min(F.struct("r", "c")).getField("c").alias("many"))
    return single.join(stacked, ["sheet", "header"], "full").select("sheet", "header", F.coalesce("one", "many").alias("c"))


def columns_by_bank(grid: DataFrame, bank_header: str, headers: DataFrame, banks: DataFrame) -> DataFrame:  # O-13
    """bank, header, value for every bank (bank) and header: from the bank's first row; null for a bank that isn't there."""
    spark = grid.sparkSession
    at = header_column(grid, headers.unionByName(spark.createDataFrame([(bank_header,)], "header string")))
    place = at.where(F.col("header") == bank_header).select("sheet", "c")
    names = grid.join(F.broadcast(place), ["sheet", "c"]).withColumn("bank", T.strip(F.col("value"))).join(banks, "bank", "left_semi")
    first = names.groupBy("sheet", "bank").agg(F.min("r").alias("r"))
    value = first.join(F.broadcast(at.where(F.col("header") != bank_header)), "sheet").join(grid, ["sheet", "r", "c"], "left").select("bank", "header", parse_plain(F.col("value")).alias("value"))
    every = banks.select("bank", F.explode(F.array(*[F.lit(h.header) for h in headers.distinct().collect()])).alias("header"))
    return every.join(value, ["bank", "header"], "left")


def resolve_period(links: DataFrame, asked: DataFrame) -> DataFrame:  # O-115, O-136
    """Of links (y, m, url) the one for each request (id, y, m): the month itself, else the newest before it, else the oldest; the newest for a request without a month.  Adds exact and note."""
    months = links.groupBy().agg(F.array_sort(F.collect_list(F.struct("y", "m", "url"))).alias("all"))
    x = asked.select("id", F.col("y").alias("ay"), F.col("m").alias("am")).join(F.broadcast(months))
    any_month = F.col("ay").isNull() | F.col("am").isNull()
    before = F.filter("all", lambda l: (l.y < F.col("ay")) | ((l.y == F.col("ay")) & (l.m <= F.col("am"))))  # noqa: E741
    pick = F.when(any_month, F.element_at("all", -1)).when(F.size(before) > 0, F.try_element_at(before, F.lit(-1))).otherwise(F.get("all", F.lit(0)))
    x = x.where(F.size("all") > 0).withColumn("l", pick)
    exact = any_month | ((F.col("l.y") == F.col("ay")) & (F.col("l.m") == F.col("am")))
    later = (F.col("l.y") > F.col("ay")) | ((F.col("l.y") == F.col("ay")) & (F.col("l.m") > F.col("am")))
    # fixed values: these two reasons
    why = F.when(later, "that month is no longer in the published dataset").otherwise("that month isn't published yet")
    note = F.when(exact, "").otherwise(F.concat(F.lit("figures of "), F.col("l.y"), F.lit("年"), F.col("l.m"), F.lit("月 in place of "), F.col("ay"), F.lit("年"), F.col("am"), F.lit("月: "), why))
    return x.select("id", "l.y", "l.m", "l.url", exact.alias("exact"), note.alias("note"))


def period_links(pages: DataFrame, extension: str, pattern: str) -> DataFrame:  # O-10
    """page_url, y, m, url: links of pages (page_url, html) that end in extension and whose decoded file name has pattern's year and month; of equal months the last link."""
    hrefs = pages.select("page_url", F.posexplode(F.regexp_extract_all("html", F.lit(rf'href="([^"]+\.{extension})"'), F.lit(1))).alias("pos", "url"))
    name = T.last_segment(F.col("url"))
    part = lambda k: F.nullif(F.regexp_extract(name, pattern, k), F.lit("")).try_cast("int")
    x = hrefs.select("page_url", "pos", "url", part(1).alias("y"), part(2).alias("m")).where("y IS NOT NULL AND m IS NOT NULL")
    return x.groupBy("page_url", "y", "m").agg(F.max_by("url", "pos").alias("url"))


def page_links(pages: DataFrame) -> DataFrame:  # O-10, O-36
    """page_url, pos, url, name for every link of pages (page_url, html): in page order, with the decoded last part of its path."""
    hrefs = pages.select("page_url", F.posexplode(F.regexp_extract_all("html", F.lit(r'href="([^"]+)"'), F.lit(1))).alias("pos", "url"))
    bare = F.regexp_replace("url", r"[?#].*$", "")
    return hrefs.select("page_url", "pos", "url", F.try_url_decode(F.element_at(F.split(bare, "/"), -1)).alias("name"))
