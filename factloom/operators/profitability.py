"""Profitability disclosures in three layouts, ratios and their cross-checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numeric as N
from ..functions import period as P
from ..functions import text as T
from ..sources.staged import staged
from . import tables as X

METRICS = ("roa_pretax", "roa_posttax", "roe_pretax", "roe_posttax", "profit_margin")
_TOKEN = r"\(?\s*-?\d+(?:\.\d+)?\s*\)?|[-—–]"


def extract_metrics(cells: Column) -> list[Column]:  # O-77: five numbers by position; a dash takes a place
    tokens = F.regexp_extract_all(F.array_join(F.slice(cells, 2, 1 << 20), " "), F.lit(_TOKEN), F.lit(0))
    return [N.parse_numeric(F.get(tokens, F.lit(k))).alias(name) for k, name in enumerate(METRICS)]


def _entries(lines: DataFrame) -> DataFrame:
    """Layout 1: blocks from each date range to the next, whose first table row names an entity."""  # O-76, O-78
    by_doc = Window.partitionBy(*X.KEY).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = T.computed(lines, start=P.has_range(F.col("line")), row=F.col("line").contains("|") & ~T.is_divider(F.col("line")), cells=T.split_row(F.col("line")))
    block = marked.withColumn("block", F.last(F.when(F.col("start"), F.col("line_no")), True).over(by_doc)).where("block IS NOT NULL")
    block = block.withColumn("label", F.first(P.range_text(F.col("line"))).over(Window.partitionBy(*X.KEY, "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    rows = block.where("row").withColumn("name", T.strip_footnote(F.get("cells", F.lit(0))))
    rows = rows.withColumn("opens", T.is_entity(F.col("name")))
    in_block = Window.partitionBy(*X.KEY, "block").orderBy("line_no")
    rows = rows.withColumn("by_entity", F.first("opens").over(in_block.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("entry", F.last(F.when(F.col("opens"), F.col("line_no")), True).over(in_block.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = rows.where("by_entity AND entry IS NOT NULL").groupBy(*X.KEY, "file_name", "block", "entry").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "cells"))).alias("parts"), F.max(F.when(F.col("opens"), F.col("name"))).alias("entity"), F.max("label").alias("period_label")
    )
    cells = F.flatten(F.transform("parts", lambda p: p.cells))
    return grouped.select(*X.KEY, "file_name", F.lit(1).alias("layout"), F.col("entry").alias("pos"), F.lit(0).alias("col"), "entity", "period_label", P.quarter_of_label(F.col("period_label")).alias("quarter_num"), *extract_metrics(cells))


def _dated(tables: DataFrame) -> DataFrame:
    """Layouts 2 and 3: a column for each date; under a numbered name (2), or for the filing itself where no numbered company precedes and a metric row exists (3)."""
    dates = F.filter(F.transform("header", lambda c, i: F.struct(P.parse_header_date(c).alias("date"), i.alias("col"))), lambda x: x.date.isNotNull())
    t = T.computed(tables, dates=dates, metric_rows=F.filter(F.transform("rows", lambda r: F.struct(T.metric_of_row(r).alias("metric"), r.alias("cells"))), lambda x: x.metric.isNotNull()))
    t = t.where(F.size("dates") > 0)
    layout = lambda n, entity: F.struct(F.lit(n).alias("layout"), entity.cast("string").alias("entity"))
    two = F.when(F.col("numbered").isNotNull(), layout(2, F.col("numbered")))
    three = F.when(~F.col("company_before") & (F.size("metric_rows") > 0), layout(3, F.lit(None)))
    both = t.withColumn("read", F.explode(F.array_compact(F.array(two, three)))).select("*", "read.layout", "read.entity").drop("read")
    x = both.select("*", F.posexplode(F.array_sort("dates", lambda a, b: F.when(a.date > b.date, -1).when(a.date < b.date, 1).otherwise(a.col - b.col))).alias("rank", "d")).select("*", "d.date", F.col("d.col").alias("at")).drop("d")

    def last(metric: str) -> Column:  # of several rows of a metric the last that reaches the column
        some = F.filter("metric_rows", lambda r: (r.metric == metric) & (F.size(r.cells) > F.col("at")))
        return N.parse_numeric(F.get(F.get(some, F.size(some) - 1).getField("cells"), F.col("at"))).alias(metric)

    label = F.concat(F.col("date.y"), F.lit("年"), F.col("date.m"), F.lit("月"), F.col("date.d"), F.lit("日"))
    return x.select(*X.KEY, "file_name", "layout", F.col("header_line").alias("pos"), F.col("rank").alias("col"), "entity", label.alias("period_label"), P.month_quarter(F.col("date.m")).alias("quarter_num"), *[last(m) for m in METRICS])


def entries(docs: DataFrame, lines: DataFrame) -> DataFrame:  # O-06, O-153, O-163
    """Disclosed entries of files that mention the section: folder, file_ord, file_name, layout, pos, col, entity, period_label, quarter_num and metrics."""
    some = docs.where(F.col("content").contains("獲利能力")).select(*X.KEY)
    within = lines.join(some, X.KEY, "left_semi")
    return staged(_entries(within).unionByName(_dated(staged(X.tables(within), "tables"))), "disclosed")


def chosen(found: DataFrame, banks: DataFrame) -> DataFrame:  # O-117
    """The entry of each folder (banks: folder, bank, names): in scope, with a value, of the latest date, the first of equals."""
    x = found.join(banks.select("folder", "names"), "folder", "left")
    scope = F.col("entity").isNull() | F.coalesce(F.exists("names", lambda a: F.col("entity").contains(a)), F.lit(False))
    has = F.col("roa_posttax").isNotNull() | F.col("roe_posttax").isNotNull()
    date = F.coalesce(P.parse_single_date(F.col("period_label")), F.struct(F.lit(0).alias("y"), F.lit(0).alias("m"), F.lit(0).alias("d")))
    order = Window.partitionBy("folder").orderBy(scope.desc(), has.desc(), date.desc(), "file_ord", "layout", "pos", "col")
    return x.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n", "names")


def manual_ratios(codes: DataFrame) -> DataFrame:  # O-133, O-137, O-165
    """roa and roe in percent from income, assets1, assets2, equity1, equity2, quarter; null where any is missing or an average is 0."""

    def ratio(now: str, then: str) -> Column:
        return F.try_divide(F.try_divide(F.col("income"), (F.col(now) + F.col(then)) / 2), F.col("quarter")) * 4 * 100

    complete = ratio("assets1", "assets2").isNotNull() & ratio("equity1", "equity2").isNotNull()
    return codes.withColumn("manual_roa", F.when(complete, ratio("assets1", "assets2"))).withColumn("manual_roe", F.when(complete, ratio("equity1", "equity2")))


LIMITS = {"ROA": (-5.0, 5.0), "ROE": (-50.0, 50.0)}


def prioritised(term: str, disclosed: Column, deck: Column, manual: Column, period_label: Column, file_name: Column) -> dict[str, Column]:  # O-87, O-88, O-118
    """value, matched_label, source_file, crosscheck_value, diverges, implausible: disclosure before deck before manual formula, which else serves as cross-check."""
    value = F.coalesce(disclosed, deck, manual)
    check = F.when(disclosed.isNotNull() | deck.isNotNull(), manual)
    label = F.when(disclosed.isNotNull(), F.concat(F.lit(f"{term}(年) 稅後 @ "), period_label)).when(value.isNotNull(), term)
    small = F.least(F.abs(value), F.when(check == 0, 1e-9).otherwise(F.abs(check)))
    apart = ((value > 0) != (check > 0)) | (F.try_divide(F.greatest(F.abs(value), F.abs(check)), small) > 2.0)
    low, high = LIMITS[term]
    return {
        "value": value,
        "matched_label": label,
        "source_file": F.when(disclosed.isNotNull(), file_name),
        "crosscheck_value": check,
        "diverges": F.coalesce((value != 0) & apart, F.lit(False)),
        "implausible": F.coalesce(~value.between(low, high), F.lit(False)),
    }


def note(term: str, value: Column, check: Column, diverges: Column, implausible: Column) -> Column:
    low, high = LIMITS[term]
    one = F.when(diverges, F.concat(F.lit("cross-check diverges: manual formula gives "), N.format_pct(check), F.lit(" against "), N.format_pct(value), F.lit(" as disclosed")))
    two = F.when(implausible, F.concat(F.lit("implausible value: "), N.format_pct(value), F.lit(f" is outside [{low}%, {high}%] for {term}")))
    return F.when(value.isNull(), F.lit(f"no {term}: no disclosure, no deck figure, and the formula lacks an input")).otherwise(F.concat_ws("; ", one, two))


def ratio_rows(found: DataFrame, manual: DataFrame) -> DataFrame:  # O-164
    """Rows of the ratio table: disclosed entries with annualised columns, or one approximated row for a folder without any."""
    q = F.col("quarter_num")
    rows = found.select(
        "folder", "file_ord", "layout", "pos", "col", F.col("period_label").alias("period"), F.coalesce("entity", F.lit("(this filing)")).alias("entity"), q.alias("quarter"),
        "roa_posttax", N.annualize(F.col("roa_posttax"), q).alias("roa_posttax_annualized"), "roe_posttax", N.annualize(F.col("roe_posttax"), q).alias("roe_posttax_annualized"),
        "profit_margin", F.col("file_name").alias("source_file"), F.lit(False).alias("used_fallback"),
    )
    rest = manual.where("manual_roa IS NOT NULL").join(found.select("folder").distinct(), "folder", "left_anti")
    approximated = rest.select("folder", F.lit("(approximated)").alias("entity"), F.col("quarter").cast("int").alias("quarter"), (F.col("manual_roa") / 100).alias("roa_posttax_annualized"), (F.col("manual_roe") / 100).alias("roe_posttax_annualized"), F.lit(True).alias("used_fallback"))
    return rows.unionByName(approximated, allowMissingColumns=True)
