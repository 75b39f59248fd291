"""Lines, tables and account entries of documents.

A document is a row; its lines are exploded once.  All windows are over (folder, file_ord), so they share one shuffle,
and a window never spans documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions import text as T

KEY = ["folder", "file_ord"]


def _by_line() -> WindowSpec:
    return Window.partitionBy(*KEY).orderBy("line_no")


def _so_far(last: int = 0) -> WindowSpec:
    return _by_line().rowsBetween(Window.unboundedPreceding, last)


def split_lines(docs: DataFrame) -> DataFrame:
    """folder, file_ord, file_name, line_no (0 first), line: non-blank normalised lines, tables as they stand."""
    return docs.select("folder", "file_ord", "file_name", F.posexplode(T.lines_of(F.col("content"))).alias("line_no", "line"))


def table_lines(lines: DataFrame) -> DataFrame:
    """lines with cells, pipe, divider, header_line (line_no of the table the line is in, else null) and row_idx (null but for data rows).  O-66

    A header is a line with a pipe before a divider; of dividers in a row each second may be one.  Rows go on until a
    line without a pipe, a divider, or the next header.
    """
    pipe, divider = F.col("line").contains("|"), T.is_divider(F.col("line"))
    base = T.computed(lines, pipe=pipe, divider=divider, cells=F.when(pipe, T.split_row(F.col("line"))))
    may = base.withColumn("may", F.col("pipe") & F.coalesce(F.lead("divider").over(_by_line()), F.lit(False)))
    # candidates in a row take turns: position since the last line that is none
    runs = may.withColumn("last_none", F.max(F.when(~F.col("may"), F.col("line_no"))).over(_so_far()))
    head = runs.withColumn("header", F.col("may") & (F.pmod(F.col("line_no") - F.coalesce("last_none", F.lit(-1)), F.lit(2)) == 1))
    at = head.withColumn("header_line", F.last(F.when(F.col("header"), F.col("line_no")), True).over(_so_far()))
    rel = F.col("line_no") - F.col("header_line")
    stop = at.withColumn("stop", (rel >= 2) & (~F.col("pipe") | F.col("divider")))
    broken = F.max(F.when(F.col("stop"), F.col("line_no"))).over(_so_far()) > F.col("header_line")
    inside = stop.withColumn("header_line", F.when(~F.coalesce(broken, F.lit(False)), F.col("header_line")))
    row = (F.col("line_no") - F.col("header_line")) >= 2
    return inside.withColumn("row_idx", F.when(row, F.col("line_no") - F.col("header_line") - 2)).drop("may", "last_none", "stop")


def doc_lines(docs: DataFrame) -> DataFrame:  # O-03, O-12
    """split_lines with dual-column tables unfolded: all left halves, then all right halves, of the rows of a table with two code columns."""
    t = table_lines(split_lines(docs))
    codes = F.filter(F.transform(F.col("cells"), lambda c, i: F.when(c.rlike("代碼$"), i)), lambda i: i.isNotNull())
    at = F.when(F.col("header"), F.get(codes, F.lit(1)))
    cut = t.withColumn("at", F.when(F.col("row_idx").isNotNull(), F.last(F.when(F.col("header"), F.coalesce(at, F.lit(-1))), True).over(_so_far())))
    whole = F.array(F.struct(F.lit(0).alias("half"), F.col("line").alias("line")))

    def part(half: int, cells: Column) -> Column:
        line = F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
        return F.when(F.exists(cells, lambda c: c != ""), F.struct(F.lit(half).alias("half"), line.alias("line")))

    halves = F.array_compact(F.array(part(0, F.slice("cells", 1, F.col("at"))), part(1, F.slice("cells", F.col("at") + 1, F.size("cells")))))
    parts = F.when(F.coalesce(F.col("at"), F.lit(-1)) > 0, halves).otherwise(whole)
    new = cut.select(*KEY, "file_name", "line_no", F.when(F.col("at") > 0, F.col("header_line") + 2).otherwise(F.col("line_no")).alias("first"), F.explode(parts).alias("p"))
    order = Window.partitionBy(*KEY).orderBy("first", "p.half", "line_no")
    return new.select(*KEY, "file_name", (F.row_number().over(order) - 1).alias("n"), F.col("p.line").alias("line")).withColumnRenamed("n", "line_no")


def restrict_section(lines: DataFrame, start: Column, end: Column) -> DataFrame:  # O-63
    """Lines from the first with a start marker to before the next with an end marker; none where there is no start.  Contents lines don't count."""
    real = ~T.is_toc_like(F.col("line"))
    per_doc = Window.partitionBy(*KEY)
    s = F.min(F.when(real & T.contains_any(F.col("line"), start), F.col("line_no"))).over(per_doc)
    from_start = lines.withColumn("_s", s).where("line_no >= _s")
    e = F.min(F.when((F.col("line_no") > F.col("_s")) & real & T.contains_any(F.col("line"), end), F.col("line_no"))).over(per_doc)
    return from_start.withColumn("_e", e).where("_e IS NULL OR line_no < _e").drop("_s", "_e")


def row_lines(lines: DataFrame) -> DataFrame:
    """Lines with a pipe that aren't dividers, with cells and stride.  O-64

    stride is 2 below a header with a % column, 1 below one without, 2 before any header.
    """
    pipe, divider = F.col("line").contains("|"), T.is_divider(F.col("line"))
    base = T.computed(lines, cells=T.split_row(F.col("line")), _pipe=pipe, _divider=divider)
    base = base.withColumn("_header", F.col("_pipe") & ~F.col("_divider") & F.coalesce(F.lead("_divider").over(_by_line()), F.lit(False)))
    percent = F.exists("cells", lambda c: c.rlike("[%％]$"))
    marked = base.withColumn("stride", F.when(F.col("_header"), F.when(percent, 2).otherwise(1)))
    filled = marked.withColumn("stride", F.coalesce(F.last("stride", True).over(_so_far()), F.lit(2)))
    return filled.where("_pipe AND NOT _divider").drop("_pipe", "_divider", "_header")


def code_entries(rows: DataFrame) -> DataFrame:  # O-65
    """folder, file_ord, file_name, entry_ord, code, cells, stride: a row whose first cell is shaped like a code, with the cells of the rows after it up to the next."""
    opens = T.looks_like_code(F.get("cells", F.lit(0)))
    island = rows.withColumn("entry_ord", F.last(F.when(opens, F.col("line_no")), True).over(_so_far())).where("entry_ord IS NOT NULL")
    first = island.withColumn("own", F.col("line_no") == F.col("entry_ord"))
    grouped = first.groupBy(*KEY, "file_name", "entry_ord").agg(
        F.sort_array(F.collect_list(F.struct("line_no", "cells"))).alias("parts"), F.max(F.when(F.col("own"), F.col("stride"))).alias("stride")
    )
    cells = F.flatten(F.transform("parts", lambda p: p.cells))
    return grouped.select(*KEY, "file_name", "entry_ord", F.get(cells, F.lit(0)).alias("code"), cells.alias("cells"), "stride")


def tables(lines: DataFrame) -> DataFrame:
    """A row for each table: folder, file_ord, file_name, header_line, header, rows, heading, topic, numbered (the nearest `n. name` line before it), company_before, scale.  O-48, O-66, O-67"""
    from ..functions import numeric

    head = T.heading(F.col("line"))
    number = F.nullif(F.regexp_extract("line", r"(?U)^\s*\d+[.．]\s*(.+?)\s*$", 1), F.lit(""))
    t = table_lines(lines)
    t = t.withColumn("heading", F.last(head, True).over(_so_far(-1))).withColumn("numbered", F.last(number, True).over(_so_far(-1)))
    t = t.withColumn("company_before", F.coalesce(F.max(T.names_company(number)).over(_so_far(-1)), F.lit(False)))
    back = F.last(numeric.unit_scale(F.col("line")), True).over(_by_line().rowsBetween(-8, -1))
    t = t.withColumn("scale", F.when(F.col("header"), F.coalesce(numeric.unit_scale(F.get("cells", F.lit(0))), back, F.lit(1.0))))
    t = t.where("header_line IS NOT NULL AND (header OR row_idx IS NOT NULL)")
    first = lambda c: F.max(F.when(F.col("header"), F.col(c))).alias(c)
    grouped = t.groupBy(*KEY, "file_name", "header_line").agg(
        F.max(F.when(F.col("header"), F.col("cells"))).alias("header"),
        F.sort_array(F.collect_list(F.when(F.col("row_idx").isNotNull(), F.struct("row_idx", "cells")))).alias("parts"),
        first("heading"), first("numbered"), first("company_before"), first("scale"),
    )
    return grouped.select(*KEY, "file_name", "header_line", "header", F.transform("parts", lambda p: p.cells).alias("rows"), "heading", T.heading_topic(F.col("heading")).alias("topic"), "numbered", "company_before", "scale")


def row_sections(rows: Column) -> Column:  # O-68
    """For each row of an array of rows, the label of the nearest bare row before it; null on a bare row.

    Each bare row's label is repeated up to the next bare row, so the work grows with the rows.
    """
    is_bare = lambda r: (F.coalesce(F.get(r, F.lit(0)), F.lit("")) != "") & F.forall(F.slice(r, 2, 1 << 20), lambda c: c == "")
    bare = F.filter(F.transform(rows, lambda r, i: F.when(is_bare(r), F.struct(i.alias("at"), F.get(r, F.lit(0)).alias("label")))), lambda x: x.isNotNull())

    def filled(found: Column) -> Column:
        ends = F.concat(F.transform(F.slice(found, 2, F.greatest(F.size(found), F.lit(1))), lambda x: x.at), F.array(F.size(rows)))
        runs = F.zip_with(F.slice(found, 1, F.size(found)), F.slice(ends, 1, F.size(found)), lambda x, end: F.array_repeat(x.label, end - x.at))
        first = F.coalesce(F.get(found, F.lit(0)).at, F.size(rows))
        return F.concat(F.array_repeat(F.lit(None).cast("string"), first), F.flatten(runs))

    return F.zip_with(rows, T.let(bare, filled), lambda r, label: F.when(~is_bare(r), label))
