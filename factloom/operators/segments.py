"""Scans over the lines of documents of any length: two levels, no task holds a document.

A document is cut into segments of `SEGMENT` lines.  A scan (forward fill, running sum, position) runs in a window over
each segment; the last row of each segment says what it hands on, these few rows are scanned over the document, and what
comes in is joined to the segments' rows.  Rows stay where their segment is; only one row for each segment moves.  Where
a line looks at the next one, the first line of a segment is given to the segment before as well.

The functions give what those of tables.py and lookup.py give for documents that fit a task; facts come without lists of
cells, so an entry or a table may be as long as the document.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numeric as N
from ..functions import text as T
from ..sources.staged import staged
from .tables import KEY

#: Lines of a segment.
SEGMENT = 1 << 14


def _inside(keys: list[str], last: int = 0):
    return Window.partitionBy(*keys, "seg").orderBy("line_no").rowsBetween(Window.unboundedPreceding, last)


def cut(lines: DataFrame, size: int = SEGMENT) -> DataFrame:
    return lines.withColumn("seg", F.floor(F.col("line_no") / size))


def numbered(rows: DataFrame, keys: list[str], order: list[str], seg: str) -> DataFrame:  # O-150
    """rows with line_no: 0, 1... within keys, in order of (seg, *order); a segment fits a task."""
    own = F.row_number().over(Window.partitionBy(*keys, seg).orderBy(*order))
    at = staged(rows.withColumn("line_no", own), "numbered")
    counts = at.groupBy(*keys, seg).agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.sum("_n").over(Window.partitionBy(*keys).orderBy(seg)) - F.col("_n")).drop("_n")
    return at.join(starts, [*keys, seg]).withColumn("line_no", F.col("_start") + F.col("line_no") - 1).drop("_start")


def scanned(rows: DataFrame, name: str, fills: Mapping[str, Column] | None = None, sums: Mapping[str, Column] | None = None, keys: list[str] = KEY) -> DataFrame:
    """rows (with seg and line_no) with forward fills (the last value up to and with the row) and running sums (of the rows before), over each document."""
    fills, sums = fills or {}, sums or {}
    within = rows.withColumns({k: F.last(v, True).over(_inside(keys)) for k, v in fills.items()} | {f"_own_{k}": v for k, v in sums.items()})
    within = within.withColumns({k: F.coalesce(F.sum(f"_own_{k}").over(_inside(keys, -1)), F.lit(0)) for k in sums})
    at = staged(within, name)
    # what a segment hands on is in its last row
    last = at.groupBy(*keys, "seg").agg(F.max_by(F.struct(*fills, *[(F.col(k) + F.col(f"_own_{k}")).alias(k) for k in sums]), "line_no").alias("_x"))
    so_far = Window.partitionBy(*keys).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    came = last.select(*keys, "seg", *[F.last(f"_x.{k}", True).over(so_far).alias(f"_in_{k}") for k in fills], *[F.coalesce(F.sum(f"_x.{k}").over(so_far), F.lit(0)).alias(f"_in_{k}") for k in sums])
    joined = at.join(came, [*keys, "seg"])
    for k in fills:
        joined = joined.withColumn(k, F.coalesce(k, f"_in_{k}"))
    for k in sums:
        joined = joined.withColumn(k, F.col(k) + F.col(f"_in_{k}"))
    return joined.drop(*[f"_in_{k}" for k in (*fills, *sums)], *[f"_own_{k}" for k in sums])


def before_divider(lines: DataFrame, size: int) -> DataFrame:
    """lines in segments, with cells (of lines with a pipe), pipe, divider and opens (the next line is a divider)."""
    pipe, divider = F.col("line").contains("|"), T.is_divider(F.col("line"))
    flagged = T.computed(cut(lines, size), pipe=pipe, divider=divider, cells=F.when(pipe, T.split_row(F.col("line"))))
    # the first line of a segment is seen by the segment before
    seen = F.when((F.col("line_no") % size == 0) & (F.col("line_no") > 0), F.array(F.col("seg"), F.col("seg") - 1)).otherwise(F.array("seg"))
    both = flagged.withColumn("_home", F.col("seg")).withColumn("seg", F.explode(seen))
    opens = F.coalesce(F.lead("divider").over(Window.partitionBy(*KEY, "seg").orderBy("line_no")), F.lit(False))
    return both.withColumn("opens", opens).where("seg = _home").drop("_home")


def table_lines(lines: DataFrame, size: int = SEGMENT) -> DataFrame:  # O-66, O-67, O-141
    """Lines with seg, cells, pipe, divider, header, header_line and row_idx as of tables.table_lines(); for lines of a table also heading, of the nearest heading line before its header, and right, the place of its second code column."""
    may = before_divider(lines, size).withColumn("may", F.col("pipe") & F.col("opens")).drop("opens")
    codes = F.filter(F.transform(F.col("cells"), lambda c, i: F.when(c.rlike("代碼$"), i)), lambda i: i.isNotNull())
    # what is staged is narrow: cells are cut from their line again at the end
    may = may.withColumn("_right", F.when(F.col("may"), F.get(codes, F.lit(1)))).drop("cells")
    runs = scanned(may, "runs", {"last_none": F.when(~F.col("may"), F.col("line_no")), "_head": T.heading(F.col("line"))})
    header = F.col("may") & (F.pmod(F.col("line_no") - F.coalesce("last_none", F.lit(-1)), F.lit(2)) == 1)
    # what is known of a table travels with its header
    head = runs.withColumn("header", header).withColumn("_at", F.when(F.col("header"), F.struct(F.col("line_no").alias("line"), F.col("_head").alias("heading"), F.col("_right").alias("right")))).drop("may", "last_none", "_head", "_right")
    at = scanned(head, "headers", {"_at": F.col("_at")})
    rel = F.col("line_no") - F.col("_at.line")
    ends = at.withColumn("_stop", F.when((rel >= 2) & (~F.col("pipe") | F.col("divider")), F.col("line_no")))
    known = scanned(ends, "stops", {"_stop": F.col("_stop")})
    inside = ~F.coalesce(F.col("_stop") > F.col("_at.line"), F.lit(False))
    found = known.withColumn("header_line", F.when(inside, F.col("_at.line"))).withColumn("heading", F.when(inside, F.col("_at.heading"))).withColumn("right", F.when(inside, F.col("_at.right")))
    row = F.col("line_no") - F.col("header_line") - 2
    found = T.computed(found, cells=F.when(F.col("pipe"), T.split_row(F.col("line"))))
    return found.withColumn("row_idx", F.when(row >= 0, row)).drop("_at", "_stop")


def unfolded(lines: DataFrame, size: int = SEGMENT) -> DataFrame:  # O-12
    """Lines with dual-column tables unfolded, as of tables.doc_lines(): sorted by range over all tasks and numbered anew."""
    t = table_lines(lines, size)

    def part(half: int, cells: Column) -> Column:
        line = F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
        return F.when(F.exists(cells, lambda c: c != ""), F.struct(F.lit(half).alias("half"), line.alias("line")))

    dual = F.coalesce((F.col("right") > 0) & F.col("row_idx").isNotNull(), F.lit(False))
    halves = F.array_compact(F.array(part(0, F.slice("cells", 1, F.col("right"))), part(1, F.slice("cells", F.col("right") + 1, F.size("cells")))))
    parts = F.when(dual, halves).otherwise(F.array(F.struct(F.lit(0).alias("half"), F.col("line").alias("line"))))
    new = t.select(*KEY, "file_name", F.col("line_no").alias("_old"), F.when(dual, F.col("header_line") + 2).otherwise(F.col("line_no")).alias("_first"), F.explode(parts).alias("_p"))
    order = ["_first", "_half", "_old"]
    new = new.select(*KEY, "file_name", "_first", F.col("_p.half").alias("_half"), "_old", F.col("_p.line").alias("line"))
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = staged(new.repartitionByRange(tasks, *KEY, *order).withColumn("_range", F.spark_partition_id()), "unfolded")
    return numbered(ranges, KEY, order, "_range").select(*KEY, "file_name", "line_no", "line")


def row_lines(lines: DataFrame, size: int = SEGMENT) -> DataFrame:  # O-64, O-140
    """Lines with a pipe that aren't dividers, with seg, cells and stride, as of tables.row_lines()."""
    base = before_divider(lines, size)
    percent = F.exists("cells", lambda c: c.rlike("[%％]$"))
    header = F.col("pipe") & ~F.col("divider") & F.col("opens")
    filled = scanned(base.withColumn("_own", F.when(header, F.when(percent, 2).otherwise(1))).drop("opens"), "strides", {"stride": F.col("_own")})
    return filled.where("pipe AND NOT divider").withColumn("stride", F.coalesce("stride", F.lit(2))).drop("pipe", "divider", "_own")


def code_facts(rows: DataFrame, period: int = 1) -> DataFrame:  # O-65, O-142
    """folder, file_ord, file_name, entry_ord, code, label, value of a period: as of lookup.code_facts() over tables.code_entries().

    The numbers of an entry are counted along its rows, so the row that holds the wanted one is known without the others.
    """
    opens = T.looks_like_code(F.get("cells", F.lit(0)))
    numbers = lambda cells: F.filter(F.transform(cells, N.parse_numeric), lambda v: v.isNotNull())
    right = F.when(opens, F.slice("cells", 2, 1 << 20)).otherwise(F.col("cells"))
    base = T.computed(rows, _opens=opens, _numbers=numbers(right), _first=F.get("cells", F.lit(0)), _second=F.get("cells", F.lit(1)))
    # what is staged is narrow: the cells stay behind
    base = base.select(*KEY, "file_name", "seg", "line_no", "stride", "_opens", "_numbers", "_first", "_second")
    entry = F.when(F.col("_opens"), F.struct(F.col("line_no").alias("ord"), F.col("stride").alias("stride")))
    at = scanned(base.withColumn("_new", entry).drop("stride"), "entries", {"_entry": F.col("_new")}, {"_before": F.size("_numbers")}).where("_entry IS NOT NULL")
    # numbers before the entry: those before its first row, which is a row of the entry's own
    first = scanned(at.drop("_new"), "islands", {"_base": F.when(F.col("_opens"), F.col("_before"))})
    place = (period - 1) * F.col("_entry.stride") - (F.col("_before") - F.col("_base"))
    hit = (place >= 0) & (place < F.size("_numbers"))
    own = lambda c: F.max(F.when(F.col("_opens"), c))
    found = first.withColumn("_value", F.when(hit, F.get("_numbers", place.cast("int")))).withColumn("entry_ord", F.col("_entry.ord"))
    # an entry's label may be on a later row where its first has one cell only
    second = F.when(F.col("_opens"), F.col("_second"))
    later = F.min(F.when(~F.col("_opens"), F.struct("line_no", F.col("_first").alias("cell")))).getField("cell")
    code = own(F.col("_first"))
    return found.groupBy(*KEY, "file_name", "entry_ord").agg(code.alias("code"), F.coalesce(F.max(second), later, code).alias("label"), F.max("_value").alias("value"))
