"""Tables for a terminal: columns as wide as their widest value, where East Asian characters take two places."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def padded(c: Column, width: Column | int) -> Column:  # O-18f
    """A text filled up with spaces to a width on a terminal."""
    return F.concat(c, F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - T.display_width(c))))


def _shown(c: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("N/A")), r"[\r\n\t]", " ")


def laid_out(rows: DataFrame, columns: Iterable[str], keep: Iterable[str] = (), least: Iterable[int] = ()) -> DataFrame:  # O-18f, O-35
    """rows' `keep` and line: the columns as text, N/A for null, two spaces apart, each as wide as its widest value and as `least` says; spaces at the end go."""
    columns = list(columns)
    least = list(least) or [0] * len(columns)
    widths = rows.agg(*[F.coalesce(F.max(T.display_width(_shown(c))), F.lit(0)).alias(f"w{k}") for k, c in enumerate(columns)]).first()
    line = F.concat_ws("  ", *[padded(_shown(c), max(w, n)) for c, w, n in zip(columns, widths, least)])
    return rows.select(*keep, F.rtrim(line).alias("line"))


def printed(rows: DataFrame) -> Iterator[str]:
    """Lines of a table under the names of its columns: all rows in their order, a partition at a time."""
    kept = rows.select(*[F.col(c).cast("string").alias(f"c{k}") for k, c in enumerate(rows.columns)]).persist()
    columns = kept.columns
    head = rows.sparkSession.createDataFrame([tuple(rows.columns)], ", ".join(f"{c} string" for c in columns))
    widths = [kept.agg(*[F.coalesce(F.max(T.display_width(_shown(c))), F.lit(0)) for c in columns]).first(), head.select(*[T.display_width(F.col(c)) for c in columns]).first()]
    for table in (head, kept):
        yield from (r.line for r in laid_out(table, columns, least=map(max, *widths)).toLocalIterator())
    kept.unpersist()
