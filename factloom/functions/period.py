"""Reporting periods: labels of deck columns, dates of filings, quarters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip, strip_period_footnote

#: The quarter that a month's name stands for.
MONTH_QUARTER = {"jan": 1, "feb": 1, "mar": 1, "apr": 2, "may": 2, "jun": 2, "jul": 3, "aug": 3, "sep": 3, "oct": 4, "nov": 4, "dec": 4}
_RANGE = r"(?U)(\d{2,3})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日\s*至\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"
_DAY = r"(?U)(\d{2,3})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"
PERIOD = "struct<year:int,rank:double,cumulative:boolean>"
DATE = "struct<y:int,m:int,d:int>"


def _part(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit("")).try_cast("int")


def normalize_year(y: Column) -> Column:  # O-55
    return F.when(y < 100, y + 2000).when(y < 200, y + 1911).otherwise(y)


def parse_period_label(cell: Column) -> Column:  # O-56
    """struct(year, rank, cumulative) of a cell that is purely a period label, else null.

    rank counts quarters, a full year is 5; cumulative marks N-month figures, whose rank may be a whole number of
    quarters without being that quarter.
    """
    return let(strip_period_footnote(strip(cell)), _period)


def _period(c: Column) -> Column:
    def form(pattern: str, year: Column, rank: Column, cumulative: bool = False, valid: Column | None = None) -> Column:
        made = F.struct(year.cast("int").alias("year"), rank.cast("double").alias("rank"), F.lit(cumulative).alias("cumulative"))
        return F.when(c.rlike(pattern) & (F.lit(True) if valid is None else valid), made)

    def number(pattern: str, group: int) -> Column:
        return _part(c, pattern, group)

    fy, q, h, m = r"(?i)^FY(\d{2,4})$", r"(?i)^(\d)Q(\d{2,4})$", r"(?i)^(\d)H(\d{2,4})$", r"(?i)^(\d{1,2})M(\d{2,4})$"
    named, dotted = r"(?U)^([A-Za-z]{3})[a-z]*\.?[\s\-]+(\d{2,4})$", r"^((?:19|20)\d{2})[./\-](0?[1-9]|1[0-2])$"
    quarter = F.element_at(F.create_map(*[F.lit(x) for kv in MONTH_QUARTER.items() for x in kv]), F.lower(F.regexp_extract(c, named, 1)))
    return F.coalesce(
        form(fy, normalize_year(number(fy, 1)), F.lit(5)),
        form(r"^(19|20)\d{2}$", c.try_cast("int"), F.lit(5)),
        form(q, normalize_year(number(q, 2)), number(q, 1), valid=number(q, 1).between(1, 4)),
        form(h, normalize_year(number(h, 2)), number(h, 1) * 2, valid=number(h, 1).between(1, 2)),
        form(m, normalize_year(number(m, 2)), number(m, 1) / 3, True),
        form(named, normalize_year(number(named, 2)), quarter, valid=quarter.isNotNull()),
        form(dotted, number(dotted, 1), F.floor((number(dotted, 2) + 2) / 3)),
    )


def _date(c: Column, pattern: str, *groups: int) -> Column:
    y, m, d = (_part(c, pattern, g) for g in groups)
    return F.when(y.isNotNull(), F.struct(y.alias("y"), m.alias("m"), d.alias("d")))


def parse_single_date(c: Column) -> Column:  # O-57
    return _date(c, _DAY, 1, 2, 3)


def parse_header_date(cell: Column) -> Column:  # O-58: a range gives its end
    c = strip(cell)
    dot, fiscal = r"^(\d{2,3})\.(\d{1,2})\.(\d{1,2})$", r"(?U)^(\d{2,3})\s*年度$"
    year = _part(c, fiscal, 1)
    return F.coalesce(_date(c, _RANGE, 1, 4, 5), parse_single_date(c), _date(c, dot, 1, 2, 3), F.when(year.isNotNull(), F.struct(year.alias("y"), F.lit(12).alias("m"), F.lit(31).alias("d"))))


def has_range(c: Column) -> Column:
    return c.rlike(_RANGE)


def range_text(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, _RANGE, 0), F.lit(""))


def month_quarter(month: Column) -> Column:
    return F.floor((month - 1) / 3).cast("int") + 1


def quarter_of_label(label: Column) -> Column:  # O-59
    return F.coalesce(month_quarter(_part(label, _RANGE, 4)), month_quarter(_part(label, _DAY, 2)))


def first_quarter(text: Column) -> Column:  # O-60
    return month_quarter(_part(text, r"(?U)(\d{2,3})\s*年\s*(\d{1,2})\s*月", 2))


def deck_quarter(text: Column) -> Column:  # O-61
    ordinal = F.regexp_extract(text, r"(?U)第\s*([一二三四1-4])\s*季", 1)
    named = F.element_at(F.create_map(*[F.lit(x) for k, n in zip("一二三四1234", (1, 2, 3, 4) * 2) for x in (k, n)]), ordinal)
    return F.coalesce(named, F.when(text.rlike(r"(?i)全年|FY\d{2,4}|Full[- ]?Year"), F.lit(4)), first_quarter(text))


def deck_year(text: Column) -> Column:  # O-62
    return _part(text, r"(?U)(20\d{2})\s*年", 1)


def ranked(items: Column, prefer_quarterly: Column) -> Column:  # O-144
    """An array of structs with period and pos, most recent first; prefer_quarterly lifts the latest year's fourth quarter over that full year."""
    latest = F.array_max(F.transform(items, lambda x: x.period.year))
    keyed = F.transform(
        items,
        lambda x: F.struct(
            F.when(prefer_quarterly & (x.period.year == latest) & (x.period.rank == 4) & ~x.period.cumulative, 0).otherwise(1).alias("a"),
            (-x.period.year).alias("y"),
            (-x.period.rank).alias("r"),
            x.pos.alias("p"),
            x.alias("item"),
        ),
    )
    return F.transform(F.array_sort(keyed), lambda k: k.getField("item"))
