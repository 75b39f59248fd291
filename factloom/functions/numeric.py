"""Numbers, units and their display: Column to Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

#: Unit tokens, longest first, and what they make of an amount in billions of NT dollars.
UNIT_TO_BILLIONS = (
    ("兆", 1e3), ("拾億", 1.0), ("十億", 1.0), ("百萬", 1e-3), ("仟元", 1e-6), ("千元", 1e-6), ("億", 1e-1),
    ("billion", 1.0), ("bn", 1.0), ("million", 1e-3), ("mn", 1e-3), ("thousand", 1e-6),
)
_PLACEHOLDERS = ("", "-", "–", "—", "N/A", "NA", "n/a")
_FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _as_double(text: Column) -> Column:
    return F.when(text.rlike(_FLOAT), text.try_cast("double"))


def parse_numeric(cell: Column) -> Column:  # O-40
    """A cell's number or null.  Magnitude characters are dropped, not applied: units belong to tables."""

    def number(c: Column) -> Column:
        negative = c.rlike(r"^[(（]") & c.rlike(r"[)）]$")
        body = F.when(negative, strip(c.substr(F.lit(2), F.length(c) - 2))).otherwise(c)
        clean = F.regexp_replace(F.regexp_replace(body, r"(?U)[,$%％\s元仟千萬億NTnt]", ""), "−", "-")
        value = let(clean, _as_double)
        return F.when(negative, -value).otherwise(value) + 0.0

    # a plain number needs no cleaning, and without a digit there is none
    plain = lambda c: F.when(c.rlike(_FLOAT), c.try_cast("double") + 0.0).when(c.rlike("[0-9]"), number(c))
    return let(strip(cell), plain)


def nth_value(cells: Column, n: Column | int, stride: Column | int) -> Column:  # O-41
    """The n-th amount (1 first) right of the first cell, by position: numeric cells taken every stride."""
    n, stride = F.lit(n), F.lit(stride)
    numbers = F.filter(F.transform(F.slice(cells, 2, 1 << 20), parse_numeric), lambda v: v.isNotNull())
    return F.when(n >= 1, F.get(numbers, (n - 1) * stride))


def annualize(value: Column, quarter: Column) -> Column:  # O-42
    return F.try_divide(value * 4, quarter)


def format_value(value: Column) -> Column:  # O-43
    return F.coalesce(F.call_function("format_number", value, F.lit("#,##0.##########")), F.lit("N/A"))


def two_decimals(value: Column) -> Column:
    """A number with two decimals: its exact binary value, rounded to even at ties.

    value * 100 is a rounded product p and an exact error e, which Dekker's split of the factor gives.  Below 2^52 rint(p)
    is right but where p is a tie that e breaks; beyond, p is whole and e is what is rounded.  From 2^52 on a number has
    no decimals.
    """

    def shown(v: Column) -> Column:
        a = F.abs(v)
        c = a * 134217729.0
        high = c - (c - a)
        p = a * 100.0
        e = (high * 100.0 - p) + (a - high) * 100.0
        r = F.rint(p)
        small = r.cast("long") + F.when((p - r == 0.5) & (e > 0), 1).when((p - r == -0.5) & (e < 0), -1).otherwise(0)
        k = F.rint(e)
        large = p.cast("long") + k.cast("long")
        large += F.when((F.abs(e - k) == 0.5) & (F.pmod(large, F.lit(2)) == 1), F.signum(e - k).cast("long")).otherwise(0)
        digits = F.when(p < 4503599627370496.0, small).otherwise(large).cast("string")
        digits = F.concat(F.repeat(F.lit("0"), 3 - F.length(digits)), digits)
        minus = F.when((v < 0) | (F.signum(v).cast("string") == "-0.0"), "-").otherwise("")
        text = F.concat(minus, digits.substr(F.lit(1), F.length(digits) - 2), F.lit("."), F.substring(digits, -2, 2))
        return F.when(F.isnan(v) | (a >= 4503599627370496.0), F.format_string("%.2f", v)).otherwise(text)

    return let(value.cast("double"), shown)


def format_pct(value: Column) -> Column:  # O-44
    return F.coalesce(F.concat(two_decimals(value), F.lit("%")), F.lit("N/A"))


def format_maybe_pct(value: Column, is_percent: Column) -> Column:
    return F.when(is_percent, format_pct(value)).otherwise(format_value(value))


def apply_cost_sign(value: Column, label: Column, is_cost: Column) -> Column:  # O-45
    states_sign = F.coalesce(strip(label).rlike("^減[：:]"), F.lit(False))
    return F.when(is_cost & ~states_sign, -value + 0.0).otherwise(value)


def parse_plain(text: Column) -> Column:  # O-46
    return _as_double(F.regexp_replace(strip(text), ",", ""))


def unit_scale(text: Column) -> Column:  # O-47
    """Factor to billions where the text declares a unit, else null."""
    declared = text.rlike(r"(?i)單位|新台幣|新臺幣|NT\$|NTD")
    low = F.lower(text)
    first = F.coalesce(*[F.when(low.contains(token), F.lit(scale)) for token, scale in UNIT_TO_BILLIONS])
    return F.when(declared, first)


def thousands_to_billions(v: Column) -> Column:  # O-49
    return v / 1e6


def roc_year(western: Column) -> Column:
    return western - 1911


def quarter_end_month(quarter: Column) -> Column:
    return F.when(quarter.between(1, 4), quarter * 3)


def add_all(*values: Column) -> Column:  # O-50: null if any is null, 0 for none
    return reduce(lambda a, b: a + b, values, F.lit(0.0))


def all_or_null_sum(value: Column) -> Column:  # O-130
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def exported(value: Column, is_percent: Column) -> Column:  # O-51
    """Filing amounts in thousands as millions; percentages as they are."""
    return F.when(is_percent, value).otherwise(value / 1000)


def number_format(value: Column, is_percent: Column, is_scaled: Column) -> Column:  # O-18d
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(is_percent, "0.00%")
        .when(is_scaled, "#,##0.000")
        .when(value == F.floor(value), "#,##0")
        .otherwise("#,##0.00")
    )
