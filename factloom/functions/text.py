"""Text of documents and cells: Column to Column, no Python in the query path.

Java's \\s and trim are ASCII only; documents hold U+3000 and the like, so white space is spelled out here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of this module and the wording in them, which must match the documents' own.

#: White space as Unicode has it, with the four information separators that Python's strip() also removes.
_W = r"[\s\x1c-\x1f]"
#: The same as characters, for trimming: a regular expression would try each place of a text.
_W_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
_CJK = "[一-鿿]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once and written once in the plan, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that later steps refer to without being merged into them: Catalyst would otherwise copy an expression to each of its uses."""
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.drop(*columns).select("*", made.alias("_c")).select("*", *[F.col(f"_c.{n}").alias(n) for n in columns]).drop("_c")


def strip(c: Column) -> Column:  # O-21
    return F.when(F.octet_length(c) == F.length(c), F.btrim(c, F.lit(_W_CHARS[:10]))).otherwise(F.btrim(c, F.lit(_W_CHARS)))


def despace_cjk(c: Column) -> Column:  # O-20
    ascii_only = F.octet_length(c) == F.length(c)
    return F.when(ascii_only, c).otherwise(F.regexp_replace(c, rf"(?U)(?<={_CJK}){_W}+(?={_CJK})", ""))


def contains_any(c: Column, terms: Column) -> Column:  # O-22
    """Whether any of an array of terms is in the text, in any case; false for an empty or null array."""
    low = F.lower(c)
    return F.coalesce(F.exists(terms, lambda t: low.contains(F.lower(t))), F.lit(False))


def is_toc_like(c: Column) -> Column:  # O-23
    return strip(c).rlike(r"(?U)^[一二三四五六七八九十百]+[、.].{0,30}\d+\s*[-–—]?\s*$")


def page_num(file_name: Column) -> Column:  # O-24
    stem = F.regexp_replace(file_name, r"(?<=.)\.[^.]*$", "")
    digits = F.regexp_extract(stem, r"^(\d+)", 1)
    return F.when(F.coalesce(file_name, F.lit("")) == "", "").when(digits != "", digits).otherwise(stem)


def strip_footnote(c: Column) -> Column:  # O-25
    return strip(F.regexp_replace(c, r"(?U)[（(]\s*註\s*\d+\s*[）)]", ""))


def strip_footnote_suffix(c: Column) -> Column:  # O-26
    return strip(F.regexp_replace(c, r"[（(]附註.*$", ""))


def split_row(line: Column) -> Column:  # O-27
    """Cells of a table line; one pipe at either end goes, empty cells keep their place."""
    inner = F.regexp_replace(strip(line), r"^\||\|$", "")
    return F.transform(F.split(inner, r"\|"), strip)


def is_divider(line: Column) -> Column:  # O-28
    cells = F.split(F.regexp_replace(strip(line), r"^\|+|\|+$", ""), r"\|")
    # few lines hold nothing but a divider's characters, and only these are cut
    may = line.contains("|") & (F.btrim(line, F.lit("|:-" + _W_CHARS)) == "")
    return F.when(line.isNotNull(), F.when(may, F.forall(cells, lambda c: strip(c).rlike(r"^(:?-+:?)?$"))).otherwise(False))


def looks_like_code(c: Column) -> Column:  # O-29
    return c.rlike(r"^[A-Za-z0-9]{3,8}$")


def strip_period_footnote(c: Column) -> Column:  # O-30
    return strip(F.regexp_replace(F.regexp_replace(c, r"(?i)(<sup>\d+</sup>)+$", ""), "[¹²³⁰⁴-⁹]+$", ""))


def heading_topic(c: Column) -> Column:  # O-31
    after = strip(F.get(F.split(c, r"[－\-–—]", 2), F.lit(1)))
    return F.when(F.coalesce(after, F.lit("")) != "", after).otherwise(strip(c))


def heading(line: Column) -> Column:  # O-67: text of a heading line, else null
    found = F.regexp_extract(line, r"(?U)^#{1,6}\s+(.+?)\s*$", 1)
    return F.when(found != "", strip(found))


def is_share_or_growth(c: Column) -> Column:  # O-32
    return c.rlike(r"(?i)占|佔|比重|比率|Ratio|Share|%|％|Chg|成長率|年增|季增|增率|YoY|QoQ|Growth")


def is_percent_cell(c: Column) -> Column:  # O-33
    return c.rlike("[%％]")


def names_company(c: Column) -> Column:
    return c.rlike(r"(?i)銀行|金控|控股|人壽|產險|證券|投信|投顧|保險|公司|Bank|FHC|Holdings|Financial|Life|Securities|Insurance")


def metric_of_row(cells: Column) -> Column:  # O-34
    """profit_margin, roa_posttax, roa_pretax, roe_posttax, roe_pretax or null, by the first two cells."""
    label = F.array_join(F.slice(cells, 1, 2), " ")
    roa, roe, after, before = label.contains("資產報酬率"), label.contains("淨值報酬率"), label.rlike(r"(?U)稅\s*後"), label.rlike(r"(?U)稅\s*前")
    return (
        F.when(label.contains("純益率"), "profit_margin")
        .when(roa & after, "roa_posttax")
        .when(roa & before, "roa_pretax")
        .when(roe & after, "roe_posttax")
        .when(roe & before, "roe_pretax")
    )


def is_entity(label: Column) -> Column:  # O-76
    return label.rlike(r"(?U)^(合併|本\s*公\s*司|國\s*泰|.+(?:銀行|人壽|產險|證券|保險)(?:股份有限公司|公司)?$)")


def display_width(c: Column) -> Column:  # O-35
    """Columns on a terminal: two for East Asian wide and full-width characters."""
    return F.length(F.regexp_replace(c, r"[ᄀ-ᅟ⺀-〾ぁ-꓏가-힣豈-﫿︰-﹯＀-｠￠-￦]", "xx"))


def last_segment(url: Column) -> Column:  # O-36
    return F.url_decode(F.element_at(F.split(url, "/"), -1))


def lenient_utf8(content: Column) -> Column:  # O-02
    """Bytes as text, invalid bytes left out."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "�", "")


def lines_of(content: Column) -> Column:  # O-03 up to the unfolding of tables
    """Non-blank lines, stripped, without spaces between CJK characters."""
    stripped = F.transform(F.split(content, _LINE_END), lambda x: strip(x))
    return F.transform(F.filter(stripped, lambda x: x != ""), lambda x: despace_cjk(x))
