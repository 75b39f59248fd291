"""The deck summary: 12 rows for each earnings deck, with loans recomposed and reconciled, and regulator figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import period as P
from ..plans import dims
from ..sources.staged import staged
from . import classify, matching
from . import tables as X

REGULATOR = ("逾放比率", "備抵呆帳/逾期放款")
#: What a deck takes from the regulator's table; the two datasets may be of different months.
FIGURES = {"card_period": "string", "revolving": "double", "npl_period": "string", "npl_ratio": "double", "coverage": "double"}


def periods(docs: DataFrame) -> DataFrame:  # O-05, O-61, O-62
    """folder, quarter, year of each deck, by its first file."""
    return docs.where("file_ord = 1").select("folder", P.deck_quarter(F.col("content")).alias("quarter"), P.deck_year(F.col("content")).alias("year"))


def asked(docs: DataFrame) -> DataFrame:
    """folder, year, quarter whose regulator figures each deck asks for; both null, for the newest month, when the deck doesn't state both."""
    known = F.col("year").isNotNull() & F.col("quarter").isNotNull()
    return periods(docs).select("folder", F.when(known, F.col("year")).alias("year"), F.when(known, F.col("quarter")).alias("quarter"))


def recomposed(values: DataFrame, formulas: DataFrame) -> DataFrame:  # O-50, O-161
    """folder, bank, term, value for values (folder, bank, term, value): sums of coefficient times value; null if any input is.  A bank's other terms aren't in the result."""
    need = values.select("folder", "bank").distinct().join(F.broadcast(formulas), "bank")
    x = need.join(values.select("folder", F.col("term").alias("in_term"), "value"), ["folder", "in_term"], "left")
    total = F.when(F.count("value") == F.count(F.lit(1)), F.sum(F.col("coef") * F.col("value")))
    return x.groupBy("folder", "bank", F.col("out_term").alias("term")).agg(total.alias("value"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("coef")).alias("k"), "in_term"))), lambda y: F.concat(F.when(y.k < 0, "+").otherwise("−"), y.in_term)), " ").alias("formula"))


def reconciled(rows: DataFrame, tolerance: float = dims.LOAN_TOLERANCE) -> DataFrame:  # O-90
    """folder, parts, total, gap of folders whose four loan parts miss the total by more than tolerance; all five must be known."""
    part = F.when(F.col("term").isin(*dims.LOAN_PARTS), F.col("value"))
    total = F.max(F.when(F.col("term") == "法說會放款餘額合計", F.col("value")))
    x = rows.groupBy("folder").agg(F.count(part).alias("n"), F.sum(part).alias("parts"), total.alias("total"))
    return x.where((F.col("n") == len(dims.LOAN_PARTS)) & F.col("total").isNotNull()).withColumn("gap", F.col("parts") - F.col("total")).where(F.abs("gap") > tolerance).drop("n")


def deck_ratios(docs: DataFrame, banks: DataFrame | None = None) -> DataFrame:  # O-120
    """folder, roa, roe: the deck's best figures, quarters preferred."""
    t = dims.curated_terms()
    found = matching.best(matching.in_lines(X.doc_lines(docs), [([t["ROA(稅後年化)"], t["ROE(稅後年化)"]], True, False)]), _primary(docs, banks))
    v = lambda k: F.max(F.when(F.col("term") == k, F.col("value")))
    return found.groupBy("folder").agg(v("ROA(稅後年化)").alias("roa"), v("ROE(稅後年化)").alias("roe"))


def _primary(docs: DataFrame, banks: DataFrame | None) -> DataFrame:
    named = (classify.identity(docs) if banks is None else banks).select("folder", "bank")
    names = F.create_map(*[x for b, f in dims.ENTITIES.items() for x in (F.lit(b), F.array(*map(F.lit, f[1])))])
    return named.select("folder", "bank", F.try_element_at(names, F.coalesce("bank", F.lit(""))).alias("primary"))


def deck_summary(docs: DataFrame, regulator: DataFrame | None = None, banks: DataFrame | None = None) -> DataFrame:  # O-116, O-160
    """folder, ord, term, kind, value, matched_label, period_label, source_file, note: 12 rows for each folder.

    regulator: bank (legal name), year, quarter as in asked(), card_period, revolving (thousands), npl_period, npl_ratio,
    coverage, one row for each bank and asked quarter; null or absent figures leave the rows N/A, with the reason where
    no name of the regulator's is known.
    """
    spark = docs.sparkSession
    terms = dims.curated_terms()
    primary = staged(_primary(docs, banks), "primary")
    groups = [([terms[k] for k in dims.RATIO_TERMS], True, False), ([terms[k] for k in dims.BALANCE_TERMS + dims.HELPER_TERMS], False, True)]
    found = staged(matching.best(matching.in_lines(staged(X.doc_lines(docs), "lines"), groups), primary.select("folder", "primary")), "found")
    names = dims.RATIO_TERMS + dims.BALANCE_TERMS + dims.HELPER_TERMS
    want = F.array(*[F.struct(F.lit(i + 1).alias("ord"), F.lit(n).alias("term"), F.lit("ratio" if n in dims.RATIO_TERMS else "balance" if n in dims.BALANCE_TERMS else "helper").alias("kind")) for i, n in enumerate(names)])
    legal = F.create_map(*[F.lit(x) for kv in dims.REGULATOR_NAMES.items() for x in kv])
    folders = primary.select("folder", "bank", F.try_element_at(legal, F.coalesce("bank", F.lit(""))).alias("legal"))
    if regulator is None:
        folders = folders.withColumns({n: F.lit(None).cast(t) for n, t in FIGURES.items()})
    else:
        official = regulator.select("bank", "year", "quarter", *FIGURES).toDF("r_bank", "r_year", "r_quarter", *FIGURES)
        same = (F.col("legal") == F.col("r_bank")) & F.col("year").eqNullSafe(F.col("r_year")) & F.col("quarter").eqNullSafe(F.col("r_quarter"))
        folders = folders.join(asked(docs), "folder", "left").join(official, same, "left").select("folder", "bank", "legal", *FIGURES)
    folders = staged(folders, "folders")
    rows = folders.withColumn("w", F.explode(want)).select("*", "w.*").drop("w").join(found.select("folder", "term", "value", "matched_label", "period_label", F.col("file_name").alias("source_file"), "scale"), ["folder", "term"], "left")
    rows = rows.withColumn("value", F.when(F.col("kind") == "ratio", F.col("value")).otherwise(F.col("value") * F.col("scale")))
    card = (F.col("term") == "信用卡循環") & F.col("value").isNull() & F.col("revolving").isNotNull()
    rows = rows.withColumns({
        "matched_label": F.when(card, F.concat(F.lit("循環信用餘額（金管會"), F.col("card_period"), F.lit("）"))).otherwise(F.col("matched_label")),
        "period_label": F.when(card, F.col("card_period")).otherwise(F.col("period_label")),
        "source_file": F.when(~card, F.col("source_file")),
        "value": F.when(card, F.col("revolving") / 1e6).otherwise(F.col("value")),
    })
    unmapped = F.when(F.col("bank").isNull(), "the deck names no known bank; the regulator was not asked").when(F.col("legal").isNull(), F.concat(F.lit("the regulator's name of "), F.col("bank"), F.lit(" is unknown"))).otherwise("")
    new = recomposed(rows.where("kind <> 'ratio'"), dims.loan_formulas(spark)).select("folder", "term", F.col("value").alias("nvalue"), "formula")
    rows = rows.withColumn("note", F.when((F.col("term") == "信用卡循環") & F.col("value").isNull(), unmapped).otherwise(""))
    rows = rows.join(new, ["folder", "term"], "left").where("kind <> 'helper'")
    rows = rows.withColumn("value", F.when(F.col("formula").isNotNull(), F.col("nvalue")).otherwise(F.col("value")))
    rows = rows.withColumn("matched_label", F.coalesce(F.concat(F.lit("重組："), F.col("formula")), "matched_label"))
    off = reconciled(rows).select("folder", F.lit("法說會放款餘額合計").alias("term"), F.format_string("the parts add up to %,.1f, the stated total is %,.1f: %,.1f apart", "parts", "total", "gap").alias("warn"))
    columns = ["folder", "ord", "term", "kind", "value", "matched_label", "period_label", "source_file", "note"]
    rows = rows.join(off, ["folder", "term"], "left").withColumn("note", F.coalesce("warn", "note")).select(columns)
    official = []
    for i, (term, figure) in enumerate(zip(REGULATOR, ("npl_ratio", "coverage"))):
        value = F.col(figure)
        label = F.when(value.isNotNull(), F.concat(F.lit("金管會公布（"), F.col("npl_period"), F.lit("）")))
        official.append(folders.select("folder", F.lit(11 + i).alias("ord"), F.lit(term).alias("term"), F.lit("ratio").alias("kind"), value.alias("value"), label.alias("matched_label"), F.when(value.isNotNull(), F.col("npl_period")).alias("period_label"), F.lit(None).cast("string").alias("source_file"), F.when(value.isNull(), unmapped).otherwise("").alias("note")))
    return rows.unionByName(official[0]).unionByName(official[1])
