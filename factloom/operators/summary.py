"""The filing summary: 18 rows for each folder, from a fixed layout, each missing value with its reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import period as P
from ..functions import text as T
from ..plans import dims
from ..sources.staged import staged
from . import classify, lookup, profitability
from . import tables as X


def needed_codes(spark, folders: DataFrame, kind: str = "full") -> DataFrame:
    """folder, bank, slot, code that the layout, derivations and composites of each folder (folder, bank) need."""
    over = F.broadcast(dims.overrides(spark, kind))
    coded = folders.select("folder", "bank", F.explode(F.array(*[F.lit(r[1]) for r in dims.LAYOUT if r[0] == "code"])).alias("slot"))
    coded = coded.join(over, ["bank", "slot"], "left").select("folder", "slot", F.coalesce("new_code", "slot").alias("code"))  # O-104
    parts = coded.join(F.broadcast(dims.derivations(spark)), "code").select("folder", F.lit(None).cast("string").alias("slot"), F.col("part_code").alias("code"))
    comps = folders.join(F.broadcast(dims.composites(spark)), "bank").select("folder", F.lit(None).cast("string").alias("slot"), "code")
    return coded.unionByName(parts).unionByName(comps)


def laid_out(spark, folders: DataFrame, index: DataFrame, labels: DataFrame, kind: str = "full") -> DataFrame:  # O-103, O-105, O-106
    """The 15 layout rows of each folder (folder, bank), with values of index (folder, code, ...) and labels (folder, term, ...)."""
    over = F.broadcast(dims.overrides(spark, kind))
    rows = folders.select("folder", "bank", F.explode(F.array(*[F.struct(F.lit(i + 1).alias("ord"), F.lit(k).alias("kind"), F.lit(c).cast("string").alias("slot"), F.lit(t).alias("term"), F.lit(x).alias("is_cost")) for i, (k, c, t, x) in enumerate(dims.LAYOUT)])).alias("r")).select("folder", "bank", "r.*")
    rows = rows.join(over, ["bank", "slot"], "left").withColumn("code", F.coalesce("new_code", "slot"))
    direct = rows.join(index, ["folder", "code"], "left")
    # a total that no filing states, from its parts: all of them, or none
    d = F.broadcast(dims.derivations(spark))
    part = index.withColumnRenamed("code", "part_code").join(d, "part_code")
    count = d.groupBy("code").agg(F.count("*").alias("of"))
    derived = part.groupBy("folder", "code").agg(F.sum("value").alias("sum"), F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "label"))), lambda x: x.label), "+").alias("labels"), F.min_by("file_name", "part").alias("file"))
    derived = derived.join(F.broadcast(count), "code").where("n = of").drop("n", "of")
    # composites: all or null, the first missing part named
    c = folders.join(F.broadcast(dims.composites(spark)), "bank").join(index, ["folder", "code"], "left")
    comp = c.groupBy("folder", "term").agg(N.all_or_null_sum(F.col("value")).alias("csum"), F.min_by("file_name", "part").alias("cfile"), F.min(F.when(F.col("value").isNull(), F.struct("part", "code"))).alias("miss"))
    x = direct.join(derived, ["folder", "code"], "left").join(comp, ["folder", "term"], "left")
    x = x.join(labels.select("folder", F.col("term").alias("term"), F.col("label").alias("llabel"), F.col("value").alias("lvalue"), F.col("file_name").alias("lfile")), ["folder", "term"], "left")
    is_code, is_comp = F.col("kind") == "code", F.col("kind") == "composite"
    stated = F.col("value").isNotNull()
    value = F.when(is_code, F.coalesce("value", "sum")).when(is_comp, F.col("csum")).otherwise(F.col("lvalue"))
    label = F.when(is_code, F.coalesce("label", "labels")).when(is_comp, F.when(F.col("csum").isNotNull(), F.col("term"))).otherwise(F.col("llabel"))
    file = F.when(is_code, F.when(stated, F.col("file_name")).otherwise(F.col("file"))).when(is_comp, F.when(F.col("csum").isNotNull(), F.col("cfile"))).otherwise(F.col("lfile"))
    plus = F.regexp_replace("labels", r"\+", " + ")
    reason = (
        F.when(is_code & stated, "")
        .when(is_code & F.col("sum").isNotNull(), F.concat(F.lit("derived: "), F.col("term"), F.lit(" has no line of its own; sum of "), plus))
        .when(is_code, F.concat(F.lit("code "), F.col("code"), F.lit(" ("), F.col("term"), F.lit(") not found in any file")))
        .when(is_comp & F.col("csum").isNotNull(), "")
        .when(is_comp & F.col("miss").isNull(), F.concat(F.lit("'"), F.col("term"), F.lit("' has no formula for this bank")))
        .when(is_comp, F.concat(F.lit("'"), F.col("term"), F.lit("': component code "), F.col("miss.code"), F.lit(" not found")))
        .when(F.col("lvalue").isNull(), F.concat(F.lit("'"), F.col("term"), F.lit("': none of its labels found in any file")))
        .otherwise("")
    )
    return x.select("folder", "ord", "term", N.apply_cost_sign(value, F.when(is_comp, F.lit(None).cast("string")).otherwise(label), F.col("is_cost")).alias("value"), label.alias("matched_label"), file.alias("source_file"), (F.col("kind") == "label").alias("is_percent"), F.lit(None).cast("double").alias("crosscheck_value"), reason.alias("note"))


def cost_income(rows: DataFrame) -> DataFrame:  # O-137
    """The CIR row of each folder, from its built rows."""
    v = lambda t: F.max(F.when(F.col("term") == t, F.col("value")))
    x = rows.groupBy("folder").agg(v("淨收益").alias("net"), v("營業費用").alias("cost"))
    absent = F.concat_ws(" and ", F.when(F.col("net").isNull(), "淨收益"), F.when(F.col("cost").isNull(), "營業費用"))
    why = F.when(absent != "", F.concat(F.lit("CIR needs "), absent, F.lit(", which came back N/A above"))).when(F.col("net") == 0, "CIR undefined: 淨收益 is zero").otherwise("")
    return x.select("folder", F.lit(16).alias("ord"), F.lit("CIR").alias("term"), (F.try_divide(F.abs("cost"), F.col("net")) * 100).alias("value"), F.lit("abs(營業費用) / 淨收益").alias("matched_label"), F.lit(None).cast("string").alias("source_file"), F.lit(True).alias("is_percent"), F.lit(None).cast("double").alias("crosscheck_value"), why.alias("note"))


def manual_inputs(docs: DataFrame, entries: DataFrame, rows: DataFrame, folders: DataFrame) -> DataFrame:
    """income, assets1, assets2, equity1, equity2, quarter of each folder (folder, bank), always by the full filing's codes."""
    spark = docs.sparkSession
    income = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for b, m in dims.OVERRIDES["full"].items() for x in (b, m["64000"])]), F.col("bank")), F.lit("64000"))
    wanted = folders.select("folder", F.explode(F.array(F.struct(income.alias("code"), F.lit("income").alias("what"), F.lit("64000").alias("slot")), *[F.struct(F.lit(c).alias("code"), F.lit(w).alias("what"), F.lit(c).alias("slot")) for c, w in (("10000", "assets"), ("30000", "equity"))])).alias("w")).select("folder", "w.*")
    both = (1, 2)
    label = F.coalesce(F.get("cells", F.lit(1)), F.col("code"))
    coded = lookup.in_periods(entries.join(wanted, ["folder", "code"]).withColumn("label", label), both)
    code = staged(lookup._first(coded, "folder", "what", "period"), "coded")
    fall = wanted.join(F.broadcast(dims.fallbacks(spark)), "slot").withColumn("period", F.explode(F.array(*map(F.lit, both)))).join(code, ["folder", "what", "period"], "left_anti")
    rest = rows.where(F.col("line").startswith("|") & (F.size("cells") >= 2)).withColumn("entry_ord", F.col("line_no"))
    sides = [F.struct(F.lit(side).alias("side"), T.strip_footnote_suffix(F.get("cells", F.lit(1 - side))).alias("label")) for side in (0, 1)]
    named = rest.withColumn("x", F.explode(F.array(*sides))).withColumn("label", F.col("x.label")).drop("x")
    labelled = lookup.in_periods(named, both).join(fall.select("folder", "label", "what", "period"), ["folder", "label", "period"])
    both = code.unionByName(lookup._first(labelled, "folder", "what", "period"))
    pick = lambda what, p: F.max(F.when((F.col("what") == what) & (F.col("period") == p), F.col("value")))
    file = F.max(F.when((F.col("what") == "assets") & (F.col("period") == 1), F.col("file_name")))
    x = both.groupBy("folder").agg(pick("income", 1).alias("income"), pick("assets", 1).alias("assets1"), pick("assets", 2).alias("assets2"), pick("equity", 1).alias("equity1"), pick("equity", 2).alias("equity2"), file.alias("file_name"))
    quarters = docs.select("folder", "file_name", "file_ord", P.first_quarter(F.col("content")).alias("q")).groupBy("folder", "file_name").agg(F.min_by("q", "file_ord").alias("quarter"))
    return x.join(quarters, ["folder", "file_name"], "left").drop("file_name")


def parsed(docs: DataFrame, banks: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """folders (folder, bank) whose bank and industry are known, lines, rows, entries: parsed once, and staged."""
    folders = (classify.identity(docs) if banks is None else banks).where(F.col("bank").isNotNull() & F.col("industry").isin(*dims.BANKING)).select("folder", "bank")
    lines = staged(X.doc_lines(docs), "lines")
    rows = staged(X.row_lines(lines), "rows")
    return staged(folders, "folders"), lines, rows, staged(X.code_entries(rows), "entries")


def layout_rows(folders: DataFrame, rows: DataFrame, entries: DataFrame, kind: str = "full", period: int = 1) -> DataFrame:
    """The 15 rows of each folder that come from codes and labels."""
    spark = folders.sparkSession
    needed = needed_codes(spark, folders, kind)
    fall = needed.where("slot IS NOT NULL").join(F.broadcast(dims.fallbacks(spark)), "slot").select("folder", "code", "label").distinct()
    index = staged(lookup.code_index(rows, entries, needed.select("folder", "code").distinct(), fall, period), "index")
    deposit = spark.createDataFrame([("活存比", x) for x in dims.DEPOSIT_LABELS], "term string, label string")
    return staged(laid_out(spark, folders, index, lookup.find_labels(rows, F.broadcast(deposit), period), kind), "laid")


def filing_summary(docs: DataFrame, kind: str = "full", period: int = 1, deck_ratios: DataFrame | None = None, banks: DataFrame | None = None) -> DataFrame:  # O-162
    """folder, ord, term, value, matched_label, source_file, is_percent, crosscheck_value, note: 18 rows for each folder whose bank and industry are known.

    deck_ratios: folder, roa, roe of an earnings deck.  banks: folder, bank, industry, when already known.
    """
    spark = docs.sparkSession
    folders, lines, rows, entries = parsed(docs, banks)
    laid = layout_rows(folders, rows, entries, kind, period)
    names = F.broadcast(dims.aliases(spark).groupBy("bank").agg(F.collect_list("alias").alias("names")))
    scoped = folders.join(names, "bank", "left")
    entry = profitability.chosen(profitability.entries(docs, lines), scoped)
    manual = profitability.manual_ratios(manual_inputs(docs, entries, rows, folders))
    x = folders.join(entry.select("folder", "roa_posttax", "roe_posttax", "period_label", "file_name"), "folder", "left").join(manual, "folder", "left")
    x = x.join(deck_ratios, "folder", "left") if deck_ratios is not None else x.withColumns({"roa": F.lit(None).cast("double"), "roe": F.lit(None).cast("double")})
    x = staged(x, "ratios")
    out = laid.unionByName(cost_income(laid))
    for ord_, term, disclosed, deck, formula in ((17, "ROA", "roa_posttax", "roa", "manual_roa"), (18, "ROE", "roe_posttax", "roe", "manual_roe")):
        p = profitability.prioritised(term, F.col(disclosed), F.col(deck), F.col(formula), F.col("period_label"), F.col("file_name"))
        r = x.select("folder", F.lit(ord_).alias("ord"), F.lit(term).alias("term"), *[c.alias(n) for n, c in p.items()])
        r = r.withColumn("note", profitability.note(term, F.col("value"), F.col("crosscheck_value"), F.col("diverges"), F.col("implausible"))).withColumn("is_percent", F.lit(True)).drop("diverges", "implausible")
        out = out.unionByName(r)
    return out


def coverage(rows: DataFrame, ratio: float = 0.5) -> DataFrame:  # O-89
    """Folders of whose summary rows more than ratio are N/A: folder, missing, n, terms, in order of layout."""
    x = rows.groupBy("folder").agg(F.count_if(F.col("value").isNull()).alias("missing"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("value").isNull(), F.struct("ord", "term")))).alias("t"))
    return x.where(F.col("missing") > ratio * F.col("n")).select("folder", "missing", "n", F.array_join(F.transform("t", lambda y: y.term), ", ").alias("terms"))
