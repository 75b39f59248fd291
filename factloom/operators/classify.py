"""What a folder is: kind of document set, industry, reporting bank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import dims


def first_files(docs: DataFrame, n: int = 5) -> DataFrame:  # O-04: folder, text of its first n files run together
    some = docs.where(F.col("file_ord") <= n).groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("file_ord", "content"))).alias("parts"))
    return some.select("folder", F.array_join(F.transform("parts", lambda p: p.content), "").alias("text"))


def industry(text: Column) -> Column:  # O-113: the first in order of priority whose legal endings occur
    found = [F.when(reduce(lambda a, b: a | b, [text.contains(w) for w in words]), name) for name, words in dims.INDUSTRY_WORDS]
    return F.coalesce(*found)


def bank_candidates(text: Column, industry_name: Column) -> Column:  # O-112: all entities named, in order
    """Entities with an alias in the text that file under the industry; all entities when it is unknown."""
    fits = industry_name.isNull() | industry_name.isin(*dims.BANKING)
    named = [F.when(fits & reduce(lambda a, b: a | b, [text.contains(a) for a in f[0]]), b) for b, f in dims.ENTITIES.items()]
    return F.array_compact(F.array(*named))


def resolved(names: DataFrame) -> DataFrame:  # O-114
    """names (name) with bank: the entity whose own name or alias it is, the first in order of entities; null for an unknown name."""
    spark = names.sparkSession
    known = dims.aliases(spark).select("bank", "bank_ord", "alias").union(dims.aliases(spark).select("bank", "bank_ord", F.col("bank")).distinct())
    one = known.groupBy("alias").agg(F.min_by("bank", "bank_ord").alias("bank"))
    return names.join(F.broadcast(one.withColumnRenamed("alias", "name")), "name", "left")


def identity(docs: DataFrame) -> DataFrame:
    """folder, industry, candidates, bank: the bank only when exactly one is named; else message says why."""
    x = T.computed(first_files(docs), industry=industry(F.col("text"))).withColumn("candidates", bank_candidates(F.col("text"), F.col("industry"))).drop("text")
    bank = F.when(F.size("candidates") == 1, F.get("candidates", F.lit(0)))
    message = (
        F.when(F.size("candidates") == 1, "")
        .when(F.size("candidates") > 1, F.concat(F.lit("several banks are named: "), F.array_join("candidates", ", ")))
        .when(F.col("industry").isNotNull() & ~F.col("industry").isin(*dims.BANKING), F.concat(F.lit("no entity files under "), F.col("industry")))
        .otherwise("no bank is named in the first pages")
    )
    return x.withColumn("bank", bank).withColumn("message", message)


def classified(docs: DataFrame, codes: DataFrame, threshold: int = 5, most_files: int = 30) -> DataFrame:  # O-132, O-166
    """folder, kind, code_hits, con_hits: filing on code rows before deck on wording; codes: code."""
    marks = docs.groupBy("folder").agg(
        F.count_if(reduce(lambda a, b: a | b, [F.col("content").contains(w) for w in dims.DECK_WORDS])).alias("con_hits"),
        F.max(F.col("content").contains("活期性存款比率")).alias("short"),
        F.count("*").alias("files"),
    )
    lines = docs.select("folder", F.explode(F.split("content", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")).alias("line")).where(F.col("line").startswith("|"))
    first = lines.select("folder", T.strip(F.get(F.split(F.regexp_replace("line", r"^\|+|\|+$", ""), r"\|"), F.lit(0))).alias("code"))
    hits = first.join(codes.select("code"), "code", "left_semi").groupBy("folder").agg(F.count("*").alias("code_hits"))
    x = marks.join(hits, "folder", "left").withColumn("code_hits", F.coalesce("code_hits", F.lit(0)))
    kind = F.when(F.col("code_hits") >= threshold, F.when(F.col("short") & (F.col("files") <= most_files), "fin_report_summary").otherwise("fin_report")).when(F.col("con_hits") > 0, "con_call")
    return x.select("folder", kind.alias("kind"), "code_hits", "con_hits")


def paired(kinds: DataFrame) -> DataFrame:  # O-119
    """filing, deck: only when there is exactly one of each."""
    filing = F.col("kind").startswith("fin_report")
    deck = F.col("kind") == "con_call"
    x = kinds.agg(F.count_if(filing).alias("f"), F.count_if(deck).alias("d"), F.max(F.when(filing, F.col("folder"))).alias("filing"), F.max(F.when(deck, F.col("folder"))).alias("deck"))
    return x.where("f = 1 AND d = 1").select("filing", "deck")
