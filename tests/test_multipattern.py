"""The automaton against plain search, and strengths by it against strength()."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.functions import multipattern as M
from factloom.operators import matching
from factloom.plans import dims


def test_all_patterns_are_found(spark):
    rng = random.Random(4)
    patterns = sorted({"".join(rng.choice("ab放款𝒳") for _ in range(rng.randint(1, 4))) for _ in range(60)})
    texts = [None, "", "zzz", *("".join(rng.choice("ab放款𝒳 z") for _ in range(rng.randint(1, 30))) for _ in range(150))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", M.found(F.col("t"), M.automaton(patterns)).alias("f")).collect()
    for r in rows:
        assert r.f == [i for i, p in enumerate(patterns) if p in (r.t or "")]
    with pytest.raises(ValueError):
        M.automaton(["a", ""])


def test_the_plan_has_one_size(spark):
    df = spark.createDataFrame([("abc",)], "t string")
    size = lambda n: df.select(M.found(F.col("t"), M.automaton([f"p{i}x" for i in range(n)])))._jdf.queryExecution().analyzed().numberedTreeString().count("\n")
    assert size(2) == size(500)


def test_strengths_are_those_of_each_term(spark):
    rng = random.Random(8)
    terms = [*dims.curated_terms().values(), dims.Term("odd", True, ("Ab", "ab c"), ((("ab", "x"), 0.5), (("C", "c"), 0.3), (("",), 0.1)), 0.9, ("no",)), dims.Term("blank", False, ("",))]
    words = ["放款", "企業", "房貸", "NIM", "nim", "存款", "利差", "ROA", "稅後", "年化", "信用卡", "循環", "個人", "Ab", "c", "x", "no", "外幣", "合計", " "]
    labels = [None, "", "  ", *("".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(300)), *[f" {a} " for t in terms for a in t.aliases]]
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    found = Counter(tuple(r) for r in matching.strengths(df, terms).collect())
    plain = df.distinct().withColumn("t", F.explode(dims.term_column(terms))).select("label", F.col("t.name").alias("term"), matching.strength(F.col("t"), F.col("label")).alias("strength")).where("strength > 0")
    assert found == Counter(tuple(r) for r in plain.collect())


def test_labels_are_dealt_over_all_tasks(spark):
    from factloom.operators import matching
    from factloom.plans import dims

    labels = spark.createDataFrame([(f"alpha {i}",) for i in range(40)], "label string")
    found = matching.strengths(labels, [dims.Term("a", aliases=("alpha",))])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan  # small labels aren't brought together into one task
    assert found.count() == 40
