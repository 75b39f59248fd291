"""Sections of rows against a plain loop, and in proportion to the rows."""

import random
import time

from pyspark.sql import functions as F

from factloom.operators import tables as X


def plain(rows):
    out, now = [], None
    for r in rows:
        bare = bool(r) and r[0] != "" and all(c == "" for c in r[1:])
        now = r[0] if bare else now
        out.append(None if bare else now)
    return out


def test_sections(spark):
    rng = random.Random(3)
    tables = [[], [["a", ""]], [["a"]], [["", ""]], [["x", "1"]], *[[[rng.choice(["a", "b", ""]), *[rng.choice(["", "", "7"]) for _ in range(rng.randint(0, 2))]] for _ in range(rng.randint(1, 12))] for _ in range(200)]]
    df = spark.createDataFrame([(t,) for t in tables], "t array<array<string>>")
    for r in df.select("t", X.row_sections(F.col("t")).alias("s")).collect():
        assert r.s == plain(r.t), r.t


def test_long_tables(spark):
    t = [["s%d" % i, ""] if i % 2 else ["r", "1"] for i in range(200_000)]
    df = spark.createDataFrame([(t,)], "t array<array<string>>").persist()
    df.count()
    began = time.time()
    assert df.select(F.size(X.row_sections(F.col("t")))).first()[0] == len(t)
    assert time.time() - began < 20
