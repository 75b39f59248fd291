"""Numbers as text: exact binary values, ties to even."""

import math
import random

from pyspark.sql import functions as F

from factloom.functions import numeric as N


def test_two_decimals_are_those_of_the_exact_value(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 0.125, 0.375, 2.675, -2.675, 1.005, -0.004, 0.005, 0.015, 1e-320, 99.995, 0.5, 1234567.125, 4503599627370495.5, 2.0**52, -(2.0**53), 1e15 + 0.125, 12345678901234.375]
    values += [rng.randint(-(10**9), 10**9) / 8 for _ in range(300)] + [rng.uniform(-1e6, 1e6) for _ in range(300)] + [k / 1000 + 0.005 for k in range(0, 3000, 10)] + [math.ldexp(rng.random(), rng.randint(-60, 51)) for _ in range(300)]
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "v double").select("v", N.two_decimals(F.col("v")).alias("t"), N.format_pct(F.col("v")).alias("p")).collect()
    for r in rows:
        assert (r.t, r.p) == ((None, "N/A") if r.v is None else (f"{r.v:.2f}", f"{r.v:.2f}%")), r.v
