"""Conversion to cents like decimal arithmetic on exact binary values."""

import math
import random

from ledgermill.functions import text as T
from pyspark.sql import functions as F


def test_cents_of_a_million_products_and_of_ties(spark):
    rng = random.Random(1)
    xs = [k / 8 for k in range(-4000, 4000)] + [k / 100 + 0.005 for k in range(-2000, 2000)]  # exact ties, and neighbours that only look so
    xs += [math.nextafter(x, to) for x in xs[::7] for to in (math.inf, -math.inf)]
    xs += [0.0, 1e-300, -1e-9, 2.675, 1.005, 1e13 + 0.125, -(2.0**42) - 0.375, 4.4e13 + 0.015625, 1e15 + 0.5, 1e300, -1e300]
    xs += [round(rng.uniform(-1e7, 1e7), 2) * rng.choice([1.09, 0.74, 3.6725, 83.12, 1 / 3]) for _ in range(200_000)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", T.rounded_cents(F.col("x")).alias("r")).collect()
    assert [(r["x"], r["r"]) for r in got if r["r"] != round(r["x"], 2)] == []
    # a million more, whose sums of cents must agree
    rows = spark.range(1_000_000).select((F.col("id") * 1.015 - 500_000.0).alias("x"), T.convert(F.col("id") * 1.015 - 500_000.0, F.lit(1.0)).alias("r"))
    pairs = rows.toPandas()
    assert [x for x, r in zip(pairs["x"], pairs["r"]) if round(x, 2) != r] == []
    assert spark.range(1).select(T.convert(F.lit(None).cast("double"), F.lit(2.0)).alias("r")).first()["r"] is None
