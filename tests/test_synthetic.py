"""Synthetic rows: frequencies of many values, and the same rows on any partitioning."""

import math
from collections import Counter

from pyspark.sql import functions as F

from millrace.operators import drift


def test_frequencies_of_many_values(spark):
    """50,000 rare values beside one that a third of the rows have: all are in reach, and counts are within chance."""
    rare = spark.range(50_000).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("c"))
    df = rare.unionByName(spark.range(25_000).select(F.lit("common").alias("c")))
    n = 60_000
    drawn = drift.draw_values(spark.range(n), df, "c", 7)
    counts = {r.c: r["count"] for r in drawn.groupBy("c").count().collect()}
    assert sum(counts.values()) == n and counts.keys() <= {"common", *(f"v{i}" for i in range(50_000))}
    assert abs(counts["common"] - n / 3) < 5 * math.sqrt(n * 2 / 9)
    share = n / 75_000  # of each rare value a Poisson number is drawn
    sizes = Counter(counts.values())
    for k in range(1, 5):
        expected = 50_000 * math.exp(-share) * share**k / math.factorial(k)
        assert abs(sizes[k] - expected) < 6 * math.sqrt(expected)


def test_bounds_have_no_gap(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] + [(None,)] * 2 + [("c",)] * 6, "c string")
    bounds, total = drift.value_bounds(df, "c")
    spans = sorted({(r.low, r.high, r.value) for r in bounds.collect()})
    assert total == 10 and spans == [(0, 3, "a"), (3, 4, "b"), (4, 10, "c")]


def test_rows_do_not_depend_on_partitioning(spark):
    df = spark.createDataFrame([(i, i / 7, f"s{i % 5}", None, None) for i in range(300)], "a int, b double, c string, d string, e double")
    make = lambda d: sorted(map(str, drift.generate_synthetic(d, 500).withColumn("b", F.round("b", 6)).collect()))
    once = make(df)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert make(df.repartition(5)) == once and len(once) == 500
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = drift.generate_synthetic(df, 4000)
    assert got.columns == df.columns and got.where("d is not null or e is not null or c is null").count() == 0
    row = got.agg(F.avg("b"), F.stddev("b"), F.avg("a")).first()
    assert abs(row[0] - 299 / 14) < 1.5 and abs(row[1] - 12.4) < 1.5 and abs(row[2] - 149.5) < 10
    assert drift.generate_synthetic(df.limit(0), 3).count() == 3 and drift.generate_synthetic(df, 0).count() == 0
