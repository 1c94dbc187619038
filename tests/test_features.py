"""Rank correlation, exact percentiles and fitted preparation, against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import preparation, quantiles, rank_correlation


def tau_b(rows):
    rows = [(x, y) for x, y in rows if x is not None and y is not None and x == x and y == y]
    c = d = tx = ty = 0
    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][0] - rows[j][0], rows[i][1] - rows[j][1]
            c, d, tx, ty = c + (a * b > 0), d + (a * b < 0), tx + (a == 0), ty + (b == 0)
    n0 = len(rows) * (len(rows) - 1) // 2
    return (c - d) / math.sqrt((n0 - tx) * (n0 - ty)) if n0 > tx and n0 > ty else None


@pytest.mark.parametrize(("seed", "ranges"), [(1, 1), (2, 4), (3, 30), (4, 100)])
def test_kendall(spark, seed, ranges):
    rng = random.Random(seed)
    hot = lambda v: 5.0 if rng.random() < 0.35 else v
    rows = [(hot(float(rng.randrange(60))), hot(rng.gauss(0, 9) // 1)) for _ in range(400)] + [(None, 1.0), (2.0, None), (float("nan"), 3.0)]
    rows += rows[:50]
    got = rank_correlation.kendall(spark.createDataFrame(rows, "a double, b double").repartition(3), "a", "b", ranges)
    assert got == pytest.approx(tau_b(rows), abs=1e-12)


def test_kendall_of_few_values(spark):
    tau = lambda rows: rank_correlation.kendall(spark.createDataFrame(rows, "a double, b double"), "a", "b")
    assert tau([]) is None and tau([(1.0, 2.0)]) is None and tau([(1.0, 2.0), (1.0, 3.0)]) is None
    assert tau([(1.0, 2.0), (2.0, 3.0)]) == 1.0 and tau([(1.0, 3.0), (2.0, 2.0)]) == -1.0
    pairs = rank_correlation.kendall_pairs(spark.createDataFrame([(1, 2, 3), (2, 1, 3), (3, 0, 3)], "a int, b int, c int"), ["a", "b", "c"])
    assert {(r.a, r.b): r.tau for r in pairs.collect()} == {("a", "b"): -1.0, ("a", "c"): None, ("b", "c"): None}
    assert rank_correlation.strong_pairs(pairs, "tau").count() == 1


def test_inversions_with_large_weights():
    x, y, w = np.array([1.0, 2.0]), np.array([2.0, 1.0]), np.array([4 * 10**9, 5 * 10**9])
    assert rank_correlation.inversions(x, y, w) == 20 * 10**18


@pytest.mark.parametrize(("accuracy", "inside"), [(10_000, 100_000), (10, 100_000), (20, 3)])
def test_percentiles(spark, accuracy, inside):
    rng = random.Random(6)
    rows = [(rng.gauss(0, 1), float(rng.choice([1, 1, 1, 2, 7])), None if rng.random() < 0.5 else rng.random(), None) for _ in range(5000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    shares = [0.0, 0.003, 0.25, 0.5, 0.987, 1.0]
    got = quantiles.exact_percentiles(df, {c: shares for c in "abcd"}, accuracy, inside)
    for i, c in enumerate("abc"):
        assert got[c] == pytest.approx(np.percentile([r[i] for r in rows if r[i] is not None], [100 * p for p in shares]).tolist(), abs=1e-12)
    assert got["d"] == [None] * 6
    assert quantiles.exact_percentiles(df.limit(1), {"a": [0.5]})["a"] == [df.limit(1).first().a]


def test_numbered(spark):
    rows = [(i % 7, str(i)) for i in range(200)]
    got = quantiles.numbered(spark.createDataFrame(rows, "a long, b string").repartition(5), [F.desc("a"), F.col("b")], "n").collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.n)] == sorted(rows, key=lambda r: (-r[0], r[1])) and [r.n for r in sorted(got, key=lambda r: r.n)] == list(range(200))
    assert quantiles.numbered(spark.createDataFrame([], "a long"), [F.col("a")], "n").count() == 0


def people(n=400, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = rng.gauss(50, 20)
        rows.append((i, f"name {i}", f"http://{i}", rng.choice(["red", "green", "blue", None]), size, size * 2 + rng.gauss(0, 0.1), None if rng.random() < 0.1 else rng.random() * 9, f"2024-0{rng.randint(1, 5)}-1{rng.randint(0, 9)} 00:00:00", 3.0 * size + rng.random()))
    return rows


KIND = "row_key long, name string, page_url string, colour string, size double, twice double, weight double, seen timestamp, price double"


def frame(spark, rows):
    return spark.createDataFrame(rows, KIND.replace("seen timestamp", "seen string")).withColumn("seen", F.col("seen").cast("timestamp"))


def test_fit_and_transform(spark, tmp_path):
    rows = people()
    known, new = frame(spark, rows[:300]), frame(spark, rows[300:])
    made = preparation.fit(known, "price")
    assert set(made.sources) == {"row_key", "colour", "size", "twice", "weight", "seen"} and "twice" in made.dropped and "twice" not in made.features
    assert {"seen_year", "seen_month", "seen_day", "seen_dayofweek", "size_bin"} - set(made.dropped) <= set(made.features)
    out = made.transform(known)
    assert out.columns == ["name", "page_url", "price", *made.features]
    row = out.agg(*[F.struct(F.avg(c), F.stddev_pop(c), F.count_if(F.col(c).isNull())).alias(c) for c in made.features]).first()
    for c in made.features:
        assert abs(row[c][0]) < 1e-9 and (abs(row[c][1] - 1) < 1e-9 or row[c][1] == 0) and row[c][2] == 0
    plain = made.transform(new, scale=False).collect()
    codes = {"blue": 0, "green": 1, "red": 2}
    median = float(np.median([codes[r[3]] for r in rows[:300] if r[3]]))
    weight = float(np.median([r[6] for r in rows[:300] if r[6] is not None]))
    edges = sorted(set(np.percentile([r[4] for r in rows[:300]], [0, 20, 40, 60, 80, 100])))[1:-1]
    for r, p in zip(rows[300:], sorted(plain, key=lambda p: p.name and int(p.name[5:])), strict=True):
        assert p.colour == codes.get(r[3], median) and p.size == r[4] and p.weight == (r[6] if r[6] is not None else weight)
        assert p.seen_month == int(r[7][5:7]) and ("size_bin" in made.dropped or p.size_bin == sum(r[4] > e for e in edges))
    made.save(f"{tmp_path}/prep")
    again = preparation.load_preparation(spark, f"{tmp_path}/prep")
    assert sorted(map(str, again.transform(new).collect())) == sorted(map(str, made.transform(new).collect()))


def test_rows_that_lack_columns_or_have_others(spark):
    made = preparation.fit(frame(spark, people()), "price")
    odd = spark.createDataFrame([("purple", "12.5", "extra"), (None, "no number", "extra")], "colour string, size string, more string")
    got = made.transform(odd, scale=False).collect()
    assert [r.more for r in got] == ["extra"] * 2 and {r.colour for r in got} == {made.medians["colour"]} and sorted(r["size"] for r in got) == sorted([12.5, made.medians["size"]])
    assert all(r.weight == 0 and r.seen_month == 0 and r.row_key == 0 for r in got)
    assert all(r[f"{a}_div_{b}"] == 0 for r in got for a, b in made.ratios if f"{a}_div_{b}" in made.features)
    assert made.transform(frame(spark, []), scale=True).count() == 0


def test_many_codes_are_joined(spark, monkeypatch):
    made = preparation.fit(frame(spark, people()), "price")
    before = sorted(map(str, made.transform(frame(spark, people(seed=9))).collect()))
    monkeypatch.setattr(preparation, "BROADCAST_CODES", 0)
    assert sorted(map(str, made.transform(frame(spark, people(seed=9))).collect())) == before


def test_predict_passes_rows_through(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    df = frame(spark, people())
    made = preparation.fit(df, "price")
    model = LinearRegression(labelCol="price").fit(VectorAssembler(inputCols=made.features, outputCol="features").transform(made.transform(df)))
    rows = df.drop("price", "twice").withColumn("features", F.lit("mine"))
    got = preparation.predict(made, model, rows)
    assert got.columns == [*rows.columns, "prediction"] and got.where("features = 'mine'").count() == 400
    errors = got.join(df.select("name", "price"), "name").select(F.abs(F.col("prediction") - F.col("price")).alias("e")).agg(F.max("e")).first()[0]
    assert errors < 5


def test_empty_table(spark):
    made = preparation.fit(frame(spark, []), "price")
    assert made.transform(frame(spark, people(3))).count() == 3


def test_kept_features_stay_whatever_the_rows(spark):
    """The bins of 'colour' repeat it where a share of its values falls below a quantile's; a query that needs them must have them."""
    rows = [(i, 7 * i % 100, "abcd"[(i % 10 > 3) + (i % 10 > 4) + (i % 10 > 6)] if i else "b", float(i % 13), float(i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, m long, colour string, size double, price double")
    plain = preparation.fit(df, "price")
    assert "colour_bin" in plain.dropped and "size_div_colour" not in plain.features
    made = preparation.fit(df, "price", keep=["colour_bin", "size_div_colour"])
    assert {"colour_bin", "size_div_colour", *plain.features} == set(made.features) and "colour_bin" not in made.dropped
    got = {r.colour: r.colour_bin for r in made.transform(df, scale=False).select("colour", "colour_bin").distinct().collect()}
    assert got == {0.0: 0.0, 1.0: 0.0, 2.0: 1.0, 3.0: 2.0}


def test_narrowing_plans_no_comparison_for_each_cut(spark, monkeypatch):
    """Brackets are narrowed without an expression for each of their cuts, which took minutes to plan for many columns."""
    made = []
    plain = F.lit
    monkeypatch.setattr(quantiles.F, "lit", lambda v: made.append(v) or plain(v))
    df = spark.range(3000).select((F.col("id") * 7 % 3001).cast("double").alias("a"))
    assert quantiles.exact_percentiles(df, {"a": [0.25, 0.5]}, inside=100)["a"] == [float(np.percentile([i * 7 % 3001 for i in range(3000)], p)) for p in (25, 50)]
    assert len(made) < 200
