"""Metrics of many candidates at once, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import evaluation


def table(spark, n=900, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b"]), rng.randrange(3), float(rng.choice([0, 1, 1, 2])), float(rng.choice([0, 1, 3])), round(rng.random(), 2)) for _ in range(n)]
    rows += [("a", 0, None, 1.0, 0.5), ("a", 0, 1.0, None, None)]
    return rows, spark.createDataFrame(rows, "candidate string, fold int, y double, prediction double, score double").repartition(4)


def groups(rows):
    out = {}
    for c, f, *rest in rows:
        out.setdefault((c, f), []).append(rest)
    return out


def test_class_metrics(spark):
    rows, df = table(spark)
    got = {(r.candidate, r.fold): r for r in evaluation.class_metrics(df).collect()}
    for key, found in groups(rows).items():
        known = [(y, p) for y, p, _ in found if y is not None and p is not None]
        n, e = len(known), {"precision": 0, "recall": 0, "f1": 0}
        for label in {y for y, _ in known}:
            hits, support, predicted = sum(y == p == label for y, p in known), sum(y == label for y, _ in known), sum(p == label for _, p in known)
            e["precision"] += support * (hits / predicted if predicted else 0) / n
            e["recall"] += hits / n
            e["f1"] += support * 2 * hits / (support + predicted) / n
        assert got[key].accuracy == pytest.approx(sum(y == p for y, p in known) / n) and all(got[key][k] == pytest.approx(v) for k, v in e.items())


def test_area_under_curve(spark):
    rows, df = table(spark)
    got = {(r.candidate, r.fold): r.roc_auc for r in evaluation.area_under_curve(df, 1.0).collect()}
    for key, found in groups(rows).items():
        hits = [s for y, _, s in found if y == 1 and s is not None]
        rest = [s for y, _, s in found if y not in (1, None) and s is not None]
        assert got[key] == pytest.approx(sum((a > b) + (a == b) / 2 for a in hits for b in rest) / len(hits) / len(rest))
    assert evaluation.area_under_curve(df.where("y = 1"), 1.0).where("roc_auc is not null").count() == 0


def test_number_metrics_and_summary(spark):
    rows, df = table(spark)
    metrics = evaluation.number_metrics(df)
    got = {(r.candidate, r.fold): r for r in metrics.collect()}
    for key, found in groups(rows).items():
        known = [(y, p) for y, p, _ in found if y is not None and p is not None]
        mean = sum(y for y, _ in known) / len(known)
        squares = sum((y - p) ** 2 for y, p in known)
        assert got[key].r2 == pytest.approx(1 - squares / sum((y - mean) ** 2 for y, _ in known)) and got[key].rmse == pytest.approx((squares / len(known)) ** 0.5)
    of = [got["a", f].mae for f in range(3)]
    row = evaluation.summary(metrics).where("candidate = 'a' and metric = 'mae'").first()
    assert row["mean"] == pytest.approx(sum(of) / 3, abs=1e-4) and row["std"] == pytest.approx((sum((x - sum(of) / 3) ** 2 for x in of) / 3) ** 0.5, abs=1e-4)
    assert evaluation.number_metrics(df.where("y = 1")).where("r2 is not null").count() == 0


def test_running_totals(spark):
    rng = random.Random(2)
    rows = [(rng.choice("xy") if k % 3 else "x", k, rng.randrange(9)) for k in range(500)]
    got = evaluation.running_totals(spark.createDataFrame(rows, "g string, k int, v long").repartition(6), ["g"], "k", "v", "t").collect()
    assert {(r.g, r.k): r.t for r in got} == {(g, k): sum(v for h, j, v in rows if h == g and j < k) for g, k, _ in rows}


def test_folds_depend_on_the_key_alone(spark):
    df = spark.range(3000).withColumn("f", evaluation.fold_of("id", 3))
    assert {(r.id, r.f) for r in df.collect()} == {(r.id, r.f) for r in df.drop("f").repartition(9).withColumn("f", evaluation.fold_of("id", 3)).collect()}
    assert all(850 < r["count"] < 1150 for r in df.groupBy("f").count().collect())


def test_search(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.regression import LinearRegression

    rng = random.Random(3)
    rows = [(i, rng.gauss(0, 1), rng.choice(["u", "v", None]), None if i % 50 == 0 else "yes" if rng.random() < 0.5 else "no") for i in range(600)]
    df = spark.createDataFrame(rows, "row_key long, x double, c string, label string").withColumn("x", F.when(F.col("label") == "yes", F.col("x") + 3).otherwise(F.col("x")))
    models = {"weak": (LogisticRegression(labelCol="y", regParam=50.0, elasticNetParam=1.0), {}), "good": (LogisticRegression(labelCol="y", regParam=0.01), {})}
    best, found = evaluation.search(df, "label", "row_key", models)
    scores = {(r.candidate, r.metric): r["mean"] for r in found.collect()}
    assert best == "good" and scores["good", "f1"] > 0.85 and scores["good", "roc_auc"] > 0.95 and scores["weak", "roc_auc"] == 0.5 and len(scores) == 10
    best, found = evaluation.search(df.withColumn("label", F.col("x") * 2 + 1), "label", "row_key", {"line": (LinearRegression(labelCol="y"), {})}, folds=2)
    assert best == "line" and {r.metric for r in found.collect()} == {"r2", "mae", "rmse"} and found.where("metric = 'r2'").first()["mean"] > 0.99
