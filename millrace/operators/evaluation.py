"""Model search over grids, with all metrics of all candidates from one long table of predictions.

Folds are a function of the row's key, so they are the same on any cluster. Every candidate is fitted on all folds but one and
applied to that one; the predictions of all candidates and folds are one table (candidate, fold, y, prediction, score), and the
metrics of each candidate and fold come from one plan over it: counts of (y, prediction) for classes, sums for numbers, and the
area under the curve from sums of ranks, which are running totals over ranges of scores.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GROUP = ["candidate", "fold"]


def fold_of(key: str, folds: int = 3, seed: int = 42) -> Column:
    """The fold of a row, by the hash of its key."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(folds)).cast("int")


def class_metrics(predictions: DataFrame) -> DataFrame:
    """accuracy, precision, recall and f1 (weighted by the classes' sizes) of each candidate and fold.

    Rows without a label or a prediction are left out. A class that is never predicted has precision 0.
    """
    cells = predictions.where(F.col("y").isNotNull() & F.col("prediction").isNotNull()).groupBy(*GROUP, "y", "prediction").agg(F.count(F.lit(1)).alias("n"))
    same = F.col("y") == F.col("prediction")
    sides = F.array(
        F.struct(F.col("y").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(same, F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("prediction").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")),
    )
    labels = cells.select(*GROUP, F.explode(sides).alias("s")).groupBy(*GROUP, "s.label").agg(*[F.sum(f"s.{c}").alias(c) for c in ("support", "predicted", "hits")])
    precision = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("predicted")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hits"), F.col("predicted") + F.col("support")), F.lit(0.0))
    weighted = lambda x: F.sum(x * F.col("support")) / F.sum("support")
    return labels.groupBy(*GROUP).agg((F.sum("hits") / F.sum("support")).alias("accuracy"), weighted(precision).alias("precision"), weighted(recall).alias("recall"), weighted(f1).alias("f1"))


def running_totals(df: DataFrame, group: list[str], by: str, value: str, name: str) -> DataFrame:
    """df with the sum of value over the rows of its group that come before by `by` (whose values differ within a group).

    Rows are dealt by ranges of (group, by): sums within a range, plus the sums of the group's earlier ranges, of which there is one
    for each range and group that meet.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c) for c in [*group, by]]
    ranged = df.repartitionByRange(width, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    inside = W.partitionBy("_part", *group).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    parts = ranged.groupBy("_part", *group).agg(F.sum(value).alias("_sum"))
    earlier = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select("_part", *group, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    within = ranged.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return within.join(offsets, ["_part", *group]).withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def area_under_curve(predictions: DataFrame, positive) -> DataFrame:
    """roc_auc of each candidate and fold by the score of the positive class; null where a class is missing."""
    hit = (F.col("y") == F.lit(positive)).cast("long")
    known = predictions.where(F.col("y").isNotNull() & F.col("score").isNotNull())
    scores = known.groupBy(*GROUP, "score").agg(F.sum(hit).alias("hits"), F.sum(1 - hit).alias("misses"))
    ranked = running_totals(scores, GROUP, "score", "misses", "below")
    won = F.sum(F.col("hits") * (F.col("below") + F.col("misses") / 2.0))
    return ranked.groupBy(*GROUP).agg(F.try_divide(won, F.sum("hits").cast("double") * F.sum("misses")).alias("roc_auc"))


def number_metrics(predictions: DataFrame) -> DataFrame:
    """r2, mae and rmse of each candidate and fold; r2 is null where all labels are equal."""
    y, p = F.col("y").cast("double"), F.col("prediction").cast("double")
    known = predictions.where(y.isNotNull() & p.isNotNull())
    squares = F.sum((y - p) * (y - p))
    spread = F.when(F.var_pop(y) > 0, F.var_pop(y) * F.count(F.lit(1)))
    return known.groupBy(*GROUP).agg((1 - squares / spread).alias("r2"), F.avg(F.abs(y - p)).alias("mae"), F.sqrt(squares / F.count(F.lit(1))).alias("rmse"))


def summary(metrics: DataFrame, digits: int = 4) -> DataFrame:
    """(candidate, metric, mean, std) over the folds."""
    names = [c for c in metrics.columns if c not in GROUP]
    long = metrics.select("candidate", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in names])).alias("m")).select("candidate", "m.*")
    return long.groupBy("candidate", "metric").agg(F.round(F.avg("value"), digits).alias("mean"), F.round(F.stddev_pop("value"), digits).alias("std"))


def candidates(classification: bool, seed: int = 42) -> dict[str, tuple]:
    """{name: (estimator, settings)}: every point of the grids."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.regression import LinearRegression, RandomForestRegressor

    linear, forest = (LogisticRegression, RandomForestClassifier) if classification else (LinearRegression, RandomForestRegressor)
    found = {f"linear, regParam {r:g}": (linear(labelCol="y", regParam=r), {"regParam": r}) for r in (0.01, 0.1, 1.0)}
    return found | {f"forest, {n} trees, depth {d}": (forest(labelCol="y", numTrees=n, maxDepth=d, seed=seed), {"numTrees": n, "maxDepth": d}) for n in (20, 50) for d in (5, 10)}


def predictions_of(df: DataFrame, target: str, key: str, models: dict[str, tuple], classification: bool, folds: int = 3, seed: int = 42) -> tuple[DataFrame, list]:
    """The long table of predictions of every candidate on every fold, and the labels by their index (classes only).

    What a fold is prepared with (preparation.fit) is learnt from the other folds alone.
    """
    from pyspark.ml.feature import VectorAssembler

    from . import preparation

    known = df.where(F.col(target).isNotNull()).withColumn("_fold", fold_of(key, folds, seed))
    labels: list = []
    if classification:
        labels = [r[0] for r in known.select(F.col(target).cast("string")).distinct().orderBy(target).collect()]  # one for each class
        index = F.create_map(*[x for i, v in enumerate(labels) for x in (F.lit(v), F.lit(float(i)))])
        known = known.withColumn("y", F.element_at(index, F.col(target).cast("string")))
    else:
        known = known.withColumn("y", F.col(target).cast("double"))
    known = known.checkpoint()
    tables = []
    for fold in range(folds):
        rest, held = known.where(F.col("_fold") != fold), known.where(F.col("_fold") == fold)
        made = preparation.fit(rest.drop("_fold", "y", key), target)
        vectors = VectorAssembler(inputCols=made.features, outputCol="features")
        ready, unseen = (vectors.transform(made.transform(part)).select("y", "features") for part in (rest, held))
        ready = ready.checkpoint()
        for name, (estimator, _) in models.items():
            scored = estimator.fit(ready).transform(unseen)
            score = _second("probability") if classification and len(labels) == 2 else F.lit(None).cast("double")
            tables.append(scored.select(F.lit(name).alias("candidate"), F.lit(fold).alias("fold"), "y", "prediction", score.alias("score")))
    return reduce(DataFrame.unionByName, tables), labels


def _second(column: str) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(column)[1]


def search(df: DataFrame, target: str, key: str, models: dict[str, tuple] | None = None, folds: int = 3, seed: int = 42) -> tuple[str, DataFrame]:
    """(name of the best candidate by f1 or r2, the summary of all metrics of all candidates)."""
    from .training import problem_type

    classification = problem_type(df, target) == "classification"
    table, labels = predictions_of(df, target, key, models or candidates(classification, seed), classification, folds, seed)
    table = table.checkpoint()
    if not classification:
        found = summary(number_metrics(table)).checkpoint()
    else:
        metrics = class_metrics(table)
        found = summary(metrics.join(area_under_curve(table, 1.0), GROUP) if len(labels) == 2 else metrics).checkpoint()
    best = found.where(F.col("metric") == ("f1" if classification else "r2")).orderBy(F.desc_nulls_last("mean"), "candidate").first()
    return best.candidate if best else "", found
