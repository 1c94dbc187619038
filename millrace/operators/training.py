"""Model training on pyspark.ml."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names that a target column bears or begins with (fixed values).
TARGET_HINTS = ["target", "label", "class", "outcome", "result", "y", "is_", "has_", "survived", "churn", "fraud", "default", "price", "salary", "revenue", "cost", "amount", "score"]


def detect_target(df: DataFrame) -> str:
    """The first column, by the order of hints, that begins with one in any letter case; else the last column."""
    return next((c for hint in TARGET_HINTS for c in df.columns if c.lower().startswith(hint)), df.columns[-1])


def problem_type(df: DataFrame, target: str) -> str:
    """Strings, and numbers of few values, are classes."""
    if isinstance(df.schema[target].dataType, (T.StringType, T.BooleanType)):
        return "classification"
    row = df.agg(F.count_distinct(target).alias("d"), F.count(F.lit(1)).alias("n")).first()
    return "classification" if row.d <= 15 and row.d < 0.05 * row.n else "regression"


def reliability(n_rows: int, spread: float, metric: float) -> tuple[int, str]:
    """A score of 0 to 100 from the size of the data, the spread over folds and the metric, and its grade."""
    size = 20 if n_rows >= 10_000 else 10 if n_rows >= 1_000 else -15 if n_rows < 100 else 0
    score = max(0, min(100, int(50 + size + (10 if spread < 0.02 else -15 if spread > 0.1 else 0) + (25 if metric >= 0.9 else 15 if metric >= 0.75 else 0 if metric >= 0.6 else -20))))
    return score, "A" if score >= 85 else "B" if score >= 70 else "C" if score >= 50 else "D"


def train(df: DataFrame, target: str, features: list[str], folds: int = 3, seed: int = 42):
    """(best pipeline model, its name, the metric of each): a linear model and a forest, by cross-validation."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
    from pyspark.ml.regression import LinearRegression, RandomForestRegressor
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    data = df.where(F.col(target).isNotNull()).select(target, *[F.col(c).cast("double").alias(c) for c in features])
    steps = [Imputer(strategy="median", inputCols=features, outputCols=features), VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
    if problem_type(df, target) == "classification":
        steps.insert(0, StringIndexer(inputCol=target, outputCol="y", handleInvalid="keep"))
        evaluator = MulticlassClassificationEvaluator(labelCol="y", metricName="f1")
        models = [LogisticRegression(labelCol="y"), RandomForestClassifier(labelCol="y", seed=seed)]
    else:
        data = data.withColumn("y", F.col(target).cast("double"))
        evaluator = RegressionEvaluator(labelCol="y", metricName="r2")
        models = [LinearRegression(labelCol="y", elasticNetParam=0.0), RandomForestRegressor(labelCol="y", seed=seed)]
    grids = [ParamGridBuilder().addGrid(models[0].regParam, [0.01, 0.1]), ParamGridBuilder().addGrid(models[1].numTrees, [20]).addGrid(models[1].maxDepth, [5])]
    found, metrics = [], {}
    for model, grid in zip(models, grids, strict=True):
        fitted = CrossValidator(estimator=Pipeline(stages=[*steps, model]), estimatorParamMaps=grid.build(), evaluator=evaluator, numFolds=folds, seed=seed).fit(data)
        name = type(model).__name__
        metrics[name] = max(fitted.avgMetrics)
        found.append((metrics[name], name, fitted.bestModel))
    best = max(found, key=lambda x: x[0])
    return best[2], best[1], metrics


def baseline(df: DataFrame, target: str, folds: int = 3, seed: int = 42) -> float:
    """The metric of a guess that knows the target alone: its commonest class (weighted F1), or its mean (R2), over folds.

    A row's fold is a function of its values, so it is the same on any cluster.
    """
    data = df.where(F.col(target).isNotNull()).select(F.col(target).alias("y"), F.pmod(F.xxhash64(F.lit(seed), *df.columns), F.lit(folds)).alias("fold"))
    if problem_type(df, target) == "classification":
        counts = data.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each class and fold
        scores = []
        for fold in range(folds):
            known: dict = {}
            for r in counts:
                if r.fold != fold:
                    known[r.y] = known.get(r.y, 0) + r.n
            held = {r.y: r.n for r in counts if r.fold == fold}
            if known and held:
                guess = max(sorted(known, key=str), key=lambda y: known[y])
                share = held.get(guess, 0) / sum(held.values())
                scores.append(share * 2 * share / (1 + share))
        return sum(scores) / max(len(scores), 1)
    stats = {r.fold: r for r in data.groupBy("fold").agg(F.count("y").alias("n"), F.sum(F.col("y").cast("double")).alias("s"), F.sum(F.col("y").cast("double") ** 2).alias("q")).collect()}
    scores = []
    for fold, r in stats.items():
        others = [x for f, x in stats.items() if f != fold]
        guess = sum(x.s for x in others) / max(sum(x.n for x in others), 1)
        spread = r.q - r.s**2 / r.n
        scores.append(1 - (r.q - 2 * guess * r.s + r.n * guess**2) / spread if spread else 0.0)
    return sum(scores) / max(len(scores), 1)


def improvement(metric: float, base: float) -> float:
    """By how many per cent a metric is better than the baseline's."""
    return round((metric - base) / abs(base) * 100, 2) if base else round(metric * 100, 2)


def predict(model, rows: DataFrame, features: list[str]) -> DataFrame:
    """rows with the model's prediction; features that rows lack, or that are no numbers, count as 0."""
    ready = rows.withColumns({f: F.coalesce(F.col(f).try_cast("double"), F.lit(0.0)) if f in rows.columns else F.lit(0.0) for f in features})
    return model.transform(ready).select(*rows.columns, "prediction")
