"""Drift between two tables, and synthetic rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profiling import numeric_columns, running_sum, string_columns


def schema_drift(base: DataFrame, other: DataFrame) -> DataFrame:
    """Columns with 'shared', 'missing' or 'new'."""
    spark = base.sparkSession
    a, b = set(base.columns), set(other.columns)
    rows = [(c, "shared" if c in a & b else "missing" if c in a else "new") for c in sorted(a | b)]
    return spark.createDataFrame(rows, "column_name string, state string")


def ks_statistic(base: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """The largest distance of the two empirical distributions: (d, n1, n2), from counts of distinct values."""
    x = F.col(column).cast("double").alias("x")
    both = base.select(x, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(other.select(x, F.lit(0).alias("a"), F.lit(1).alias("b"))).where("x is not null")
    counts = both.groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sizes = counts.agg(F.sum("a").alias("n1"), F.sum("b").alias("n2")).first()
    n1, n2 = sizes.n1 or 1, sizes.n2 or 1
    walked = running_sum(counts.withColumn("step", F.col("a") / F.lit(n1) - F.col("b") / F.lit(n2)), "x", "step", "d")
    return walked.agg(F.round(F.max(F.abs("d")), 6).alias("d")).withColumns({"n1": F.lit(n1).cast("long"), "n2": F.lit(n2).cast("long")})


def ks_p_value(d: float, n1: int, n2: int) -> float:
    """Kolmogorov's asymptotic series."""
    root = math.sqrt(n1 * n2 / (n1 + n2)) if n1 and n2 else 0.0
    t = root * d
    if t < 0.2:
        return 1.0
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))))


def drift_report(base: DataFrame, other: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(column_name, d, p_value, drifted, pct_change) for the numeric columns that both have."""
    rows = []
    shared = [c for c in numeric_columns(base) if c in numeric_columns(other)]
    means = [df.agg(*[F.avg(c).alias(c) for c in shared]).first() if shared else {} for df in (base, other)]
    for c in shared:
        r = ks_statistic(base, other, c).first()
        p = ks_p_value(r.d or 0.0, r.n1, r.n2)
        a, b = means[0][c], means[1][c]
        rows.append((c, r.d, p, p < alpha, abs(b - a) / abs(a) * 100 if a and b is not None else None))
    return base.sparkSession.createDataFrame(rows, "column_name string, d double, p_value double, drifted boolean, pct_change double")


def drift_score(schema_drifted: bool, drifted: int, total: int) -> int:
    return max(0, int(100 - 20 * schema_drifted - (50 * drifted / total if total else 0)))


def fit_synthetic(df: DataFrame) -> DataFrame:
    """Of each numeric column (column_name, n, mean, bandwidth): Scott's rule."""
    columns = numeric_columns(df)
    row = df.agg(*[F.struct(F.count(c).alias("n"), F.round(F.avg(c), 4).alias("mean"), F.round(1.06 * F.stddev(c) * F.pow(F.count(c), F.lit(-0.2)), 4).alias("bandwidth")).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}.n").alias("n"), F.col(f"{c}.mean").alias("mean"), F.col(f"{c}.bandwidth").alias("bandwidth")) for c in columns])).alias("x")).select("x.*")


#: A row of the draw finds its value through so many buckets of the cumulative counts.
DRAW_BUCKETS = 4_096
#: Bounds of values are broadcast up to so many rows; beyond that they are joined by a shuffle.
BROADCAST_BOUNDS = 50_000


def uniform(seed: int, *keys) -> Column:
    """A number in (0, 1) that is a function of seed and keys, whatever the partitioning."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)


def value_bounds(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """(bucket, low, high, value) of each value and each bucket that its share of the rows meets; and how many rows there are.

    Shares are laid end to end in the order of values. A common value meets many buckets, a bucket of rare ones holds many
    values: together there are no more rows than values and buckets.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    laid = running_sum(counts.checkpoint(), "value", "n", "high").withColumn("low", F.col("high") - F.col("n")).checkpoint()
    bucket = lambda at: F.floor(at * float(DRAW_BUCKETS) / float(max(total, 1))).cast("int")
    return laid.select(F.explode(F.sequence(bucket(F.col("low")), bucket(F.col("high") - 1))).alias("bucket"), "low", "high", "value"), total


def draw_values(rows: DataFrame, df: DataFrame, column: str, seed: int) -> DataFrame:
    """rows (with id) and a column of values of df's column, each as often as its share of the rows, within chance."""
    bounds, total = value_bounds(df, column)
    if not total:
        return rows.withColumn(column, F.lit(None).cast(df.schema[column].dataType))
    bounds = bounds.checkpoint()
    few = bounds.count() <= BROADCAST_BOUNDS
    at = F.least(F.floor(uniform(seed, "id", F.lit(column)) * float(total)), F.lit(total - 1)).cast("long")
    placed = rows.withColumn("_at", at).withColumn("_bucket", F.floor(F.col("_at") * float(DRAW_BUCKETS) / float(total)).cast("int"))
    met = (F.col("_bucket") == F.col("bucket")) & (F.col("low") <= F.col("_at")) & (F.col("_at") < F.col("high"))
    return placed.join(F.broadcast(bounds) if few else bounds, met).withColumnRenamed("value", column).drop("_at", "_bucket", "bucket", "low", "high")


def generate_synthetic(df: DataFrame, rows: int, seed: int = 42, points: int = 256) -> DataFrame:
    """`rows` rows with columns drawn independently: numbers from a smoothed quantile table, strings by their frequencies.

    A row is a function of seed and number, so the same seed gives the same rows on any cluster. A column without values is null.
    """
    numbers, strings = numeric_columns(df), string_columns(df)
    grid = [i / points for i in range(points + 1)]
    stats = df.agg(*[F.struct(F.percentile(c, F.array(*map(F.lit, grid))).alias("q"), F.coalesce(1.06 * F.stddev(c) * F.pow(F.count(c), F.lit(-0.2)), F.lit(0.0)).alias("h")).alias(c) for c in numbers]).first() if numbers else {}
    whole = {f.name for f in df.schema.fields if f.dataType.typeName() in ("long", "integer", "short", "byte")}
    out = df.sparkSession.range(rows)
    for c in strings:
        out = draw_values(out, df, c, seed)
    for c in numbers:
        if stats[c].q is None:
            out = out.withColumn(c, F.lit(None).cast(df.schema[c].dataType))
            continue
        place, u, v = (uniform(seed + k, "id", F.lit(c)) for k in (1, 2, 3))
        table = F.array(*[F.lit(float(x)) for x in stats[c].q])
        normal = F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)
        value = F.element_at(table, (F.floor(place * (points + 1)) + 1).cast("int")) + normal * F.lit(float(stats[c].h))
        out = out.withColumn(c, F.round(value).cast("long") if c in whole else value)
    out = out.select("id", *[c for c in df.columns if c in (*numbers, *strings)])
    return out.drop("id")
