"""Profiles of a table: each is one pass of aggregates, turned into rows afterwards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def unpivot_stats(row: DataFrame, columns: list[str], stats: list[str], key: str = "column_name") -> DataFrame:
    """One row `c__stat` for each column and statistic becomes a row for each column."""
    each = [F.struct(F.lit(c).alias(key), *[F.col(f"{c}__{s}").alias(s) for s in stats]) for c in columns]
    return row.select(F.explode(F.array(*each)).alias("r")).select("r.*")


def missing_profile(df: DataFrame) -> DataFrame:
    """Nulls of each column, and their share in percent."""
    n = F.count(F.lit(1))
    parts = []
    for c in df.columns:
        missing = F.count_if(F.col(c).isNull())
        parts += [missing.cast("long").alias(f"{c}__n_missing"), F.round(F.coalesce(missing * 100.0 / n, F.lit(0.0)), 2).alias(f"{c}__pct_missing")]
    return unpivot_stats(df.agg(*parts), df.columns, ["n_missing", "pct_missing"])


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat another: their number and share. Groups are counted partly before the exchange."""
    groups = df.groupBy(*df.columns).count()
    return groups.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_duplicates")).withColumn(
        "pct_duplicates", F.round(F.coalesce(F.try_divide(F.col("n_duplicates") * 100.0, F.col("n_rows")), F.lit(0.0)), 2)
    )


def cardinality_profile(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Distinct values of each column, and whether it is constant, nearly so, or like an id."""
    columns = columns or df.columns
    count = F.approx_count_distinct if approximate else F.count_distinct
    row = df.agg(F.count(F.lit(1)).alias("n"), *[count(c).alias(f"{c}__n_distinct") for c in columns])
    n, d = F.col("n"), F.col("n_distinct")
    each = [F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__n_distinct").alias("n_distinct"), "n") for c in columns]
    rows = row.select(F.explode(F.array(*each)).alias("r")).select("r.*")
    return rows.select("column_name", "n_distinct", (d <= 1).alias("is_constant"), ((d <= 2) & (n > 100)).alias("is_near_constant"), ((d == n) & (n > 0)).alias("is_id"))


def bias_corrected_skewness(c: str):
    n = F.count(c)
    return F.when((n > 2) & (F.var_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def bias_corrected_kurtosis(c: str):
    n = F.count(c)
    return F.when((n > 3) & (F.var_pop(c) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def numeric_summary(df: DataFrame, columns: list[str] | None = None, digits: int = 4) -> DataFrame:
    from .quantiles import exact_percentiles

    columns = columns or numeric_columns(df)
    quarters = exact_percentiles(df, {c: [0.25, 0.5, 0.75] for c in columns})
    quarter = lambda i: lambda c: F.lit(quarters[c][i]).cast("double")
    stats = {
        "n": lambda c: F.count(c),
        "n_missing": lambda c: F.count_if(F.col(c).isNull()).cast("long"),
        "mean": lambda c: F.avg(c), "std": lambda c: F.stddev(c), "minimum": lambda c: F.min(F.col(c).cast("double")),
        "q1": quarter(0), "median": quarter(1), "q3": quarter(2),
        "maximum": lambda c: F.max(F.col(c).cast("double")), "skew": bias_corrected_skewness, "kurt": bias_corrected_kurtosis,
    }
    whole = {"n", "n_missing"}
    row = df.agg(*[(f(c) if s in whole else F.round(f(c), digits)).alias(f"{c}__{s}") for c in columns for s, f in stats.items()])
    return unpivot_stats(row, columns, list(stats))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values of several columns with counts and shares, from one pass."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("r")).select("r.*")
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    total = df.count()
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / F.lit(total), 2))


def correlation(a: str, b: str):
    """Pearson's r over the rows where both are known; null where one of them is constant there."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a).cast("double")), F.when(F.col(a).isNotNull(), F.col(b).cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y)))


def correlation_pairs(df: DataFrame, columns: list[str], digits: int = 3) -> DataFrame:
    """Pearson correlation of each two columns, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.round(correlation(a, b), digits).alias(f"{a}|{b}") for a, b in pairs])
    each = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs]
    return row.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """(column value, average rank) from value counts: ranks come from running sums over distinct values, not over rows.

    The running sum goes over ranges first, so no task holds all values.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return running_sum(counts, column, "n", "upto").select(column, (F.col("upto") - (F.col("n") - 1) / 2.0).alias(name), F.col("n").alias(f"{name}_n"))


def running_sum(df: DataFrame, order: str, value: str, name: str, then: str | None = None) -> DataFrame:
    """A cumulative sum over a globally sorted column: sums within ranges, plus what lies in the ranges before.

    Ranges are bounded by values, as many as the shuffle has partitions, so that a row's range depends on nothing but its value.
    """
    from pyspark.sql import Window as W

    held = df.where(F.col(order).isNotNull()).select(order)
    bounds = [r[0] for r in held.repartitionByRange(F.col(order)).groupBy(F.spark_partition_id().alias("_p")).agg(F.min(order).alias("_v")).select("_v").collect()]
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    ranged = df.withColumn("_p", place)
    totals = ranged.groupBy("_p").agg(F.sum(value).alias("_t"))  # one row for each range
    before = totals.withColumn("_b", F.coalesce(F.sum("_t").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    inner = F.sum(value).over(W.partitionBy("_p").orderBy(order, *([then] if then else [])).rowsBetween(W.unboundedPreceding, W.currentRow))
    return ranged.withColumn("_s", inner).join(F.broadcast(before), "_p").withColumn(name, F.col("_s") + F.col("_b")).drop("_p", "_s", "_b")


def boxplot(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """What a box plot draws: quartiles, the outermost values within 1.5 interquartile ranges of them, and how many lie beyond."""
    from .quantiles import exact_percentiles

    quarts = exact_percentiles(df, {c: [0.25, 0.5, 0.75] for c in columns})
    known = [c for c in columns if quarts[c][0] is not None]
    aggregates = []
    for c in known:
        q1, _, q3 = quarts[c]
        inside = F.col(c).between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
        aggregates += [F.round(F.min(F.when(inside, F.col(c).cast("double"))), digits).alias(f"{c}__lower"), F.round(F.max(F.when(inside, F.col(c).cast("double"))), digits).alias(f"{c}__upper"), F.count_if(~inside).cast("long").alias(f"{c}__n_beyond")]
        aggregates += [F.lit(round(v, digits)).alias(f"{c}__{s}") for s, v in zip(("q1", "median", "q3"), quarts[c], strict=True)]
    if not known:
        return df.sparkSession.createDataFrame([], "column_name string, lower double, q1 double, median double, q3 double, upper double, n_beyond long")
    return unpivot_stats(df.agg(*aggregates), known, ["lower", "q1", "median", "q3", "upper", "n_beyond"])


def shape(df: DataFrame) -> dict:
    """Numbers of rows and columns, and each column's type."""
    return {"rows": df.count(), "columns": len(df.columns), "types": dict(df.dtypes)}


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    ra, rb = average_ranks(both, a, "ra"), average_ranks(both, b, "rb")
    return both.join(ra, a).join(rb, b).agg(F.round(F.corr("ra", "rb"), 4).alias("rho"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal bins between the extremes; the maximum belongs to the last."""
    edge = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")).first()
    lo, width = edge.lo or 0.0, ((edge.hi or 0.0) - (edge.lo or 0.0)) / bins or 1.0
    place = F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def quality_report(df: DataFrame) -> DataFrame:
    """A score of 0 to 100 from missing cells, repeated rows and constant columns, and its grade."""
    width = len(df.columns)
    cells = df.agg(F.count(F.lit(1)).alias("n_rows"), reduce(lambda x, y: x + y, [F.count_if(F.col(c).isNull()) for c in df.columns]).alias("n_missing"), reduce(lambda x, y: x + y, [F.when(F.count_distinct(c) <= 1, 1).otherwise(0) for c in df.columns]).alias("n_constant"))
    both = cells.withColumn("k", F.lit(1)).join(duplicate_count(df).select(F.lit(1).alias("k"), "n_duplicates"), "k")
    share = lambda x, of: F.coalesce(F.try_divide(x.cast("double"), of.cast("double")), F.lit(0.0))
    part = lambda most, slope, x: F.greatest(F.lit(0.0), most * (1 - slope * x))
    miss, dup, const = share(F.col("n_missing"), F.col("n_rows") * width), share(F.col("n_duplicates"), F.col("n_rows")), F.col("n_constant") / F.lit(float(width))
    score = F.floor(part(40.0, 2, miss) + part(30.0, 2, dup) + part(30.0, 3, const)).cast("int")
    s = F.col("score")
    return both.withColumn("score", score).select("n_rows", F.col("n_missing").cast("long").alias("n_missing"), "n_duplicates", F.col("n_constant").cast("long").alias("n_constant"), "score", F.when(s >= 90, "A").when(s >= 80, "B").when(s >= 60, "C").when(s >= 40, "D").otherwise("F").alias("grade"))
