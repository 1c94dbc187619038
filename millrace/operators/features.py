"""Feature engineering: statistics in one aggregate, features as expressions."""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .nearest import nearest
from .profiling import correlation, numeric_columns, running_sum, string_columns
from .quantiles import exact_percentiles


def datetime_features(df: DataFrame, column: str, parts: tuple[str, ...] = ("year", "month", "day", "dayofweek", "quarter")) -> DataFrame:
    """Parts of a timestamp as columns `<column>_<part>`; Monday is 0. The column itself goes."""
    made = {
        "year": F.year, "month": F.month, "day": F.dayofmonth, "dayofweek": F.weekday, "quarter": F.quarter, "hour": F.hour,
        "minute": F.minute, "is_weekend": lambda c: (F.weekday(c) >= 5).cast("int"),
    }
    return df.withColumns({f"{column}_{p}": made[p](column) for p in parts}).drop(column)


def polynomial(df: DataFrame, columns: list[str], degree: int = 2, interaction_only: bool = False) -> DataFrame:
    """Products of columns, the first 5 numeric ones at most: `a^2`, `a b`."""
    columns = columns[:5]
    if len(columns) < 2:
        return df
    made = {}
    for d in range(2, degree + 1):
        for group in (combinations if interaction_only else combinations_with_replacement)(columns, d):
            product = F.lit(1.0)
            for c in group:
                product = product * F.col(c)
            made[" ".join(f"{c}^{k}" if (k := group.count(c)) > 1 else c for c in dict.fromkeys(group))] = product
    return df.withColumns(made)


def ratio_features(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return df.withColumns({f"{a}_div_{b}": F.coalesce(F.col(a) / F.nullif(F.col(b).cast("double"), F.lit(0.0)), F.lit(0.0)) for a, b in pairs})


def one_hot(df: DataFrame, column: str, values: list[str] | None = None, drop_first: bool = False, with_null: bool = False) -> DataFrame:
    """A 0/1 column for each value in order; the values are read once if they aren't given."""
    if values is None:
        values = [r[0] for r in df.where(F.col(column).isNotNull()).select(F.col(column).cast("string")).distinct().orderBy(column).collect()]
    made = {f"{column}_{v}": (F.coalesce(F.col(column).cast("string") == v, F.lit(False))).cast("int") for v in values[1 if drop_first else 0 :]}
    if with_null:
        made[f"{column}_nan"] = F.col(column).isNull().cast("int")
    return df.withColumns(made).drop(column)


#: Codes are sent to all tasks up to so many values; more are joined by value.
MOST_CODES = 100_000


def label_encode(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Rank of the value among the distinct values; null counts as "Unknown"."""
    value = F.coalesce(F.col(column).cast("string"), F.lit("Unknown"))
    distinct = df.select(value.alias("_v")).distinct()
    coded = distinct.withColumn("_one", F.lit(1))
    ranks = running_sum(coded, "_v", "_one", "_code").select("_v", (F.col("_code") - 1).cast("int").alias("_code"))
    few = distinct.limit(MOST_CODES + 1).count() <= MOST_CODES  # by value, all rows of a common one would meet in one task
    return df.withColumn("_v", value).join(F.broadcast(ranks) if few else ranks, "_v").withColumn(name or column, F.col("_code")).drop("_v", "_code")


def encode_auto(df: DataFrame, target: str | None = None) -> DataFrame:
    """Two values: labels; up to ten: one-hot without the first; more: labels."""
    columns = [c for c in string_columns(df) if c != target]
    if not columns:
        return df
    row = df.agg(*[F.count_distinct(c).alias(c) for c in columns]).first()
    for c in columns:
        df = one_hot(df, c, drop_first=True) if 2 < row[c] <= 10 else label_encode(df, c)
    return df


def scale(df: DataFrame, columns: list[str], method: str = "standard") -> DataFrame:
    """standard (population deviation), minmax, or robust (median and quartiles); without spread only shifted."""
    center_scale = {
        "standard": lambda c: (F.avg(c), F.stddev_pop(c)), "minmax": lambda c: (F.min(c), F.max(c) - F.min(c)),
        "robust": lambda c: (F.percentile(c, 0.5), F.percentile(c, 0.75) - F.percentile(c, 0.25)),
    }[method]
    row = df.agg(*[F.struct(*(x.cast("double") for x in center_scale(c))).alias(c) for c in columns]).first()
    return df.withColumns({c: (F.col(c) - F.lit(row[c][0])) / F.lit(row[c][1] or 1.0) for c in columns})


def bin_quantile(df: DataFrame, column: str, bins: int = 4) -> DataFrame:
    """Right-closed quantile bins from 0; equal edges are one."""
    edges = df.agg(F.percentile(column, F.array(*[F.lit(i / bins) for i in range(bins + 1)])).alias("e")).first().e or []
    inner = sorted(set(edges))[1:-1]
    place = sum([(F.col(column) > e).cast("int") for e in inner], F.lit(0))
    return df.withColumn(f"{column}_bin", F.when(F.col(column).isNotNull(), place))


def bin_uniform(df: DataFrame, column: str, bins: int = 4) -> DataFrame:
    """Right-closed bins of equal width from 0."""
    row = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")).first()
    inner = [row.lo + (row.hi - row.lo) * i / bins for i in range(1, bins)] if row.lo is not None else []
    place = sum([(F.col(column) > e).cast("int") for e in inner], F.lit(0))
    return df.withColumn(f"{column}_bin", F.when(F.col(column).isNotNull(), place))


def low_variance(df: DataFrame, least: float = 0.01) -> list[str]:
    numbers = numeric_columns(df)
    row = df.agg(*[F.var_pop(c).alias(c) for c in numbers]).first()
    return [c for c in numbers if row[c] is not None and row[c] <= least]


def highly_correlated(df: DataFrame, columns: list[str], most: float = 0.95) -> list[str]:
    """Columns that correlate with an earlier one beyond `most`."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[correlation(a, b).alias(f"{a}|{b}") for a, b in pairs]).first()
    return [b for b in columns if any(y == b and (row[f"{x}|{y}"] or 0) ** 2 > most**2 for x, y in pairs)]


def top_variance(df: DataFrame, most: int = 4) -> list[str]:
    numbers = numeric_columns(df)
    row = df.agg(*[F.var_samp(c).alias(c) for c in numbers]).first()
    return sorted(numbers, key=lambda c: -(row[c] or 0))[:most]


def balance(df: DataFrame, label: str, key: str, method: str = "undersample", seed: str = "42") -> DataFrame:
    """Every class as large as the smallest (undersample) or the largest (oversample, by repeating rows in turn)."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    goal = sizes.agg(F.min("_n").alias("lo"), F.max("_n").alias("hi")).first()
    lot = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    ranked = df.withColumn("_r", F.row_number().over(W.partitionBy(label).orderBy(lot, key)))
    if method == "undersample":
        return ranked.where(F.col("_r") <= F.lit(goal.lo)).drop("_r")
    copies = F.floor((F.lit(goal.hi) - F.col("_r")) / F.col("_n")).cast("int") + 1
    return ranked.join(F.broadcast(sizes), label).withColumn("_c", F.explode(F.sequence(F.lit(1), copies))).drop("_r", "_n", "_c")


def informations(df: DataFrame, columns: list[str], target: str, bins: int = 10) -> DataFrame:
    """(i, mi): the plug-in mutual information, in nats, of each quantile-binned column and a class, over the rows that hold both.

    All columns together take one search of their percentiles and one count of the grid of bins and classes.
    """
    names = {f"c{i}": F.col(c).cast("double") for i, c in enumerate(columns)}
    rows = df.dropna(subset=[target]).select(F.col(target).alias("y"), *[F.nanvl(v, F.lit(None).cast("double")).alias(n) for n, v in names.items()])
    edges = exact_percentiles(rows, {n: [k / bins for k in range(bins + 1)] for n in names})
    inner = {n: sorted({e for e in at if e is not None})[1:-1] for n, at in edges.items()}
    place = lambda n: F.when(F.col(n).isNotNull(), sum([(F.col(n) > e).cast("int") for e in inner[n]], F.lit(0)))
    binned = rows.select("y", F.posexplode(F.array(*map(place, names))).alias("i", "x")).where(F.col("x").isNotNull())
    joint = binned.groupBy("i", "x", "y").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    sums = lambda name, *by: joint.groupBy("i", *by).agg(F.sum("n").cast("double").alias(name))
    whole = joint.join(sums("nx", "x"), ["i", "x"]).join(sums("ny", "y"), ["i", "y"]).join(sums("total"), "i")
    return whole.groupBy("i").agg(F.round(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny")))), 4).alias("mi"))


def mutual_information(df: DataFrame, column: str, target: str, bins: int = 10) -> DataFrame:
    """informations() of one column: one row, null without rows."""
    return informations(df, [column], target, bins).agg(F.first("mi").alias("mi"))


def smote(df: DataFrame, features: list[str], label: str, minority, key: str, k: int = 5, per_row: int = 1, blocks: int = 16, seed: int = 42) -> DataFrame:
    """New rows of a class between a row and one of its k nearest rows of that class, found in `blocks` boxes of the space or more.

    Keys are unlike one another; a row that lacks a number among its features, or has no other, gives none.
    """
    rows = df.where(F.col(label) == minority).select(F.col(key).alias("key"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    rows = rows.where(~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))).where("key is not null")
    found = nearest(rows, k + 1, len(features), blocks)
    others = F.slice(F.filter("near", lambda o: o["key"] != F.col("key")), 1, k)
    lists = rows.join(found, "x").select("key", "x", others.alias("near")).where(F.size("near") > 0)
    lists = lists.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(per_row))))
    drawn = lists.withColumn("o", F.element_at("near", (F.pmod(F.xxhash64(F.lit(seed), "key", "copy"), F.size("near")) + 1).cast("int"))["y"])
    share = F.pmod(F.xxhash64(F.lit(seed + 1), "key", "copy"), F.lit(1 << 20)) / float(1 << 20)
    made = drawn.withColumn("s", share).select(*[(F.col("x")[i] + F.col("s") * (F.col("o")[i] - F.col("x")[i])).alias(f) for i, f in enumerate(features)])
    return made.withColumn(label, F.lit(minority))


def importances(df: DataFrame, columns: list[str], target: str, bins: int = 10) -> list[tuple[str, float]]:
    """Columns by their mutual information with the target, the largest first, then by name."""
    told = {r.i: r.mi for r in informations(df, columns, target, bins).collect()}
    found = [(c, told.get(i) or 0.0) for i, c in enumerate(columns)]
    return sorted(found, key=lambda x: (-x[1], x[0]))


def drop_unimportant(df: DataFrame, columns: list[str], target: str, least: float = 0.01, keep: int | None = None) -> DataFrame:
    """df without the columns whose importance is below `least`, or beyond the first `keep`."""
    ranked = importances(df, columns, target)
    gone = {c for i, (c, v) in enumerate(ranked) if (i >= keep if keep is not None else v < least)}
    return df.drop(*gone)


def auto_evolve(df: DataFrame, columns: list[str], target: str, top: int = 5, most: int = 10, least: float = 0.001) -> DataFrame:
    """df and the products of each two of its `top` most important columns, the `most` best that tell more than `least` of the target."""
    best = [c for c, _ in importances(df, columns, target)[:top]]
    made = {f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in combinations(best, 2)}
    if not made:
        return df
    wide = df.withColumns(made)
    kept = [c for c, v in importances(wide, list(made), target) if v > least][:most]
    return wide.select(*df.columns, *kept)
