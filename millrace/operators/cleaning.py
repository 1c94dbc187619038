"""Cleaning operators: DataFrame to DataFrame, statistics as one aggregate, the change as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .profiling import numeric_columns, string_columns
from .quantiles import exact_percentiles


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Names that are no columns are passed over."""
    return df.withColumnsRenamed({a: b for a, b in mapping.items() if a in df.columns})


def drop_columns(df: DataFrame, columns: list[str] = (), constant: bool = False, id_like: bool = False) -> DataFrame:
    gone = {c for c in columns if c in df.columns}
    if constant or id_like:
        row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_distinct(c).alias(c) for c in df.columns]).first()
        gone |= {c for c in df.columns if (constant and row[c] <= 1) or (id_like and row[c] == row["_n"])}
    return df.select(*[c for c in df.columns if c not in gone])


def extract_regex(df: DataFrame, source: str, pattern: str, name: str) -> DataFrame:
    """The first group, null where the pattern isn't found."""
    return df.withColumn(name, F.when(F.rlike(source, F.lit(pattern)), F.regexp_extract(source, pattern, 1)))


def replace_values(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    return df.replace(mapping, subset=[column])


def drop_high_missing(df: DataFrame, most: float = 0.4) -> DataFrame:
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if not row["_n"] or row[c] / row["_n"] <= most])


def impute(df: DataFrame, numeric: str = "median", categorical: str = "mode", columns: list[str] | None = None, fill=None) -> DataFrame:
    """Nulls become the median, mean or 0 (numbers), the commonest value or "Unknown" (strings), or fill."""
    columns = columns or df.columns
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    columns = [c for c in columns if counts[c]]
    numbers, strings = [c for c in numeric_columns(df) if c in columns], [c for c in string_columns(df) if c in columns]
    wanted = {}
    if fill is None:
        if numeric in ("median", "mean"):
            wanted |= {c: F.percentile(c, 0.5) if numeric == "median" else F.avg(c) for c in numbers}
        if categorical == "mode":
            wanted |= {c: F.mode(c, True) for c in strings}
    values = df.agg(*[f.alias(c) for c, f in wanted.items()]).first().asDict() if wanted else {}
    default = {c: fill if fill is not None else 0 for c in numbers} | {c: str(fill) if fill is not None else "Unknown" for c in strings}
    chosen = {c: values.get(c) if values.get(c) is not None else default[c] for c in numbers + strings}
    return df.select(*[(F.coalesce(F.col(c).cast("double") if isinstance(chosen[c], float) else F.col(c), F.lit(chosen[c])).alias(c) if c in chosen else F.col(c)) for c in df.columns])


def deduplicate(df: DataFrame, subset: list[str], order: list[str], keep: str = "first") -> DataFrame:
    """Rows equal in subset: the first or last in order stays, or none of them."""
    if keep == "none":
        w = W.partitionBy(*subset)
        return df.withColumn("_n", F.count(F.lit(1)).over(w)).where("_n = 1").drop("_n")
    by = [F.col(c).desc() if keep == "last" else F.col(c).asc() for c in order]
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*subset).orderBy(*by))).where("_r = 1").drop("_r")


def outlier_bounds(df: DataFrame, columns: list[str], method: str = "iqr", threshold: float = 1.5) -> dict[str, tuple[float, float]]:
    if method == "iqr":
        row = exact_percentiles(df, {c: [0.25, 0.75] for c in columns})
        return {c: (q[0] - threshold * (q[1] - q[0]), q[1] + threshold * (q[1] - q[0])) for c in columns if (q := row[c])[0] is not None}
    row = df.agg(*[F.struct(F.avg(c), F.stddev(c)).alias(c) for c in columns]).first()
    return {c: (m - threshold * s, m + threshold * s) for c in columns for m, s in [row[c]] if m is not None and s}


def handle_outliers(df: DataFrame, columns: list[str], method: str = "iqr", threshold: float = 1.5, action: str = "clip") -> DataFrame:
    """clip and nan use bounds of the input for all columns; remove goes column by column, later bounds seeing fewer rows."""
    if action == "remove":
        for c in columns:
            for lo, hi in outlier_bounds(df, [c], method, threshold).values():
                df = df.where(F.col(c).isNull() | F.col(c).between(lo, hi))
        return df
    bounds = outlier_bounds(df, columns, method, threshold)
    for c, (lo, hi) in bounds.items():
        x = F.col(c).cast("double")
        kept = F.greatest(F.least(x, F.lit(hi)), F.lit(lo)) if action == "clip" else x
        df = df.withColumn(c, F.when(x.between(lo, hi), x).when(x.isNotNull() & F.lit(action == "clip"), kept))
    return df


def stripped(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_categorical(df: DataFrame, columns: list[str], mapping: dict[str, str] | None = None) -> DataFrame:
    out = df.withColumns({c: F.lower(stripped(F.col(c))) for c in columns})
    return out.replace(mapping, subset=columns) if mapping else out


def change_log(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A row for each changed cell."""
    a, b = before.select(key, *[F.col(c).cast("string").alias(f"a_{c}") for c in columns]), after.select(key, *[F.col(c).cast("string").alias(f"b_{c}") for c in columns])
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"a_{c}").alias("old_value"), F.col(f"b_{c}").alias("new_value")) for c in columns])
    return a.join(b, key).select(key, F.explode(each).alias("x")).select(key, "x.*").where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def parse_number(c: Column) -> Column:
    """'$1,200', '1.5k', '2M', '3B' as numbers; null where nothing parses."""
    bare = F.lower(F.regexp_replace(c, r"[\s$€£₹,]", ""))
    factor = F.when(F.endswith(bare, F.lit("k")), 1e3).when(F.endswith(bare, F.lit("m")), 1e6).when(F.endswith(bare, F.lit("b")), 1e9).otherwise(1.0)
    return F.regexp_replace(bare, "[kmb]$", "").try_cast("double") * factor


def clean_numeric_text(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: parse_number(F.col(c)) for c in columns})


def infer_types(df: DataFrame, share: float = 0.9, few: float = 0.05) -> DataFrame:
    """Of each string column the type its values have: a row (column_name, inferred)."""
    columns = string_columns(df)
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.struct(F.count(F.col(c).try_cast("double")).alias("num"), F.count(F.col(c).try_cast("timestamp")).alias("time"), F.count_distinct(c).alias("distinct")).alias(c) for c in columns])
    n = F.greatest(F.col("_n"), F.lit(1))
    kind = lambda c: F.when(F.col(c)["num"] / n > share, "numeric").when(F.col(c)["time"] / n > share, "datetime").when(F.col(c)["distinct"] / n < few, "category").otherwise("text")
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), kind(c).alias("inferred")) for c in columns])).alias("x")).select("x.*")


def suggestions(df: DataFrame) -> DataFrame:
    """What a table asks for: rows (column_name, suggestion)."""
    numbers = numeric_columns(df)
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.struct(F.count_if(F.col(c).isNull()).alias("missing"), F.count_distinct(c).alias("distinct")).alias(c) for c in df.columns])
    n = F.greatest(F.col("n"), F.lit(1))
    each = []
    for c in df.columns:
        x = F.col(c)
        fill = F.lit("impute_median" if c in numbers else "impute_mode")
        each.append(F.struct(F.lit(c).alias("column_name"), F.when(x["missing"] / n > 0.4, F.lit("drop_column")).when(x["missing"] > 0, fill).when(x["distinct"] <= 1, F.lit("drop_constant")).when(x["distinct"] == F.col("n"), F.lit("drop_id")).alias("suggestion")))
    return row.select(F.explode(F.array(*each)).alias("x")).select("x.*").where("suggestion is not null")
