"""A fitted chain from raw columns to a model's features.

`fit` learns from the rows it is given (a training fold): which columns are junk, the parts of timestamps, the codes of
strings, ratios, bins, columns that repeat another, medians, means and deviations. `Preparation` holds what was learnt as
plain values, but for the codes, which are a table, since a column may have any number of values. It is saved with them and
applied to other rows: strings that were not seen and nulls become the median, columns that the rows lack count as 0 and so
do features made of them, extra columns pass through untouched, and a column of another type is cast.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .profiling import correlation, string_columns
from .quantiles import exact_percentiles, numbered

#: Names of columns that tell nothing of a row: ids, and addresses of pages and files (fixed values, in any letter case).
ID_NAMES = r"^(id|_id|index|row_?num|serial|sr_?no|unnamed)"
ADDRESS_NAMES = r"(url|link|href|src|image|img|photo|avatar|thumbnail|path|file)"
PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "dayofweek": F.weekday}
#: Codes of a column are broadcast up to so many; beyond that they are joined by a shuffle.
BROADCAST_CODES = 50_000


def junk_columns(df: DataFrame, keep: str | None = None, most: float = 0.9, least_rows: int = 20) -> list[str]:
    """Columns by the names above, and strings nearly all of whose values differ."""
    named = [c for c in df.columns if c != keep and (re.match(ID_NAMES, c, re.I) or re.search(ADDRESS_NAMES, c, re.I))]
    strings = [c for c in string_columns(df) if c not in named and c != keep]
    if not strings:
        return named
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_distinct(c).alias(c) for c in strings]).first()
    return [c for c in df.columns if c in named or c in strings and row["_n"] > least_rows and row[c] > most * row["_n"]]


@dataclass
class Preparation:
    target: str
    sources: dict[str, str]  # kept column: number, code, or time
    features: list[str] = field(default_factory=list)  # in order
    ratios: list[tuple[str, str]] = field(default_factory=list)
    bins: dict[str, list[float]] = field(default_factory=dict)  # inner edges
    dropped: list[str] = field(default_factory=list)
    medians: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    deviations: dict[str, float] = field(default_factory=dict)
    n_codes: dict[str, int] = field(default_factory=dict)
    codes: DataFrame | None = None  # column_name, value, code

    def base(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        """df with a number for each kept column, named _f_<feature>, and the features whose column df lacks."""
        made, absent = {}, []
        for c, kind in self.sources.items():
            there = c in df.columns
            if kind == "time":
                made |= {f"_f_{c}_{p}": f(F.col(c).try_cast("timestamp")).cast("double") if there else F.lit(0.0) for p, f in PARTS.items()}
                absent += [] if there else [f"{c}_{p}" for p in PARTS]
            elif kind == "number" or not there:
                made[f"_f_{c}"] = F.col(c).try_cast("double") if there else F.lit(0.0)
                absent += [] if there else [c]
        df = df.withColumns(made)
        for c, kind in self.sources.items():
            if kind == "code" and c in df.columns:
                codes = self.codes.where(F.col("column_name") == c).select(F.col("value").alias("_v"), F.col("code").cast("double").alias(f"_f_{c}"))
                small = self.n_codes.get(c, 0) <= BROADCAST_CODES
                df = df.join(F.broadcast(codes) if small else codes, F.col(c).cast("string") == F.col("_v"), "left").drop("_v")
        return df, absent

    def ratio(self, a: str, b: str) -> Column:
        return F.col(f"_f_{a}") / F.nullif(F.col(f"_f_{b}"), F.lit(0.0))

    def derived(self, absent: list[str]) -> dict[str, Column]:
        """Ratios, and the places of values among the edges of bins."""
        out = {f"{a}_div_{b}": F.lit(0.0) if {a, b} & set(absent) else F.coalesce(self.ratio(a, b), F.lit(0.0)) for a, b in self.ratios}
        for c, edges in self.bins.items():
            place = sum([(F.col(f"_f_{c}") > e).cast("double") for e in edges], F.lit(0.0))
            out[f"{c}_bin"] = F.lit(0.0) if c in absent else F.when(F.col(f"_f_{c}").isNotNull(), place)
        return out

    def transform(self, df: DataFrame, scale: bool = True) -> DataFrame:
        """df with the features instead of the columns they are made of; the target, if it is there, stays."""
        named = [c for c in df.columns if c not in self.sources and c not in self.features]
        wide, absent = self.base(df)
        wide = wide.withColumns({f"_f_{c}": x for c, x in self.derived(absent).items()})
        out = []
        for c in self.features:
            value = F.coalesce(F.col(f"_f_{c}"), F.lit(self.medians[c]))
            out.append(((value - F.lit(self.means[c])) / F.lit(self.deviations[c]) if scale else value).alias(c))
        return wide.select(*named, *out)

    def save(self, path: str) -> None:
        spark = self.codes.sparkSession
        plain = {k: v for k, v in asdict(self._without_codes()).items() if k != "codes"}
        spark.createDataFrame([(json.dumps(plain),)], "state string").coalesce(1).write.text(f"{path}/state")
        self.codes.write.partitionBy("column_name").parquet(f"{path}/codes")

    def _without_codes(self) -> Preparation:
        return Preparation(**{k: None if k == "codes" else v for k, v in self.__dict__.items()})


CODES = "value string, code long, column_name string"


def load_preparation(spark: SparkSession, path: str) -> Preparation:
    state = json.loads(spark.read.text(f"{path}/state").first()[0])
    state["ratios"] = [tuple(r) for r in state["ratios"]]
    try:
        codes = spark.read.schema(CODES).parquet(f"{path}/codes")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        codes = spark.createDataFrame([], CODES)
    return Preparation(**state, codes=codes)


def value_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, code): the rank of each value among its column's distinct ones, all columns in one plan."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, value string, code long")
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    distinct = df.select(F.explode(each).alias("x")).select("x.*").where("value is not null").distinct()
    places = numbered(distinct, [F.col("column_name"), F.col("value")], "_rank").checkpoint()
    first = places.groupBy("column_name").agg(F.min("_rank").alias("_first"))  # one row for each column
    return places.join(F.broadcast(first), "column_name").select("column_name", "value", (F.col("_rank") - F.col("_first")).alias("code"))


def fit(df: DataFrame, target: str, max_ratios: int = 5, n_bins: int = 5, correlated: float = 0.9, keep: list[str] = ()) -> Preparation:
    """What transform() needs, from the rows of df. keep: ratios that are made whatever the rows, and features that stay even
    where they repeat another."""
    junk = junk_columns(df, keep=target)
    kinds = {f.name: "number" if isinstance(f.dataType, T.NumericType) else "code" if isinstance(f.dataType, T.StringType) else "time" if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) else None for f in df.schema.fields}
    sources = {c: kinds[c] for c in df.columns if c != target and c not in junk and kinds[c]}
    strings = [c for c, k in sources.items() if k == "code"]
    made = Preparation(target, sources, codes=value_codes(df, strings))
    made.n_codes = {r.column_name: r["count"] for r in made.codes.groupBy("column_name").count().collect()}
    wide = made.base(df.select(*sources))[0].select(*(F.col(f"_f_{c}").alias(f"_f_{c}") for c in _numbers(sources))).checkpoint()
    _choose_ratios(made, wide, max_ratios)
    made.ratios += [r for r in permutations(_numbers(sources), 2) if "{}_div_{}".format(*r) in keep and r not in made.ratios]
    numbers = [*_numbers(sources), *(f"{a}_div_{b}" for a, b in made.ratios)]
    wide = wide.withColumns({f"_f_{c}": x for c, x in made.derived([]).items()})
    shares = [i / n_bins for i in range(n_bins + 1)]
    edges = exact_percentiles(wide, {f"_f_{c}": shares for c in numbers[:5]})
    made.bins = {c: sorted(set(edges[f"_f_{c}"]))[1:-1] for c in numbers[:5] if edges[f"_f_{c}"][0] is not None}
    wide = wide.withColumns({f"_f_{c}": x for c, x in made.derived([]).items() if c.endswith("_bin")}).checkpoint()  # else each pair below repeats the expressions
    numbers += [f"{c}_bin" for c in made.bins]
    made.dropped = [c for c in _repeating(wide, numbers, correlated) if c not in keep]
    made.features = [c for c in numbers if c not in made.dropped]
    named = {f"_f_{c}": [0.5] for c in made.features}
    made.medians = {c[3:]: m[0] if m[0] is not None else 0.0 for c, m in exact_percentiles(wide, named).items()}
    filled = wide.select(*[F.coalesce(F.col(f"_f_{c}"), F.lit(made.medians[c])).alias(c) for c in made.features])
    row = filled.agg(*[F.struct(F.avg(c), F.stddev_pop(c)).alias(c) for c in made.features]).first()
    made.means = {c: row[c][0] or 0.0 for c in made.features}
    made.deviations = {c: row[c][1] or 1.0 for c in made.features}
    return made


def _numbers(sources: dict[str, str]) -> list[str]:
    """Base features: columns in order, and the parts of timestamps after them."""
    return [c for c, k in sources.items() if k != "time"] + [f"{c}_{p}" for c, k in sources.items() if k == "time" for p in PARTS]


def _choose_ratios(made: Preparation, wide: DataFrame, most: int) -> None:
    """The first pairs of the four columns of the largest variance whose ratio is known for over half of the rows."""
    numbers = _numbers(made.sources)
    if len(numbers) < 2:
        return
    spread = wide.agg(*[F.var_samp(f"_f_{c}").alias(c) for c in numbers]).first()
    pairs = list(combinations(sorted(numbers, key=lambda c: -(spread[c] or 0.0))[:4], 2))
    known = wide.agg(F.count(F.lit(1)).alias("_n"), *[F.count(made.ratio(a, b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
    made.ratios = [p for i, p in enumerate(pairs) if known[f"p{i}"] > 0.5 * known["_n"]][:most]


def _repeating(wide: DataFrame, numbers: list[str], most: float, at_once: int = 100) -> list[str]:
    """Columns that correlate with an earlier one beyond most, either way."""
    pairs, gone = list(combinations(numbers, 2)), set()
    for at in range(0, len(pairs), at_once):
        part = pairs[at : at + at_once]
        row = wide.agg(*[correlation(f"_f_{a}", f"_f_{b}").alias(f"p{i}") for i, (a, b) in enumerate(part)]).first()
        gone |= {b for i, (_, b) in enumerate(part) if row[f"p{i}"] is not None and abs(row[f"p{i}"]) > most}
    return [c for c in numbers if c in gone]


def predict(preparation: Preparation, model, rows: DataFrame) -> DataFrame:
    """rows with the prediction of a pyspark.ml model that was trained on the vector "features" of transformed rows."""
    from pyspark.ml.feature import VectorAssembler

    held = F.struct(*[F.col(c) for c in rows.columns]).alias("_row")
    ready = preparation.transform(rows.select(held, *[c for c in rows.columns if c in preparation.sources]))
    vectors = VectorAssembler(inputCols=preparation.features, outputCol="features").transform(ready)
    return model.transform(vectors).select("_row.*", "prediction")
