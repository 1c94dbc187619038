"""Exact percentiles and row numbers that no single task has to work out.

`percentile` merges all distinct values of a column in one task. Here approximate percentiles, whose sketches are small, only
bracket the wanted ranks; one pass counts what lies below each bracket, the values inside are counted, and as long as they
are too many the brackets are narrowed. What reaches the driver is bounded by INSIDE.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000
#: So many distinct values inside the brackets of all columns may go to the driver.
INSIDE = 100_000


def exact_percentiles(df: DataFrame, wanted: dict[str, list[float]], accuracy: int = ACCURACY, inside: int = INSIDE) -> dict[str, list[float | None]]:
    """The percentiles of each column, interpolated between neighbours as `percentile` does; None for a column without values."""
    if not wanted:
        return {}
    values = df.select(*[F.col(c).cast("double").alias(c) for c in wanted])
    grid = {c: sorted({min(1.0, max(0.0, p + d)) for p in ps for d in (-2 / accuracy, 2 / accuracy)} | {0.0, 1.0}) for c, ps in wanted.items()}
    row = values.agg(*[F.struct(F.count(c).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi"), F.percentile_approx(c, grid[c], accuracy).alias("at")).alias(c) for c in wanted]).first()
    brackets, ranks = [], {}
    for c, ps in wanted.items():
        if not (n := row[c].n):
            continue
        near = dict(zip(grid[c], row[c]["at"], strict=True))
        for p in ps:
            place = p * (n - 1)
            ranks[c, p] = (math.floor(place), math.ceil(place), place)
            low, high = max(0.0, p - 2 / accuracy), min(1.0, p + 2 / accuracy)
            slack = 2 * n / accuracy < 2  # so few rows that the next rank may lie outside
            brackets.append((c, p, row[c].lo if slack or low == 0 else near[low], row[c].hi if slack or high == 1 else near[high]))
    found = _select(values, brackets, ranks, inside)
    return {c: [found.get((c, p)) for p in ps] for c, ps in wanted.items()}


def _select(values: DataFrame, brackets: list[tuple], ranks: dict, inside: int) -> dict:
    """The interpolated value at each rank; every bracket (column, p, low, high) holds its ranks."""
    found: dict = {}
    while brackets:
        below = values.agg(*[F.count_if(F.col(c) < F.lit(lo)).alias(f"b{i}") for i, (c, _, lo, _) in enumerate(brackets)]).first()
        each = F.array(*[F.when(F.col(c).between(F.lit(lo), F.lit(hi)), F.struct(F.lit(i).alias("i"), F.col(c).alias("v"))) for i, (c, _, lo, hi) in enumerate(brackets)])
        counts = values.select(F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).groupBy("x.i", "x.v").agg(F.count(F.lit(1)).alias("n")).checkpoint()
        if counts.count() <= max(inside, 8 * len(brackets)):  # narrowing leaves a bracket three values at most
            upto = [below[f"b{i}"] for i in range(len(brackets))]
            known: list[dict] = [{} for _ in brackets]
            for r in counts.orderBy("i", "v").collect():
                c, p, _, _ = brackets[r.i]
                for rank in set(ranks[c, p][:2]):
                    if upto[r.i] <= rank < upto[r.i] + r.n:
                        known[r.i][rank] = r.v
                upto[r.i] += r.n
            for (c, p, _, _), at in zip(brackets, known, strict=True):
                low, high, place = ranks[c, p]
                found[c, p] = at[low] if low == high else (high - place) * at[low] + (place - low) * at[high]
            return found
        brackets = _narrowed(counts, brackets, ranks, below)
    return found


def _narrowed(counts: DataFrame, brackets: list[tuple], ranks: dict, below) -> list[tuple]:
    """Brackets between values of the counts, cut at quantiles of the distinct ones, that still hold their ranks."""
    shares = [k / 200 for k in range(201)]
    cuts = {r.i: sorted(set(r["at"])) for r in counts.groupBy("i").agg(F.percentile_approx("v", shares, 2_000).alias("at")).collect()}

    def placed(batches):  # how many cuts lie below each value; as an expression, thousands of comparisons took longer to plan than to run
        for batch in batches:
            i, v = (batch.column(c).to_numpy() for c in (0, 1))
            k = np.zeros(len(i), np.int64)
            for b in np.unique(i):
                k[i == b] = np.searchsorted(cuts[b], v[i == b])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k), batch.column(2)], ["i", "k", "n"])

    parts = counts.select("i", "v", "n").mapInArrow(placed, "i int, k long, n long")
    sums = {(r.i, r.k): r.n for r in parts.groupBy("i", "k").agg(F.sum("n").alias("n")).collect()}  # 201 rows for each bracket
    out = []
    for i, (c, p, _, _) in enumerate(brackets):
        upto, ends = below[f"b{i}"], []
        for k, v in enumerate(cuts[i]):
            upto += sums.get((i, k), 0)
            ends.append((upto, v))  # so many rows up to v
        low = max((v for n, v in ends if n <= ranks[c, p][0]), default=cuts[i][0])
        high = min((v for n, v in ends if n > ranks[c, p][1]), default=cuts[i][-1])
        out.append((c, p, low, high))
    return out


def numbered(df: DataFrame, by: list[Column], name: str) -> DataFrame:
    """df with 0, 1, 2 ... in the order by: numbers within ranges, plus the rows of the ranges before, one count for each."""
    spark = df.sparkSession
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(width, *by).sortWithinPartitions(*by).select("*", F.spark_partition_id().alias("_part"), place.alias("_place")).checkpoint()
    firsts, before = [], 0
    for r in sorted(ranged.groupBy("_part").count().collect()):
        firsts.append((r[0], before))
        before += r[1]
    return ranged.join(F.broadcast(spark.createDataFrame(firsts, "_part int, _first long")), "_part").withColumn(name, F.col("_first") + F.col("_place")).drop("_part", "_place", "_first")
