"""Kendall's tau-b by counting discordant pairs in ranges; no pair of rows is ever formed.

Equal pairs of values are counted once, with their number. Both columns are cut at approximate quantiles: the values between
two bounds are a range, and every bound is a range of its own, so that a value that a third of the rows share never makes a
range large. Two rows are discordant if the one with the larger x has the smaller y, and such pairs lie

- in one range of x: each range is counted by itself, by a merge sort's count;
- in two ranges of x and one range of y: likewise within each range of y, with the range of x as x;
- in two ranges of each: from the counts of the grid of ranges, whose size is a parameter's square.

Ranges that are one value have no pair of the first two kinds, and are not sent.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Quantiles at which a column is cut; the grid has (2 * RANGES + 1)^2 cells at most.
RANGES = 100
ACCURACY = 10_000


def range_of(column: Column, bounds: list) -> Column:
    """2 k + 1 for the k-th bound itself, and 2 k for what lies between it and the bound before, by binary search."""

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(2 * low)
        mid = (low + high) // 2
        bound = F.lit(bounds[mid])
        return F.when(column < bound, within(low, mid)).when(column == bound, F.lit(2 * mid + 1)).otherwise(within(mid + 1, high))

    return within(0, len(bounds))


def inversions(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> int:
    """The sum of weights[i] * weights[j] over all pairs with x[i] < x[j] and y[i] > y[j].

    Rows in the order of (x, y) are dealt by the bits of y's rank, the highest first, as a merge sort would: at each bit, every
    row with a 0 counts the weight of those before it that have a 1 and agree with it in all higher bits.
    """
    if len(x) < 2:
        return 0
    order = np.lexsort((y, x))
    rank = np.unique(y, return_inverse=True)[1][order]
    w = weights[order]
    total, large = 0, int(w.sum()) ** 2 >= 1 << 62
    for bit in range(int(rank.max()).bit_length() - 1, -1, -1):
        head, one = rank >> (bit + 1), (rank >> bit) & 1
        ones = np.cumsum(w * one)
        starts = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
        before = np.repeat(np.concatenate([[0], ones])[starts], np.diff(np.concatenate([starts, [len(head)]])))
        zeros = one == 0
        ahead, own = (ones - before)[zeros], w[zeros]
        total += sum(int(a) * int(b) for a, b in zip(ahead, own, strict=True)) if large else int(np.dot(ahead, own))
        order = np.argsort(rank >> bit, kind="stable")
        rank, w = rank[order], w[order]
    return total


def _inversions_of(pairs: DataFrame, group: str, x: str, y: str) -> int:
    """The sum of inversions() over the groups of pairs (x, y, n)."""

    def counted(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_numpy() for c in ("x", "y", "n")]
        return pa.table({"found": pa.array([str(inversions(*columns))])})

    found = pairs.select(F.col(group).alias("g"), F.col(x).alias("x"), F.col(y).alias("y"), "n").groupBy("g").applyInArrow(counted, "found string")
    return int(found.agg(F.sum(F.col("found").cast("decimal(38,0)"))).first()[0] or 0)


def _tied(pairs: DataFrame, *columns: str) -> int:
    """Pairs of rows that agree in the columns."""
    sizes = pairs.groupBy(*columns).agg(F.sum("n").cast("decimal(19,0)").alias("t"))
    return int(sizes.agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).cast("decimal(38,0)")).first()[0] or 0)


def kendall(df: DataFrame, a: str, b: str, ranges: int = RANGES) -> float | None:
    """tau-b of two numeric columns over the rows where both are numbers; None where one has a single value or none."""
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    known = df.where(number(a) & number(b)).select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
    shares = [i / (ranges + 1) for i in range(1, ranges + 1)]
    row = known.agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(c, shares, ACCURACY).alias(c) for c in ("x", "y")]).first()
    if not row.n:
        return None
    pairs = known.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.withColumns({f"r{c}": range_of(F.col(c), sorted(set(row[c]))) for c in ("x", "y")}).checkpoint()
    n0, n1, n2, n3 = row.n * (row.n - 1) // 2, _tied(pairs, "x"), _tied(pairs, "y"), _tied(pairs, "x", "y")
    if n1 == n0 or n2 == n0:
        return None
    grid = np.zeros((2 * ranges + 1, 2 * ranges + 1), object)
    for cell in pairs.groupBy("rx", "ry").agg(F.sum("n").alias("n")).collect():  # as many as the grid has cells at most
        grid[cell.rx, cell.ry] = cell.n
    above = np.cumsum(np.cumsum(grid, axis=0)[:, ::-1], axis=1)[:, ::-1]  # rows up to a range of x, from a range of y on
    discordant = int((grid[1:, :-1] * above[:-1, 1:]).sum())
    discordant += _inversions_of(pairs.where(F.col("rx") % 2 == 0), "rx", "x", "y")
    discordant += _inversions_of(pairs.where(F.col("ry") % 2 == 0), "ry", "rx", "y")
    return (n0 - n1 - n2 + n3 - 2 * discordant) / math.sqrt(n0 - n1) / math.sqrt(n0 - n2)


def kendall_pairs(df: DataFrame, columns: list[str], digits: int = 4, ranges: int = RANGES) -> DataFrame:
    """(a, b, tau) of each two columns."""
    found = [(a, b, None if (tau := kendall(df, a, b, ranges)) is None else round(tau, digits)) for a, b in combinations(columns, 2)]
    return df.sparkSession.createDataFrame(found, "a string, b string, tau double")


def strong_pairs(correlations: DataFrame, value: str, least: float = 0.7) -> DataFrame:
    """The pairs of columns that correlate by at least so much, either way."""
    return correlations.where(F.abs(value) >= least)
