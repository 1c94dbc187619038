"""The exact nearest rows of every row in a few dimensions, by tiles of the space.

Halving a bounded sample along its widest dimension gives boxes of about TILE_ROWS rows. Rows meet the others of their box; one
whose k-th distance reaches beyond its box then visits the boxes that it reaches, and no others. Of rows at one point the
first few keys are enough to answer any row, so copies never meet in numbers. The sample decides where boxes end, never what is found.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

TILE_ROWS = 2_048
#: Rows of the sample that the boxes are cut by.
SAMPLE_ROWS = 100_000
#: Distances of so many pairs are held at once.
AT_ONCE = 1 << 20


class Tiles:
    """Boxes as a complete binary tree, in the order of a heap: a row goes right where its value reaches the cut."""

    def __init__(self, sample: np.ndarray, depth: int):
        inner, dims = (1 << depth) - 1, sample.shape[1]
        self.depth, self.dim, self.cut = depth, np.zeros(inner, int), np.full(inner, np.inf)
        lo, hi, held = np.full((2 * inner + 1, dims), -np.inf), np.full((2 * inner + 1, dims), np.inf), {0: sample}
        for n in range(inner):
            own = held.pop(n)
            if len(own) > 1:
                self.dim[n] = j = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                cut = np.partition(own[:, j], len(own) // 2)[len(own) // 2]
                self.cut[n] = cut if cut > own[:, j].min() else min((v for v in own[:, j] if v > cut), default=np.inf)
            right = own[:, self.dim[n]] >= self.cut[n]
            held[2 * n + 1], held[2 * n + 2] = own[~right], own[right]
            for child in (2 * n + 1, 2 * n + 2):
                lo[child], hi[child] = lo[n], hi[n]
            hi[2 * n + 1, self.dim[n]] = lo[2 * n + 2, self.dim[n]] = self.cut[n]
        self.lo, self.hi = lo[inner:], hi[inner:]

    def of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), int)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.dim[node]] >= self.cut[node])
        return node - len(self.cut)

    def reached(self, x: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, tile) of the boxes no farther than `most`, a squared distance. Sums go as in _ranked, so rounding keeps the order."""
        rows, tiles, step = [np.zeros(0, int)], [np.zeros(0, int)], max(1, AT_ONCE // len(self.lo))
        for at in range(0, len(x), step):
            q = x[at : at + step]
            d = sum(np.maximum(np.maximum(self.lo[None, :, i] - q[:, i, None], q[:, i, None] - self.hi[None, :, i]), 0.0) ** 2 for i in range(x.shape[1]))
            i, j = np.nonzero(d <= most[at : at + step, None])
            rows.append(at + i), tiles.append(j)
        return np.concatenate(rows), np.concatenate(tiles)


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _ranked(points: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, row of x, squared distance) of the k nearest, ties to the earlier row, sorted by point and distance."""
    out, step = [], max(1, AT_ONCE // max(1, len(x)))
    for at in range(0, len(points), step):
        q = points[at : at + step]
        d = sum((q[:, i, None] - x[None, :, i]) ** 2 for i in range(x.shape[1]))
        edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if len(x) > k else np.inf
        i, j = np.nonzero(d <= edge)
        order = np.lexsort((j, d[i, j], i))
        i, j = i[order], j[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((at + i[first], j[first], d[i[first], j[first]]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def nearest(rows: DataFrame, k: int, dims: int, least_tiles: int = 1) -> DataFrame:
    """(x, near) for each distinct x of rows (key, x array<double>): the k first rows by squared distance, then key, as (d, key, y).

    Keys are unlike one another, and all values of x are numbers; the rows at x itself are among the k.
    """
    spark, kind = rows.sparkSession, rows.schema["key"].dataType.simpleString()
    few = rows.withColumn("r", F.row_number().over(W.partitionBy("x").orderBy("key"))).where(F.col("r") <= k).checkpoint()
    n = few.count()
    depth = max(0, math.ceil(math.log2(max(least_tiles, n / TILE_ROWS, 1))))
    share = min(1.0, SAMPLE_ROWS / max(n, 1))
    picked = few.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select("x").limit(2 * SAMPLE_ROWS)
    sample = _matrix(picked.toArrow().column(0), dims)
    tiles = spark.sparkContext.broadcast(Tiles(sample, depth))
    near_type = f"array<struct<d: double, key: {kind}, y: array<double>>>"

    def placed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tiles.value.of(_matrix(batch.column(1), dims)), pa.int32())], ["key", "x", "r", "tile"])

    held = few.mapInArrow(placed, f"key {kind}, x array<double>, r int, tile int").checkpoint()

    def answered(points: np.ndarray, table: pa.Table) -> tuple[pa.Array, np.ndarray]:
        """The lists of the k nearest, and each list's last squared distance, infinite if it is short."""
        table = table.sort_by("key")
        x = _matrix(table.column("x"), dims)
        i, j, d = _ranked(points, x, k)
        sizes = np.bincount(i, minlength=len(points))
        ends = np.cumsum(sizes)
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(j) + 1) * dims, pa.int32()), pa.array(x[j].ravel()))
        each = pa.StructArray.from_arrays([pa.array(d), table.column("key").combine_chunks().take(pa.array(j)), vectors], ["d", "key", "y"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), each), np.where(sizes == k, d[ends - 1], np.inf)

    def at_home(table):
        own = table.filter(pa.compute.equal(table.column("r"), 1)).column("x").combine_chunks()
        points = _matrix(own, dims)
        near, last = answered(points, table)
        row, tile = tiles.value.reached(points, last)
        away = tile != table.column("tile")[0].as_py()
        row, tile = row[away], tile[away]
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(points)))])
        return pa.table([own, near, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tile, pa.int32()))], ["x", "near", "away"])

    home = held.groupBy("tile").applyInArrow(at_home, f"x array<double>, near {near_type}, away array<int>").checkpoint()
    visits = home.where(F.size("away") > 0).select("x", F.explode("away").alias("tile"))

    def abroad(here, guests):
        if not (len(here) and len(guests)):
            return pa.table([pa.array([], t) for t in (pa.list_(pa.float64()), near_arrow(here))], ["x", "near"])
        own = guests.column("x").combine_chunks()
        return pa.table([own, answered(_matrix(own, dims), here)[0]], ["x", "near"])

    def near_arrow(table):
        return pa.list_(pa.struct([("d", pa.float64()), ("key", table.schema.field("key").type), ("y", pa.list_(pa.float64()))]))

    found = held.groupBy("tile").cogroup(visits.groupBy("tile")).applyInArrow(abroad, f"x array<double>, near {near_type}")
    merged = home.where(F.size("away") > 0).select("x", "near").unionByName(found).groupBy("x").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return home.where(F.size("away") == 0).select("x", "near").unionByName(merged)
