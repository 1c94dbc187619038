"""Nearest rows by tiles against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import features, nearest


def points(dims):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(300, dims)) * 50, np.round(rng.normal(size=(300, dims)) * 3), np.ones((120, dims)), np.full((3, dims), 900.0)])
    return [(int(k), [float(v) for v in row]) for k, row in zip(rng.permutation(len(x)), x, strict=True)]


@pytest.mark.parametrize(("dims", "tiles"), [(1, 32), (2, 1), (2, 64), (3, 32)])
def test_nearest_are_those_of_all_pairs(spark, monkeypatch, dims, tiles):
    """Ties, many copies of one point and far rows included, whatever the tiles."""
    monkeypatch.setattr(nearest, "AT_ONCE", 5_000)
    rows, k = points(dims), 6
    keys, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    got = {tuple(r.x): [(n.d, n.key, tuple(n.y)) for n in r.near] for r in nearest.nearest(spark.createDataFrame(rows, "key long, x array<double>"), k, dims, tiles).collect()}
    assert got.keys() == set(map(tuple, x))
    for p, near in got.items():
        d = sum((np.array(p)[i] - x[:, i]) ** 2 for i in range(dims))
        order = np.lexsort((keys, d))[:k]
        assert near == [(d[i], keys[i], tuple(x[i])) for i in order]


def test_rows_meet_few_boxes(spark, monkeypatch):
    """The pairs that are looked at grow with the rows, not with their square."""
    rng = np.random.default_rng(1)
    sample = rng.uniform(size=(20_000, 2))
    for depth, most in ((4, 1.0), (8, 1.0)):
        tiles = nearest.Tiles(sample, depth)
        size = np.bincount(tiles.of(sample), minlength=1 << depth)
        assert size.min() > 0 and size.max() < 2 * len(sample) / (1 << depth)
        rows, _ = tiles.reached(sample, np.full(len(sample), 8 / (np.pi * len(sample))))
        assert len(rows) / len(sample) - 1 < most


def test_smote_of_copies_and_missing_numbers(spark):
    """Copies of one point give themselves; rows without a number, and a row alone, give none."""
    df = spark.createDataFrame([(i, 5.0, 1.0, "P") for i in range(50)] + [(90, None, 1.0, "P"), (91, float("nan"), 1.0, "P"), (92, 5.0, 1.0, "Q")], "id long, a double, b double, c string")
    got = features.smote(df, ["a", "b"], "c", "P", "id", k=3, per_row=2, blocks=4).collect()
    assert len(got) == 100 and {(r.a, r.b, r.c) for r in got} == {(5.0, 1.0, "P")}
    assert features.smote(df, ["a", "b"], "c", "Q", "id").count() == 0 and features.smote(df.where(F.col("id") < 0), ["a"], "c", "P", "id").count() == 0
