"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage_table


def _stars(pairs: DataFrame, node: str, other: str) -> DataFrame:
    """Each pair, told the smallest of its node's neighbours and the node itself. Minima are partly taken before the exchange."""
    least = pairs.groupBy(node).agg(F.least(F.min(other), F.first(node)).alias("m"))
    return pairs.join(least, node)


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the smallest node that it is connected with.

    Rounds of large-star and small-star: every node's larger neighbours, then its smaller ones, are tied to the smallest, so
    that components become stars in a logarithmic number of rounds. Each round is written to the shared folder.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = stage_table(now, "edges")
    seen = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _stars(both, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        starred = _stars(large, "a", "b")
        small = starred.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stage_table(small.unionByName(starred.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
