"""Joins and set operations of the registry, the monitor and the crawler."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def last_label(rows: DataFrame, labels: DataFrame, key: str, order: list[str], label: str) -> DataFrame:
    """rows with the last label of each key, "unlabelled" without one."""
    newest = labels.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*[F.desc(c) for c in order]))).where("_r = 1").select(key, label)
    return rows.join(newest, key, "left").withColumn(label, F.coalesce(F.col(label).cast("string"), F.lit("unlabelled")))


def version_diff(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """How many rows are added, removed and unchanged, by hash of their columns."""
    h = F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).alias("h")
    both = old.select(h, F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(new.select(h, F.lit(0).alias("o"), F.lit(1).alias("n")))
    sides = both.groupBy("h").agg(F.max("o").alias("o"), F.max("n").alias("n"))
    return sides.agg(F.count_if((F.col("n") == 1) & (F.col("o") == 0)).alias("added"), F.count_if((F.col("n") == 0) & (F.col("o") == 1)).alias("removed"), F.count_if((F.col("n") == 1) & (F.col("o") == 1)).alias("unchanged"))


LOWER_IS_BETTER = ("loss", "perplexity", "error")


def compare_runs(metrics: DataFrame, run_a: str, run_b: str) -> DataFrame:
    """Of each metric of (run_id, metric, value) both values, their difference, and whether b improves on a."""
    a = metrics.where(F.col("run_id") == run_a).select("metric", F.col("value").alias("a"))
    b = metrics.where(F.col("run_id") == run_b).select("metric", F.col("value").alias("b"))
    delta = F.col("b") - F.col("a")
    better = F.when(F.col("metric").isin(*LOWER_IS_BETTER), delta < 0).otherwise(delta > 0)
    return a.join(b, "metric", "full").select("metric", "a", "b", F.round(delta, 6).alias("delta"), F.round(F.try_divide(delta * 100, F.abs("a")), 4).alias("pct"), better.alias("improved"))


def best_runs(metrics: DataFrame) -> DataFrame:
    low = F.col("metric").isin(*LOWER_IS_BETTER)
    signed = metrics.withColumn("_s", F.when(low, -F.col("value")).otherwise(F.col("value")))
    best = W.partitionBy("metric").orderBy(F.desc("_s"), "run_id")
    return signed.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("metric", "run_id", "value")


def metric_history(metrics: DataFrame, order: str) -> DataFrame:
    w = W.partitionBy("metric").orderBy(order)
    return metrics.withColumn("previous", F.lag("value").over(w)).withColumn("change", F.round(F.col("value") - F.col("previous"), 6))


def retrain_triggers(metrics: DataFrame, triggers: DataFrame) -> DataFrame:
    """Metrics beyond a trigger (metric, least, most)."""
    joined = metrics.join(F.broadcast(triggers), "metric")
    return joined.where((F.col("value") < F.col("least")) | (F.col("value") > F.col("most"))).select("run_id", "metric", "value")


def url_form(url: Column) -> Column:
    """Lower-case scheme and host, without fragment and final slash."""
    bare = F.regexp_replace(url, "#.*$", "")
    head = F.regexp_extract(bare, r"^(?i)(https?://[^/?]*)", 1)
    return F.regexp_replace(F.concat(F.lower(head), F.substr(bare, F.length(head) + 1)), "/$", "")


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, href) in order, each once."""
    found = F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="([^"]+)"'), 1))
    return pages.select("page_id", F.posexplode(found).alias("place", "href"))


def frontier(links: DataFrame, start: DataFrame, depth: int, source: str = "source", target: str = "target", node: str = "node") -> DataFrame:
    """Nodes within `depth` links of the start, with their depth: each round joins the frontier and leaves out what was seen."""
    seen = start.select(node).distinct().withColumn("depth", F.lit(0))
    edge = seen
    for d in range(1, depth + 1):
        reached = edge.join(links, edge[node] == links[source]).select(F.col(target).alias(node)).distinct()
        edge = reached.join(seen, node, "left_anti").withColumn("depth", F.lit(d)).checkpoint()
        if edge.isEmpty():
            break
        seen = seen.unionByName(edge)
    return seen
