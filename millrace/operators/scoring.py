"""Quality of documents and of instruction pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from .near_duplicates import THRESHOLD, mark_near_duplicates


def score_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """Length, diversity and coherence scores, flags and the overall score of plain texts."""
    t = F.col(text)
    scored = docs.withColumns({"length_score": X.length_score(t), "diversity_score": X.diversity_score(t), "coherence_score": X.coherence_score(t), "is_toxic": X.is_toxic(t), "n_flags": F.size(X.low_quality_flags(t))})
    base = 0.2 * F.col("length_score") + 0.3 * F.col("diversity_score") + 0.2 * F.col("coherence_score")
    overall = F.when(F.col("is_toxic"), 0.0).otherwise(base * F.greatest(F.lit(0.0), 1 - 0.15 * F.col("n_flags")))
    return scored.withColumn("overall_score", F.round(overall, 6))


def score_pairs(pairs: DataFrame, similar: float = THRESHOLD, stop_words: list[str] = ()) -> DataFrame:
    """The same of (pair_id, instruction, input, output), with the ratio and originality scores, and pairs marked whose text is
    similar to that of an earlier one (cosine of TF-IDF vectors)."""
    whole = F.concat_ws(" ", "instruction", "input", "output")
    scored = score_documents(pairs.withColumn("_t", whole), "_t").drop("_t")
    scored = scored.withColumns({"ratio_score": X.ratio_score(F.col("instruction"), F.col("output")), "originality": X.originality_score(F.col("instruction"), F.col("input"), F.col("output"))})
    base = 0.2 * F.col("length_score") + 0.3 * F.col("diversity_score") + 0.2 * F.col("coherence_score") + 0.3 * F.col("ratio_score")
    flags = F.greatest(F.lit(0.0), 1 - 0.15 * F.col("n_flags"))
    marks = mark_near_duplicates(pairs.select("pair_id", whole.alias("_t")), "pair_id", "_t", similar, stop_words).select("pair_id", "is_duplicate")
    marked = scored.join(marks, "pair_id")
    overall = F.when(F.col("is_toxic"), 0.0).otherwise(base * F.when(F.col("is_duplicate"), 0.1).otherwise(1.0) * flags * F.col("originality"))
    return marked.withColumn("overall_score", F.round(overall, 6))


def reject_reason(df: DataFrame, text: str = "text", least: float = 0.5, shortest: int = 20, longest: int = 5000) -> DataFrame:
    """Why a row goes, in this order: its length, toxicity, repetition, score; null if it stays."""
    n = F.length(text)
    duplicate = F.col("is_duplicate") if "is_duplicate" in df.columns else F.lit(False)
    return df.withColumn("reject_reason", F.when(n < shortest, "too_short").when(n > longest, "too_long").when(F.col("is_toxic"), "toxic").when(duplicate, "duplicate").when(F.col("overall_score") < least, "low_score"))


def rescue(df: DataFrame, most: int = 25, key: str = "doc_id") -> DataFrame:
    """The best rows that aren't toxic."""
    return df.where(~F.col("is_toxic")).orderBy(F.desc("overall_score"), key).limit(most)


def cap_per_key(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def split_by_hash(df: DataFrame, key: str, seed: str = "42", train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """train, validation or test by the hash of the key: no global order is needed, and a row keeps its side as data grow."""
    share = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return df.withColumn("split", F.when(share < train, "train").when(share < train + validation, "validation").otherwise("test"))


def balance_tasks(df: DataFrame, task: str, order: str, weights: dict[str, int]) -> DataFrame:
    """As many rows of each task as its weight allows beside the scarcest; all rows if some task has none."""
    counts = {r[task]: r["count"] for r in df.groupBy(task).count().collect()}
    unit = min(counts.get(t, 0) // w for t, w in weights.items())
    if not unit:
        return df
    limit = F.create_map(*[F.lit(x) for t, w in weights.items() for x in (t, w * unit)])
    return df.withColumn("_r", F.row_number().over(W.partitionBy(task).orderBy(order))).where(F.col("_r") <= F.element_at(limit, F.col(task))).drop("_r")
