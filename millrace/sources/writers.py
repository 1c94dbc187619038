"""Sinks: tables, JSON lines, and a registry of versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    if kind not in ("csv", "parquet", "json"):
        raise ValueError(f"unsupported format: {kind}")
    df.write.mode("overwrite").options(**({"header": True, "escape": '"'} if kind == "csv" else {})).format(kind).save(path)


def save_jsonl(df: DataFrame, path: str, columns: tuple[str, ...] = ("instruction", "input", "output")) -> None:
    """Only the training columns, nulls written out."""
    df.select(*[c for c in columns if c in df.columns]).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def content_hash(df: DataFrame) -> str:
    """A hash of the rows that doesn't depend on their order."""
    h = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
    row = df.agg(F.sum(h).alias("s"), F.count(F.lit(1)).alias("n")).first()
    return f"{int(row.s or 0) & (2**128 - 1):032x}-{row.n}"


class Registry:
    """Versions of datasets: a folder each, and an index table."""

    INDEX = "name string, version string, path string, content_hash string, n_rows long, tags array<string>, parent string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def index(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.INDEX).json(f"{self.root}/_index")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.INDEX)

    def register(self, name: str, version: str, df: DataFrame, tags: list[str] = (), parent: str | None = None) -> str:
        if not self.index().where((F.col("name") == name) & (F.col("version") == version)).isEmpty():
            raise ValueError(f"{name} {version} exists")
        path = f"{self.root}/{name}/{version}"
        df.write.parquet(path)
        stored = self.spark.read.parquet(path)
        entry = self.spark.createDataFrame([(name, version, path, content_hash(stored), stored.count(), list(tags), parent)], self.INDEX)
        entry.coalesce(1).write.mode("append").json(f"{self.root}/_index")
        return path

    def load(self, name: str, version: str) -> DataFrame:
        found = self.index().where((F.col("name") == name) & (F.col("version") == version)).select("path").first()
        if found is None:
            raise KeyError(f"{name} {version}")
        return self.spark.read.parquet(found.path)
