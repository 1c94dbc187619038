"""Sources: tables and documents from files."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as missing in CSV files (fixed values).
NA = ["", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "n/a", "<NA>", "#N/A", "-NaN", "-nan"]
TEXT_SUFFIXES = (".txt", ".md", ".markdown", ".rst", ".log")
DOCUMENT = "source string, source_type string, text string, error string"


def load_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """A table by its suffix: csv, json, jsonl, parquet, or an Excel sheet read on the driver."""
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix == ".csv":
        return load_csv(spark, path, **options)[0]
    if suffix == ".json":
        return spark.read.json(path, multiLine=True, **options)
    if suffix in (".jsonl", ".ndjson"):
        return spark.read.json(path, **options)
    if suffix == ".parquet":
        return spark.read.parquet(path, **options)
    if suffix in (".xlsx", ".xls"):
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path, **options))
    raise ValueError(f"unsupported file type: {suffix or path}")


#: What a column's texts may all be, in the order that types are tried; what fits none is a string.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
TYPES = {
    "bigint": lambda c: F.rlike(c, F.lit(r"^[+-]?\d+$")) & c.try_cast("bigint").isNotNull(),
    "double": lambda c: F.rlike(c, F.lit(NUMBER)) & c.try_cast("double").isNotNull(),
    "boolean": lambda c: F.lower(c).isin("true", "false"),
    "date": lambda c: F.rlike(c, F.lit(r"^\d{4}-\d{1,2}-\d{1,2}$")) & c.try_cast("date").isNotNull(),
    "timestamp": lambda c: F.rlike(c, F.lit(r"^\d{4}-\d{1,2}-\d{1,2}")) & c.try_cast("timestamp").isNotNull(),
}


def infer_text_types(df: DataFrame) -> dict[str, str]:
    """The first of TYPES that all known values of each string column are, string where there is none: one aggregate for all columns.

    Each type's count is kept beside the others, so that a date column with one time of day is a timestamp, and an integer
    column with one fraction is a double.
    """
    columns = [c for c, t in df.dtypes if t == "string"]
    if not columns:
        return {}
    plain = {c: F.trim(F.col(f"`{c}`")) for c in columns}
    row = df.agg(*[F.struct(F.count(x).alias("n"), *[F.count_if(fits(x)).alias(t) for t, fits in TYPES.items()]).alias(f"c{i}") for i, x in enumerate(plain.values())]).first()
    return {c: next((t for t in TYPES if row[f"c{i}"].n and row[f"c{i}"][t] == row[f"c{i}"].n), "string") for i, c in enumerate(columns)}


def load_csv(spark: SparkSession, path: str, missing: list[str] = NA, **options) -> tuple[DataFrame, DataFrame]:
    """(rows, rows that don't parse) of CSV files with a header. Texts that count as missing become null before types are inferred.

    Rows with too few or too many fields are in the second table alone, one column `record`.
    """
    options = {"header": True, "multiLine": True, "escape": '"'} | options
    names = spark.read.options(**options).csv(path).columns
    broken = "_record"
    while broken in names:
        broken += "_"
    fields = T.StructType([T.StructField(n, T.StringType()) for n in [*names, broken]])
    raw = spark.read.options(**options).schema(fields).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", broken).csv(path)
    # Spark reads records that don't parse only beside another column, which the second condition names.
    whole, another = F.col(f"`{broken}`").isNull(), F.coalesce(F.length(f"`{names[0]}`"), F.lit(0)) >= 0
    known = raw.where(whole & another)
    texts = known.select(*[F.when(F.trim(F.col(f"`{n}`")).isin(missing), None).otherwise(F.col(f"`{n}`")).alias(n) for n in names])
    kinds = infer_text_types(texts)
    rows = texts.select(*[F.trim(F.col(f"`{n}`")).try_cast(kinds[n]).alias(n) if kinds[n] != "string" else F.col(f"`{n}`") for n in names])
    return rows, raw.where(~whole & another).select(F.col(f"`{broken}`").alias("record"))


def load_samples(spark: SparkSession, path: str) -> DataFrame:
    """Instruction samples from JSON lines, a JSON array, or {"data": [...]}; absent columns are empty."""
    df = spark.read.json(path, multiLine=path.endswith(".json"))
    if "data" in df.columns:
        df = df.select(F.explode("data").alias("d")).select("d.*")
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in ("instruction", "input", "output")])


def flatten_json(value, indent: str = "") -> str:
    """`key: value` lines, nested ones indented."""
    if isinstance(value, dict):
        return "\n".join(f"{indent}{k}:\n{flatten_json(v, indent + '  ')}" if isinstance(v, dict | list) else f"{indent}{k}: {v}" for k, v in value.items())
    if isinstance(value, list):
        return "\n".join(flatten_json(v, indent) for v in value)
    return f"{indent}{value}"


def decode_text(data: bytes) -> str:
    for encoding in ("utf-8", "cp1252", "latin-1"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def document_text(path: str, data: bytes) -> tuple[str, str]:
    """(type, text) of a file."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".json":
        return "json", flatten_json(json.loads(decode_text(data)))
    if suffix == ".xml":
        return "xml", "\n".join(t.strip() for t in ET.fromstring(data).itertext() if t.strip())
    if suffix in (".html", ".htm"):
        return "html", decode_text(data)
    if suffix in TEXT_SUFFIXES:
        return "markdown" if suffix.startswith(".m") else "text", decode_text(data)
    raise ValueError(f"unsupported document type: {suffix}")


def load_documents(spark: SparkSession, path: str, recursive: bool = True, most_bytes: int = 10 << 20) -> DataFrame:
    """Documents (source, source_type, text, error) of a folder; a file that can't be read keeps its row with the error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for name, size, data in zip(pdf["path"], pdf["length"], pdf["content"], strict=True):
                try:
                    if size > most_bytes:
                        raise ValueError(f"larger than {most_bytes} bytes")
                    rows.append((name, *document_text(name, bytes(data)), None))
                except Exception as e:  # the error is the row's result
                    rows.append((name, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["source", "source_type", "text", "error"])

    return files.mapInPandas(parse, DOCUMENT)
