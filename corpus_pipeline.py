"""The corpus pipeline: five stages from raw documents to token counts.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe_codec import default_tokenizer, encode
from millrace.llm.compression_quality import keep_good
from millrace.llm.divide_skip_join import keep_one
from millrace.llm.line_chunks import remove_repeated_lines
from millrace.llm.shared import read_table, stage_table
from millrace.llm.template_decontamination import remove_leaking


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that a smaller doc_id has go; n_chars follows the text."""
    done = remove_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("long"))
    return done.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 80 % of their five-word shingles one stays."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a run of template tokens with a benchmark item go."""
    return remove_leaking(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, encoded and decoded again."""
    return encode(docs.select("doc_id", "text"), default_tokenizer()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("bpe encoding and decoding", tokens),
]

#: SQL cannot express the classifier and the encoding. tests/llm compares line dedup, the join, the encoding with brute force,
#: the classifier with held-out labels, and the decontamination with planted cases at every offset.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name.split(" ")[0])
    return STAGES[-1][1](spark, docs, sf_dir)
