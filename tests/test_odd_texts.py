"""Queries over null, empty and blank texts, and over shares that halve their last place, agree with their SQL."""

import duckdb
import pytest

from millrace.plans.registry import oracle_sql, queries

from .test_queries import rows

TEXTS = [None, "", " ", "x", "y" * 448, "z" * 449, "é" * 1000]


def agrees(spark, tmp_path, name, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    ours, theirs = queries()[name](spark, str(tmp_path)).toPandas(), duck.execute(oracle_sql()[name]).df()
    assert rows(ours) == rows(theirs)
    return ours


def test_char_windows(spark, tmp_path):
    ours = agrees(spark, tmp_path, "q_chunk_char_windows", TEXTS)
    assert not {0, 1} & set(ours.doc_id) and len(ours) == 1 + 1 + 1 + 2 + 3


@pytest.mark.parametrize("texts", [TEXTS, ["", "x"]])
def test_chunk_stats(spark, tmp_path, texts):
    ours = agrees(spark, tmp_path, "q_chunk_stats", texts)
    assert ours.shortest[0] == 1


def test_alpha_ratio(spark, tmp_path):
    """57 of 800 is 0.07125, whose double lies below it; 1 of 32 is 0.03125 in both."""
    ours = agrees(spark, tmp_path, "q_alpha_ratio", [*TEXTS, "a" * 57 + "1" * 743, "a" + "1" * 31]).set_index("doc_id").ratio
    assert ours[7] == 0.0712 and ours[8] == 0.0313
