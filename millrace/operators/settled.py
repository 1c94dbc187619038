"""A border in the plan that the optimizer leaves standing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, kept: list[Column | str], **made: Column) -> DataFrame:
    """`kept` beside the `made` columns, which are worked out once, in one row each.

    A filter on a column is pushed below the projection that makes it, with the whole expression in the column's place, and so
    on down; where expressions name one another many times, that grows without end. It stays above the generator used here.
    """
    return df.select(*kept, F.inline(F.array(F.struct(*[v.alias(k) for k, v in made.items()]))))


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over all cores, for work that is long beside the rows: a small file of many rows is read by one or two tasks."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def held(columns: list[str]) -> list[Column]:
    """The columns under names of their own, so that an operator's names clash with none of them; back() undoes it."""
    return [F.col("`" + c.replace("`", "``") + "`").alias(f"_held{i}") for i, c in enumerate(columns)]


def back(columns: list[str]) -> list[Column]:
    return [F.col(f"_held{i}").alias(c) for i, c in enumerate(columns)]
