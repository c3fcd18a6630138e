"""Small helpers that keep an expensive expression from being computed more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def keep(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet a condition on computed columns.

    A plain filter is pushed below the projections that compute those columns, with their expressions copied
    into it; this form tests the computed values.
    """
    marked = df.select("*", F.explode_outer(F.when(condition, F.array(F.lit(True)))).alias("_kept"))
    return marked.where(F.col("_kept").isNotNull()).drop("_kept")


def unfold(df: DataFrame, keep: list, values: Column | str, name: str, position: str | None = None) -> DataFrame:
    """Explode a computed array without null elements.

    A plain explode lets the optimizer push a size filter on the array below it, which computes the array
    twice; the outer form followed by a null test does not.
    """
    rows = F.explode_outer(values).alias(name) if position is None else F.posexplode_outer(values).alias(position, name)
    return df.select(*keep, rows).where(F.col(name).isNotNull())


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over the cores, for rows of few bytes that make much work: a task or two would read them all."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)
