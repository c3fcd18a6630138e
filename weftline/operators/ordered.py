"""Ordered computations that stay parallel when one key holds a large share of the rows.

A window partitioned by the key alone puts a hot key into one task.  Here the rows are range-sorted by key and order
and written with the number of their partition, so every key lies in neighbouring partitions.  The window runs per
(partition, key), and one small row per partition carries the state of its last key over to the next partitions.
There is one plan for all keys: no threshold, no sample of keys, nothing that depends on the size of a key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.runtime import materialize

_PART = "_part"


@dataclass(frozen=True)
class Running:
    """A running value over the rows of a key.

    ``previous``: value of the row before.  ``last``: last non-null value before the row.
    ``count``: rows up to and including the row.  ``sum`` / ``max``: up to and including the row.
    ``max_before`` / ``sum_before``: rows strictly before.
    """

    kind: str
    value: Column | None = None


def _local(spec: Running, window) -> Column:
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    if spec.kind == "previous":
        return F.lag(F.struct(spec.value.alias("v"))).over(window)
    if spec.kind == "last":
        return F.last(spec.value, ignorenulls=True).over(before)
    if spec.kind == "count":
        return F.count(F.lit(1)).over(upto)
    if spec.kind == "sum":
        return F.sum(spec.value).over(upto)
    if spec.kind == "max":
        return F.max(spec.value).over(upto)
    if spec.kind == "sum_before":
        return F.sum(spec.value).over(before)
    if spec.kind == "max_before":
        return F.max(spec.value).over(before)
    raise ValueError(spec.kind)


def _total(spec: Running, order: Column) -> Column:
    """State after all rows of a key in one partition."""
    if spec.kind == "previous":
        return F.max_by(F.struct(spec.value.alias("v")), order)
    if spec.kind == "last":
        return F.max_by(spec.value, F.when(spec.value.isNotNull(), order))
    if spec.kind == "count":
        return F.count(F.lit(1))
    if spec.kind in ("sum", "sum_before"):
        return F.sum(spec.value)
    return F.max(spec.value)


def _upto(spec: Running, total: Column, window) -> Column:
    """State of a key after all its partitions up to this one."""
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if spec.kind == "previous":
        return total
    if spec.kind == "last":
        return F.last(total, ignorenulls=True).over(upto)
    if spec.kind in ("count", "sum", "sum_before"):
        return F.sum(total).over(upto)
    return F.max(total).over(upto)


def _merged(spec: Running, local: Column, carry: Column) -> Column:
    if spec.kind in ("previous", "last"):
        return F.coalesce(local, carry)
    if spec.kind in ("count", "sum", "sum_before"):
        return F.when(local.isNull() & carry.isNull(), F.lit(None)).otherwise(
            F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
        )
    return F.greatest(local, carry)


def range_sorted(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` written in a global order, with its partition in ``_part`` and the place in it in ``_place``."""
    return materialize(
        df.orderBy(*order).select(
            "*",
            F.spark_partition_id().alias(_PART),
            F.expr("monotonically_increasing_id() & 8589934591").alias("_place"),
        ),
        "sorted",
    )


def _numbered(placed: DataFrame, name: str) -> DataFrame:
    """Global 0-based position of sorted rows; the start of each partition is a sum over one row per partition."""
    starts = (
        placed.groupBy(_PART)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            F.col(_PART).alias("_p"),
            F.coalesce(
                F.sum("_n").over(Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("_start"),
        )
    )
    return (
        placed.join(F.broadcast(starts), F.col(_PART) == F.col("_p"))
        .withColumn(name, F.col("_start") + F.col("_place"))
        .drop("_p", "_start")
    )


def running(
    df: DataFrame, keys: list[str], order: list[str], specs: dict[str, Running], position: str | None = None
) -> DataFrame:
    """Add the running values ``specs`` per ``keys`` in ascending ``order`` (which must be unique per key).

    Null keys are a key of their own.  The rows move twice: into the global order, and to their (partition, key).
    ``position`` adds the place in the global order, one more from row to row of a key, which the values may use.
    """
    values = {f"_v_{name}": spec.value for name, spec in specs.items() if spec.value is not None}
    by = [F.col(c) for c in [*keys, *order]]
    if position is None:
        placed = range_sorted(df.withColumns(values) if values else df, by).drop("_place")
    else:
        placed = _numbered(range_sorted(df, by), position).drop("_place").withColumns(values)
    own = {name: Running(spec.kind, None if spec.value is None else F.col(f"_v_{name}")) for name, spec in specs.items()}

    window = Window.partitionBy(_PART, *keys).orderBy(*order)
    local = placed.withColumns({name: _local(spec, window) for name, spec in own.items()})

    key = F.struct(*keys)
    edges = placed.groupBy(_PART).agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    totals = (
        placed.join(F.broadcast(edges), _PART)  # one row per partition
        .where(key == F.col("_last"))
        .groupBy(_PART, "_first", "_last")
        .agg(*[_total(spec, F.struct(*order)).alias(f"_t_{name}") for name, spec in own.items()])
    )
    along = Window.partitionBy("_last").orderBy(_PART)
    state = F.struct("_last", *[_upto(spec, F.col(f"_t_{name}"), along).alias(f"_k_{name}") for name, spec in own.items()])
    carried = (
        totals.select(_PART, "_first", state.alias("_state"))
        .select(F.col(_PART).alias("_to"), "_first", F.lag("_state").over(Window.orderBy(_PART)).alias("_before"))
        .where(F.col("_before._last") == F.col("_first"))
        .select("_to", "_first", *[F.col(f"_before._k_{name}").alias(f"_k_{name}") for name in own])
    )
    joined = local.join(F.broadcast(carried), (F.col(_PART) == F.col("_to")) & (key == F.col("_first")), "left")
    out = joined.withColumns({name: _merged(spec, F.col(name), F.col(f"_k_{name}")) for name, spec in own.items()}).drop(
        _PART, "_to", "_first", *values, *[f"_k_{name}" for name in own]
    )
    return _unwrap(out, specs)


def _unwrap(df: DataFrame, specs: dict[str, Running]) -> DataFrame:
    wrapped = [name for name, spec in specs.items() if spec.kind == "previous"]
    return df.withColumns({name: F.col(f"{name}.v") for name in wrapped}) if wrapped else df


def ranked(df: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """Global 0-based position in ``order`` without a single-task window.

    The rows are range-sorted and written once with their partition and place in it; the start of each
    partition is a sum over one row per partition.
    """
    return _numbered(range_sorted(df, order), name).drop(_PART, "_place")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Rows of one page, the page number clamped to the existing pages, with totals on every row.

    The page is cut out of the global position, so no task holds all rows before it.
    """
    if size < 1:
        raise ValueError("page size must be at least 1")
    total = df.count()
    pages = -(-total // size)
    number = max(1, number)
    if pages:
        number = min(number, pages)
    first = (number - 1) * size
    rows = ranked(df, order, "_pos").where(F.col("_pos").between(first, first + size - 1)).drop("_pos")
    return rows.select(
        "*",
        F.lit(number).cast("bigint").alias("page"),
        F.lit(pages).cast("bigint").alias("total_pages"),
        F.lit(total).cast("bigint").alias("total_rows"),
    )
