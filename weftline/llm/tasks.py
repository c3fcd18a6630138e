"""Helpers shared by the operators: walking Arrow batches in bounded pieces."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.runtime import ship  # noqa: F401  the operators here take it from this module

BROADCAST_ROWS = 1_000_000  # lists of ids up to this many rows are broadcast, longer ones are shuffled
CHUNK_BYTES = 2 << 20  # text bytes that one numpy pass holds at a time; a longer single text is one chunk


def filled(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with null texts read as empty."""
    return docs.withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit("")))


def small_side(df: DataFrame) -> DataFrame:
    """A written list of ids as one side of a join: broadcast where its counted size allows, else as Spark decides."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def without_rows(docs: DataFrame, dropped: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows of the written list (_drop_id, _drop_content: hash of the text).

    The caller's row rides along as one struct, so its columns may have any names.
    """
    held = docs.select(F.struct("*").alias("_doc"), F.col(key).alias("_id"), F.xxhash64(F.col(text).cast("string")).alias("_same"))
    same = (F.col("_same") == F.col("_drop_content")) & F.col("_id").eqNullSafe(F.col("_drop_id"))
    return held.join(small_side(dropped), same, "left_anti").select("_doc.*")


def release() -> None:
    """Give the memory that earlier tasks of this worker have freed back to the machine; a reused worker keeps it else."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim is not None:
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes in ``column``, and at least one row each."""
    release()
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def empty_batch(schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Flat indices of the ranges [start, start + length), one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def binary_rows(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """One binary value per row from the rows' items laid end to end (any item size)."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths * flat.dtype.itemsize, out=offsets[1:])
    if offsets[-1] >= 2**31 - 1:
        raise ValueError("a chunk of rows is larger than one Arrow buffer may be")
    return pa.Array.from_buffers(
        pa.binary(),
        len(lengths),
        [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))],
    )
