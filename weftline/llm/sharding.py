"""Random shards through a two-pass external shuffle.

Pass one scatters the records uniformly over buckets that fit a task's memory, by a seeded hash of id and text, and
counts them.  Pass two gathers one bucket per task, puts it into an order that does not depend on the cluster, runs a
Fisher-Yates shuffle seeded by the bucket's number, and writes it.  Shards are equal ranges of the shuffled order, so
their row counts differ by at most one ("rows"); a bucket writes into one shard or a few neighbouring ones.

The hash sees the id, so copies of one text are spread like other rows.  Rows that repeat id and text are numbered, by
a range sort that splits hot groups, and hashed with their number, so that they are spread as well; which of them gets
which number is open.  Null ids and texts hash as such.  The caller's row travels as one struct, so its columns may
have any names; one that is named like a result column gets the suffix ``_given``.  An empty table has no shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.tasks import ship
from weftline.operators.ordered import Running, running
from weftline.runtime import materialize, scratch_path

BUCKET_BYTES = 48 << 20  # text bytes that one task shuffles in memory
ROW_BYTES = 16           # bytes of a record besides its text


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A uniform permutation: element i changes places with one of the elements 0 to i."""
    order = list(range(n))
    partner = np.floor(np.random.default_rng(seed).random(n) * np.arange(1, n + 1)).astype(np.int64).tolist()
    for i in range(n - 1, 0, -1):
        j = partner[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def _shuffled(seed: int):
    def shuffle(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table.select(["doc"]).append_column("pos", pa.array([], pa.int64()))
        bucket, first = table.column("bucket")[0].as_py(), table.column("first")[0].as_py()
        # the arrival order depends on the cluster; hash and checksum fix it up to identical rows
        table = table.take(pc.sort_indices(table, [("hash", "ascending"), ("sum", "ascending")]))
        position = pa.array(first + np.arange(table.num_rows))
        return table.select(["doc"]).take(pa.array(fisher_yates(table.num_rows, [seed, bucket]))).append_column("pos", position)

    return shuffle


def _numbered(docs: DataFrame, hashed: Column) -> DataFrame:
    """(doc, hash): the hash takes in the number of the row among those that repeat its id and text."""
    rows = docs.select(F.struct("*").alias("doc"), hashed.alias("hash"))
    repeats = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    repeats = materialize(repeats, "shard-repeats")
    if repeats.isEmpty():
        return rows
    again = rows.join(repeats, "hash", "left_semi").withColumn("arrival", F.monotonically_increasing_id())
    counted = running(materialize(again, "shard-repeated"), ["hash"], ["arrival"], {"nth": Running("count")})
    counted = counted.select("doc", F.when(F.col("nth") == 1, F.col("hash")).otherwise(F.xxhash64("hash", "nth")).alias("hash"))
    return rows.join(repeats, "hash", "left_anti").select("doc", "hash").unionByName(counted)


def shard_rows(
    docs: DataFrame, shards: int, seed: int = 0, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """The rows of ``docs`` as written shard files, with _size (long), _shard (int) and _slot (long).

    _slot counts from 0 without gaps within a shard, in the shuffled order.
    """
    spark = ship(docs.sparkSession)
    added = {"_size", "_shard", "_slot"}
    docs = docs.withColumnsRenamed({c: f"{c}_given" for c in docs.columns if c in added})
    content = F.col("doc")[text]
    size = (F.coalesce(F.octet_length(content), F.lit(0)) + ROW_BYTES).cast("bigint")
    total, rows = docs.agg(
        F.sum((F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + ROW_BYTES).cast("bigint")), F.count(F.lit(1))
    ).first()
    buckets = max(1, -(-(total or 0) // bucket_bytes))
    scattered = _numbered(docs, F.xxhash64(F.lit(seed), F.col(key), F.col(text)))
    scattered = scattered.select("doc", "hash", F.pmod("hash", F.lit(buckets)).alias("bucket"))
    # one row per bucket, that is one per BUCKET_BYTES of input
    counts = scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("first"))

    schema = scattered.select("doc").withColumn("pos", F.lit(0).cast("bigint")).schema
    shuffled = (
        scattered.withColumn("sum", F.crc32(content.cast("binary")))
        .join(starts, "bucket")
        .groupBy("bucket")
        .applyInArrow(_shuffled(seed), schema)
    )
    # the first `extra` shards hold one row more
    base, extra = divmod(rows, shards)
    wide = extra * (base + 1)
    position = F.col("pos")
    if base:
        later = F.lit(extra) + F.floor((position - wide) / F.lit(base))
        later_slot = F.pmod(position - wide, F.lit(base))
    else:
        later, later_slot = F.lit(extra), F.lit(0)
    placed = shuffled.select(
        "doc.*",
        size.alias("_size"),
        F.when(position < wide, F.floor(position / F.lit(base + 1))).otherwise(later).cast("int").alias("_shard"),
        F.when(position < wide, F.pmod(position, F.lit(base + 1))).otherwise(later_slot).cast("bigint").alias("_slot"),
    )
    path = scratch_path(spark, "shards")
    placed.write.partitionBy("_shard").parquet(path)
    return spark.read.schema(placed.schema).parquet(path)
