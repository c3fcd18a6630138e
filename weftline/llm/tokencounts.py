"""Token counts through a digest cache.

The digest of the normalised content and the digest of the tokenizer file are looked up in a stored table of counts.
Of the contents without a count one row each is encoded, and the new counts are appended to the table.

Null texts count as empty.  Any tables, empty ones too, repeated rows and null ids give one result row per input row.
Texts are never cut: a chunk of rows holds about 2 MB, a longer text is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.encoders import Tokenizer, encoder
from weftline.llm.tasks import chunks, filled, ship, texts_of
from weftline.runtime import materialize

CACHE_SCHEMA = "tokenizer string, content binary, n_tokens bigint"


def normalised(text: Column, tokenizer: Tokenizer) -> Column:
    """Content that decides the count: runs of ASCII white space are one space where the tokenizer drops white space."""
    if not tokenizer.space_free:
        return text
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version, one row per content (two runs may have stored the same one)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return spark.createDataFrame([], CACHE_SCHEMA)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("tokenizer") == version)
    return stored.groupBy("tokenizer", "content").agg(F.max("n_tokens").alias("n_tokens"))


def _counted(tokenizer: Tokenizer, version: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        for chunk in chunks(batches, "_text"):
            n = tool.count(texts_of(chunk, "_text"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * len(n)), chunk.column("content"), pa.array(n, pa.int64())],
                names=["tokenizer", "content", "n_tokens"],
            )

    return count


def count_tokens(docs: DataFrame, tokenizer: Tokenizer, cache: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens) for every row of ``docs``; new counts are appended to the table at ``cache``.

    Only digests are grouped.  Texts move once, for the contents that the cache lacks, to meet their digest.
    """
    spark = ship(docs.sparkSession)
    version = tokenizer.version()
    rows = filled(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text").withColumn(
        "content", F.unhex(F.sha2(normalised(F.col("_text"), tokenizer).cast("binary"), 256))
    )
    digests = materialize(rows.select("_key", "content", F.octet_length("_text").cast("bigint").alias("n_bytes")), "digests")
    stored = read_cache(spark, cache, version)
    missing = (
        digests.groupBy("content")
        .agg(F.min("_key").alias("_first"))
        .join(stored.select("content"), "content", "left_anti")
        .withColumnRenamed("content", "_content")
    )
    one_each = rows.join(
        missing,
        (F.col("content") == F.col("_content")) & F.col("_key").eqNullSafe(F.col("_first")),
        "left_semi",
    )
    one_each.select("content", "_text").mapInArrow(_counted(tokenizer, version), CACHE_SCHEMA).write.mode("append").parquet(cache)
    counts = read_cache(spark, cache, version).select("content", "n_tokens")
    return digests.join(counts, "content").select(F.col("_key").alias(key), "n_bytes", "n_tokens")
