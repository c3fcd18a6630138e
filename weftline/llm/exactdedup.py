"""Exact deduplication as a stream with disk-backed keyed state that never expires.

The rows' digests flow through a streaming aggregation whose state lives in RocksDB and is checkpointed to the shared
folder.  Per digest the state retains the digest, the stable identifier (the largest id seen) with the locator of its
content, and the number of rows.  Every later row of a digest is a hit: its full bytes are compared with the content
at the retained locator.  Contents that share a digest without being equal are told apart by their bytes.

Null texts count as empty.  Rows with a null id stay behind all others; rows that agree in id and text are one
retained row and its copies: the one with the greatest locator stays.  Extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.tasks import filled
from weftline.runtime import materialize, scratch_path, write_table

BATCH_BYTES = 256 << 20  # digest bytes that one micro-batch takes in
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def stream_state(spark: SparkSession, digests: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(digest, keep struct<id, locator>, n): the state after all micro-batches over the table at ``digests``."""
    root = scratch_path(spark, "dedup-stream")
    changes = f"{root}/changes"
    schema = spark.read.parquet(digests).schema
    rows = spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(digests)
    state = rows.groupBy("digest").agg(
        F.max(F.struct("_id", "_locator")).alias("keep"), F.count(F.lit(1)).alias("n")
    )

    def emit(batch: DataFrame, number: int) -> None:
        # the same batch may run twice after a failure: it then replaces its own folder
        batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")

    settings = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        # files of a store are not laid out in advance: megabytes for each of many small stores
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        query = (
            state.writeStream.outputMode("update")
            .foreachBatch(emit)
            .option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    changed = state_schema(schema)
    if spark.read.schema(schema).parquet(digests).isEmpty():
        return spark.createDataFrame([], changed)
    seen = spark.read.schema(f"{changed}, batch bigint").parquet(changes)
    latest = seen.groupBy("digest").agg(F.max_by(F.struct("keep", "n"), "batch").alias("s"))
    return latest.select("digest", "s.keep", "s.n")


def state_schema(schema) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
    return f"digest string, keep struct<_id:{kinds['_id']},_locator:{kinds['_locator']}>, n bigint"


def deduplicate(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    digest: Callable[[Column], Column] = sha256,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """(_id, _locator, digest, keep struct<id, locator>, n, kept) for every row of ``docs``, in the order of nothing.

    ``digest`` is a parameter for tests: with a weak one, equality still is that of the full bytes.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "dedup-digests")
    # the locator names a row of this written table; the length rides along, so that a hit of another length is no hit
    slim = write_table(
        filled(docs, text).select(
            F.col(key).alias("_id"),
            F.xxhash64(F.col(key), F.col(text)).alias("_content"),
            F.concat_ws(":", digest(F.col(text)), F.octet_length(text)).alias("digest"),
            F.monotonically_increasing_id().alias("_locator"),
        ),
        path,
    )
    state = materialize(stream_state(spark, path, batch_bytes), "dedup-state")
    grouped = slim.join(state.where("n > 1"), "digest", "left").select(
        "_id", "_content", "_locator", "digest", F.coalesce("keep", F.struct("_id", "_locator")).alias("keep"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("n"),
    )
    different = _collided(docs, key, text, digest, state)
    if different.isEmpty():
        return grouped.select("*", (F.col("keep._locator") == F.col("_locator")).alias("kept")).drop("_content")
    return _by_bytes(docs, slim, grouped, different, key, text, digest)


def _collided(docs: DataFrame, key: str, text: str, digest, state: DataFrame) -> DataFrame:
    """Digests of which some row's bytes differ from the bytes of the retained row."""
    repeated = state.where("n > 1").select("digest", F.col("keep._id").alias("_keep_id"))
    rows = filled(docs, text).select(
        F.col(key).alias("_id"),
        F.concat_ws(":", digest(F.col(text)), F.octet_length(text)).alias("digest"),
        F.col(text).alias("_text"),
    )
    hits = materialize(rows.join(repeated, "digest"), "dedup-hits")
    retained = (
        hits.where(F.col("_id").eqNullSafe(F.col("_keep_id")))
        .groupBy("digest")
        .agg(F.min("_text").alias("_kept_text"))
    )
    return (
        hits.join(materialize(retained, "dedup-retained"), "digest")  # written, so that a hot digest is split
        .where(F.col("_text") != F.col("_kept_text"))
        .select("digest")
        .distinct()
    )


def _by_bytes(docs, slim, grouped, different, key, text, digest) -> DataFrame:
    """The result where some digest has several contents: those digests are grouped by the bytes themselves."""
    clash = materialize(different, "dedup-clash")
    names = filled(docs, text).select(
        F.xxhash64(F.col(key), F.col(text)).alias("_content"),
        F.concat_ws(":", digest(F.col(text)), F.octet_length(text)).alias("digest"),
        F.col(text).alias("_text"),
    )
    texts = names.join(clash, "digest", "left_semi").distinct()
    rows = slim.join(clash, "digest", "left_semi").join(texts, ["digest", "_content"])
    sets = rows.groupBy("digest", "_text").agg(
        F.max(F.struct("_id", "_locator")).alias("keep"), F.count(F.lit(1)).alias("n")
    )
    exact = rows.join(sets, ["digest", "_text"]).select("_id", "_locator", "digest", "keep", "n")
    clean = grouped.join(clash, "digest", "left_anti").select("_id", "_locator", "digest", "keep", "n")
    return clean.unionByName(exact).select("*", (F.col("keep._locator") == F.col("_locator")).alias("kept"))


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The rows of ``docs`` without copies: of equal texts the row with the largest id stays, once.

    The caller's row rides along as one struct, so its columns may have any names.
    """
    found = deduplicate(docs, key, text, batch_bytes=batch_bytes).where("kept").select("_id", "digest")
    digest = F.concat_ws(":", sha256(filled_text(text)), F.octet_length(filled_text(text)))
    keyed = docs.select(F.struct("*").alias("_doc"), F.col(key).alias("_key"), digest.alias("_digest"))
    stay = materialize(found.select(F.col("_id").alias("_stays"), F.col("digest").alias("_equal")), "dedup-stay")
    same = (F.col("_digest") == F.col("_equal")) & F.col("_key").eqNullSafe(F.col("_stays"))
    left = keyed.join(stay, same, "left_semi")
    # ids are unique as a rule; rows that repeat an id and its text are thinned out on their own
    twice = stay.join(
        materialize(docs.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "dedup-ids"),
        F.col("_stays").eqNullSafe(F.col("_k")),
        "left_semi",
    )
    several = materialize(twice, "dedup-twice")
    if several.isEmpty():
        return left.select("_doc.*")
    once = left.join(several, same, "left_semi").dropDuplicates(["_digest"])
    return left.join(several, same, "left_anti").unionByName(once).select("_doc.*")


def filled_text(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))
