"""Histories as streams whose state per key is a written table.

A micro-batch runs the batch operators over its rows and the state rows of its own keys, so a key with a third of
all rows is spread as it is there.  What a batch emits goes to ``folder/out/batch=N``, what it changes in the state to
``folder/state``; both are overwritten when the batch is repeated after a failure, and a batch reads only what earlier
ones wrote.  A stopped stream that starts again on the same folder therefore goes on with the same state.

The rows of a batch count as later than those of all batches before; within a batch the given order holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from weftline.operators import history
from weftline.runtime import delete_path, list_folder, materialize, scratch

COMPACT_EVERY = 16

_TURN = "_turn"  # 0: a row of the state, 1: a row of the batch
_SIGN = "_sign"


class StateLog:
    """Live rows as signed changes per batch over a base.

    ``changes/batch=N`` holds the rows that batch N added (1) or removed (-1), so a batch writes what it changed and
    not the whole state.  Every ``compact_every`` batches ``base/batch=N`` takes all live rows, and what no repeated
    batch can ask for is deleted.  Equal rows are counted, null keys are a key of their own.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, compact_every: int = COMPACT_EVERY):
        self.spark, self.folder, self.schema, self.compact_every = spark, folder, schema, compact_every
        self._signed = StructType([*schema.fields, StructField(_SIGN, LongType())])

    def _batches(self, part: str) -> list[int]:
        return sorted(int(name.removeprefix("batch=")) for name in list_folder(self.spark, f"{self.folder}/{part}"))

    def live(self, before: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """Live rows after all batches below ``before`` (of all without it), of the given keys only."""
        bases = [n for n in self._batches("base") if before is None or n < before]
        base = bases[-1] if bases else -1
        changes = [n for n in self._batches("changes") if n > base and (before is None or n < before)]
        rows = self.spark.createDataFrame([], self._signed)
        if bases:
            kept = self.spark.read.schema(self.schema).parquet(f"{self.folder}/base/batch={base}")
            rows = rows.unionByName(kept.withColumn(_SIGN, F.lit(1).cast("bigint")))
        if changes:
            paths = [f"{self.folder}/changes/batch={n}" for n in changes]
            rows = rows.unionByName(self.spark.read.schema(self._signed).parquet(*paths))
        if keys is not None:
            (key,) = keys.columns
            asked = keys.select(F.col(key).alias("_asked")).distinct()
            rows = rows.join(asked, F.col(key).eqNullSafe(F.col("_asked")), "left_semi")
        counted = rows.groupBy(*self.schema.names).agg(F.sum(_SIGN).cast("int").alias(_SIGN)).where(F.col(_SIGN) > 0)
        copies = F.explode(F.array_repeat(F.lit(1), F.col(_SIGN)))
        return counted.withColumn(_SIGN, copies).select(*self.schema.names)

    def change(self, batch: int, added: DataFrame, removed: DataFrame) -> None:
        names = self.schema.names
        signed = added.select(*names, F.lit(1).cast("bigint").alias(_SIGN)).unionByName(
            removed.select(*names, F.lit(-1).cast("bigint").alias(_SIGN))
        )
        signed.write.mode("overwrite").parquet(f"{self.folder}/changes/batch={batch}")
        if (batch + 1) % self.compact_every == 0:
            self._compact(batch)

    def _compact(self, batch: int) -> None:
        before = [n for n in self._batches("base") if n < batch]
        self.live(before=batch + 1).write.mode("overwrite").parquet(f"{self.folder}/base/batch={batch}")
        if before:  # this batch, if repeated, reads the base before and the changes since
            for part, limit in (("changes", before[-1] + 1), ("base", before[-1])):
                for n in self._batches(part):
                    if n < limit:
                        delete_path(self.spark, f"{self.folder}/{part}/batch={n}")


Step = Callable[[DataFrame, int, StateLog], DataFrame]


def _log(spark: SparkSession, folder: str, schema: StructType) -> StateLog:
    return StateLog(spark, f"{folder}/state", schema)


def _stream(rows: DataFrame, folder: str, state: StructType, step: Step, trigger: dict) -> StreamingQuery:
    """Run ``step`` per micro-batch; it changes the state and returns the rows to emit."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        with scratch(spark, "batch"):
            out = step(batch, number, _log(spark, folder, state))
            out.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    return rows.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/checkpoint").trigger(**trigger).start()


def emitted(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """All rows that the finished batches of a stream emitted."""
    batches = list_folder(spark, f"{folder}/out")
    if not batches:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/out/{name}" for name in batches])


def held(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Live state rows of a stream."""
    return _log(spark, folder, schema).live()


def _with_state(batch: DataFrame, state: DataFrame) -> DataFrame:
    """Batch and state rows in one written table; columns that the state lacks are null there."""
    new = batch.withColumn(_TURN, F.lit(1))
    return materialize(new.unionByName(state.withColumn(_TURN, F.lit(0)), allowMissingColumns=True), "both")


def _part(both: DataFrame, turn: int) -> DataFrame:
    return both.where(F.col(_TURN) == turn).drop(_TURN)


def drop_consecutive(rows: DataFrame, folder: str, key: str, order: list[str], trigger: dict) -> StreamingQuery:
    """``history.drop_consecutive`` with the last type and hash per key as state; emits the kept rows."""
    state = StructType([rows.schema[c] for c in (key, "type", "hash")])

    def step(batch: DataFrame, number: int, log: StateLog) -> DataFrame:
        hashed = batch.where("hash is not null")
        both = _with_state(hashed, log.live(number, hashed.select(key)))
        last = both.groupBy(key).agg(F.max_by(F.struct("type", "hash"), F.struct(_TURN, *order)).alias("_last"))
        log.change(number, last.select(key, "_last.type", "_last.hash"), _part(both, 0))
        return _part(history.drop_consecutive(both, key, [_TURN, *order]), 1)

    return _stream(rows, folder, state, step, trigger)


def assign_ids(rows: DataFrame, folder: str, key: str, order: list[str], moment: str, trigger: dict) -> StreamingQuery:
    """``history.assign_ids`` with the last id per key as state; emits all rows with ``assigned_id``.

    A state row takes part as the first row of its key, at the moment of the last id: it gets that id again, and the
    rows after it go on from there.
    """
    state = StructType([rows.schema[key], StructField(moment, LongType())])

    def step(batch: DataFrame, number: int, log: StateLog) -> DataFrame:
        both = _with_state(batch, log.live(number, batch.select(key)))
        numbered = materialize(history.assign_ids(both, key, [_TURN, *order], moment), "numbered")
        log.change(number, numbered.groupBy(key).agg(F.max("assigned_id").alias(moment)), _part(both, 0))
        return _part(numbered, 1)

    return _stream(rows, folder, state, step, trigger)


def evict(rows: DataFrame, folder: str, key: str, kept: int, trigger: dict) -> StreamingQuery:
    """Emit every unpinned row once, when ``kept`` newer ones of its key exist; the state is what ``history.retain`` keeps.

    (created_ms, id) is unique per key.  A task passes on at most ``kept`` rows of a key, and pinned rows only enter
    the state, so neither many rows nor many pins of one key meet.
    """
    state = StructType(list(rows.schema.fields))

    def step(batch: DataFrame, number: int, log: StateLog) -> DataFrame:
        loose = log.live(number, batch.select(key)).where(~F.coalesce("pinned", F.lit(False)))
        both = _with_state(batch, loose)
        gone = materialize(history.evicted(both, key, kept), "gone")
        log.change(number, _part(history.retain(both, key, kept), 1), _part(gone, 0))
        return gone.drop(_TURN)

    return _stream(rows, folder, state, step, trigger)


def expire(rows: DataFrame, folder: str, ttl_ms: int, trigger: dict) -> StreamingQuery:
    """Emit every row once, when it is more than ``ttl_ms`` older than the newest row of any key.

    The clock is the greatest ``created_ms`` so far, so a row expires without another row of its key.  The state is the
    rows that have not expired; the newest one is always among them and holds the clock.  Rows without a time never expire.
    """
    state = StructType(list(rows.schema.fields))

    def step(batch: DataFrame, number: int, log: StateLog) -> DataFrame:
        both = _with_state(batch, log.live(number))
        now = both.agg(F.max("created_ms").alias("now")).first()["now"]
        alive = F.coalesce(F.lit(now) - F.col("created_ms") <= ttl_ms, F.lit(True))
        log.change(number, _part(both.where(alive), 1), _part(both.where(~alive), 0))
        return both.where(~alive).drop(_TURN)

    return _stream(rows, folder, state, step, trigger)
