"""Streaming forms of the history operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.operators.history import DEFAULT_TTL_MS, expire

OUTPUT = "key bigint, id bigint, created_ms bigint, type string, hash string"
STATE = "fingerprint string"


def drop_consecutive_stream(rows: DataFrame) -> DataFrame:
    """Consecutive-duplicate suppression with the last fingerprint per key as state.

    Only narrow columns go through Python.  A key's rows in one micro-batch are sorted together, so bound the
    batch at the source (maxFilesPerTrigger, maxOffsetsPerTrigger); join the text back by id where needed.
    """

    # a local function travels to the workers by value, so they need not have this package installed
    def keep_changes(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(chunks)).sort_values(["created_ms", "id"])
        prints = batch["type"] + ":" + batch["hash"]
        before = prints.shift(1)
        before.iloc[0] = state.get[0] if state.exists else None
        state.update((prints.iloc[-1],))
        yield batch[prints.ne(before)]

    return (
        rows.where("hash is not null")
        .select("key", "id", "created_ms", "type", "hash")
        .groupBy("key")
        .applyInPandasWithState(keep_changes, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
    )


def expire_stream(rows: DataFrame, ttl_ms: int = DEFAULT_TTL_MS) -> DataFrame:
    """Drop rows older than the limit at the time their micro-batch runs."""
    return expire(rows, F.unix_millis(F.current_timestamp()), ttl_ms)
