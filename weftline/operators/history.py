"""Bounded, deduplicated histories: ``key, id, created_ms, type, text, file_paths, image_path, hash, pinned``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import content_hash
from weftline.operators.ordered import Running, running

DEFAULT_KEPT = 200
LARGEST_KEPT = 10_000
DEFAULT_TTL_MS = 60 * 60 * 1000


def with_hash(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("hash", content_hash(F.col(text)))


def fingerprint() -> Column:
    return F.concat_ws(":", "type", "hash")


def drop_consecutive(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Drop a row whose type and hash equal those of the row before it; rows without a hash are dropped first.

    Equal neighbours chain, so the row before is as good as the last kept row.
    """
    rows = df.where("hash is not null").withColumn("_print", fingerprint())
    seen = running(rows, [key], order, {"_before": Running("previous", F.col("_print"))})
    return seen.where(~F.col("_print").eqNullSafe(F.col("_before"))).drop("_print", "_before")


def drop_paused(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Drop items between a pause and the next resume; ``event`` is item, suppress, pause or resume."""
    switch = F.when(F.col("event").isin("pause", "resume"), F.col("event"))
    seen = running(df, [key], order, {"_switch": Running("last", switch)})
    return seen.where(
        ~F.col("event").isin("pause", "resume")
        & ~((F.col("event") == "item") & F.coalesce(F.col("_switch") == "pause", F.lit(False)))
    ).drop("_switch")


def suppress_marked(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Items that stay after marker suppression and consecutive-duplicate suppression.

    A ``suppress`` event names a hash; it drops the next item if that has the hash and expires on any other.
    """
    rows = df.where("event in ('item', 'suppress') and (event = 'suppress' or hash is not null)")
    item_print = F.when(F.col("event") == "item", fingerprint())
    marker = F.when(F.col("event") == "suppress", F.col("hash"))
    seen = running(
        rows,
        [key],
        order,
        {"_marker": Running("previous", marker), "_print": Running("last", item_print)},
    )
    return seen.where(
        (F.col("event") == "item")
        & ~F.coalesce(F.col("_marker") == F.col("hash"), F.lit(False))
        & ~fingerprint().eqNullSafe(F.col("_print"))
    ).drop("_marker", "_print")


def _pinned() -> Column:
    return F.coalesce("pinned", F.lit(False))


def _newest(df: DataFrame, key: str, kept: int) -> DataFrame:
    """Newest unpinned rows per key.  The rank limit is pushed below the exchange (window group limit)."""
    if not 1 <= kept <= LARGEST_KEPT:
        raise ValueError(f"kept must be between 1 and {LARGEST_KEPT}")
    newest = Window.partitionBy(key).orderBy(F.col("created_ms").desc(), F.col("id").desc())
    return df.where(~_pinned()).withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= kept)


def retain(df: DataFrame, key: str, kept: int = DEFAULT_KEPT) -> DataFrame:
    """Pinned rows and the newest ``kept`` unpinned rows per key."""
    return df.where(_pinned()).unionByName(_newest(df, key, kept).drop("_rank"))


def evicted(df: DataFrame, key: str, kept: int = DEFAULT_KEPT) -> DataFrame:
    """The complement of ``retain``: unpinned rows older than the last kept row of a full key.

    One small row per full key is joined back, so a hot key is filtered where it lies, not sorted.
    """
    oldest_kept = (
        _newest(df, key, kept)
        .where(F.col("_rank") == kept)
        .select(F.col(key).alias("_key"), F.struct("created_ms", "id").alias("_oldest"))
    )
    return (
        df.where(~_pinned())
        .join(oldest_kept, F.col(key).eqNullSafe(F.col("_key")) & (F.struct("created_ms", "id") < F.col("_oldest")))
        .drop("_key", "_oldest")
    )


def history_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("pinned").desc(), F.col("created_ms").desc(), F.col("id").desc())


def search_history(df: DataFrame, query: str = "", only: str | None = None) -> DataFrame:
    """Rows of one type (or ``PINNED``) that contain the query in type, text, a path or the image path."""
    rows = df
    if only == "PINNED":
        rows = rows.where("pinned")
    elif only:
        rows = rows.where(F.col("type") == only)
    word = (query or "").strip().lower()
    if not word:
        return rows

    def holds(value: Column) -> Column:
        return F.coalesce(F.contains(F.lower(value), F.lit(word)), F.lit(False))

    paths = F.coalesce("file_paths", F.array().cast("array<string>"))
    return rows.where(
        holds(F.col("type")) | holds(F.col("text")) | F.exists(paths, holds) | holds(F.col("image_path"))
    )


def assign_ids(df: DataFrame, key: str, order: list[str], moment: str = "created_ms") -> DataFrame:
    """Strictly increasing ids: max(last id + 1, moment), in closed form over the rows of a key.

    Less its place, an id is the greatest (moment less place) so far; the place may count from anywhere, so the
    position in the global order serves and one sort is enough.  ``streaming.keyed.assign_ids`` goes on over batches.
    """
    lead = F.col(moment) - F.col("_row")
    highest = running(df, [key], order, {"_high": Running("max", lead)}, position="_row")
    return highest.withColumn("assigned_id", F.col("_row") + F.col("_high")).drop("_row", "_high")


def expire(df: DataFrame, now_ms: int | Column, ttl_ms: int = DEFAULT_TTL_MS) -> DataFrame:
    """Rows at most ``ttl_ms`` old; works on batch and streaming frames."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    return df.where(now - F.col("created_ms") <= ttl_ms)
