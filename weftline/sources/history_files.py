"""History files in JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY_SCHEMA = (
    "key bigint, id bigint, created_ms bigint, type string, text string, file_paths array<string>, "
    "image_path string, hash string, pinned boolean"
)


def load_history(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, damaged lines): one damaged record does not stop the load."""
    raw = spark.read.text(path).where("trim(value) <> ''")
    parsed = raw.select(
        "value",
        F.from_json(
            "value", HISTORY_SCHEMA + ", _damaged string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_damaged"}
        ).alias("r"),
    )
    damaged = F.col("r._damaged").isNotNull() | F.col("r.id").isNull()
    good = parsed.where(~damaged).select("r.*").drop("_damaged")
    return good, parsed.where(damaged).select(F.col("value").alias("line"))
