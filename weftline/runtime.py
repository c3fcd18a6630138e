"""Session settings, lineage cutting and bounded size checks shared by the operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings every result below assumes.  Cluster sizing (executors, shuffle partitions) is left to the deployment.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even where that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # rank limits up to this size are applied per map task, before the rows of a hot key meet
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    "spark.sql.variant.allowDuplicateKeys": "true",
}

ARROW_BATCH = {  # rows handed to Python at a time, bounded by number and by bytes
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply SESSION_CONF to a running session."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per session, so that tasks can import it from any folder, and bound
    what they are handed at a time."""
    for name, value in ARROW_BATCH.items():
        spark.conf.set(name, value)
    context = spark.sparkContext
    if not getattr(context, "_weftline_shipped", False):
        root = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="weftline-package-"), "weftline.zip")
        with zipfile.ZipFile(target, "w") as archive:
            for file in sorted(root.rglob("*.py")):
                archive.write(file, str(Path(root.name) / file.relative_to(root)))
        context.addPyFile(target)
        context._weftline_shipped = True
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the session's checkpoint directory.

    A local session without one gets a fresh temporary folder; a cluster without one is refused, because
    a folder on one machine is lost with that machine.
    """
    context = spark.sparkContext
    configured = context._jsc.sc().getCheckpointDir()
    if configured.isDefined():
        return configured.get()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
    return context._jsc.sc().getCheckpointDir().get()


_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{_SCRATCH.get() or checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession, label: str) -> Iterator[None]:
    """Intermediate tables made inside go to one folder that is deleted at the end, for work that repeats without end."""
    folder = scratch_path(spark, label)
    token = _SCRATCH.set(folder)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        delete_path(spark, folder)


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` and return the written table: no lineage, exact size statistics, survives executor loss."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    return write_table(df, scratch_path(df.sparkSession, label))


def delete_path(spark: SparkSession, path: str) -> None:
    """Drop an intermediate table that no later step reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


POINTER = "CURRENT"


def _file(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none where it does not exist."""
    target, files = _file(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(target)) if files.exists(target) else []


def read_pointer(spark: SparkSession, root: str) -> str | None:
    """What the pointer file of a versioned folder says, or nothing without one."""
    target, files = _file(spark, f"{root}/{POINTER}")
    return spark.read.text(f"{root}/{POINTER}").first()["value"] if files.exists(target) else None


def write_pointer(spark: SparkSession, root: str, text: str) -> None:
    """Replace the pointer by a rename, so that a reader finds the old version or the new one, never a part."""
    fresh, fs = _file(spark, f"{root}/.{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(fresh), fs.makeQualified(_file(spark, f"{root}/{POINTER}")[0]), options)
