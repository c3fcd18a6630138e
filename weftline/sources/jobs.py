"""Job catalogues: reading, validation and versioned snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.jsontext import field_text, json_type, node_text
from weftline.functions.names import clean_names, is_blank, parse_table_list
from weftline.functions.rows import let
from weftline.operators.graph import assert_unique_names
from weftline.operators.ordered import ranked
from weftline.runtime import delete_path, materialize, read_pointer, write_pointer, write_table
from weftline.sources import blocks

BOM = "﻿"


def _tables(element: Column, name: str, alternative: str) -> Column:
    def names_of(node: Column) -> Column:
        listed = node.try_cast("array<variant>")
        return F.when(listed.isNotNull(), clean_names(F.transform(listed, node_text))).otherwise(
            parse_table_list(node_text(node))
        )

    def candidate(field: str) -> Column:
        return let(F.try_variant_get(element, f"$.{field}", "variant"), names_of)

    return let(candidate(name), lambda first: F.when(F.size(first) > 0, first).otherwise(candidate(alternative)))


def _validated(elements: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Jobs from ``root_ok, pos, element``: parsed once, written, then checked on the written table.

    A document that is not a catalogue or holds anything but objects is rejected, and so is a repeated name;
    nameless records are dropped.  ``ord`` numbers the records by the columns ``order``, else as they arrive.
    """
    e = F.col("element")
    is_record = F.coalesce(json_type(e) == "OBJECT", F.lit(False))
    problem = F.when(~F.col("root_ok"), "root").when(F.col("pos").isNotNull() & ~is_record, "element")
    order = order or []
    arrival = [] if order else [F.monotonically_increasing_id().alias("ord")]
    parsed = (
        elements.select(
            *arrival,
            *[F.col(c).alias(f"_by_{c}") for c in order],
            problem.alias("problem"),
            field_text(e, "source").alias("source"),
            field_text(e, "name").alias("name"),
            field_text(e, "description").alias("description"),
            field_text(e, "sql").alias("sql"),
            _tables(e, "inputTables", "inputtables").alias("input_tables"),
            _tables(e, "outputTables", "outputtables").alias("output_tables"),
        )
    )
    places = [f"_by_{c}" for c in order]
    # the order is that of (file, position); the ranked rows are written
    parsed = ranked(parsed, [F.col(c) for c in places], "ord").drop(*places) if order else materialize(parsed, "catalogue")
    found = parsed.where("problem is not null").select("problem").first()
    if found:
        raise ValueError(
            "a catalogue must be a JSON array or an object with a records array"
            if found["problem"] == "root"
            else "every catalogue record must be a JSON object"
        )
    named = parsed.drop("problem").where(~is_blank(F.col("name")))
    fields = ["ord", "source", "name", "description", "sql", "input_tables", "output_tables"]
    return assert_unique_names(named.select(*fields))


# A catalogue object that holds its records and nothing else.
RECORDS_HEAD = rf"""^{blocks.BOM}?\s*\{{\s*"records"\s*:\s*\["""
RECORDS_TAIL = r"\]\s*\}\s*$"


def _opened(documents: DataFrame, text: str, *kept: str) -> DataFrame:
    """(kept, root_ok, pos, element) of whole catalogue documents."""
    body = F.ltrim(F.coalesce(F.col(text), F.lit("")), F.lit(BOM))
    root = F.substring(F.regexp_replace(body, r"^\s+", ""), 1, 1)
    listed = F.when(root == "[", F.from_json(body, "array<variant>")).when(
        root == "{", F.from_json(body, "records array<variant>")["records"]
    )
    opened = documents.select(*kept, listed.alias("elements"))
    return opened.select(*kept, F.col("elements").isNotNull().alias("root_ok"), F.posexplode_outer("elements").alias("pos", "element"))


def jobs_from_documents(documents: DataFrame, text: str = "value") -> DataFrame:
    """Validated jobs of catalogue documents: each an array, or an object with a ``records`` array."""
    return _validated(_opened(documents, text))


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue from JSON documents (one file is one document), each read by many tasks.

    Arrays, and objects with ``records`` alone, are cut into groups of records; objects with other keys are read whole.
    Records are numbered by file and position.
    """
    arrays, others = blocks.array_groups(spark, path)
    found = blocks.array_elements(arrays)
    if not others.isEmpty():
        wrapped, rest = blocks.array_groups(spark, path, RECORDS_HEAD, RECORDS_TAIL, 2, only=False)
        found = found.unionByName(blocks.array_elements(wrapped))
        left = others.join(rest, "file", "left_semi")
        if not left.isEmpty():
            whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
            opened = _opened(whole.join(left, "file", "left_semi"), "value", "file")
            found = found.unionByName(opened.withColumn("group", F.lit(0).cast("bigint")))
    return _validated(found, ["file", "group", "pos"])


def read_jobs_lines(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue from JSON lines, one record per line, numbered by file and position."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"), "value"
    )
    lines = lines.where("trim(value) <> ''")
    records = lines.select("file", "start", "line", F.lit(True).alias("root_ok"), F.lit(0).alias("pos"), F.try_parse_json("value").alias("element"))
    return _validated(records, ["file", "start", "line"])


def replace_snapshot(jobs: DataFrame, root: str) -> DataFrame:
    """Write a validated catalogue as a new version and point ``root`` at it; a bad one leaves the old in place."""
    spark = jobs.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    written = write_table(jobs, f"{root}/{version}")
    try:
        assert_unique_names(written)
    except ValueError:
        delete_path(spark, f"{root}/{version}")
        raise
    write_pointer(spark, root, version)
    return written


def current_snapshot(spark: SparkSession, root: str) -> DataFrame:
    version = read_pointer(spark, root)
    if version is None:
        raise ValueError("no snapshot has been written there")
    return spark.read.parquet(f"{root}/{version}")
