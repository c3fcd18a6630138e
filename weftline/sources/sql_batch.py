"""Batches of SQL texts from JSON arrays or delimited files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.jsontext import field_text, json_type, node_text
from weftline.functions.names import is_blank, strip
from weftline.operators.ordered import ranked
from weftline.runtime import materialize
from weftline.sources import blocks

DELIMITER = r"(?m)^\s*--\s*@SQL\s*$"  # fixed value


# why a batch is refused
PROBLEMS = {
    "array": "a JSON batch must be a non-empty array",
    "text": "no SQL found in the batch",
    "item": "every batch item must be a string or an object with a non-blank sql",
}


def parse_sql_batch(documents: DataFrame, text: str = "value") -> DataFrame:
    """(ord, sql_id, sql, source, file_name, metadata) of batch documents.

    A document that starts with ``[`` is a JSON array of strings or objects, any other is cut at ``-- @SQL`` lines.
    The documents are parsed once and written; the checks run on the written table.
    """
    body = strip(F.coalesce(F.col(text), F.lit("")))
    texts = F.filter(F.transform(F.split("body", DELIMITER), strip), lambda b: b != "")
    as_items = F.when(
        F.col("is_json"),
        F.transform(
            F.from_json("body", "array<variant>"),
            lambda e: F.struct(F.lit(None).cast("string").alias("plain"), e.alias("e")),
        ),
    ).otherwise(
        F.transform(texts, lambda b: F.struct(b.alias("plain"), F.lit(None).cast("variant").alias("e")))
    )
    docs = documents.select(body.alias("body"), body.startswith("[").alias("is_json")).select(
        "is_json", as_items.alias("items")
    )
    items = docs.select("is_json", F.posexplode_outer("items").alias("pos", "item")).select(
        "is_json", "pos", "item.plain", "item.e"
    )
    return _accepted(_statements(items).withColumn("ord", F.monotonically_increasing_id()))


def _statements(items: DataFrame, *kept: str) -> DataFrame:
    """(kept, sql_id, sql, source, file_name, metadata, problem) of the items (is_json, pos, plain, e)."""
    element = F.col("e")
    shape = json_type(element)
    number = F.format_string("sql-%04d", F.col("pos") + 1)

    def field(name: str, default: Column) -> Column:
        value = strip(field_text(element, name))
        return F.when(F.coalesce(value, F.lit("")) == "", default).otherwise(value)

    sql = (
        F.when(~F.col("is_json"), F.col("plain"))
        .when(shape == "STRING", node_text(element))
        .when(shape == "OBJECT", field("sql", F.lit("")))
    )
    return items.select(
        *kept,
        F.when(F.col("is_json") & (shape == "OBJECT"), field("sqlId", number)).otherwise(number).alias("sql_id"),
        sql.alias("sql"),
        F.when(shape == "OBJECT", field("source", F.lit(""))).alias("source"),
        F.when(shape == "OBJECT", field("fileName", F.lit(""))).alias("file_name"),
        F.transform_values(
            F.try_variant_get(element, "$.metadata", "variant").try_cast("map<string,variant>"),
            lambda k, v: node_text(v),
        ).alias("metadata"),
        F.when(F.col("pos").isNull(), F.when(F.col("is_json"), "array").otherwise("text")).alias("problem"),
    ).withColumn("problem", F.coalesce("problem", F.when(is_blank(F.col("sql")), "item")))


def _accepted(statements: DataFrame) -> DataFrame:
    """The statements, written and checked on the written table."""
    parsed = materialize(statements, "batch")
    found = parsed.where("problem is not null").select("problem").first()
    if found:
        raise ValueError(PROBLEMS[found["problem"]])
    return parsed.select("ord", "sql_id", "sql", "source", "file_name", "metadata")


def read_sql_batch(spark: SparkSession, path: str) -> DataFrame:
    """The batch documents at ``path``, each read by many tasks; statements are numbered by file and position."""
    arrays, others = blocks.array_groups(spark, path)
    elements = blocks.array_elements(arrays).select(
        "file", "group", F.coalesce("pos", F.lit(0)).alias("at"), "root_ok", F.col("pos").isNotNull().alias("held"), F.lit(True).alias("is_json"),
        F.lit(None).cast("string").alias("plain"), F.col("element").alias("e"),
    )
    found = elements
    if not others.isEmpty():
        texts = blocks.line_blocks(spark, path, DELIMITER).join(others, "file", "left_semi")
        texts = texts.select("file", F.col("block").alias("group"), F.lit(0).alias("at"), F.lit(True).alias("root_ok"), strip(F.regexp_replace("text", f"^{blocks.BOM}", "")).alias("plain"))
        # a file without a block keeps one row that says so
        kept = texts.where("plain <> ''").withColumn("held", F.lit(True))
        none = others.join(kept, "file", "left_anti").select("file", F.lit(0).cast("bigint").alias("group"), F.lit(0).alias("at"), F.lit(False).alias("root_ok"), F.lit(None).cast("string").alias("plain"), F.lit(False).alias("held"))
        blocks_of = kept.unionByName(none).withColumns({"is_json": F.lit(False), "e": F.lit(None).cast("variant")})
        found = found.unionByName(blocks_of)
    placed = ranked(found, [F.col("file"), F.col("group"), F.col("at")], "ord")
    first = materialize(placed.groupBy("file").agg(F.min("ord").alias("first")), "batch-files")
    numbered = placed.join(first, "file").withColumn("pos", F.when(F.col("held"), (F.col("ord") - F.col("first")).cast("int")))
    return _accepted(_statements(numbered, "ord"))
