"""Data dictionaries, sheet cells and probe results.

Cells: ``file, sheet, row_no, col_no, value`` with 0-based numbers.  Header, type and comment rows are 1-based.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.names import camel_name, is_blank, kind_of, strip
from weftline.runtime import materialize

ROWS_PER_BLOCK = 10_000


def unique_names(df: DataFrame, keys: list[str], base: str, order: str, out: str = "field_name") -> DataFrame:
    """Give the n-th equal name within ``keys`` the suffix n, or the next free one where that name is taken.

    One exchange on the keys.  Only groups in which a suffixed name meets another name are walked in order, each as
    long as its sheet or table is wide.
    """

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        taken, names = set(), []
        for name in group.sort_values(order)[base]:
            free, n = name, 1
            while free in taken:
                n += 1
                free = f"{name}{n}"
            taken.add(free)
            names.append(free)
        return group.sort_values(order).assign(**{out: names})

    nth = F.row_number().over(Window.partitionBy(*keys, base).orderBy(order))
    suffixed = F.when(nth > 1, F.concat(base, nth.cast("string"))).otherwise(F.col(base))
    met = F.count(F.lit(1)).over(Window.partitionBy(*keys, out)) > 1
    marked = (
        df.repartition(*keys)
        .withColumn(out, suffixed)
        .withColumn("_met", met)
        .withColumn("_walk", F.max("_met").over(Window.partitionBy(*keys)))
    )
    marked = materialize(marked.drop("_met"), "names")
    plain, clashing = marked.where("not _walk").drop("_walk"), marked.where("_walk").drop("_walk")
    return plain.unionByName(clashing.groupBy(*keys).applyInPandas(walk, clashing.schema))


def sheet_dictionary(cells: DataFrame, header_row: int, type_row: int = 0, comment_row: int = 0) -> DataFrame:
    """Dictionary rows from the header, type and comment rows of every sheet; only those rows are read."""
    if header_row < 1:
        raise ValueError("header_row counts from 1")
    wanted = [r - 1 for r in (header_row, type_row, comment_row) if r > 0]

    def value_of(row: int) -> Column:
        if row < 1:
            return F.lit("")
        return strip(F.coalesce(F.max(F.when(F.col("row_no") == row - 1, F.col("value"))), F.lit("")))

    fields = (
        cells.where(F.col("row_no").isin(wanted))
        .groupBy("file", "sheet", "col_no")
        .agg(
            value_of(header_row).alias("source_name"),
            value_of(type_row).alias("source_type"),
            value_of(comment_row).alias("comment"),
        )
        .where("source_name <> ''")
        .withColumn("_base", camel_name(F.col("source_name")))
    )
    return unique_names(fields, ["file", "sheet"], "_base", "col_no").select(
        "file", "sheet", "col_no", "source_name", "field_name", kind_of(F.col("source_type")).alias("kind"),
        "source_type", "comment",
    )


def sheet_errors(cells: DataFrame, header_row: int) -> DataFrame:
    """(file, sheet, error): sheets without the header row or without a field in it."""
    header = F.col("row_no") == header_row - 1
    state = cells.groupBy("file", "sheet").agg(
        F.max("row_no").alias("last_row"),
        F.count_if(header & ~is_blank(F.col("value"))).alias("fields"),
    )
    return state.where("fields = 0").select(
        "file",
        "sheet",
        F.when(F.col("last_row") < header_row - 1, "MISSING_HEADER_ROW").otherwise("NO_FIELD").alias("error"),
    )


def columns_dictionary(columns: DataFrame) -> DataFrame:
    """Dictionary from column-catalogue rows ``table_name, position, name, type, comment``."""
    based = columns.withColumn("_base", camel_name(F.col("name")))
    return unique_names(based, ["table_name"], "_base", "position").select(
        "table_name",
        F.col("table_name").alias("entity_name"),
        "position",
        F.col("name").alias("source_name"),
        "field_name",
        kind_of(F.col("type")).alias("kind"),
        F.col("type").alias("source_type"),
        F.coalesce("comment", F.lit("")).alias("comment"),
    )


def frame_dictionary(df: DataFrame, table_name: str) -> DataFrame:
    """Dictionary of a read frame, such as the result of a JDBC query: one row per column of its schema."""
    fields = [(table_name, i, f.name, f.dataType.simpleString(), f.metadata.get("comment")) for i, f in enumerate(df.schema.fields)]
    columns = df.sparkSession.createDataFrame(fields, "table_name string, position int, name string, type string, comment string")
    return columns_dictionary(columns)


# Kind -> Spark type.
KIND_TYPES = {
    "STRING": "string",
    "INTEGER": "int",
    "LONG": "bigint",
    "BIG_INTEGER": "decimal(38,0)",
    "BIG_DECIMAL": "decimal(38,18)",
    "BOOLEAN": "boolean",
    "LOCAL_DATE": "date",
    "LOCAL_TIME": "string",
    "LOCAL_DATE_TIME": "timestamp_ntz",
    "BYTE_ARRAY": "binary",
}


def apply_dictionary(df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Rename and cast the columns of a raw text frame; a value that does not fit becomes null.

    The dictionary of one sheet is as long as the frame is wide.  Columns keep the order of the frame.
    """
    wanted = dictionary.where(F.col("source_name").isin(df.columns)).select("source_name", "field_name", "kind")
    twice = wanted.groupBy("source_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not twice.isEmpty():
        raise ValueError("the dictionary names a column of the frame more than once; hand in one table's rows")
    fields = {r["source_name"]: r for r in wanted.collect()}  # at most one row per column of the frame
    return df.select(
        *[
            F.col(f"`{name}`").try_cast(KIND_TYPES.get(fields[name]["kind"], "string")).alias(fields[name]["field_name"])
            for name in df.columns
            if name in fields
        ]
    )


def probe_rollup(results: DataFrame) -> DataFrame:
    """(ip, open_count, closed_count, total_count) from ``ip, port, open``."""
    return results.groupBy("ip").agg(
        F.count_if("open").alias("open_count"),
        F.count_if(~F.coalesce("open", F.lit(False))).alias("closed_count"),
        F.count(F.lit(1)).alias("total_count"),
    )


def sheet_summary(cells: DataFrame) -> DataFrame:
    """(file, sheet, total_rows, total_cols)."""
    return cells.groupBy("file", "sheet").agg(
        (F.max("row_no") + 1).cast("bigint").alias("total_rows"),
        (F.max("col_no") + 1).cast("bigint").alias("total_cols"),
    )


def densify(cells: DataFrame) -> DataFrame:
    """Every cell of every sheet's rectangle, blank where missing.

    Only the given cells move: those of a row become a map, and the row of the grid is made from it.  Row ranges are
    cut into blocks and spread before they are generated, so one huge sheet uses many tasks.
    """
    blocks = (
        sheet_summary(cells)
        .select(
            "file", "sheet", "total_rows", "total_cols",
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("total_rows") - 1, F.lit(ROWS_PER_BLOCK).cast("bigint"))).alias("first"),
        )
        .repartition("file", "sheet", "first")
    )
    last = F.least(F.col("first") + ROWS_PER_BLOCK, F.col("total_rows")) - 1
    rows = blocks.select("file", "sheet", "total_cols", F.explode(F.sequence("first", last)).alias("_row")).select(
        "file", "sheet", "total_cols", F.col("_row").cast("int").alias("row_no")
    )
    filled = cells.groupBy("file", "sheet", "row_no").agg(F.map_from_entries(F.collect_list(F.struct("col_no", "value"))).alias("_values"))
    return (
        rows.join(filled, ["file", "sheet", "row_no"], "left")
        .select("file", "sheet", "row_no", "_values", F.explode(F.sequence(F.lit(0), (F.col("total_cols") - 1).cast("int"))).alias("col_no"))
        .select("file", "sheet", "row_no", "col_no", F.coalesce(F.try_element_at("_values", F.col("col_no")), F.lit("")).alias("value"))
    )


def merged_cells(regions: DataFrame) -> DataFrame:
    """Cells covered by ``file, sheet, first_row, last_row, first_col, last_col``."""
    return regions.select(
        "file", "sheet", "first_row", "first_col", "last_col", F.explode(F.sequence("first_row", "last_row")).alias("row_no")
    ).select(
        "file", "sheet", "first_row", "first_col", "row_no", F.explode(F.sequence("first_col", "last_col")).alias("col_no")
    )
