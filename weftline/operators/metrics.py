"""Metric catalogue over SELECT items.

Items: ``sql_id, ord, branch_no, item_no, alias, expression, group_by, where_text, having_text, source_tables``,
one row per SELECT item of the main query; ``branch_no`` numbers the branches of a set operation and
``item_no`` starts at 1.  ``ord`` orders the statements of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.names import is_blank, strip
from weftline.functions.rows import keep, unfold
from weftline.functions.tokens import is_operand, is_quoted, is_word, sql_tokens

# Functions that aggregate, with or without OVER.
AGGREGATES = (
    "SUM COUNT AVG MIN MAX STDDEV VARIANCE WM_CONCAT LISTAGG ROW_NUMBER RANK DENSE_RANK NTILE LAG LEAD "
    "FIRST_VALUE LAST_VALUE"
).split()
# The other aggregates of standard SQL; callers add those of their own dialect.
MORE_AGGREGATES = (
    "ANY_VALUE ARRAY_AGG BIT_AND BIT_OR BIT_XOR BOOL_AND BOOL_OR CORR COVAR_POP COVAR_SAMP CUME_DIST EVERY GROUPING "
    "GROUP_CONCAT MEDIAN MODE NTH_VALUE PERCENT_RANK PERCENTILE_CONT PERCENTILE_DISC REGR_AVGX REGR_AVGY REGR_COUNT "
    "REGR_INTERCEPT REGR_R2 REGR_SLOPE REGR_SXX REGR_SXY REGR_SYY STDDEV_POP STDDEV_SAMP STRING_AGG VAR_POP VAR_SAMP"
).split()

# Words that are neither operands nor columns.
KEYWORDS = (
    "ALL AND ANY AS ASC BETWEEN BY CASE CURRENT DESC DISTINCT ELSE END ESCAPE EXISTS FALSE FOLLOWING FROM GROUP "
    "HAVING IN INTERVAL IS LIKE NOT NULL NULLS OR ORDER OVER PARTITION PRECEDING RANGE ROW ROWS SELECT THEN TRUE "
    "UNBOUNDED UNION WHEN WHERE WITHIN"
).split()

# Words that may stand before an arithmetic operator although they are keywords.
CLOSING_WORDS = ["END", "NULL", "TRUE", "FALSE"]

SIMPLE_CLASSES = ["SUM", "AVG", "MIN", "MAX"]


def normalize_expression(text: Column) -> Column:
    """Upper-case with single blanks between tokens; quoted tokens unchanged."""
    return F.array_join(F.transform(sql_tokens(text), lambda t: F.when(is_quoted(t), t).otherwise(F.upper(t))), " ")


def expression_flags(items: DataFrame, aggregates: list[str] = AGGREGATES + MORE_AGGREGATES) -> DataFrame:
    """Add ``aggs`` (distinct names in order) and the flags of an expression; works on one row at a time.

    ``aggregates`` names the functions that aggregate, in upper case.  A call followed by OVER is a window and one
    followed by WITHIN GROUP an ordered aggregate, whatever its name.
    """
    words = items.withColumn("_t", sql_tokens(F.col("expression"))).withColumn("_u", F.transform("_t", F.upper))

    def near(i: Column, offset: int) -> Column:
        return F.coalesce(F.get(F.col("_u"), i + offset), F.lit(""))

    at = F.when(F.size("_u") > 0, F.sequence(F.lit(0), F.size("_u") - 1)).otherwise(F.array().cast("array<int>"))
    called = F.filter(F.col("_at"), lambda i: near(i, 0).isin(aggregates) & (near(i, 1) == "("))
    within = F.exists("_at", lambda i: (near(i, 0) == "WITHIN") & (near(i, 1) == "GROUP") & (near(i, -1) == ")"))
    over = F.exists("_at", lambda i: (near(i, 0) == "OVER") & ((near(i, 1) == "(") | (near(i, -1) == ")")))
    binary = F.filter(
        F.col("_at"),
        lambda i: near(i, 0).isin("+", "-", "*", "/", "%")
        & is_operand(near(i, -1))
        & (~near(i, -1).isin(KEYWORDS) | near(i, -1).isin(CLOSING_WORDS))
        & (is_operand(near(i, 1)) | near(i, 1).isin("(", "-", "+"))
        & (near(i, 1) != ")"),
    )
    operators = F.transform(binary, lambda i: near(i, 0))
    distinct = F.exists(
        "_at", lambda i: (near(i, 0) == "DISTINCT") & (near(i, -1) == "(") & near(i, -2).isin(aggregates)
    )
    return (
        words.withColumn("_at", at)
        .withColumns(
            {
                "aggs": F.array_distinct(F.transform(called, lambda i: near(i, 0))),
                "is_distinct": distinct,
                "has_case": F.array_contains("_u", "CASE"),
                "has_arithmetic": F.size(operators) > 0,
                "has_division": F.array_contains(operators, "/"),
                "is_window": over,
                "is_ordered": within,
            }
        )
        .drop("_t", "_u", "_at")
    )


def is_metric() -> Column:
    return (F.size("aggs") > 0) | F.col("is_window") | F.col("is_ordered")


def metric_rows(items: DataFrame) -> DataFrame:
    """Flagged items that are metrics."""
    return keep(expression_flags(items), is_metric())


def classify_metric() -> Column:
    """Class of a flagged row, first match wins."""
    any_agg = F.size("aggs") > 0
    name = F.when(F.size("aggs") == 1, F.get(F.col("aggs"), F.lit(0)))
    return (
        F.when(F.col("is_window"), "WINDOW")
        .when(F.col("has_division") & any_agg, "RATIO")
        .when(F.col("has_arithmetic") & any_agg, "DERIVED")
        .when(F.col("has_case") & any_agg, "CONDITIONAL_AGGREGATION")
        .when((name == "COUNT") & F.col("is_distinct"), "COUNT_DISTINCT")
        .when(name == "COUNT", "COUNT")
        .when(name.isin(SIMPLE_CLASSES), name)
        .otherwise("DERIVED")
    )


def metric_name(alias: Column, expression: Column) -> Column:
    """Alias without its quote pair, else the expression text."""
    plain = F.regexp_replace(strip(alias), r"""^(["'`\[])(.*)["'`\]]$""", "$2")
    return F.when(is_blank(alias), expression).otherwise(plain)


def metric_dimensions(items: DataFrame) -> DataFrame:
    """(sql_id, branch_no, dim_no, name, expression): GROUP BY parts named by the matching SELECT item."""
    branches = items.select("sql_id", "branch_no", "group_by").distinct()  # whichever of its items are given
    parts = branches.select("sql_id", "branch_no", F.posexplode("group_by").alias("dim_no", "expression"))
    # only items that equal a GROUP BY part of their own row can name a dimension
    labels = (
        items.select(
            "sql_id", "branch_no", "item_no", "alias", "group_by", normalize_expression(F.col("expression")).alias("norm")
        )
        .where(F.exists("group_by", lambda g: normalize_expression(g) == F.col("norm")))
        .groupBy("sql_id", "branch_no", "norm")
        .agg(F.min_by(F.struct("alias"), F.col("item_no")).alias("first_item"))
    )
    named = parts.withColumn("norm", normalize_expression(F.col("expression"))).join(
        labels, ["sql_id", "branch_no", "norm"], "left"
    )
    alias = F.col("first_item.alias")
    return named.select(
        "sql_id",
        "branch_no",
        "dim_no",
        F.when(is_blank(alias), F.col("expression")).otherwise(alias).alias("name"),
        "expression",
    )


def source_columns(items: DataFrame) -> DataFrame:
    """(sql_id, branch_no, item_no, column_name): names in the expression, without function names and keywords."""
    words = items.select("sql_id", "branch_no", "item_no", sql_tokens(F.col("expression")).alias("t"))
    return unfold(words, ["sql_id", "branch_no", "item_no"], _column_words("t"), "column_name")


def _column_words(tokens: str) -> Column:
    """Distinct names among the tokens of an expression, in order."""
    tagged = F.transform(tokens, lambda w, i: F.struct(w.alias("w"), F.coalesce(F.get(F.col(tokens), i + 1), F.lit("")).alias("n")))
    kept = F.filter(tagged, lambda p: is_word(p["w"]) & (p["n"] != "(") & ~F.upper(p["w"]).isin(KEYWORDS))
    return F.array_distinct(F.transform(kept, lambda p: p["w"]))


def metric_reasons() -> Column:
    """Evidence codes of a flagged row in a fixed order."""
    return F.array_compact(
        F.array(
            F.when(F.size("aggs") > 0, F.concat(F.lit("AGGREGATE:"), F.array_join("aggs", ","))),
            F.when(F.col("is_distinct"), F.lit("DISTINCT")),
            F.when(F.col("has_case"), F.lit("CASE")),
            F.when(F.col("has_division"), F.lit("DIVISION")).when(F.col("has_arithmetic"), F.lit("ARITHMETIC")),
            F.when(F.col("is_window"), F.lit("OVER")),
            F.when(~is_blank(F.col("alias")), F.concat(F.lit("ALIAS:"), F.col("alias"))),
        )
    )


def probe_metrics(items: DataFrame) -> DataFrame:
    """One row per metric, row-local: with its source columns and the GROUP BY parts as ``dimensions``.

    ``metric_dimensions`` names the parts by the items that show them, which takes the other rows of the statement.
    """
    return (
        metric_rows(items)
        .withColumn("_t", sql_tokens(F.col("expression")))
        .select(
            "sql_id",
            "ord",
            "branch_no",
            "item_no",
            metric_name(F.col("alias"), F.col("expression")).alias("name"),
            "expression",
            normalize_expression(F.col("expression")).alias("normalized_expression"),
            classify_metric().alias("type"),
            F.array_join("aggs", ",").alias("aggregation"),
            "is_distinct",
            F.col("has_case").alias("is_conditional"),
            "is_window",
            "source_tables",
            _column_words("_t").alias("source_columns"),
            F.coalesce("group_by", F.array().cast("array<string>")).alias("dimensions"),
            "where_text",
            "having_text",
            metric_reasons().alias("reasons"),
        )
    )


def duplicate_metrics(metrics: DataFrame) -> DataFrame:
    """Calculations that occur at least twice, with the first-seen expression and distinct name / id counts.

    One hash aggregate reduces the metrics to their spellings by name and statement, with the first place of each as one
    number; the metrics are read once.
    """
    named = metrics.where(F.col("normalized_expression") != "")
    place = F.col("ord").cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)") + (
        F.col("branch_no").cast("bigint") * 10**9 + F.col("item_no")
    ).cast("decimal(19,0)")
    spellings = named.groupBy("normalized_expression", "expression", "name", "sql_id").agg(
        F.min(place).alias("place"), F.count(F.lit(1)).alias("n")
    )
    return (
        spellings.groupBy("normalized_expression")
        .agg(
            F.min_by("expression", "place").alias("expression"),
            F.sum("n").alias("occurrence_count"),
            F.count_distinct(F.when(~is_blank(F.col("name")), F.col("name"))).alias("name_count"),
            F.count_distinct(F.when(~is_blank(F.col("sql_id")), F.col("sql_id"))).alias("sql_count"),
        )
        .where("occurrence_count > 1")
    )


def duplicate_members(metrics: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(normalized_expression, name, sql_id): the members of the duplicate groups, as rows."""
    return (
        metrics.join(duplicates.select("normalized_expression"), "normalized_expression", "left_semi")
        .select("normalized_expression", "name", "sql_id")
        .distinct()
    )


def metric_status(statements: DataFrame, metrics: DataFrame) -> DataFrame:
    """(sql_id, status, metric_count) from ``statements(sql_id, kind)``.

    A statement that is not a SELECT is skipped: nothing found and something skipped is UNSUPPORTED,
    something skipped is PARTIAL, else SUCCESS.  An input without statements is PARSE_FAILED.
    """
    skipped = statements.groupBy("sql_id").agg(
        F.max(F.coalesce(F.col("kind") != "SELECT", F.lit(False))).alias("skipped"),
        F.count("kind").alias("statements"),
    )
    found = metrics.groupBy("sql_id").agg(F.count(F.lit(1)).alias("n"))
    count = F.coalesce("n", F.lit(0)).cast("bigint")
    return skipped.join(found, "sql_id", "left").select(
        "sql_id",
        F.when(F.col("statements") == 0, "PARSE_FAILED")
        .when(F.col("skipped") & (count == 0), "UNSUPPORTED")
        .when(F.col("skipped"), "PARTIAL")
        .otherwise("SUCCESS")
        .alias("status"),
        count.alias("metric_count"),
    )


def metric_rollup(statuses: DataFrame) -> DataFrame:
    """One row: the five status counts and the number of metrics."""
    status = F.col("status")
    return statuses.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "SUCCESS").alias("success"),
        F.count_if(status == "PARTIAL").alias("partial"),
        F.count_if(status == "UNSUPPORTED").alias("unsupported"),
        F.count_if(~status.isin("SUCCESS", "PARTIAL", "UNSUPPORTED")).alias("failed"),
        F.coalesce(F.sum("metric_count"), F.lit(0)).alias("metric_count"),
    )
