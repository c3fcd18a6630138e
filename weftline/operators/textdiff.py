"""Line comparison of two versions of a text.

Lines of both versions go through one exchange on the pair; every later window is on the pair plus finer keys,
so Spark only re-sorts.  A group is the lines of one pair, bounded by the row it came from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.names import strip
from weftline.functions.rows import unfold


def split_lines(text: Column) -> Column:
    """Lines with trailing empties kept; a null or empty text has none."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line)."""
    return unfold(df, [key], split_lines(F.col(text)), "line", "pos")


def _sided(pairs: DataFrame, key: str, a: str, b: str, ignore_whitespace: bool) -> DataFrame:
    def tagged(text: str, side: str) -> Column:
        return F.transform(
            split_lines(F.col(text)),
            lambda line, i: F.struct(F.lit(side).alias("side"), i.alias("pos"), line.alias("line")),
        )

    rows = unfold(pairs, [key], F.concat(tagged(a, "A"), tagged(b, "B")), "l").select(key, "l.side", "l.pos", "l.line")
    compared = strip(F.col("line")) if ignore_whitespace else F.col("line")
    return rows.withColumn("_same", compared).repartition(key)


def _anchored(pairs: DataFrame, key: str, a: str, b: str, ignore_whitespace: bool) -> DataFrame:
    """Lines with ``anchor``: the n-th copy of a line in A meets the n-th in B and does not cross an earlier match."""
    nth = Window.partitionBy(key, "side", "_same").orderBy("pos")
    copy = Window.partitionBy(key, "_same", "_nth")
    before = Window.partitionBy(key, "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    met = (
        _sided(pairs, key, a, b, ignore_whitespace)
        .withColumn("_nth", F.row_number().over(nth))
        .withColumn("_a", F.max(F.when(F.col("side") == "A", F.col("pos"))).over(copy))
        .withColumn("_b", F.max(F.when(F.col("side") == "B", F.col("pos"))).over(copy))
    )
    matched = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    high = F.max(F.when(F.col("side") == "A", F.when(matched, F.col("_b")))).over(before)
    kept = (F.col("side") == "A") & matched & (F.col("_b") > F.coalesce(high, F.lit(-1)))
    return met.withColumn("_kept", kept).withColumn("anchor", F.max("_kept").over(copy))


def align_lines(pairs: DataFrame, key: str, a: str, b: str, ignore_whitespace: bool = False) -> DataFrame:
    """(key, a_pos, b_pos, line) of the lines both versions share."""
    rows = _anchored(pairs, key, a, b, ignore_whitespace).where("side = 'A' and anchor")
    return rows.select(key, F.col("_a").alias("a_pos"), F.col("_b").alias("b_pos"), "line")


def text_hunks(pairs: DataFrame, key: str, a: str, b: str, ignore_whitespace: bool = False) -> DataFrame:
    """(key, type, source_pos, source_lines, target_pos, target_lines) with 0-based positions."""
    before = Window.partitionBy(key, "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gaps = _anchored(pairs, key, a, b, ignore_whitespace).withColumn(
        "gap", F.sum(F.col("anchor").cast("int")).over(before)
    )
    loose = ~F.col("anchor")

    def side_lines(side: str) -> Column:
        entry = F.when(loose & (F.col("side") == side), F.struct("pos", "line"))
        return F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["line"])

    grouped = gaps.groupBy(key, "gap").agg(
        F.coalesce(F.max(F.when(F.col("anchor"), F.col("_a"))) + 1, F.lit(0)).alias("source_pos"),
        side_lines("A").alias("source_lines"),
        F.coalesce(F.max(F.when(F.col("anchor"), F.col("_b"))) + 1, F.lit(0)).alias("target_pos"),
        side_lines("B").alias("target_lines"),
    )
    removed, added = F.size("source_lines") > 0, F.size("target_lines") > 0
    return grouped.where(removed | added).select(
        key,
        F.when(removed & added, "CHANGE").when(removed, "DELETE").otherwise("INSERT").alias("type"),
        "source_pos",
        "source_lines",
        "target_pos",
        "target_lines",
    )


# Heads of the text form and of a hunk.
UNIFIED_HEAD = "--- original\n+++ revised\n"
HUNK_HEAD = "@@ -%d,%d +%d,%d @@"


def unified_diff(pairs: DataFrame, hunks: DataFrame, key: str) -> DataFrame:
    """(key, unified): one text for every pair, the head alone where nothing differs.

    Positions are 1-based unless the side is empty.
    """
    source_size, target_size = F.size("source_lines"), F.size("target_lines")

    def start(position: str, size: Column) -> Column:
        return F.when(size == 0, F.col(position)).otherwise(F.col(position) + 1)

    def marked(mark: str, column: str) -> Column:
        return F.transform(column, lambda line: F.concat(F.lit(mark), line))

    head = F.format_string(
        HUNK_HEAD, start("source_pos", source_size), source_size, start("target_pos", target_size), target_size
    )
    body = F.concat(F.array(head), marked("-", "source_lines"), marked("+", "target_lines"))
    text = F.array_join(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("source_pos", "target_pos", "body"))), lambda h: h["body"])),
        "\n",
    )
    texts = hunks.withColumn("body", body).groupBy(key).agg(text.alias("_text"))
    whole = F.concat(F.lit(UNIFIED_HEAD), F.coalesce("_text", F.lit("")))
    return pairs.select(key).join(texts, key, "left").select(key, strip(whole).alias("unified"))


def diff_summary(pairs: DataFrame, hunks: DataFrame, key: str) -> DataFrame:
    """(key, change_count, identical) for every pair."""
    counted = hunks.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    count = F.coalesce("n", F.lit(0)).cast("bigint")
    return pairs.select(key).join(counted, key, "left").select(
        key, count.alias("change_count"), (count == 0).alias("identical")
    )


def line_delta(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, added_lines, removed_lines) for every pair, the order of lines ignored."""
    change = F.sum(F.when(F.col("side") == "B", 1).otherwise(-1))
    per_line = _sided(pairs, key, a, b, False).groupBy(key, "line").agg(change.alias("d"))
    counted = per_line.groupBy(key).agg(
        F.sum(F.greatest("d", F.lit(0))).alias("added_lines"),
        F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("removed_lines"),
    )
    return pairs.select(key).join(counted, key, "left").select(
        key, F.coalesce("added_lines", F.lit(0)).alias("added_lines"), F.coalesce("removed_lines", F.lit(0)).alias("removed_lines")
    )
