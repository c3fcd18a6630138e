"""Large single documents read by many tasks: JSON arrays and delimited blocks of lines.

A file is read in fragments that end where an object may end (``},``), so any split of the file starts at some fragment.
What a fragment means depends on the text before it: whether it begins inside a string, and at which depth.  Both are
sums over the fragments before, and the range-sorted running values give them without one task seeing the whole file:
first the quotes, whose parity tells the string state, then the brackets outside strings.  Where an object of the outer
array ends, a group of elements ends, and only the fragments of one group meet again.

Order is (file, byte position), not the order in which Spark packs the splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.ordered import Running, running
from weftline.runtime import materialize

SEPARATOR = "},"
BOM = "﻿"
ARRAY_HEAD = rf"^{BOM}?\s*\["
ARRAY_TAIL = r"\]\s*$"


def fragments(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, start, line, text), written: text between separators, in file order by (start, line)."""
    rows = spark.read.option("lineSep", separator).text(path)
    found = materialize(
        rows.select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("line"),
            F.col("value").alias("text"),
        ),
        "fragments",
    )
    if found.select("file").distinct().count() < len(set(rows.inputFiles())):  # the names that Spark's scan holds anyway
        raise ValueError("empty document")
    return found


def _brackets(outside: Column) -> Column:
    count = lambda pattern: F.regexp_count(outside, F.lit(pattern))
    return (count(r"[\[{]") - count(r"[\]}]")).cast("bigint")


def _sums(marks: DataFrame, name: str, kind: str, value: Column) -> DataFrame:
    found = running(marks, ["file"], ["start", "line"], {name: Running(kind, value)})
    return found.withColumn(name, F.coalesce(name, F.lit(0)))


def array_groups(spark: SparkSession, path: str, head: str = ARRAY_HEAD, tail: str = ARRAY_TAIL, depth: int = 1, only: bool = True) -> tuple[DataFrame, DataFrame]:
    """((file, group, elements, ok), (file, whole)): the outer arrays of the JSON files at ``path`` in groups of elements.

    ``elements`` is the text of neighbouring elements, ``ok`` whether the file's brackets and quotes close.  ``head`` and
    ``tail`` are what stands around the elements, ``depth`` the brackets that ``head`` opens; files that begin otherwise
    are not split: ``whole`` names them.  A file that holds more than the array is not ok where the array must be the
    ``only`` content, else it is not split either.
    """
    texts = fragments(spark, path, SEPARATOR)
    # escaped characters are no quotes; the pieces between quotes lie outside strings and inside them by turns
    pieces = F.split(F.regexp_replace("text", r"(?s)\\.", ""), '"')
    side = lambda odd: F.array_join(F.filter("pieces", lambda p, i: i % 2 == odd), " ")
    marks = texts.withColumn("pieces", pieces).select(
        "file", "start", "line", (F.size("pieces") - 1).cast("bigint").alias("quotes"), _brackets(side(0)).alias("even"), _brackets(side(1)).alias("odd")
    )
    inside = _sums(marks, "before", "sum_before", F.col("quotes"))
    ends = materialize(texts.groupBy("file").agg(F.max(F.struct("start", "line")).alias("end")), "fragment-ends")
    state = inside.join(ends, "file").select(
        "file", "start", "line",
        F.when(F.col("before") % 2 == 0, F.col("even")).otherwise(F.col("odd")).alias("step"),
        ((F.col("before") + F.col("quotes")) % 2 == 0).alias("outside"),
        (F.struct("start", "line") == F.col("end")).alias("last"),
    )
    # the separator after a fragment closes an object, but for the last fragment, which has none
    closes = (F.col("outside") & ~F.col("last")).cast("bigint")
    deep = _sums(state, "depth", "sum", F.col("step") - closes)
    boundary = (F.col("outside") & ~F.col("last") & (F.col("depth") == depth)).cast("bigint")
    grouped = materialize(_sums(deep, "group", "sum_before", boundary), "fragment-groups")

    joined = grouped.join(texts, ["file", "start", "line"])
    first = F.min_by(F.substring(F.regexp_replace("text", r"^\s+", ""), 1, 200), F.struct("start", "line"))
    end = F.expr("right(regexp_replace(text, '[\\\\s]+$', ''), 200)")
    lowest = F.min(F.when(~F.col("last"), F.col("depth")))
    files = materialize(
        joined.groupBy("file").agg(
            first.alias("first"), F.coalesce(lowest, F.lit(depth)).alias("lowest"), F.max("group").alias("groups"),
            F.max_by(F.struct(((F.col("depth") == 0) & F.col("outside")).alias("closed"), F.when(F.col("last"), end).alias("end")), F.struct("start", "line")).alias("final"),
        ),
        "fragment-files",
    )
    begins, alone = F.col("first").rlike(head), F.col("lowest") >= depth
    closed = F.col("final.closed") & F.col("final.end").rlike(tail) & alone
    files = files.select("file", "groups", (~begins if only else ~(begins & alone)).alias("whole"), closed.alias("closed"))
    parts = joined.groupBy("file", "group").agg(F.sort_array(F.collect_list(F.struct("start", "line", "text"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), SEPARATOR)
    ended = F.when(F.col("group") < F.col("groups"), F.concat(text, F.lit("}"))).otherwise(F.regexp_replace(text, tail, ""))
    body = F.when(F.col("group") == 0, F.regexp_replace(ended, head, "")).otherwise(ended)
    # an element is missing after a comma that ends the array
    complete = F.col("closed") & ((F.col("group") == 0) | (F.trim("elements") != ""))
    groups = parts.join(files.where("not whole"), "file").select("file", "group", "groups", "closed", body.alias("elements"))
    return groups.select("file", "group", "elements", complete.alias("ok")), files.where("whole").select("file")


def array_elements(groups: DataFrame) -> DataFrame:
    """(file, group, pos, root_ok, element) of the groups; a group that is no JSON has one row without an element."""
    listed = F.when(F.col("ok"), F.from_json(F.concat(F.lit("["), "elements", F.lit("]")), "array<variant>"))
    opened = groups.select("file", "group", listed.alias("listed"))
    return opened.select("file", "group", F.col("listed").isNotNull().alias("root_ok"), F.posexplode_outer("listed").alias("pos", "element"))


def line_blocks(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """(file, block, text): the text between lines that match ``delimiter``, numbered from 0 in every file."""
    lines = fragments(spark, path, "\n").withColumn("cut", F.col("text").rlike(delimiter).cast("bigint"))
    placed = materialize(_sums(lines, "block", "sum", F.col("cut")), "blocks")
    parts = placed.where("cut = 0").groupBy("file", "block").agg(F.sort_array(F.collect_list(F.struct("start", "line", "text"))).alias("parts"))
    return parts.select("file", "block", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
