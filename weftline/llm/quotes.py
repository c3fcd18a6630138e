"""Quotation linking: conversations in reply order, without the quotes that they were rebuilt from.

A line whose first marks are ``>`` is quoted, as deep as it has marks.  Neighbouring lines of one depth are a passage,
and a blank line ends it.  Passages are normalised (lower case, runs of white space are one space) and hashed.  Every
quoted passage is joined to the earliest message of its conversation that has the passage as text of its own, if that
message came before.  A passage that nobody wrote as a whole is a trimmed quote if each of its lines, or each of its
sentences, was written before; it goes to the message that holds most of its characters, the earliest of several.
Lines without a letter or digit (``[...]``) do not count.  A message replies to the one that its shallowest linked quote names, the latest of several; its
root is found by pointer doubling.  Messages are ordered by root and turn, so a reply follows what it answers.

DataFrame functions only.  Only the lines of one message ever meet in a group of their own, so a conversation or a
passage that holds a third of all rows stays spread.  Null texts are empty messages; rows without conversation or
turn link with nothing; rows that repeat conversation and turn are messages of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.ordered import Running, running
from weftline.runtime import materialize

QUOTE = r"^((?:[ \t]*>)+)"
ATTRIBUTION = r"(?i)\bwrote:\s*$"  # the line that introduces a quote
SENTENCE_END = r"(?<=[.!?…])\s+|(?<=[。！？])"
MAX_DOUBLINGS = 64  # a chain of replies has fewer than 2^64 messages


def _level(line: Column) -> Column:
    marks = F.regexp_extract(line, QUOTE, 1)
    return F.length(F.regexp_replace(marks, "[^>]", ""))


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def body(text: Column) -> Column:
    """The message without quoted lines and without the line that introduces them."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    own = F.filter(
        lines,
        lambda line, i: ~line.rlike(QUOTE)
        & ~(line.rlike(ATTRIBUTION) & F.coalesce(F.get(lines, i + 1).rlike(QUOTE), F.lit(False))),
    )
    return F.trim(F.array_join(own, "\n"), F.lit("\n"))


def _runs(messages: DataFrame) -> DataFrame:
    """(_m, conv_id, turn, level, run, lines): the passages of the messages, own ones at level 0, as normalised lines."""
    lines = messages.select(
        "_m", "conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line")
    ).select(
        "_m", "conv_id", "turn", "pos", _level(F.col("line")).alias("level"),
        _normal(F.regexp_replace("line", QUOTE, "")).alias("words"),
    )
    in_message = Window.partitionBy("_m").orderBy("pos")
    begins = (F.col("level") != F.lag("level", 1, -1).over(in_message)) | (F.lag("words", 1, "").over(in_message) == "")
    runs = lines.withColumn("begin", begins.cast("int")).withColumn("run", F.sum("begin").over(in_message)).where("words <> ''")
    return runs.groupBy("_m", "conv_id", "turn", "level", "run").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "words"))), lambda s: s["words"]).alias("lines")
    )


def passages(messages: DataFrame) -> DataFrame:
    """(_m, conv_id, turn, level, run, hash): the passages of the messages, own ones at level 0."""
    return _runs(messages).select("_m", "conv_id", "turn", "level", "run", F.sha2(F.array_join("lines", " "), 256).alias("hash"))


def _trimmed(messages: DataFrame, missing: DataFrame) -> DataFrame:
    """(_m, run, _trimmed): of the quoted passages ``missing`` (_m, run, conv_id) those whose lines or sentences were all
    written before, with the message (turn, _m) that holds most of them.

    Every line looks up the first message that wrote it, and only those messages are compared, so a frequent line does
    not meet all its copies.
    """
    involved = messages.where("turn is not null").join(missing.select("conv_id").distinct(), "conv_id", "left_semi")
    parts = _runs(involved).select(
        "_m", "conv_id", "turn", "level", "run", "lines", F.split(F.array_join("lines", " "), SENTENCE_END).alias("sentences")
    )
    parts = materialize(parts, "quote-lines")

    def hashed(unit: Column) -> Column:
        return F.sha2(unit, 256).alias("unit")

    counts = F.col("unit").rlike(r"[\p{L}\p{N}]")
    said = parts.where("level = 0").select("conv_id", "turn", "_m", F.explode(F.array_union("lines", "sentences")).alias("unit"))
    said = materialize(said.where(counts).select("conv_id", "turn", "_m", hashed(F.trim("unit"))).distinct(), "said-lines")
    first = said.groupBy("conv_id", "unit").agg(F.min(F.struct("turn", "_m")).alias("original"))
    quoted = parts.where("level > 0").join(missing.select("_m", "run"), ["_m", "run"], "left_semi")
    asked = quoted.select(
        "conv_id", "turn", "_m", "run",
        F.explode(F.array(F.struct(F.lit("line").alias("by"), F.col("lines").alias("units")), F.struct(F.lit("sentence").alias("by"), F.col("sentences").alias("units")))).alias("way"),
    )
    asked = asked.select("conv_id", "turn", "_m", "run", "way.by", F.explode(F.array_distinct("way.units")).alias("unit")).where(counts)
    asked = asked.select("conv_id", "turn", "_m", "run", "by", F.length("unit").alias("size"), hashed(F.trim("unit")))
    asked = materialize(
        asked.join(first, ["conv_id", "unit"], "left").withColumn("original", F.when(F.col("original.turn") < F.col("turn"), F.col("original"))),
        "asked-lines",
    )
    passage = ["_m", "run", "by"]
    whole = asked.groupBy(*passage).agg(F.count_if(F.col("original").isNull()).alias("unsaid")).where("unsaid = 0").select(*passage)
    candidates = asked.join(whole, passage, "left_semi").select(*passage, "original").distinct()
    held = said.select("conv_id", "unit", F.col("_m").alias("_by"))
    return (
        asked.drop("original")
        .join(candidates.withColumn("_by", F.col("original._m")), passage)
        .join(held, ["conv_id", "unit", "_by"])
        .groupBy(*passage, "original")
        .agg(F.sum("size").alias("overlap"))
        .groupBy("_m", "run")
        .agg(F.min(F.struct((-F.col("overlap")).alias("most"), "original")).alias("best"))
        .select("_m", "run", F.col("best.original").alias("_trimmed"))
    )


def _roots(replies: DataFrame) -> DataFrame:
    """(_m, _root) of the links (_m, _parent)."""
    reached = materialize(replies.select("_m", F.col("_parent").alias("_root")), "reply-roots")
    for _ in range(MAX_DOUBLINGS):
        further = reached.select(F.col("_m").alias("_root"), F.col("_root").alias("_next"))
        if reached.join(further, "_root", "left_semi").isEmpty():
            break
        reached = materialize(
            reached.join(further, "_root", "left").select("_m", F.coalesce("_next", "_root").alias("_root")), "reply-roots"
        )
    return reached


def linked_conversations(conversations: DataFrame) -> DataFrame:
    """One row per message: its reply, root and place in the conversation, and its chat text without quotes.

    (conv_id, turn, role, reply_to, root_turn, position, n_quoted, n_linked, chat)
    """
    messages = materialize(
        conversations.select("conv_id", "turn", "role", "text").withColumn("_m", F.monotonically_increasing_id()), "messages"
    )
    found = materialize(passages(messages), "passages")
    originals = (
        found.where("level = 0").groupBy("conv_id", "hash").agg(F.min(F.struct("turn", "_m")).alias("original"))
    )
    linked = (
        found.where("level > 0")
        .join(originals, ["conv_id", "hash"], "left")
        .withColumn("original", F.when(F.col("original.turn") < F.col("turn"), F.col("original")))
    )
    missing = materialize(
        linked.where("original is null and conv_id is not null and turn is not null").select("_m", "run", "conv_id"), "unlinked"
    )
    if not missing.isEmpty():
        trimmed = materialize(_trimmed(messages, missing), "trimmed-quotes")
        linked = linked.join(trimmed, ["_m", "run"], "left").withColumn("original", F.coalesce("original", "_trimmed"))
    linked = (
        linked.groupBy("_m")
        .agg(
            F.count(F.lit(1)).alias("n_quoted"),
            F.count("original").alias("n_linked"),
            F.max(F.when(F.col("original").isNotNull(), F.struct((-F.col("level")).alias("near"), "original"))).alias("best"),
        )
        .select("_m", "n_quoted", "n_linked", F.col("best.original._m").alias("_parent"), F.col("best.original.turn").alias("reply_to"))
    )
    linked = materialize(linked, "replies")
    roots = _roots(linked.where("_parent is not null"))
    turns = messages.select(F.col("_m").alias("_root"), F.col("turn").alias("root_turn"))
    placed = (
        messages.join(linked.drop("_parent"), "_m", "left")
        .join(roots.join(turns, "_root").drop("_root"), "_m", "left")
        .select(
            "_m", "conv_id", "turn", "role", "reply_to",
            F.coalesce("root_turn", "turn").alias("root_turn"),
            F.coalesce("n_quoted", F.lit(0)).cast("bigint").alias("n_quoted"),
            F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"),
            F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), body(F.col("text"))).alias("chat"),
        )
    )
    ordered = running(
        materialize(placed, "placed"), ["conv_id"], ["root_turn", "turn", "_m"], {"position": Running("count")}
    )
    return ordered.select(
        "conv_id", "turn", "role", "reply_to", "root_turn", (F.col("position") - 1).alias("position"), "n_quoted", "n_linked", "chat"
    )
