"""How quality filters interact, for every order in which they could run.

Every filter has a table of the ids of the rows that fail it.  Which rows outlive the filters run so far depends on
their set and not on their order, so left-anti and left-semi joins between the tables are made once per set of filters
run before: the survivors, what the next filter removes, what an earlier filter had removed already, and what is lost
of the labelled rows.  The counts of all orders are then read off a few hundred counts per part.

Rows that fail nothing take part in one join only.  No text and no id leaves the executors.

Null texts, parts and ids: a null text is empty, a null part the empty string, and a row without an id neither has
labels nor counts as an earlier or later copy.  Rows that repeat an id are rows of their own, and not copies of each
other.  Texts are equal when their SHA-256 is.  An empty table has no parts and thus no rows.  Other columns of
``docs`` and ``labels`` are not read, whatever their names.
"""

from __future__ import annotations

import json
import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.rows import let
from weftline.runtime import materialize, scratch_path

MIN_WORDS = 50
DISTINCT_PERCENT = 65
CAPITAL_PERCENT = 5
SYMBOLS = r"[#$%&*|]"
_BLANK = r"[\x20\x09-\x0D]+"
_FAILING = "row bigint, id bigint, part string, bit int, filter string"


def text_facts(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(row, id, part, digest, words, distinct, capitals, chars, symbol), written: the texts are read once."""
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    counted = let(
        F.array_remove(F.split(content, _BLANK), ""),
        lambda w: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct")),
    )
    facts = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).cast("bigint").alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.sha2(content.cast("binary"), 256).alias("digest"),
        counted.alias("counted"),
        F.regexp_count(content, F.lit("[A-Z]")).alias("capitals"),
        F.length(content).alias("chars"),
        content.rlike(SYMBOLS).alias("symbol"),
    )
    return materialize(facts, "audit-facts").select("*", "counted.*").drop("counted")


def standard_conditions() -> dict[str, Column]:
    """What fails each filter that looks at one row: too short, repetitive, loud, full of symbols."""
    words = F.col("words").cast("bigint")
    return {
        "A": words < MIN_WORDS,
        "B": 100 * F.col("distinct").cast("bigint") < DISTINCT_PERCENT * words,
        "C": 100 * F.col("capitals").cast("bigint") > CAPITAL_PERCENT * F.col("chars").cast("bigint"),
        "D": F.col("symbol"),
    }


def later_copies(facts: DataFrame) -> DataFrame:
    """The rows whose text some row with a smaller id has.  The first ids are written, so that a hot text's join is split."""
    first = facts.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = materialize(first.select("digest", "first"), "audit-first")
    return facts.join(first, "digest").where("id > first")


def failing_tables(facts: DataFrame, conditions: dict[str, Column], copies: str | None = None) -> DataFrame:
    """(row, id, part, bit, filter): one written table of failing ids per filter, as partitions of one folder.

    ``copies`` names the filter that later copies fail; it comes after those of ``conditions``.
    """
    root = scratch_path(facts.sparkSession, "audit-failing")
    named = F.array(*[F.when(c, F.struct(F.lit(1 << i).alias("bit"), F.lit(n).alias("filter"))) for i, (n, c) in enumerate(conditions.items())])
    rows = facts.select("row", "id", "part", F.explode(named).alias("f")).where("f is not null").select("row", "id", "part", "f.*")
    if copies is not None:
        again = later_copies(facts).select("row", "id", "part", F.lit(1 << len(conditions)).alias("bit"), F.lit(copies).alias("filter"))
        rows = rows.unionByName(again)
    rows.write.partitionBy("filter").parquet(root)
    return facts.sparkSession.read.schema(_FAILING).parquet(root)


def _sets(count: int, without: Column | None = None) -> Column:
    """The sets of filters as bit masks, one row each; only those that lack ``without``."""
    masks = F.array(*[F.lit(m) for m in range(1 << count)])
    return F.explode(masks if without is None else F.filter(masks, lambda m: m.bitwiseAND(without) == 0))


def set_counts(facts: DataFrame, failing: DataFrame, labels: dict[str, DataFrame], count: int) -> DataFrame:
    """(part, key, n): the counts that all orders are made of.

    Keys: ``kept:set``, per filter and set of filters run before ``removed:bit:set``, ``redundant:bit:set`` and
    ``<label>:bit:set``, and ``shapley:bit`` with the rows removed over all orders.  ``labels`` maps a name to its ids (id); zeros have no row.
    """
    earlier = failing.select(F.col("row").alias("_row"), F.col("bit").alias("_bit"))
    fails_one = (F.col("row") == F.col("_row")) & (F.col("run").bitwiseAND(F.col("_bit")) != 0)

    hurt = failing.select("row", "part").distinct().select("row", "part", _sets(count).alias("run"))
    unhurt = facts.join(failing, "row", "left_anti").groupBy("part").count()
    survivors = hurt.join(earlier, fails_one, "left_anti").groupBy("part", "run").count()
    every = unhurt.select("part", _sets(count).alias("run"), "count").unionByName(survivors)
    found = [every.select("part", F.concat_ws(":", F.lit("kept"), "run").alias("key"), "count")]

    steps = failing.select("row", "id", "part", "bit", _sets(count, F.col("bit")).alias("run"))
    removed = materialize(steps.join(earlier, fails_one, "left_anti"), "audit-removed")
    tables = {"removed": removed, "redundant": steps.join(earlier, fails_one, "left_semi")}
    for name, ids in labels.items():
        tables[name] = removed.join(materialize(ids.select("id").distinct(), "audit-label"), "id", "left_semi")
    for name, rows in tables.items():
        counted = rows.groupBy("part", "bit", "run").count()
        found.append(counted.select("part", F.concat_ws(":", F.lit(name), "bit", "run").alias("key"), "count"))
    # over all orders, a filter runs after a given set as often as that set and the filters left can be arranged
    share = [math.factorial(m.bit_count()) * math.factorial(max(0, count - 1 - m.bit_count())) for m in range(1 << count)]
    weight = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in share]), F.col("run") + 1)
    orders = removed.groupBy("part", "bit", "run").count().groupBy("part", "bit").agg(F.sum(F.col("count") * weight).alias("count"))
    found.append(orders.select("part", F.concat_ws(":", F.lit("shapley"), "bit").alias("key"), "count"))
    together = found[0]
    for one in found[1:]:
        together = together.unionByName(one)
    return together.groupBy("part", "key").agg(F.sum("count").alias("n"))


def audit(facts: DataFrame, failing: DataFrame, names: list[str], labels: dict[str, DataFrame]) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, <label>_lost, shapley) for all orders.

    ``names`` are single letters in the order of their bits.  A part has factorial(len(names)) * len(names) rows, all
    made from its own few counts.
    """
    size, full = len(names), (1 << len(names)) - 1
    steps = []
    for order in permutations(range(size)):
        run = 0
        for i, at in enumerate(order):
            bit = 1 << at
            steps.append({"o": "".join(names[k] for k in order), "s": i + 1, "b": bit, "r": run, "a": run | bit, "u": full ^ bit})
            run |= bit
    counts = materialize(set_counts(facts, failing, labels, size), "audit-counts")
    per_part = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("counts"))
    places = F.from_json(F.lit(json.dumps(steps)), "array<struct<o:string,s:int,b:int,r:int,a:int,u:int>>")

    def at(kind: str, *keys: str) -> Column:
        return F.coalesce(F.try_element_at("counts", F.concat_ws(":", F.lit(kind), *keys)), F.lit(0))

    return per_part.select("part", "counts", F.explode(places).alias("p")).select(
        "part",
        F.col("p.o").alias("filter_order"),
        F.col("p.s").alias("step"),
        at("kept", "p.a").alias("kept"),
        at("removed", "p.b", "p.r").alias("removed"),
        at("redundant", "p.b", "p.r").alias("redundant"),
        at("removed", "p.b", "p.u").alias("unique_fails"),
        *[at(name, "p.b", "p.r").alias(f"{name}_lost") for name in labels],
        at("shapley", "p.b").alias("shapley"),
    )


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the four standard filters and of copies (E), with the good and the toxic rows of ``labels``."""
    facts = text_facts(docs)
    conditions = standard_conditions()
    failing = failing_tables(facts, conditions, copies="E")
    ids = F.col("doc_id").cast("bigint").alias("id")
    marked = {"good": labels.where("quality = 1").select(ids), "toxic": labels.where("toxic = 1").select(ids)}
    return audit(facts, failing, [*conditions, "E"], marked)
