"""Strongly connected components, closures over the graph without its cycles, and ancestor counts without pairs.

Names become numbers in name order first.  Every round writes its tables to the shared checkpoint folder, and joins
are made against written tables, so that a hub's edges can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import closure
from weftline.operators.ordered import ranked
from weftline.runtime import materialize, scratch_path, write_table

DEFAULT_SKETCH = 256
HASH_BITS = 52  # of a name's digest; whole numbers below this are exact in doubles


def _trim(links: DataFrame) -> DataFrame:
    """Links between tables that have links in and out: what hangs on a cycle or between two."""
    size = links.count()
    while size:
        heads = materialize(links.select(F.col("v").alias("u")).distinct(), "heads")
        tails = materialize(links.select(F.col("u").alias("v")).distinct(), "tails")
        links = materialize(links.join(heads, "u", "left_semi").join(tails, "v", "left_semi").select("u", "v"), "trimmed")
        left = links.count()
        if left == size:
            break
        size = left
    return links


def _coloured(links: DataFrame) -> DataFrame:
    """(id, c): the least number that reaches every table, its own included."""
    ids = links.select(F.col("u").alias("id")).distinct()  # after trimming every table has a link out
    colours = materialize(ids.select("id", F.col("id").alias("c"), F.lit(True).alias("fresh")), "colours")
    while True:
        moved = colours.where("fresh").select(F.col("id").alias("u"), "c")
        offers = links.join(moved, "u").groupBy(F.col("v").alias("id")).agg(F.min("c").alias("offer"))
        fresh = F.col("offer").isNotNull() & (F.col("offer") < F.col("c"))
        colours = materialize(
            colours.select("id", "c").join(materialize(offers, "offers"), "id", "left")
            .select("id", F.when(fresh, F.col("offer")).otherwise(F.col("c")).alias("c"), fresh.alias("fresh")),
            "colours",
        )
        if colours.where("fresh").isEmpty():
            return colours.select("id", "c")


def _back_from_roots(links: DataFrame, colours: DataFrame) -> DataFrame:
    """(id, c) of the tables that reach the root of their colour inside it: the component of the root."""
    base = scratch_path(links.sparkSession, "back")
    frontier = write_table(colours.where("id = c"), f"{base}/hop=0")
    hop = 0
    while not frontier.isEmpty():
        seen = links.sparkSession.read.schema(colours.schema).parquet(base)
        step = links.join(frontier.select(F.col("id").alias("v"), "c"), ["v", "c"]).select(F.col("u").alias("id"), "c").distinct()
        hop += 1
        frontier = write_table(step.join(seen, "id", "left_anti"), f"{base}/hop={hop}")
    return links.sparkSession.read.schema(colours.schema).parquet(base)


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, representative): the least name of the tables that reach each other; a table outside cycles is its own.

    Trimming takes off what lies on no cycle; the rest is coloured by the least table upstream, and what leads back to
    that table within the colour is its component (Orzan, 2004).  Links between colours lie on no cycle and go.
    """
    ids = ranked(nodes.select("name"), [F.col("name")], "id")
    links = (
        edges.join(ids.select(F.col("name").alias("src"), F.col("id").alias("u")), "src")
        .join(ids.select(F.col("name").alias("dst"), F.col("id").alias("v")), "dst")
        .where("u <> v")
        .select("u", "v")
        .distinct()
    )
    links = _trim(materialize(links, "links"))
    found = scratch_path(nodes.sparkSession, "strong")
    parts = []
    while not links.isEmpty():
        colours = _coloured(links)
        inner = materialize(
            links.join(colours.select(F.col("id").alias("u"), "c"), "u")
            .join(colours.select(F.col("id").alias("v"), F.col("c").alias("d")), "v")
            .where("c = d")
            .select("u", "v", "c"),
            "inner",
        )
        parts.append(write_table(_back_from_roots(inner, colours), f"{found}/{len(parts)}"))
        done = parts[-1].select("id")
        rest = inner.join(done.withColumnRenamed("id", "u"), "u", "left_anti").join(done.withColumnRenamed("id", "v"), "v", "left_anti")
        links = _trim(materialize(rest.select("u", "v"), "links"))
    if not parts:
        return ids.select("name", F.col("name").alias("representative"))
    settled = nodes.sparkSession.read.schema(parts[0].schema).parquet(*[f"{found}/{n}" for n in range(len(parts))])
    members = ids.join(settled, "id", "left").select("name", F.coalesce("c", "id").alias("c"))
    return members.join(ids.select(F.col("id").alias("c"), F.col("name").alias("representative")), "c").select("name", "representative")


def condensed(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(src, dst) between strong components, named by their representatives: a graph without cycles."""
    return (
        edges.join(members.select(F.col("name").alias("src"), F.col("representative").alias("s")), "src")
        .join(members.select(F.col("name").alias("dst"), F.col("representative").alias("d")), "dst")
        .where("s <> d")
        .select(F.col("s").alias("src"), F.col("d").alias("dst"))
        .distinct()
    )


def reachable(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, name) of all tables upstream of the seeds, which are among them; no cycle is walked.

    Seeds of one component share its closure.  Seeds that are no tables give nothing.
    """
    members = materialize(strong_components(nodes, edges), "strong-members")
    wanted = materialize(seeds.select(F.col("name").alias("seed")).distinct().join(members.withColumnRenamed("name", "seed"), "seed"), "seeds")
    heads = wanted.select(F.col("representative").alias("name")).distinct()
    above = closure.upstream_closure(condensed(edges, members), heads, 0)
    pairs = above.select(F.col("seed").alias("representative"), F.col("name").alias("r")).join(wanted, "representative")
    return pairs.select("seed", "r").join(members.withColumnRenamed("representative", "r"), "r").select("seed", "name")


def _digest(name: str) -> Column:
    return F.conv(F.substring(F.md5(F.col(name)), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def ancestor_counts(nodes: DataFrame, edges: DataFrame, sketch: int = DEFAULT_SKETCH) -> DataFrame:
    """(name, ancestors, exact): number of other tables upstream of every table, from bottom-k sketches.

    A table holds the ``sketch`` + 1 ancestors of least digest, handed on along the edges until nothing changes; only
    rows that are new travel.  Up to ``sketch`` ancestors (on a cycle with the table itself) the number is exact, beyond
    it the standard error is about 1 / sqrt(sketch - 2) of it.  A sketch has bounded rows however many tables lie upstream, also on cycles.
    """
    if sketch < 3:
        raise ValueError("a sketch needs at least three entries")
    ids = ranked(nodes.select("name"), [F.col("name")], "id")
    links = materialize(
        edges.join(ids.select(F.col("name").alias("src"), F.col("id").alias("u")), "src")
        .join(ids.select(F.col("name").alias("dst"), F.col("id").alias("v")), "dst")
        .select("u", "v", _digest("src").alias("h"))
        .distinct(),
        "links",
    )
    least = Window.partitionBy("id").orderBy("h", "a")

    def bounded(rows: DataFrame) -> DataFrame:
        """The least entries per table; an entry is fresh if it was not held before."""
        once = rows.groupBy("id", "h", "a").agg(F.min("fresh").alias("fresh"))
        ranks = once.withColumn("place", F.row_number().over(least)).where(F.col("place") <= sketch + 1)
        return materialize(ranks.drop("place"), "sketch")

    held = bounded(links.select(F.col("v").alias("id"), "h", F.col("u").alias("a"), F.lit(1).alias("fresh")))
    while not held.where("fresh = 1").isEmpty():
        news = held.where("fresh = 1").select(F.col("id").alias("u"), F.col("h").alias("g"), "a")
        offers = links.select("u", "v").join(news, "u").select(F.col("v").alias("id"), F.col("g").alias("h"), "a", F.lit(1).alias("fresh"))
        held = bounded(held.withColumn("fresh", F.lit(0)).unionByName(offers))
    # without the table itself, which is its own ancestor on a cycle; sketch + 1 others mean that there are more
    others = held.where("a <> id").withColumn("place", F.row_number().over(least))
    within = F.col("place") <= sketch
    seen = others.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(within, F.col("h"))).alias("last"))
    on_cycle = held.where("a = id").select("id", F.lit(1).alias("self"))
    total = F.coalesce("n", F.lit(0)) + F.coalesce("self", F.lit(0))
    beyond = total > sketch
    estimate = F.round((sketch - 1) * float(2**HASH_BITS) / (F.col("last") + 1)).cast("bigint")
    counted = F.when(beyond, estimate).otherwise(F.coalesce("n", F.lit(0)))
    return (
        ids.join(materialize(seen, "seen"), "id", "left")
        .join(on_cycle, "id", "left")
        .select("name", counted.alias("ancestors"), (~beyond).alias("exact"))
    )
