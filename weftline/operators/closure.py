"""Upstream closures, subgraphs and hop profiles.

The closure walks against the edges one hop per round.  Hops of all rounds live in one table, partitioned by
hop, in the shared checkpoint folder.  Very long chains switch to reach doubling, where each round doubles the
number of hops covered, as long as the walk table stays near the size of the edge table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.runtime import materialize, scratch_path

DEFAULT_DEPTH = 6
DOUBLING_AFTER = 24     # hops walked one by one before doubling is tried
WALK_GROWTH = 8         # a join of walks beyond this multiple of the edge table is not made; hops go on one by one


def _level_schema(with_hop: bool) -> T.StructType:
    fields = [T.StructField("seed", T.StringType()), T.StructField("name", T.StringType())]
    return T.StructType(fields + ([T.StructField("hop", T.IntegerType())] if with_hop else []))


def upstream_closure(edges: DataFrame, seeds: DataFrame, depth: int = DEFAULT_DEPTH) -> DataFrame:
    """(seed, name, distance): shortest hop of every table upstream of each seed, the seed at 0.

    ``depth`` of 0 or less is unlimited.  Cycles end because visited pairs are removed.
    """
    spark = edges.sparkSession
    links = materialize(edges.select("src", "dst"), "links")  # read in every round, so built once
    base = scratch_path(spark, "closure")

    def write_level(level: DataFrame, hop: int) -> DataFrame:
        level.write.parquet(f"{base}/hop={hop}")
        return spark.read.schema(_level_schema(False)).parquet(f"{base}/hop={hop}")

    def visited() -> DataFrame:
        return spark.read.schema(_level_schema(True)).parquet(base)

    frontier = write_level(seeds.select(F.col("name").alias("seed"), "name").distinct(), 0)
    hop, doubling = 0, depth <= 0
    while True:
        if 0 < depth <= hop:
            break
        if doubling and hop >= DOUBLING_AFTER:
            doubling = False
            complete = _double(links, visited().select("seed", "name", F.col("hop").alias("distance")), hop)
            if complete is not None:
                return complete
        step = (
            frontier.join(links, frontier["name"] == links["dst"])
            .select("seed", F.col("src").alias("name"))
            .distinct()
            .join(visited().select("seed", "name"), ["seed", "name"], "left_anti")
        )
        hop += 1
        frontier = write_level(step, hop)
        if frontier.isEmpty():
            break
    return visited().select("seed", "name", F.col("hop").alias("distance"))


def _double(links: DataFrame, reach: DataFrame, hops: int) -> DataFrame | None:
    """Complete a closure that already holds all hops 0..hops; None when the walk table grows too dense.

    ``walk`` holds the pairs joined by a walk of exactly ``stride`` edges.  All hops below ``stride`` are known,
    so one join with ``walk`` yields the hops stride .. 2*stride-1.
    """
    allowed = WALK_GROWTH * max(links.count(), 1)
    walk, stride = links, 1
    while stride * 2 <= hops + 1:
        if _square_size(walk) > allowed:
            return None
        walk, stride = _square(walk), stride * 2
    size = reach.count()
    while True:
        farther = (
            reach.join(walk, reach["name"] == walk["dst"])
            .select("seed", F.col("src").alias("name"), (F.col("distance") + stride).alias("distance"))
        )
        reach = materialize(
            reach.unionByName(farther).groupBy("seed", "name").agg(F.min("distance").alias("distance")), "reach"
        )
        known = reach.count()
        if known == size:
            return reach
        size = known
        if _square_size(walk) > allowed:
            return None
        walk, stride = _square(walk), stride * 2


def _square_size(walk: DataFrame) -> int:
    """Pairs that the join in ``_square`` would make, from the two degree counts of every table."""
    incoming = walk.groupBy(F.col("dst").alias("via")).agg(F.count(F.lit(1)).alias("i"))
    outgoing = walk.groupBy(F.col("src").alias("via")).agg(F.count(F.lit(1)).alias("o"))
    return incoming.join(outgoing, "via").agg(F.sum(F.col("i") * F.col("o"))).first()[0] or 0


def _square(walk: DataFrame) -> DataFrame:
    left = walk.select("src", F.col("dst").alias("via"))
    right = walk.select(F.col("src").alias("via"), "dst")
    return materialize(left.join(right, "via").select("src", "dst").distinct(), "walk")


def subgraph_nodes(edges: DataFrame, nodes: DataFrame, focus: str, depth: int = DEFAULT_DEPTH) -> DataFrame:
    """(name, distance, direction, is_focus): the upstream closure plus the direct downstream tables at -1."""
    seed = nodes.where(F.col("name") == focus).select("name")
    up = upstream_closure(edges, seed, depth).select("name", "distance")
    known = seed.withColumnRenamed("name", "src")
    down = (
        edges.where(F.col("src") == focus)
        .join(known, "src", "left_semi")
        .select(F.col("dst").alias("name"))
        .distinct()
        .join(up, "name", "left_anti")
        .select("name", F.lit(-1).alias("distance"))
    )
    return up.unionByName(down).select(
        "name",
        "distance",
        F.when(F.col("distance") == 0, "focus")
        .when(F.col("distance") > 0, "upstream")
        .otherwise("downstream")
        .alias("direction"),
        (F.col("distance") == 0).alias("is_focus"),
    )


def max_upstream_depth(sub_nodes: DataFrame) -> DataFrame:
    return sub_nodes.agg(F.greatest(F.coalesce(F.max("distance"), F.lit(0)), F.lit(0)).alias("max_upstream_depth"))


def induced_edges(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with both ends in ``names``."""
    inside = names.select("name")
    return edges.join(inside, edges["src"] == inside["name"], "left_semi").join(
        inside, F.col("dst") == inside["name"], "left_semi"
    )


def subgraph(edges: DataFrame, nodes: DataFrame, focus: str, depth: int = DEFAULT_DEPTH) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the view around one table.  The jobs of the edges come from ``subgraph_edge_jobs``."""
    sub_nodes = materialize(subgraph_nodes(edges, nodes, focus, depth), "subgraph")
    return sub_nodes, induced_edges(edges, sub_nodes)


def subgraph_edge_jobs(links: DataFrame, sub_edges: DataFrame) -> DataFrame:
    """(src, dst, name) of the jobs behind the edges of a subgraph."""
    return links.join(sub_edges.select("src", "dst"), ["src", "dst"], "left_semi")


def hop_profile(sub_nodes: DataFrame, cards: DataFrame) -> DataFrame:
    """Tables per distance and layer."""
    return (
        sub_nodes.join(cards.select("name", "layer"), "name")
        .groupBy("distance", "layer")
        .agg(F.count(F.lit(1)).alias("tables"))
    )
