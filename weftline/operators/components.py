"""Weakly connected components by alternating large-star and small-star steps.

The published bound is O(log^2 n) rounds (Kiveris et al., 2014).  Every round writes its edge table to the
shared checkpoint folder, so the plan does not grow and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.ordered import ranked
from weftline.runtime import delete_path, materialize, scratch_path, write_table


def _stars(links: DataFrame) -> DataFrame:
    """One large-star step followed by one small-star step on distinct (u, v) pairs with u > v."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # least neighbour of every node, itself included: partial aggregation keeps a hub cheap
    # written, so that the join splits a hub: the exchange of an aggregate on the join's own key cannot be
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    large = (
        both.join(least, "u")
        .where("v > u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u <> v")
        .distinct()
    )
    large = materialize(large, "large-star")
    lowest = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
    small = (
        large.join(lowest, "u")
        .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        .where("u <> v")
        .distinct()
    )
    return small


def _is_star_forest(links: DataFrame) -> bool:
    """Every node hangs on one centre and no centre hangs on another: the stars are then the components."""
    centres = links.select(F.col("v").alias("u")).distinct()
    if not links.join(centres, "u", "left_semi").isEmpty():
        return False
    return links.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def representatives(links: DataFrame) -> DataFrame:
    """(id, least_id) of the links (u, v) for every id whose component has a smaller one."""
    spark = links.sparkSession
    base = scratch_path(spark, "stars")
    links = write_table(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(),
        f"{base}/0",
    )
    round_no = 0
    while not _is_star_forest(links):
        round_no += 1
        links = write_table(_stars(links), f"{base}/{round_no}")
        delete_path(spark, f"{base}/{round_no - 1}")
    return links.select(F.col("u").alias("id"), F.col("v").alias("least_id"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, representative, cluster_id): least member name and its 0-based rank; isolated tables on their own.

    Names become numbers in name order first: the rounds then move two longs per link and aggregate by hash,
    and the least number is the least name.
    """
    ids = ranked(nodes.select("name"), [F.col("name")], "id")
    links = (
        edges.join(ids.select(F.col("name").alias("src"), F.col("id").alias("u")), "src")
        .join(ids.select(F.col("name").alias("dst"), F.col("id").alias("v")), "dst")
        .select("u", "v")
    )
    members = materialize(
        ids.join(representatives(links), "id", "left").select(
            "id", "name", F.coalesce("least_id", "id").alias("least_id")
        ),
        "members",
    )
    heads = members.where("id = least_id").select("least_id", F.col("name").alias("representative"))
    numbered = ranked(heads, [F.col("least_id")], "cluster_id")
    return members.join(numbered, "least_id").select("name", "representative", "cluster_id")


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("cluster_id", "representative").agg(F.count(F.lit(1)).alias("members"))


def component_members(components: DataFrame) -> DataFrame:
    """(cluster_id, position, name): members in name order, as rows so that a giant component stays spread."""
    placed = ranked(components, [F.col("cluster_id"), F.col("name")], "_pos")
    first = materialize(placed.groupBy("cluster_id").agg(F.min("_pos").alias("_first")), "first")  # a giant component is split
    return placed.join(first, "cluster_id").select(
        "cluster_id", (F.col("_pos") - F.col("_first")).alias("position"), "name"
    )
