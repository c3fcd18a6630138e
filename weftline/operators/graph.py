"""Table-level lineage graph from a job catalogue.

Jobs: ``ord, source, name, description, sql, input_tables, output_tables``.  The jobs behind an edge and the
members of a component are kept as rows, not as arrays: a hot edge may carry a large share of all jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.names import LAYERS, is_blank, layer_of, short_name

DEFAULT_SEARCH_LIMIT = 50


def duplicate_names(jobs: DataFrame) -> DataFrame:
    """Names that occur on more than one record."""
    return jobs.groupBy("name").agg(F.count(F.lit(1)).alias("records")).where("records > 1")


def assert_unique_names(jobs: DataFrame) -> DataFrame:
    clash = duplicate_names(jobs).limit(5).collect()
    if clash:
        raise ValueError("duplicate job names: " + ", ".join(repr(r["name"]) for r in clash))
    return jobs


def _pairs(jobs: DataFrame) -> DataFrame:
    return (
        jobs.select("name", F.explode(F.array_distinct("input_tables")).alias("src"), "output_tables")
        .select("name", "src", F.explode(F.array_distinct("output_tables")).alias("dst"))
        .where(F.lower("src") != F.lower("dst"))
    )


def edge_jobs(jobs: DataFrame, unique_names: bool = False) -> DataFrame:
    """(src, dst, name): the jobs behind every edge.  Unique names make the rows distinct without a shuffle."""
    rows = _pairs(jobs).select("src", "dst", "name")
    return rows if unique_names else rows.distinct()


def lineage_edges(jobs: DataFrame, unique_names: bool = False) -> DataFrame:
    """(src, dst, weight); weight is the number of distinct non-blank job names, at least 1."""
    named = F.count(F.when(~is_blank(F.col("name")), F.lit(1)))
    return (
        edge_jobs(jobs, unique_names)
        .groupBy("src", "dst")
        .agg(F.greatest(named, F.lit(1)).cast("bigint").alias("weight"))
    )


def table_usage(jobs: DataFrame) -> DataFrame:
    """(name, producing_sql_count, consuming_sql_count): one pass over the records, each counted once per table."""
    tagged = F.concat(
        F.transform(F.array_distinct("output_tables"), lambda t: F.struct(t.alias("name"), F.lit(1).alias("made"))),
        F.transform(F.array_distinct("input_tables"), lambda t: F.struct(t.alias("name"), F.lit(0).alias("made"))),
    )
    return (
        jobs.select(F.explode(tagged).alias("t"))
        .groupBy(F.col("t.name").alias("name"))
        .agg(
            F.sum("t.made").cast("bigint").alias("producing_sql_count"),
            F.sum(F.lit(1) - F.col("t.made")).cast("bigint").alias("consuming_sql_count"),
        )
    )


def lineage_nodes(jobs: DataFrame) -> DataFrame:
    """Every table named as input or output, self-loop records included."""
    return table_usage(jobs).select("name", short_name(F.col("name")).alias("short_name"), layer_of(F.col("name")).alias("layer"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of ``nodes`` (name, …) with in_degree and out_degree, 0 where a table has no neighbour."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("dst").alias("name"), F.lit(1).alias("incoming")),
                F.struct(F.col("src").alias("name"), F.lit(0).alias("incoming")),
            )
        ).alias("e")
    )
    counted = ends.groupBy(F.col("e.name").alias("name")).agg(
        F.sum("e.incoming").alias("in_degree"), F.sum(F.lit(1) - F.col("e.incoming")).alias("out_degree")
    )
    return nodes.join(counted, "name", "left").select(
        *nodes.columns,
        F.coalesce("in_degree", F.lit(0)).cast("bigint").alias("in_degree"),
        F.coalesce("out_degree", F.lit(0)).cast("bigint").alias("out_degree"),
    )


def table_cards(jobs: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per table with layer, degrees, usage counts and the leaf / source flags."""
    return degrees(table_usage(jobs), edges).select(
        "name",
        short_name(F.col("name")).alias("short_name"),
        layer_of(F.col("name")).alias("layer"),
        "in_degree",
        "out_degree",
        "producing_sql_count",
        "consuming_sql_count",
        (F.col("out_degree") == 0).alias("is_leaf"),
        (F.col("in_degree") == 0).alias("is_source"),
    )


def leaf_tables(cards: DataFrame) -> DataFrame:
    return cards.where("out_degree = 0").orderBy("name")


def source_tables(cards: DataFrame) -> DataFrame:
    return cards.where("in_degree = 0").orderBy("name")


def index_order() -> list[Column]:
    """Order of the stable index: leaves first, then layer, then name."""
    return [F.col("is_leaf").desc(), F.col("layer"), F.col("name")]


def layer_distribution(cards: DataFrame) -> DataFrame:
    return cards.groupBy("layer").agg(F.count(F.lit(1)).alias("tables"))


def overview(cards: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    """One row of totals and tables per layer; every part is a one-row aggregate."""
    tables = cards.agg(
        F.count(F.lit(1)).alias("table_count"),
        F.count_if("is_leaf").alias("leaf_count"),
        F.count_if("is_source").alias("source_count"),
        *[F.count_if(F.col("layer") == layer).alias(f"layer_{layer.lower()}") for layer in LAYERS],
    )
    links = edges.agg(F.count(F.lit(1)).alias("edge_count"))
    # a component is counted at its representative, so no distinct is needed
    groups = components.agg(F.count_if(F.col("name") == F.col("representative")).alias("component_count"))
    one = F.lit(1)
    return (
        tables.withColumn("_one", one)
        .join(links.withColumn("_one", one), "_one")
        .join(groups.withColumn("_one", one), "_one")
        .drop("_one")
    )


def table_list(cards: DataFrame, scope: str = "leaves", keyword: str | None = None) -> DataFrame:
    """Cards of a scope (leaves, sources, all; anything else means leaves) whose name contains the keyword."""
    wanted = (scope or "leaves").strip().lower()
    rows = cards
    if wanted == "sources":
        rows = rows.where("in_degree = 0")
    elif wanted != "all":
        rows = rows.where("out_degree = 0")
    word = (keyword or "").strip().lower()
    if word:
        rows = rows.where(F.contains(F.lower("name"), F.lit(word)))
    return rows.orderBy("name")


def search_tables(cards: DataFrame, keyword: str | None, limit: int = DEFAULT_SEARCH_LIMIT) -> DataFrame:
    """Top matches: prefix hits first, then leaves, then by name; a blank keyword lists by name."""
    word = (keyword or "").strip().lower()
    if not word:
        return cards.orderBy("name").limit(max(1, limit))
    lowered = F.lower("name")
    return (
        cards.where(F.contains(lowered, F.lit(word)))
        .orderBy(lowered.startswith(word).desc(), F.col("is_leaf").desc(), "name")
        .limit(max(1, limit))
    )


def upstream_of(edges: DataFrame, name: str) -> DataFrame:
    return _upstream(edges, name).orderBy("name")


def _upstream(edges: DataFrame, name: str) -> DataFrame:
    return edges.where(F.col("dst") == name).select(F.col("src").alias("name"), "weight")


def downstream_of(edges: DataFrame, name: str) -> DataFrame:
    return _downstream(edges, name).orderBy("name")


def _downstream(edges: DataFrame, name: str) -> DataFrame:
    return edges.where(F.col("src") == name).select(F.col("dst").alias("name"), "weight")


def producers_of(jobs: DataFrame, name: str) -> DataFrame:
    return _producers(jobs, name).orderBy(F.col("name").asc_nulls_last())


def _producers(jobs: DataFrame, name: str) -> DataFrame:
    return jobs.where(F.array_contains("output_tables", name))


def consumers_of(jobs: DataFrame, name: str) -> DataFrame:
    return jobs.where(F.array_contains("input_tables", name)).orderBy(F.col("name").asc_nulls_last())


def table_detail(cards: DataFrame, components: DataFrame, name: str) -> DataFrame:
    """Card of one table with its component; empty for an unknown table."""
    return cards.where(F.col("name") == name).join(
        components.where(F.col("name") == name).select("name", "cluster_id"), "name", "left"
    )


def table_relations(jobs: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(relation, name, JOB_FIELDS): upstream and downstream tables, and the full records of the producing jobs."""
    near = (
        _upstream(edges, name)
        .select(F.lit("upstream").alias("relation"), "name")
        .unionByName(_downstream(edges, name).select(F.lit("downstream").alias("relation"), "name"))
    )
    made = _producers(jobs, name).select(F.lit("producer").alias("relation"), "name", *JOB_FIELDS)
    return near.unionByName(made, allowMissingColumns=True)


JOB_FIELDS = ["source", "description", "sql", "input_tables", "output_tables"]


def edge_detail(
    jobs: DataFrame, src: str, dst: str, links: DataFrame | None = None, unique_names: bool = False
) -> DataFrame:
    """Jobs behind one edge with full records; a missing edge gives one row with edge_exists = false, weight 0.

    The jobs of an edge are the records that hold both names, so one filtered scan finds them.  Where names repeat,
    all records of a name that makes the edge belong to it.  ``links`` (src, dst, name) names the jobs of edges that
    come from elsewhere; a name without a record then stands alone.
    """
    records = jobs.select("name", *JOB_FIELDS)
    real = F.lit(src.lower() != dst.lower())  # a table is no neighbour of itself
    rows = records.where(real & F.array_contains("input_tables", src) & F.array_contains("output_tables", dst))
    names = rows.select("name")
    if links is not None:
        names = links.where((F.col("src") == src) & (F.col("dst") == dst)).select("name").distinct()
        rows = names.join(records, "name", "left")
    elif not unique_names:
        names = names.distinct()
        rows = records.join(names.withColumnRenamed("name", "_name"), F.col("name").eqNullSafe(F.col("_name")), "left_semi")
    weight = names.agg(
        F.count(F.lit(1)).alias("_n"), F.count(F.when(~is_blank(F.col("name")), F.lit(1))).alias("_named")
    )
    head = weight.select(
        F.lit(src).alias("src"),
        F.lit(dst).alias("dst"),
        (F.col("_n") > 0).alias("edge_exists"),
        F.when(F.col("_n") > 0, F.greatest("_named", F.lit(1))).otherwise(0).cast("bigint").alias("weight"),
    )
    found = rows.join(F.broadcast(head), F.col("edge_exists"))  # head is always exactly one row
    return head.where(~F.col("edge_exists")).unionByName(found, allowMissingColumns=True)


def resolve_sqls(jobs: DataFrame, name: str) -> DataFrame:
    """Producers of the table of that name; without any, the job of that name; else nothing."""
    made = jobs.where(F.array_contains("output_tables", name)).select("name", *JOB_FIELDS)
    has_producer = made.limit(1).select(F.lit(True).alias("_found"))
    named = (
        jobs.where(F.col("name") == name)
        .select("name", *JOB_FIELDS)
        .join(has_producer, F.lit(True), "left_anti")
    )
    return made.unionByName(named).orderBy(F.col("name").asc_nulls_last())
