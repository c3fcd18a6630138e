"""The registered queries: for every operator a DataFrame query and, where SQL can say it, the same in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.functions import jsontext, names, text, tokens
from weftline.operators import catalog, closure, components, cycles, graph, graphstore, history, jsonops, metrics, ordered, selectitems, sqlcorpus, textdiff
from weftline.plans import views as v
from weftline.runtime import configure, materialize, scratch_path
from weftline.sources import history_files, jobs as job_source, sql_batch
from weftline.streaming import keyed

Query = Callable[[SparkSession, str], DataFrame]
FOCUS = "rpt_region_0"
MIDDLE = "dws_region_1"

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def with_sql(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(parts)


def _joined(column: str | Column) -> Column:
    return F.array_join(column, ",")


# Job names are unique by construction, which spares the distinct; a test checks the view.
def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.lineage_edges(v.jobs(spark, sf_dir), unique_names=True)


RECORD_SQL = (
    "source, description, sql, array_to_string(input_tables, ',') AS inputs, array_to_string(output_tables, ',') AS outputs"
)


def _flat_record(rows: DataFrame) -> DataFrame:
    """Full job records with the two table lists as text, so that the comparison is on plain values."""
    lists = {"inputs": F.array_join("input_tables", ","), "outputs": F.array_join("output_tables", ",")}
    return rows.withColumns(lists).drop("input_tables", "output_tables")


def _catalogue(spark: SparkSession, sf_dir: str, *texts: str) -> tuple[DataFrame, DataFrame]:
    """Catalogue and edges as written tables, for queries that use them several times; texts only on demand."""
    jobs = materialize(v.jobs(spark, sf_dir).select("name", "input_tables", "output_tables", *texts), "jobs")
    return jobs, materialize(graph.lineage_edges(jobs, unique_names=True), "edges")


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, edges = _catalogue(spark, sf_dir)
    return graph.table_cards(jobs, edges)


# ------------------------------------------------------------------------------------------------- sources (S)


RAW_LISTS = "WITH raw AS (SELECT p_partkey, p_size, '`' || replace(p_name, ' ', '`, ') || '; null ;' || p_type || '，NULL' AS t FROM part)"


def _raw_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "part").select(
        "p_partkey",
        "p_size",
        F.concat(F.lit("`"), F.replace("p_name", F.lit(" "), F.lit("`, ")), F.lit("; null ;"), "p_type", F.lit("，NULL")).alias("t"),
    )


@query(
    "parse_table_list",
    RAW_LISTS
    + """ SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_type ELSE split_part(replace(replace(t, '`', ''), ' ', ''), ';', 1)
          || ',' || p_type END AS tables
          FROM raw JOIN part USING (p_partkey, p_size)""",
)
def parse_table_list(spark, sf_dir):
    raw = _raw_lists(spark, sf_dir).join(v.table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_partkey")
    first = F.when(F.col("p_size") % 3 == 0, F.lit(" ;null,``")).otherwise(F.col("t"))
    return raw.select("p_partkey", _joined(names.parse_table_list(first, F.col("p_type"))).alias("tables"))


@query(
    "split_tables",
    RAW_LISTS
    + """ SELECT p_partkey, array_to_string(list_filter(list_transform(string_split_regex(t, '[,;，]'), lambda x: trim(x)),
          lambda x: x <> ''), ',') AS tables FROM raw""",
)
def split_tables(spark, sf_dir):
    return _raw_lists(spark, sf_dir).select("p_partkey", _joined(names.split_tables(F.col("t"))).alias("tables"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One catalogue document per order with three records, one of them without a name."""
    key, part = F.col("o_orderkey"), F.col("o_custkey") % 7

    def record(name: Column, inputs: Column) -> Column:
        return F.concat(
            F.lit('{"name":"'), name, F.lit('","sql":"select 1","inputTables":'), inputs,
            F.lit(',"outputtables":"t'), part.cast("string"), F.lit('"}'),
        )

    records = F.concat_ws(
        ",",
        record(v._cat("o", key), v._cat('["c', F.col("o_custkey"), '",null,"a;b"]')),
        record(F.lit(" "), F.lit('"lost"')),
        record(v._cat("p", key), F.lit('"x ; `y`，null"')),
    )
    listed = F.concat(F.lit("["), records, F.lit("]"))
    return v.table(spark, sf_dir, "orders").select(
        F.when(key % 2 == 0, F.concat(F.lit('{"records":'), listed, F.lit("}"))).otherwise(listed).alias("value")
    )


@query(
    "job_documents",
    """SELECT 'o' || o_orderkey AS name, 'select 1' AS sql, 'c' || o_custkey || '|a;b' AS inputs, 't' || (o_custkey % 7) AS outputs FROM orders
       UNION ALL SELECT 'p' || o_orderkey, 'select 1', 'x|y', 't' || (o_custkey % 7) FROM orders""",
)
def job_documents(spark, sf_dir):
    jobs = job_source.jobs_from_documents(_documents(spark, sf_dir))
    return jobs.select(
        "name",
        "sql",
        F.array_join("input_tables", "|").alias("inputs"),
        F.array_join("output_tables", "|").alias("outputs"),
    )


JOB_ROWS = "SELECT name, sql, array_to_string(input_tables, ',') AS inputs, array_to_string(output_tables, ',') AS outputs FROM jobs"


@query("job_snapshot", with_sql(v.JOBS_SQL) + JOB_ROWS)
def job_snapshot(spark, sf_dir):
    """Validate, write as a new version, switch the pointer, read the current version back."""
    root = scratch_path(spark, "snapshot")
    job_source.replace_snapshot(v.jobs(spark, sf_dir), root)
    return job_source.current_snapshot(spark, root).select(
        "name", "sql", _joined("input_tables").alias("inputs"), _joined("output_tables").alias("outputs")
    )


@query(
    "nameless_jobs_dropped",
    """SELECT count(*) AS kept FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE p_name END AS n FROM part)
       WHERE n IS NOT NULL AND trim(n) <> ''""",
)
def nameless_jobs_dropped(spark, sf_dir):
    rule = F.col("p_partkey") % 4
    named = v.table(spark, sf_dir, "part").select(
        F.when(rule == 0, F.lit(None)).when(rule == 1, F.lit("  ")).otherwise(F.col("p_name")).alias("name")
    )
    return named.where(~names.is_blank(F.col("name"))).agg(F.count(F.lit(1)).alias("kept"))


@query(
    "duplicate_job_names",
    with_sql(v.JOBS_SQL)
    + """, doubled AS (SELECT name FROM jobs UNION ALL SELECT name FROM jobs WHERE ord % 10 = 0 AND source = 'orders')
         SELECT name, count(*) AS records FROM doubled GROUP BY name HAVING count(*) > 1""",
)
def duplicate_job_names(spark, sf_dir):
    jobs = v.jobs(spark, sf_dir).select("ord", "source", "name")
    again = jobs.where("ord % 10 = 0 and source = 'orders'")
    return graph.duplicate_names(jobs.unionByName(again))


@query(
    "sql_batch",
    """SELECT printf('sql-%04d', n) AS sql_id, sql, meta, count(*) AS copies FROM (
         SELECT 1 AS n, 'select * from t' || (o_custkey % 3) AS sql, '1' AS meta FROM orders WHERE o_orderkey % 2 = 0
         UNION ALL SELECT 2, 'select 2', NULL FROM orders WHERE o_orderkey % 2 = 0
         UNION ALL SELECT 1, 'delete from t' || (o_custkey % 3), NULL FROM orders WHERE o_orderkey % 2 = 1
         UNION ALL SELECT 2, 'select 3', NULL FROM orders WHERE o_orderkey % 2 = 1)
       GROUP BY n, sql, meta""",
)
def sql_batch_query(spark, sf_dir):
    """One batch document per order: JSON arrays for even keys, delimited text for odd ones."""
    target = (F.col("o_custkey") % 3).cast("string")
    as_json = F.concat(F.lit(' [{"sql":" select * from t'), target, F.lit('","metadata":{"k":1}}, "select 2"]'))
    as_text = F.concat(F.lit("-- @SQL\n\ndelete from t"), target, F.lit("\n  --  @SQL \nselect 3"))
    documents = v.table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 2 == 0, as_json).otherwise(as_text).alias("value")
    )
    batch = sql_batch.parse_sql_batch(documents)
    return batch.groupBy("sql_id", "sql", F.col("metadata")["k"].alias("meta")).agg(F.count(F.lit(1)).alias("copies"))


# ------------------------------------------------------------------------------------------------- lineage (L)


@query("lineage_edges", with_sql(v.JOBS_SQL) + "SELECT * FROM edges")
def lineage_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query("edge_jobs", with_sql(v.JOBS_SQL) + "SELECT * FROM edge_jobs")
def edge_jobs(spark, sf_dir):
    return graph.edge_jobs(v.jobs(spark, sf_dir), unique_names=True)


@query(
    "edge_weight",
    with_sql(v.JOBS_SQL)
    + """, renamed AS (SELECT CASE WHEN ord % 3 = 0 THEN ' ' WHEN ord % 3 = 1 THEN 'same' ELSE name END AS name,
           input_tables, output_tables FROM jobs),
         pairs AS (SELECT name, src, unnest(output_tables) AS dst FROM (SELECT name, unnest(input_tables) AS src, output_tables FROM renamed))
         SELECT src, dst, greatest(count(DISTINCT CASE WHEN trim(name) <> '' THEN name END), 1) AS weight
         FROM pairs WHERE lower(src) <> lower(dst) GROUP BY src, dst""",
)
def edge_weight(spark, sf_dir):
    """Weights when names repeat and are blank."""
    name = F.when(F.col("ord") % 3 == 0, " ").when(F.col("ord") % 3 == 1, "same").otherwise(F.col("name"))
    return graph.lineage_edges(v.jobs(spark, sf_dir).withColumn("name", name))


@query("lineage_nodes", with_sql(v.JOBS_SQL) + "SELECT name, short_name, layer FROM cards")
def lineage_nodes(spark, sf_dir):
    return graph.lineage_nodes(v.jobs(spark, sf_dir))


@query(
    "layer_of",
    """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'ODS' WHEN 1 THEN 'DWD' WHEN 2 THEN 'DWS' WHEN 3 THEN 'ADS'
         WHEN 4 THEN 'ADS' WHEN 5 THEN 'UNKNOWN' WHEN 6 THEN 'DIM' ELSE 'UNKNOWN' END AS layer,
         ['ODS_x','dwd','Dws_y','ads1','rpt_z','rptz','dimension','x_ods'][p_partkey % 8 + 1] || p_size AS short_name
       FROM part""",
)
def layer_of(spark, sf_dir):
    prefix = F.array(*[F.lit(x) for x in ["ODS_x", "dwd", "Dws_y", "ads1", "rpt_z", "rptz", "dimension", "x_ods"]])
    name = F.concat(F.lit("ods.app."), F.get(prefix, (F.col("p_partkey") % 8).cast("int")), F.col("p_size").cast("string"))
    part = v.table(spark, sf_dir, "part").select("p_partkey", name.alias("n"))
    return part.select("p_partkey", names.layer_of(F.col("n")).alias("layer"), names.short_name(F.col("n")).alias("short_name"))


@query("degrees", with_sql(v.JOBS_SQL) + "SELECT name, in_degree, out_degree FROM cards")
def degrees(spark, sf_dir):
    jobs, edges = _catalogue(spark, sf_dir)
    return graph.degrees(graph.lineage_nodes(jobs).select("name"), edges)


@query("table_usage", with_sql(v.JOBS_SQL) + "SELECT name, producing_sql_count, consuming_sql_count FROM cards")
def table_usage(spark, sf_dir):
    return graph.table_usage(v.jobs(spark, sf_dir))


@query("leaf_tables", with_sql(v.JOBS_SQL) + "SELECT * FROM cards WHERE is_leaf")
def leaf_tables(spark, sf_dir):
    return graph.leaf_tables(_cards(spark, sf_dir))


@query("source_tables", with_sql(v.JOBS_SQL) + "SELECT * FROM cards WHERE is_source")
def source_tables(spark, sf_dir):
    return graph.source_tables(_cards(spark, sf_dir))


def _components(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    jobs, edges = _catalogue(spark, sf_dir)
    return jobs, edges, components.components(graph.lineage_nodes(jobs), edges)


@query("components", with_sql(v.JOBS_SQL, v.COMPONENTS_SQL, recursive=True) + "SELECT * FROM components")
def components_query(spark, sf_dir):
    return _components(spark, sf_dir)[2]


def _stored(spark: SparkSession, sf_dir: str) -> graphstore.Store:
    """The catalogue in two changes, with jobs that come in the first and go in the second."""
    root = scratch_path(spark, "graph-store")
    jobs = materialize(v.jobs(spark, sf_dir).select("name", *graph.JOB_FIELDS), "jobs")
    late = F.crc32("name") % 4 == 0
    passing = jobs.where(F.crc32("name") % 5 == 1).withColumns(
        {"name": F.concat("name", F.lit("_old")), "output_tables": F.transform("output_tables", lambda t: F.concat(t, F.lit("_old")))}
    )
    graphstore.apply_changes(spark, root, jobs.where(~late).unionByName(passing))
    return graphstore.apply_changes(spark, root, jobs.where(late), passing)


@query("stored_edges", with_sql(v.JOBS_SQL) + "SELECT * FROM edges")
def stored_edges(spark, sf_dir):
    return _stored(spark, sf_dir).edges()


@query("stored_cards", with_sql(v.JOBS_SQL) + "SELECT * FROM cards")
def stored_cards(spark, sf_dir):
    return _stored(spark, sf_dir).cards()


@query("stored_components", with_sql(v.JOBS_SQL, v.COMPONENTS_SQL, recursive=True) + "SELECT * FROM components")
def stored_components(spark, sf_dir):
    return _stored(spark, sf_dir).components()


@query(
    "stored_producers",
    with_sql(v.JOBS_SQL) + "SELECT name, description, sql FROM jobs WHERE list_contains(output_tables, 'dwd_nation_5')",
)
def stored_producers(spark, sf_dir):
    return _stored(spark, sf_dir).producers_of("dwd_nation_5").select("name", "description", "sql")


@query(
    "component_members",
    with_sql(v.JOBS_SQL, v.COMPONENTS_SQL, recursive=True)
    + "SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY name) - 1 AS position, name FROM components",
)
def component_members(spark, sf_dir):
    return components.component_members(_components(spark, sf_dir)[2])


@query(
    "component_sizes",
    with_sql(v.JOBS_SQL, v.COMPONENTS_SQL, recursive=True)
    + "SELECT cluster_id, representative, count(*) AS members FROM components GROUP BY ALL",
)
def component_sizes(spark, sf_dir):
    return components.component_sizes(_components(spark, sf_dir)[2])


@query(
    "stable_index",
    with_sql(v.JOBS_SQL)
    + "SELECT name, layer, is_leaf, row_number() OVER (ORDER BY is_leaf DESC, layer, name) - 1 AS idx FROM cards",
)
def stable_index(spark, sf_dir):
    return ordered.ranked(_cards(spark, sf_dir).select("name", "layer", "is_leaf"), graph.index_order(), "idx")


@query(
    "overview",
    with_sql(v.JOBS_SQL, v.COMPONENTS_SQL, recursive=True)
    + """SELECT (SELECT count(*) FROM cards) AS table_count, (SELECT count(*) FROM edges) AS edge_count,
           (SELECT count(*) FROM cards WHERE is_leaf) AS leaf_count, (SELECT count(*) FROM cards WHERE is_source) AS source_count,
           (SELECT count(DISTINCT cluster_id) FROM components) AS component_count, """
    + ", ".join(f"(SELECT count(*) FROM cards WHERE layer = '{x}') AS layer_{x.lower()}" for x in names.LAYERS),
)
def overview(spark, sf_dir):
    jobs, edges, found = _components(spark, sf_dir)
    return graph.overview(graph.table_cards(jobs, edges), edges, found)


@query("layer_distribution", with_sql(v.JOBS_SQL) + "SELECT layer, count(*) AS tables FROM cards GROUP BY layer")
def layer_distribution(spark, sf_dir):
    return graph.layer_distribution(graph.lineage_nodes(v.jobs(spark, sf_dir)))


@query("table_list", with_sql(v.JOBS_SQL) + "SELECT * FROM cards WHERE is_source AND contains(lower(name), 'supplier_1')")
def table_list(spark, sf_dir):
    return graph.table_list(_cards(spark, sf_dir), "sources", " Supplier_1 ")


@query("table_list_all", with_sql(v.JOBS_SQL) + "SELECT * FROM cards")
def table_list_all(spark, sf_dir):
    return graph.table_list(_cards(spark, sf_dir), "all")


@query(
    "search_tables",
    with_sql(v.JOBS_SQL)
    + """SELECT * FROM cards WHERE contains(lower(name), 'd')
         ORDER BY starts_with(lower(name), 'd') DESC, is_leaf DESC, name LIMIT 50""",
)
def search_tables(spark, sf_dir):
    return graph.search_tables(_cards(spark, sf_dir), "D")


@query(
    "table_detail",
    with_sql(v.JOBS_SQL, v.COMPONENTS_SQL, recursive=True)
    + f"SELECT c.*, k.cluster_id FROM cards c JOIN components k USING (name) WHERE name = '{MIDDLE}'",
)
def table_detail(spark, sf_dir):
    jobs, edges, found = _components(spark, sf_dir)
    return graph.table_detail(graph.table_cards(jobs, edges), found, MIDDLE)


@query(
    "table_relations",
    with_sql(v.JOBS_SQL)
    + f"""SELECT 'upstream' AS relation, src AS name, NULL AS source, NULL AS description, NULL AS sql, NULL AS inputs, NULL AS outputs
            FROM edges WHERE dst = 'dwd_nation_3'
          UNION ALL SELECT 'downstream', dst, NULL, NULL, NULL, NULL, NULL FROM edges WHERE src = 'dwd_nation_3'
          UNION ALL SELECT 'producer', j.name, {RECORD_SQL} FROM jobs j JOIN job_outputs o ON o.job = j.name WHERE o.tbl = 'dwd_nation_3'""",
)
def table_relations(spark, sf_dir):
    jobs, edges = _catalogue(spark, sf_dir, "source", "description", "sql")
    return _flat_record(graph.table_relations(jobs, edges, "dwd_nation_3"))


@query("upstream_tables", with_sql(v.JOBS_SQL) + "SELECT src AS name, weight FROM edges WHERE dst = 'dwd_nation_5'")
def upstream_tables(spark, sf_dir):
    return graph.upstream_of(_edges(spark, sf_dir), "dwd_nation_5")


@query("downstream_tables", with_sql(v.JOBS_SQL) + "SELECT dst AS name, weight FROM edges WHERE src = 'ods_supplier_7'")
def downstream_tables(spark, sf_dir):
    return graph.downstream_of(_edges(spark, sf_dir), "ods_supplier_7")


@query(
    "producer_jobs",
    with_sql(v.JOBS_SQL) + "SELECT name, description, sql FROM jobs WHERE list_contains(output_tables, 'dwd_nation_5')",
)
def producer_jobs(spark, sf_dir):
    return graph.producers_of(v.jobs(spark, sf_dir), "dwd_nation_5").select("name", "description", "sql")


@query(
    "consumer_jobs",
    with_sql(v.JOBS_SQL) + "SELECT name, description, sql FROM jobs WHERE list_contains(input_tables, 'ods_supplier_7')",
)
def consumer_jobs(spark, sf_dir):
    return graph.consumers_of(v.jobs(spark, sf_dir), "ods_supplier_7").select("name", "description", "sql")


def _focus_sql(depth: int, focus: str = FOCUS) -> str:
    return with_sql(v.JOBS_SQL, v.closure_sql(f"SELECT '{focus}' AS name", depth), recursive=True)


SUB_NODES = f""", sub AS (
  SELECT name, distance FROM closure
  UNION ALL
  SELECT DISTINCT dst, -1 FROM edges WHERE src = '{{focus}}' AND dst NOT IN (SELECT name FROM closure)
)"""


def _focus(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(FOCUS,)], "name string")


@query("upstream_closure", _focus_sql(0) + "SELECT seed, name, distance FROM closure")
def upstream_closure(spark, sf_dir):
    return closure.upstream_closure(_edges(spark, sf_dir), _focus(spark), 0)


@query("upstream_closure_depth_2", _focus_sql(2) + "SELECT seed, name, distance FROM closure")
def upstream_closure_depth_2(spark, sf_dir):
    return closure.upstream_closure(_edges(spark, sf_dir), _focus(spark), 2)


@query(
    "subgraph_nodes",
    _focus_sql(6, MIDDLE)
    + SUB_NODES.format(focus=MIDDLE)
    + """SELECT name, distance, CASE WHEN distance = 0 THEN 'focus' WHEN distance > 0 THEN 'upstream' ELSE 'downstream' END
         AS direction, distance = 0 AS is_focus FROM sub""",
)
def subgraph_nodes(spark, sf_dir):
    jobs, edges = _catalogue(spark, sf_dir)
    return closure.subgraph(edges, graph.lineage_nodes(jobs), MIDDLE)[0]


@query(
    "subgraph_depth",
    _focus_sql(6, MIDDLE) + "SELECT max(distance)::INTEGER AS max_upstream_depth FROM closure",
)
def subgraph_depth(spark, sf_dir):
    jobs, edges = _catalogue(spark, sf_dir)
    return closure.max_upstream_depth(closure.subgraph_nodes(edges, graph.lineage_nodes(jobs), MIDDLE))


@query(
    "subgraph_edges",
    _focus_sql(2, MIDDLE)
    + SUB_NODES.format(focus=MIDDLE)
    + "SELECT src, dst, weight FROM edges WHERE src IN (SELECT name FROM sub) AND dst IN (SELECT name FROM sub)",
)
def subgraph_edges(spark, sf_dir):
    jobs, edges = _catalogue(spark, sf_dir)
    return closure.subgraph(edges, graph.lineage_nodes(jobs), MIDDLE, 2)[1]


@query(
    "subgraph_edge_jobs",
    _focus_sql(1, MIDDLE)
    + SUB_NODES.format(focus=MIDDLE)
    + "SELECT src, dst, name FROM edge_jobs WHERE src IN (SELECT name FROM sub) AND dst IN (SELECT name FROM sub)",
)
def subgraph_edge_jobs(spark, sf_dir):
    jobs, edges = _catalogue(spark, sf_dir)
    _, inside = closure.subgraph(edges, graph.lineage_nodes(jobs), MIDDLE, 1)
    return closure.subgraph_edge_jobs(graph.edge_jobs(jobs, unique_names=True), inside)


@query(
    "closure_all",
    with_sql(v.JOBS_SQL, v.closure_sql("SELECT name FROM cards WHERE is_leaf", 0), recursive=True)
    + "SELECT seed, name, distance FROM closure",
)
def closure_all(spark, sf_dir):
    """Full upstream closure of every leaf table."""
    jobs, edges = _catalogue(spark, sf_dir)
    return closure.upstream_closure(edges, graph.leaf_tables(graph.table_cards(jobs, edges)), 0)


CYCLIC_SQL = (
    v.JOBS_SQL
    + """,
back AS (SELECT dst AS src, src AS dst, row_number() OVER (ORDER BY dst, src) AS n FROM edges WHERE src <> dst),
linked AS (SELECT src, dst FROM edges UNION SELECT src, dst FROM back WHERE n % 5 = 0),
reach(a, b) AS (SELECT src, dst FROM linked UNION SELECT r.a, l.dst FROM reach r JOIN linked l ON l.src = r.b)"""
)
SKETCH = 32


def _cyclic(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tables of the catalogue, and its edges with every fifth also the other way round, so that there are cycles."""
    jobs, edges = _catalogue(spark, sf_dir)
    pairs = edges.select("src", "dst")
    turned = ordered.ranked(pairs.where("src <> dst"), [F.col("dst"), F.col("src")], "n").where("(n + 1) % 5 = 0")
    linked = pairs.unionByName(turned.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return materialize(graph.table_cards(jobs, edges), "cards"), materialize(linked, "linked")


@query(
    "strong_components",
    with_sql(CYCLIC_SQL, recursive=True)
    + """SELECT c.name, least(c.name, coalesce(min(r.b), c.name)) AS representative FROM cards c
         LEFT JOIN (SELECT x.a, x.b FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a) r ON r.a = c.name GROUP BY c.name""",
)
def strong_components(spark, sf_dir):
    return cycles.strong_components(*_cyclic(spark, sf_dir))


@query(
    "reachable_tables",
    with_sql(CYCLIC_SQL, recursive=True)
    + """SELECT name AS seed, name FROM cards WHERE is_leaf
         UNION SELECT r.b, r.a FROM reach r JOIN cards c ON c.name = r.b WHERE c.is_leaf""",
)
def reachable_tables(spark, sf_dir):
    """All tables upstream of the leaves, over the graph without its cycles."""
    nodes, edges = _cyclic(spark, sf_dir)
    return cycles.reachable(nodes, edges, graph.leaf_tables(nodes))


@query(
    "ancestor_counts",
    with_sql(CYCLIC_SQL, recursive=True)
    + f""", hashed AS (SELECT a, b, CAST('0x' || substr(md5(a), 1, 13) AS BIGINT) AS h FROM reach),
         others AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY h, a) AS k FROM hashed WHERE a <> b),
         counted AS (SELECT b, count(*) AS total FROM hashed GROUP BY b),
         told AS (SELECT b, count(*) AS n, max(h) FILTER (k <= {SKETCH}) AS last FROM others GROUP BY b)
         SELECT c.name, CASE WHEN coalesce(total, 0) > {SKETCH} THEN round({SKETCH - 1} * 4503599627370496.0::DOUBLE / (last + 1))::BIGINT
           ELSE coalesce(n, 0) END AS ancestors, coalesce(total, 0) <= {SKETCH} AS exact
         FROM cards c LEFT JOIN told ON told.b = c.name LEFT JOIN counted ON counted.b = c.name""",
)
def ancestor_counts(spark, sf_dir):
    return cycles.ancestor_counts(*_cyclic(spark, sf_dir), SKETCH)


@query(
    "edge_detail",
    with_sql(v.JOBS_SQL)
    + """SELECT 'ods_supplier_7' AS src, 'dwd_nation_5' AS dst, count(j.name) OVER () > 0 AS edge_exists,
           count(j.name) OVER () AS weight, j.name, j.source, j.description, j.sql,
           array_to_string(j.input_tables, ',') AS inputs, array_to_string(j.output_tables, ',') AS outputs
         FROM (SELECT 1) one LEFT JOIN (SELECT jobs.* FROM edge_jobs e JOIN jobs ON e.name = jobs.name
           WHERE e.src = 'ods_supplier_7' AND e.dst = 'dwd_nation_5') j ON true""",
)
def edge_detail(spark, sf_dir):
    return _flat_record(graph.edge_detail(v.jobs(spark, sf_dir), "ods_supplier_7", "dwd_nation_5", unique_names=True))


@query(
    "edge_detail_missing",
    """SELECT 'rpt_region_0' AS src, 'ods_supplier_1' AS dst, false AS edge_exists, 0::BIGINT AS weight,
       NULL::VARCHAR AS name, NULL::VARCHAR AS source, NULL::VARCHAR AS description, NULL::VARCHAR AS sql,
       NULL::VARCHAR AS inputs, NULL::VARCHAR AS outputs""",
)
def edge_detail_missing(spark, sf_dir):
    return _flat_record(graph.edge_detail(v.jobs(spark, sf_dir), "rpt_region_0", "ods_supplier_1", unique_names=True))


@query(
    "resolve_table_sqls",
    with_sql(v.JOBS_SQL) + f"SELECT name, {RECORD_SQL} FROM jobs WHERE list_contains(output_tables, '{MIDDLE}')",
)
def resolve_table_sqls(spark, sf_dir):
    return _flat_record(graph.resolve_sqls(v.jobs(spark, sf_dir), MIDDLE))


@query("resolve_job_sqls", with_sql(v.JOBS_SQL) + f"SELECT name, {RECORD_SQL} FROM jobs WHERE name = 'rpt_2'")
def resolve_job_sqls(spark, sf_dir):
    return _flat_record(graph.resolve_sqls(v.jobs(spark, sf_dir), "rpt_2"))


@query(
    "hop_profile",
    _focus_sql(6, MIDDLE)
    + SUB_NODES.format(focus=MIDDLE)
    + "SELECT distance, layer, count(*) AS tables FROM sub JOIN cards USING (name) GROUP BY ALL",
)
def hop_profile(spark, sf_dir):
    jobs, edges = _catalogue(spark, sf_dir)
    nodes = graph.lineage_nodes(jobs)
    return closure.hop_profile(closure.subgraph_nodes(edges, nodes, MIDDLE), nodes)


# ---------------------------------------------------------------------------------------------- SQL corpus (Q)


@query(
    "sql_tokens",
    with_sql(v.JOBS_SQL)
    + """SELECT name AS sql_id, len(string_split(regexp_replace(sql, '([();])', ' \\1 ', 'g'), ' '))
           - len(list_filter(string_split(regexp_replace(sql, '([();])', ' \\1 ', 'g'), ' '), lambda x: x = '')) + 1 AS token_count,
         '''it''''s -- kept''' AS quoted FROM jobs""",
)
def sql_tokens(spark, sf_dir):
    """Tokens of the corpus with a comment and a quoted literal added to every text."""
    commented = F.concat("sql", F.lit(" /* a ; b */ 'it''s -- kept' -- gone"))
    found = v.sql_inputs(spark, sf_dir).select("sql_id", tokens.sql_tokens(commented).alias("t"))
    return found.select("sql_id", F.size("t").cast("bigint").alias("token_count"), F.element_at("t", -1).alias("quoted"))


@query(
    "statement_kinds",
    with_sql(v.JOBS_SQL)
    + """SELECT ord, name AS sql_id, unnest(range(len(output_tables)))::INTEGER AS statement_no,
           CASE WHEN len(input_tables) > 0 THEN 'INSERT' ELSE 'CREATE_TABLE' END AS kind FROM jobs""",
)
def statement_kinds(spark, sf_dir):
    return sqlcorpus.statement_kinds(v.sql_inputs(spark, sf_dir))


@query(
    "table_refs",
    with_sql(v.JOBS_SQL)
    + f""", stmts AS (SELECT ord, name AS sql_id, unnest(range(len(output_tables)))::INTEGER AS statement_no,
           unnest(output_tables) AS o, input_tables FROM jobs),
         odd(rule, role, name) AS (VALUES {', '.join(
             f"({i}, '{role}', '{name}')" for i, (_, writes, reads) in enumerate(v.ODD_STATEMENTS)
             for role, names_ in (("write", writes), ("read", reads)) for name in names_.split(",") if name)})
         SELECT ord, sql_id, statement_no + 1 AS statement_no, 'write' AS role, o AS name FROM stmts
         UNION ALL SELECT ord, sql_id, statement_no + 1, 'read', unnest(input_tables) FROM stmts
         UNION ALL SELECT ord, jobs.name, 0, role, odd.name FROM jobs JOIN odd ON ord % {len(v.ODD_STATEMENTS)} = rule""",
)
def table_refs(spark, sf_dir):
    return sqlcorpus.table_refs(v.odd_inputs(spark, sf_dir))


@query(
    "text_facts",
    with_sql(v.JOBS_SQL, v.TEXT_FACTS_SQL)
    + """SELECT ord, sql_id, status, CASE status WHEN 'PARSE_FAILED' THEN '' WHEN 'PARTIAL' THEN kind || ',UNKNOWN' ELSE kind END AS kinds,
           CASE WHEN status = 'PARSE_FAILED' THEN '' ELSE array_to_string(list_sort(list_distinct(reads)), ',') END AS reads,
           CASE WHEN status = 'PARSE_FAILED' THEN '' ELSE array_to_string(writes, ',') END AS writes FROM texts""",
)
def text_facts(spark, sf_dir):
    """Facts made from the texts themselves."""
    facts = sqlcorpus.extract_facts(v.judged_inputs(spark, sf_dir))
    return facts.select(
        "ord", "sql_id", "status", _joined("statement_types").alias("kinds"), _joined("read_tables").alias("reads"),
        _joined("write_tables").alias("writes"),
    )


@query(
    "text_status_rollup",
    with_sql(v.JOBS_SQL, v.TEXT_FACTS_SQL)
    + """SELECT count(*) AS total, count(*) FILTER (status = 'SUCCESS') AS success, count(*) FILTER (status = 'PARTIAL') AS partial,
         0::BIGINT AS unsupported, count(*) FILTER (status = 'PARSE_FAILED') AS failed FROM texts""",
)
def text_status_rollup(spark, sf_dir):
    return sqlcorpus.status_rollup(sqlcorpus.extract_facts(v.judged_inputs(spark, sf_dir)))


@query(
    "text_profile",
    with_sql(v.JOBS_SQL, v.TEXT_FACTS_SQL)
    + """SELECT kind AS statement_type, status, count(*) AS statements FROM texts WHERE status <> 'PARSE_FAILED' GROUP BY ALL
         UNION ALL SELECT 'UNKNOWN', status, count(*) FROM texts WHERE status = 'PARTIAL' GROUP BY ALL""",
)
def text_profile(spark, sf_dir):
    return sqlcorpus.corpus_profile(sqlcorpus.extract_facts(v.judged_inputs(spark, sf_dir)))


@query(
    "text_edges",
    with_sql(v.JOBS_SQL, v.TEXT_FACTS_SQL)
    + """SELECT src, dst, count(DISTINCT sql_id) AS sql_count FROM (
           SELECT sql_id, src, unnest(writes) AS dst FROM (SELECT sql_id, unnest(reads) AS src, writes FROM texts WHERE status <> 'PARSE_FAILED'))
         WHERE lower(src) <> lower(dst) GROUP BY src, dst""",
)
def text_edges(spark, sf_dir):
    return sqlcorpus.batch_edges(sqlcorpus.extract_facts(v.judged_inputs(spark, sf_dir)))


@query(
    "blank_sql_triage",
    with_sql(v.JOBS_SQL)
    + """SELECT ord, name AS sql_id, CASE WHEN ord % 7 IN (0, 1) THEN 'PARSE_FAILED' END AS status,
         CASE WHEN ord % 7 IN (0, 1) THEN 'sql is blank' END AS error FROM jobs""",
)
def blank_sql_triage(spark, sf_dir):
    rule = F.col("ord") % 7
    inputs = v.sql_inputs(spark, sf_dir)
    return sqlcorpus.triage(
        inputs.withColumn("sql", F.when(rule == 0, F.lit(None)).when(rule == 1, F.lit(" \n\t")).otherwise(F.col("sql")))
    )


FACTS = with_sql(v.JOBS_SQL, v.SQL_FACTS_SQL)


@query(
    "status_rollup",
    FACTS
    + """SELECT count(*) AS total, count(*) FILTER (status = 'SUCCESS') AS success, count(*) FILTER (status = 'PARTIAL') AS partial,
         count(*) FILTER (status = 'UNSUPPORTED') AS unsupported, count(*) FILTER (status = 'PARSE_FAILED') AS failed FROM facts""",
)
def status_rollup(spark, sf_dir):
    return sqlcorpus.status_rollup(v.sql_facts(spark, sf_dir))


@query(
    "merged_tables",
    FACTS
    + "SELECT DISTINCT 'read' AS role, unnest(reads) AS name FROM facts UNION SELECT DISTINCT 'write', unnest(writes) FROM facts",
)
def merged_tables(spark, sf_dir):
    return sqlcorpus.merged_tables(v.sql_facts(spark, sf_dir))


BATCH_PAIRS = """, rd AS (SELECT ord, sql_id, unnest(reads) AS src, unnest(range(len(reads))) AS rp, writes FROM facts
  WHERE status IN ('SUCCESS', 'PARTIAL')),
pairs AS (SELECT ord, sql_id, src, rp, unnest(writes) AS dst, unnest(range(len(writes))) AS wp FROM rd),
keyed AS (SELECT *, lower(trim(src)) AS src_key, lower(trim(dst)) AS dst_key FROM pairs)"""


@query(
    "batch_edges",
    FACTS
    + BATCH_PAIRS
    + """ SELECT arg_min(src, (ord, rp, wp)) AS src, arg_min(dst, (ord, rp, wp)) AS dst, count(DISTINCT sql_id) AS sql_count
          FROM keyed WHERE src_key <> dst_key GROUP BY src_key, dst_key""",
)
def batch_edges(spark, sf_dir):
    return sqlcorpus.batch_edges(v.sql_facts(spark, sf_dir))


@query(
    "batch_edge_sqls",
    FACTS + BATCH_PAIRS + " SELECT DISTINCT src_key, dst_key, sql_id FROM keyed WHERE src_key <> dst_key",
)
def batch_edge_sqls(spark, sf_dir):
    return sqlcorpus.batch_edge_sqls(v.sql_facts(spark, sf_dir))


@query(
    "text_columns",
    with_sql(v.JOBS_SQL)
    + """, used AS (SELECT ord, name AS sql_id, input_tables, unnest(range(len(input_tables))) AS i FROM jobs WHERE len(input_tables) > 0)
         SELECT ord, sql_id, 0 AS statement_no, input_tables[i + 1] || '.c' || i AS column_name FROM used
         UNION SELECT ord, sql_id, 0, input_tables[1] || c FROM used, (SELECT unnest(['.k', '.f', '.d', '.e', '.g']) AS c)""",
)
def text_columns(spark, sf_dir):
    """Columns found in the texts themselves, through aliases, a common table expression and a subquery."""
    return sqlcorpus.column_refs(v.column_texts(spark, sf_dir))


@query(
    "text_column_usage",
    with_sql(v.JOBS_SQL)
    + """, used AS (SELECT name AS sql_id, input_tables, unnest(range(len(input_tables))) AS i FROM jobs WHERE len(input_tables) > 0)
         SELECT sql_id, input_tables[i + 1] || '.c' || i AS column_name FROM used
         UNION SELECT sql_id, input_tables[1] || c FROM used, (SELECT unnest(['.k', '.f', '.d', '.e', '.g']) AS c)""",
)
def text_column_usage(spark, sf_dir):
    return sqlcorpus.column_usage(sqlcorpus.extract_facts(v.column_texts(spark, sf_dir)))


@query("column_usage", FACTS + "SELECT DISTINCT sql_id, unnest(reads) || '.id' AS column_name FROM facts")
def column_usage(spark, sf_dir):
    return sqlcorpus.column_usage(v.sql_facts(spark, sf_dir))


@query(
    "corpus_profile",
    FACTS
    + """SELECT CASE WHEN has_input THEN 'INSERT' ELSE 'CREATE_TABLE' END AS statement_type, status,
         sum(CASE WHEN has_input THEN len(writes) ELSE 1 END)::BIGINT AS statements FROM facts GROUP BY ALL""",
)
def corpus_profile(spark, sf_dir):
    return sqlcorpus.corpus_profile(v.sql_facts(spark, sf_dir))


@query(
    "facts_lineage",
    FACTS
    + BATCH_PAIRS
    + " SELECT src, dst, count(DISTINCT sql_id) AS weight FROM pairs WHERE lower(src) <> lower(dst) GROUP BY src, dst",
)
def facts_lineage(spark, sf_dir):
    """Lineage edges built from the extracted facts."""
    return graph.lineage_edges(sqlcorpus.facts_to_jobs(v.sql_facts(spark, sf_dir)))


# ------------------------------------------------------------------------------------------------- metrics (K)

METRICS = with_sql(v.METRICS_SQL)


@query(
    "expression_flags",
    METRICS
    + """SELECT sql_id, 2 AS item_no, aggregation AS aggs, family = 2 AS is_distinct, family = 6 AS has_case,
           family IN (7, 8) AS has_arithmetic, family = 7 AS has_division, family = 9 AS is_window FROM metrics
         UNION ALL SELECT sql_id, 1, '', false, false, false, false, false FROM metrics""",
)
def expression_flags(spark, sf_dir):
    return metrics.expression_flags(v.metric_items(spark, sf_dir)).select(
        "sql_id", "item_no", _joined("aggs").alias("aggs"), "is_distinct", "has_case", "has_arithmetic", "has_division", "is_window"
    )


@query("metric_items_only", METRICS + "SELECT sql_id, 2 AS item_no FROM metrics")
def metric_items_only(spark, sf_dir):
    return metrics.metric_rows(v.metric_items(spark, sf_dir)).select("sql_id", "item_no")


@query("metric_classes", METRICS + "SELECT type, count(*) AS metrics FROM metrics GROUP BY type")
def metric_classes(spark, sf_dir):
    return metrics.probe_metrics(v.metric_items(spark, sf_dir)).groupBy("type").agg(F.count(F.lit(1)).alias("metrics"))


@query(
    "normal_forms",
    METRICS
    + """SELECT sql_id, 2 AS item_no, normalized_expression FROM metrics
         UNION ALL SELECT sql_id, 1, 'DEPT_' || (p_size % 5) FROM metrics""",
)
def normal_forms(spark, sf_dir):
    items = v.metric_items(spark, sf_dir)
    return items.select("sql_id", "item_no", metrics.normalize_expression(F.col("expression")).alias("normalized_expression"))


@query(
    "metric_names",
    METRICS
    + """SELECT sql_id, 2 AS item_no, name FROM named
         UNION ALL SELECT sql_id, 1, CASE WHEN even THEN 'department' ELSE 'dept_' || (p_size % 5) END FROM metrics""",
)
def metric_names(spark, sf_dir):
    items = v.metric_items(spark, sf_dir)
    return items.select("sql_id", "item_no", metrics.metric_name(F.col("alias"), F.col("expression")).alias("name"))


@query(
    "metric_dimensions",
    METRICS
    + """SELECT sql_id, 1 AS branch_no, 0 AS dim_no,
           CASE WHEN even THEN 'department' ELSE 'DEPT_' || (p_size % 5) END AS name, 'DEPT_' || (p_size % 5) AS expression FROM metrics""",
)
def metric_dimensions(spark, sf_dir):
    return metrics.metric_dimensions(v.metric_items(spark, sf_dir))


@query(
    "metric_source_columns",
    METRICS
    + """SELECT sql_id, 1 AS branch_no, 2 AS item_no, CASE WHEN family = 3 THEN 't.' || b WHEN family = 0 AND NOT even THEN lower(b)
           ELSE b END AS column_name FROM metrics WHERE family NOT IN (1, 5)
         UNION ALL SELECT sql_id, 1, 2, 's' FROM metrics WHERE family = 6
         UNION ALL SELECT sql_id, 1, 2, 'p_type' FROM metrics WHERE family = 9
         UNION ALL SELECT sql_id, 1, 1, 'dept_' || (p_size % 5) FROM metrics""",
)
def metric_source_columns(spark, sf_dir):
    return metrics.source_columns(v.metric_items(spark, sf_dir))


@query(
    "metric_filters",
    METRICS
    + """SELECT sql_id, 'p_size > ' || p_size AS where_text, CASE WHEN even THEN 'SUM(x) > 100' END AS having_text FROM metrics""",
)
def metric_filters(spark, sf_dir):
    return metrics.probe_metrics(v.metric_items(spark, sf_dir)).select("sql_id", "where_text", "having_text")


@query(
    "metric_reasons",
    METRICS
    + """SELECT sql_id, 'AGGREGATE:' || aggregation || CASE family WHEN 2 THEN '|DISTINCT' WHEN 6 THEN '|CASE'
           WHEN 7 THEN '|DIVISION' WHEN 8 THEN '|ARITHMETIC' WHEN 9 THEN '|OVER' ELSE '' END
           || coalesce('|ALIAS:' || CASE WHEN even THEN '"' || plain_alias || '"' ELSE plain_alias END, '') AS reasons FROM metrics""",
)
def metric_reasons(spark, sf_dir):
    return metrics.probe_metrics(v.metric_items(spark, sf_dir)).select("sql_id", F.array_join("reasons", "|").alias("reasons"))


@query(
    "metric_catalogue",
    METRICS
    + """SELECT sql_id, ord, 2 AS item_no, name, expression, normalized_expression, type, aggregation, family = 2 AS is_distinct,
           family = 6 AS is_conditional, family = 9 AS is_window, 'app.' || lower(p_type) AS source_tables,
           CASE WHEN family IN (1, 5) THEN '' WHEN family = 3 THEN 't.' || b WHEN family = 0 AND NOT even THEN lower(b)
             WHEN family = 6 THEN 's,' || b WHEN family = 9 THEN b || ',p_type' ELSE b END AS source_columns,
           'DEPT_' || (p_size % 5) AS dimensions FROM named""",
)
def metric_catalogue(spark, sf_dir):
    return metrics.probe_metrics(v.metric_items(spark, sf_dir)).select(
        "sql_id", "ord", "item_no", "name", "expression", "normalized_expression", "type", "aggregation", "is_distinct",
        "is_conditional", "is_window", _joined("source_tables").alias("source_tables"),
        _joined("source_columns").alias("source_columns"), _joined("dimensions").alias("dimensions"),
    )


DUPLICATES = """, dups AS (SELECT normalized_expression FROM named GROUP BY 1 HAVING count(*) > 1)"""


@query(
    "duplicate_metrics",
    METRICS
    + """SELECT normalized_expression, arg_min(expression, ord) AS expression, count(*) AS occurrence_count,
           count(DISTINCT name) AS name_count, count(DISTINCT sql_id) AS sql_count
         FROM named GROUP BY 1 HAVING count(*) > 1""",
)
def duplicate_metrics(spark, sf_dir):
    return metrics.duplicate_metrics(metrics.probe_metrics(v.metric_items(spark, sf_dir)))


@query(
    "duplicate_members",
    METRICS + DUPLICATES + "SELECT DISTINCT normalized_expression, name, sql_id FROM named JOIN dups USING (normalized_expression)",
)
def duplicate_members(spark, sf_dir):
    found = materialize(metrics.probe_metrics(v.metric_items(spark, sf_dir)), "metrics")
    return metrics.duplicate_members(found, metrics.duplicate_metrics(found))


# statements of the metric corpus: some inputs hold an INSERT, some hold nothing else, some hold none
def _metric_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    kinds = (
        F.when(key % 5 == 1, F.array(F.lit("SELECT"), F.lit("INSERT")))
        .when(key % 5 == 2, F.array(F.lit("UPDATE")))
        .when(key % 5 == 3, F.array(F.lit(None).cast("string")))
        .otherwise(F.array(F.lit("SELECT")))
    )
    return v.table(spark, sf_dir, "part").select(v._cat("sql-", key).alias("sql_id"), F.explode(kinds).alias("kind"))


def _metrics_of_selects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.probe_metrics(v.metric_items(spark, sf_dir).where("ord % 5 not in (2, 3)"))


STATUSES = """, statuses AS (SELECT 'sql-' || p_partkey AS sql_id, CASE p_partkey % 5 WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'UNSUPPORTED'
  WHEN 3 THEN 'PARSE_FAILED' ELSE 'SUCCESS' END AS status, CASE WHEN p_partkey % 5 IN (2, 3) THEN 0 ELSE 1 END::BIGINT AS metric_count FROM part)"""


@query("metric_status", METRICS + STATUSES + "SELECT * FROM statuses")
def metric_status(spark, sf_dir):
    return metrics.metric_status(_metric_statements(spark, sf_dir), _metrics_of_selects(spark, sf_dir))


@query(
    "metric_rollup",
    METRICS
    + STATUSES
    + """SELECT count(*) AS total, count(*) FILTER (status = 'SUCCESS') AS success, count(*) FILTER (status = 'PARTIAL') AS partial,
         count(*) FILTER (status = 'UNSUPPORTED') AS unsupported, count(*) FILTER (status = 'PARSE_FAILED') AS failed,
         sum(metric_count)::BIGINT AS metric_count FROM statuses""",
)
def metric_rollup(spark, sf_dir):
    statuses = metrics.metric_status(_metric_statements(spark, sf_dir), _metrics_of_selects(spark, sf_dir))
    return metrics.metric_rollup(statuses)


@query(
    "metric_branches",
    METRICS
    + """SELECT sql_id, branch_no, 0 AS dim_no, CASE WHEN even AND branch_no = 1 THEN 'department' ELSE 'DEPT_' || (p_size % 5) END AS name,
         'DEPT_' || (p_size % 5) AS expression FROM metrics, (SELECT unnest([1, 2]) AS branch_no)""",
)
def metric_branches(spark, sf_dir):
    """Two UNION branches per statement; the alias is only given in the first."""
    items = v.metric_items(spark, sf_dir)
    second = items.withColumns({"branch_no": F.lit(2), "alias": F.lit(None).cast("string")})
    return metrics.metric_dimensions(items.unionByName(second))


METRIC_TEXTS = with_sql(v.METRICS_SQL, v.METRIC_TEXTS_SQL)


@query(
    "text_metric_items",
    METRIC_TEXTS
    + """SELECT sql_id, ord, 1::BIGINT AS branch_no, 1 AS item_no, CASE WHEN even THEN 'department' END AS alias, 'dept_' || (p_size % 5) AS expression,
           'DEPT_' || (p_size % 5) AS group_by, 'p_size > ' || p_size AS where_text, CASE WHEN even THEN 'SUM(x) > 100' END AS having_text,
           source_table || ',raw.facts' AS source_tables FROM written
         UNION ALL SELECT sql_id, ord, 1, 2, CASE WHEN even THEN '"' || plain_alias || '"' ELSE plain_alias END, expression,
           'DEPT_' || (p_size % 5), 'p_size > ' || p_size, CASE WHEN even THEN 'SUM(x) > 100' END, source_table || ',raw.facts' FROM written""",
)
def text_metric_items(spark, sf_dir):
    """SELECT items cut out of the texts."""
    items = selectitems.metric_items(v.metric_texts(spark, sf_dir))
    return items.withColumns({"group_by": _joined("group_by"), "source_tables": _joined(F.sort_array("source_tables"))})


@query(
    "text_metric_catalogue",
    METRIC_TEXTS
    + """SELECT sql_id, ord, 2 AS item_no, name, expression, normalized_expression, type, aggregation, 'DEPT_' || (p_size % 5) AS dimensions,
           'p_size > ' || p_size AS where_text FROM written""",
)
def text_metric_catalogue(spark, sf_dir):
    found = metrics.probe_metrics(selectitems.metric_items(v.metric_texts(spark, sf_dir)))
    return found.select(
        "sql_id", "ord", "item_no", "name", "expression", "normalized_expression", "type", "aggregation",
        _joined("dimensions").alias("dimensions"), "where_text",
    )


@query(
    "text_duplicate_metrics",
    METRIC_TEXTS
    + """SELECT normalized_expression, arg_min(expression, ord) AS expression, count(*) AS occurrence_count,
           count(DISTINCT name) AS name_count, count(DISTINCT sql_id) AS sql_count
         FROM written GROUP BY 1 HAVING count(*) > 1""",
)
def text_duplicate_metrics(spark, sf_dir):
    found = metrics.probe_metrics(selectitems.metric_items(v.metric_texts(spark, sf_dir)))
    return metrics.duplicate_metrics(materialize(found, "metrics"))


@query("text_metric_status", METRICS + STATUSES + "SELECT * FROM statuses")
def text_metric_status(spark, sf_dir):
    return selectitems.metric_statuses(v.metric_texts(spark, sf_dir))


@query(
    "text_metric_dimensions",
    METRIC_TEXTS
    + """SELECT sql_id, branch_no::BIGINT AS branch_no, 0 AS dim_no, CASE WHEN even AND branch_no = 1 THEN 'department' ELSE 'DEPT_' || (p_size % 5) END AS name,
         'DEPT_' || (p_size % 5) AS expression FROM written, (SELECT unnest([1, 2]) AS branch_no) WHERE p_partkey % 5 <> 1""",
)
def text_metric_dimensions(spark, sf_dir):
    """Both branches of a set operation, cut out of the text; the alias is given in the first only."""
    texts = v.metric_texts(spark, sf_dir).where("ord % 5 not in (1, 2, 3)")
    bare = F.replace(F.regexp_extract("sql", r"(?s)\n(SELECT.*)$", 1), F.lit(" AS department"))
    items = selectitems.metric_items(texts.withColumn("sql", F.concat_ws(" UNION ALL ", "sql", F.concat(F.lit("("), bare, F.lit(")")))))
    return metrics.metric_dimensions(materialize(items, "items"))


# ---------------------------------------------------------------------------------------------------- JSON (J)

DIFFS = with_sql(v.JSON_DIFF_SQL)


@query("json_diff", DIFFS + "SELECT * FROM diffs")
def json_diff(spark, sf_dir):
    return jsonops.json_diff(v.json_pairs(spark, sf_dir), ["key"], "a", "b")


@query(
    "json_diff_summary",
    DIFFS
    + """SELECT key, CASE key % 10 WHEN 0 THEN 'BLANK' WHEN 1 THEN 'INVALID' ELSE 'OK' END AS status,
           CASE WHEN key % 10 > 1 THEN count(path) END AS diff_count, CASE WHEN key % 10 > 1 THEN count(path) = 0 END AS identical
         FROM cust LEFT JOIN diffs USING (key) GROUP BY key""",
)
def json_diff_summary(spark, sf_dir):
    rule = F.col("key") % 10
    damaged = F.when(rule == 0, F.lit(" ")).when(rule == 1, F.lit('{"id":')).otherwise(F.col("b"))
    return jsonops.json_diff_summary(v.json_pairs(spark, sf_dir).withColumn("b", damaged), ["key"], "a", "b")


@query(
    "json_types",
    """SELECT c_custkey, ['OBJECT','ARRAY','NUMBER','BOOLEAN','STRING','NULL'][c_custkey % 6 + 1] AS type,
         CASE c_custkey % 6 WHEN 0 THEN '{"a":' || c_custkey || '}' WHEN 1 THEN '[' || c_custkey || ',null]' WHEN 2 THEN c_custkey::VARCHAR
           WHEN 3 THEN 'true' WHEN 4 THEN c_mktsegment END AS text FROM customer""",
)
def json_types(spark, sf_dir):
    key = F.col("c_custkey")
    rule = key % 6
    raw = (
        F.when(rule == 0, v._cat('{ "a" : ', key, "}"))
        .when(rule == 1, v._cat("[", key, ", null]"))
        .when(rule == 2, key.cast("string"))
        .when(rule == 3, "true")
        .when(rule == 4, F.concat(F.lit('"'), "c_mktsegment", F.lit('"')))
        .otherwise("null")
    )
    parsed = v.table(spark, sf_dir, "customer").select("c_custkey", F.parse_json(raw).alias("x"))
    return parsed.select(
        "c_custkey", jsontext.json_type(F.col("x")).alias("type"), jsontext.node_text(F.col("x")).alias("text")
    )


@query(
    "table_json_diff",
    """SELECT * FROM (
         SELECT o_orderkey, 'VALUE_CHANGE' AS type, '$.o_orderpriority' AS path, o_orderpriority AS old_value, 'CHANGED' AS new_value
         FROM orders WHERE o_orderkey % 10 = 1
         UNION ALL SELECT o_orderkey, 'REMOVED', '$', '{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey ||
           ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}', NULL
         FROM orders WHERE o_orderkey % 10 = 2
         UNION ALL SELECT o_orderkey, 'ADDED', '$', NULL, '{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey ||
           ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}'
         FROM orders WHERE o_orderkey % 10 = 3
         UNION ALL SELECT o_orderkey, 'VALUE_CHANGE', '$.o_orderstatus', o_orderstatus, NULL FROM orders WHERE o_orderkey % 10 = 4)""",
)
def table_json_diff(spark, sf_dir):
    rule = F.col("o_orderkey") % 10
    rows = v.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    before = rows.where(rule != 3)
    after = rows.where(rule != 2).withColumns(
        {
            "o_orderpriority": F.when(rule == 1, "CHANGED").otherwise(F.col("o_orderpriority")),
            "o_orderstatus": F.when(rule == 4, F.lit(None)).otherwise(F.col("o_orderstatus")),
        }
    )
    return jsonops.table_json_diff(before, after, ["o_orderkey"])


@query(
    "json_schema",
    """WITH c AS (SELECT c_custkey % 6 AS rule FROM customer), n AS (SELECT count(*) AS n FROM c)
       SELECT '$' AS path, 'OBJECT' AS kind, n AS present_rows, 0::BIGINT AS nullable_rows FROM n
       UNION ALL SELECT '$.id', 'INTEGER', n, 0 FROM n
       UNION ALL SELECT '$.seg', 'STRING', (SELECT count(*) FROM c WHERE rule <> 1), 0
       UNION ALL SELECT '$.nation', 'UNKNOWN', n, 0 FROM n
       UNION ALL SELECT '$.bal', 'INTEGER', n, 0 FROM n
       UNION ALL SELECT '$.tags', 'LIST', n, 0 FROM n
       UNION ALL SELECT '$.tags[]', 'STRING', n * 2 + (SELECT count(*) FROM c WHERE rule = 4), 0 FROM n
       UNION ALL SELECT '$.addr', 'OBJECT', n, 0 FROM n
       UNION ALL SELECT '$.addr.zip', 'INTEGER', n, 0 FROM n
       UNION ALL SELECT '$.addr.city', 'STRING', n, (SELECT count(*) FROM c WHERE rule = 5) FROM n
       UNION ALL SELECT '$.new', 'OBJECT', (SELECT count(*) FROM c WHERE rule = 5), 0
       UNION ALL SELECT '$.new.x', 'LIST', (SELECT count(*) FROM c WHERE rule = 5), 0
       UNION ALL SELECT '$.new.x[]', 'BOOLEAN', (SELECT count(*) FROM c WHERE rule = 5), 0""",
)
def json_schema(spark, sf_dir):
    return jsonops.json_schema(v.json_pairs(spark, sf_dir), "b").drop("steps")


@query(
    "json_struct_rows",
    """SELECT c_custkey AS id, round(c_acctbal * 100)::INTEGER AS bal, c_nationkey AS zip, 'a,b' AS tags FROM customer""",
)
def json_struct_rows(spark, sf_dir):
    """Infer the schema of a JSON column, then read the column with it."""
    documents = v.json_pairs(spark, sf_dir).select("a")
    shape = jsonops.to_struct_type(jsonops.json_schema(documents, "a"))
    rows = documents.select(F.from_json("a", shape).alias("d"))
    return rows.select(F.col("d.id").cast("bigint").alias("id"), "d.bal", "d.addr.zip", _joined("d.tags").alias("tags"))


def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties, every 7th cut short."""
    cut = F.when(F.col("event_id") % 7 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    return v.table(spark, sf_dir, "events").select("event_id", "event_type", cut.alias("props"))


@query(
    "json_quality",
    """SELECT event_type, count(*) FILTER (event_id % 7 <> 0) AS valid_rows, count(*) FILTER (event_id % 7 = 0) AS invalid_rows
       FROM events GROUP BY event_type""",
)
def json_quality(spark, sf_dir):
    return jsonops.json_quality(_props(spark, sf_dir), "props", "event_type")


@query(
    "invalid_json",
    "SELECT event_id, event_type, left(props, length(props) - 1) AS props FROM events WHERE event_id % 7 = 0",
)
def invalid_json(spark, sf_dir):
    return jsonops.invalid_json(_props(spark, sf_dir), "props")


CANONICAL = "WITH c AS (SELECT event_id, replace(props, ': ', ':') AS canonical FROM events WHERE event_id % 7 <> 0)"


@query(
    "json_duplicates",
    CANONICAL
    + " SELECT sha256(canonical) AS digest, count(*) AS copies, min(event_id) AS first_key FROM c GROUP BY canonical HAVING count(*) > 1",
)
def json_duplicates(spark, sf_dir):
    return jsonops.json_duplicates(_props(spark, sf_dir), "props", "event_id")


@query(
    "json_duplicate_texts",
    CANONICAL + " SELECT sha256(canonical) AS digest, count(*) AS copies, canonical FROM c GROUP BY canonical HAVING count(*) > 1",
)
def json_duplicate_texts(spark, sf_dir):
    return jsonops.json_duplicate_texts(_props(spark, sf_dir), "props", "event_id")


@query(
    "json_duplicate_members",
    CANONICAL
    + """ SELECT sha256(canonical) AS digest, event_id FROM c
          WHERE canonical IN (SELECT canonical FROM c GROUP BY 1 HAVING count(*) > 1)""",
)
def json_duplicate_members(spark, sf_dir):
    return jsonops.json_duplicate_members(_props(spark, sf_dir), "props", "event_id")


@query(
    "unwrap_json",
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN left(props, length(props) - 1) ELSE props END AS json,
       event_id % 7 <> 0 AS ok FROM events""",
)
def unwrap_json(spark, sf_dir):
    escaped = _props(spark, sf_dir).withColumn("escaped", F.replace("props", F.lit('"'), F.lit('\\"')))
    return jsonops.unwrap_json(escaped, "escaped").select("event_id", "json", "ok")


@query(
    "wrap_json",
    "SELECT doc_id, md5(substr(to_json(text)::VARCHAR, 2, length(to_json(text)::VARCHAR) - 2)) AS wrapped, true AS same FROM documents",
)
def wrap_json(spark, sf_dir):
    """Escape every document for embedding, and check that unescaping gives it back."""
    wrapped = jsonops.wrap_json(v.table(spark, sf_dir, "documents"), "text")
    return wrapped.select(
        "doc_id", F.md5("wrapped").alias("wrapped"), (jsontext.unwrap_text(F.col("wrapped")) == F.col("text")).alias("same")
    )


# ---------------------------------------------------------------------------------------------------- text (X)


@query("text_lines", with_sql(v.TEXT_SQL) + "SELECT pair_id AS doc_id, pos::INTEGER AS pos, line FROM a_lines")
def text_lines(spark, sf_dir):
    return textdiff.lines(v.table(spark, sf_dir, "documents"), "doc_id", "text")


TRIMMED = "regexp_replace(line, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"
ALIGNED = with_sql(v.TEXT_SQL, v.align_sql("line"))
HUNKS = with_sql(v.TEXT_SQL, v.align_sql("line"), v.HUNKS_SQL)


@query("align_lines", ALIGNED + "SELECT pair_id, a_pos::INTEGER AS a_pos, b_pos::INTEGER AS b_pos, line FROM anchors")
def align_lines(spark, sf_dir):
    return textdiff.align_lines(v.text_pairs(spark, sf_dir), "pair_id", "a", "b")


@query(
    "align_lines_ignoring_blanks",
    with_sql(v.TEXT_SQL, v.align_sql(TRIMMED))
    + "SELECT pair_id, a_pos::INTEGER AS a_pos, b_pos::INTEGER AS b_pos, line FROM anchors",
)
def align_lines_ignoring_blanks(spark, sf_dir):
    return textdiff.align_lines(v.text_pairs(spark, sf_dir), "pair_id", "a", "b", ignore_whitespace=True)


@query(
    "text_hunks",
    HUNKS
    + """SELECT pair_id, type, source_pos::INTEGER AS source_pos, source_size::INTEGER AS source_size, source_text,
         target_pos::INTEGER AS target_pos, target_size::INTEGER AS target_size, target_text FROM hunks""",
)
def text_hunks(spark, sf_dir):
    hunks = textdiff.text_hunks(v.text_pairs(spark, sf_dir), "pair_id", "a", "b")

    def whole(column: str) -> Column:
        return F.when(F.size(column) > 0, F.array_join(column, "\n"))

    return hunks.select(
        "pair_id", "type", "source_pos", F.size("source_lines").alias("source_size"), whole("source_lines").alias("source_text"),
        "target_pos", F.size("target_lines").alias("target_size"), whole("target_lines").alias("target_text"),
    )


@query(
    "unified_diff",
    HUNKS
    + """, texts AS (SELECT pair_id, source_pos, target_pos, '@@ -' || (source_pos + CASE WHEN source_size > 0 THEN 1 ELSE 0 END) || ','
           || source_size || ' +' || (target_pos + CASE WHEN target_size > 0 THEN 1 ELSE 0 END) || ',' || target_size || ' @@'
           || coalesce(chr(10) || minus, '') || coalesce(chr(10) || plus, '') AS t FROM hunks)
         SELECT doc_id AS pair_id, regexp_replace('--- original' || chr(10) || '+++ revised' || chr(10)
           || coalesce(string_agg(t, chr(10) ORDER BY source_pos, target_pos), ''), '[\\x00-\\x20]+$', '') AS unified
         FROM documents LEFT JOIN texts ON pair_id = doc_id GROUP BY doc_id""",
)
def unified_diff(spark, sf_dir):
    pairs = v.text_pairs(spark, sf_dir)
    return textdiff.unified_diff(pairs, textdiff.text_hunks(pairs, "pair_id", "a", "b"), "pair_id")


@query(
    "diff_summary",
    HUNKS
    + """SELECT doc_id AS pair_id, count(h.pair_id) AS change_count, count(h.pair_id) = 0 AS identical
         FROM documents LEFT JOIN hunks h ON h.pair_id = doc_id GROUP BY doc_id""",
)
def diff_summary(spark, sf_dir):
    pairs = v.text_pairs(spark, sf_dir)
    return textdiff.diff_summary(pairs, textdiff.text_hunks(pairs, "pair_id", "a", "b"), "pair_id")


@query(
    "line_delta",
    with_sql(v.TEXT_SQL)
    + """, counted AS (SELECT pair_id, line, sum(d) AS d FROM (SELECT pair_id, line, -1 AS d FROM a_lines UNION ALL
           SELECT pair_id, line, 1 FROM b_lines) GROUP BY pair_id, line)
         SELECT doc_id AS pair_id, coalesce(sum(greatest(d, 0)), 0)::BIGINT AS added_lines,
           coalesce(sum(greatest(-d, 0)), 0)::BIGINT AS removed_lines FROM documents LEFT JOIN counted ON pair_id = doc_id GROUP BY doc_id""",
)
def line_delta(spark, sf_dir):
    return textdiff.line_delta(v.text_pairs(spark, sf_dir), "pair_id", "a", "b")


# ----------------------------------------------------------------------------------------------- catalogue (C)


@query("kind_of", f"SELECT p_partkey, {v.kind_sql('p_partkey % 20')} AS kind FROM part")
def kind_of(spark, sf_dir):
    return v.type_strings(spark, sf_dir).select("p_partkey", names.kind_of(F.col("type_text")).alias("kind"))


@query(
    "numeric_kind",
    """SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN 'BIG_DECIMAL' WHEN p_size - 5 <= 0 THEN 'BIG_DECIMAL'
       WHEN p_size - 5 <= 9 THEN 'INTEGER' WHEN p_size - 5 <= 18 THEN 'LONG' ELSE 'BIG_INTEGER' END AS kind FROM part""",
)
def numeric_kind(spark, sf_dir):
    scale = F.when(F.col("p_size") % 4 == 3, 2).otherwise(0)
    return v.table(spark, sf_dir, "part").select(
        "p_partkey", names.numeric_kind(F.col("p_size") - 5, scale).alias("kind")
    )


@query("camel_name", with_sql(v.LABELS_SQL) + "SELECT p_partkey, camel AS field_name FROM camel")
def camel_name(spark, sf_dir):
    return v.labels_of_parts(spark, sf_dir).select("p_partkey", names.camel_name(F.col("label")).alias("field_name"))


# Names in order: the first free one of name, name2, name3, …
NAMED = with_sql(
    v.LABELS_SQL
    + """, placed AS (SELECT p_partkey, p_size, camel, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS rn FROM camel),
named_fields AS (
  SELECT p_size, rn, p_partkey, camel AS field_name, [camel] AS taken FROM placed WHERE rn = 1
  UNION ALL
  SELECT p_size, rn, p_partkey, free AS field_name, list_append(taken, free) AS taken FROM (
    SELECT p.p_size, p.rn, p.p_partkey, f.taken,
      [x FOR x IN list_concat([p.camel], [p.camel || k FOR k IN range(2, p.rn + 2)]) IF NOT list_contains(f.taken, x)][1] AS free
    FROM named_fields f JOIN placed p ON p.p_size = f.p_size AND p.rn = f.rn + 1)
)""",
    recursive=True,
)


@query("unique_names", NAMED + "SELECT p_size, p_partkey, field_name FROM named_fields")
def unique_names(spark, sf_dir):
    """Field names per size group; some labels end in digits and meet the suffix of another name."""
    based = v.labels_of_parts(spark, sf_dir).select("p_size", "p_partkey", names.camel_name(F.col("label")).alias("base"))
    return catalog.unique_names(based, ["p_size"], "base", "p_partkey").select("p_size", "p_partkey", "field_name")


SHEETS = with_sql(v.CELLS_SQL)


@query(
    "sheet_dictionary",
    SHEETS
    + """SELECT 'book_' || (o_orderkey % 10) AS file, 'order_' || o_orderkey AS sheet, d.* FROM orders, (VALUES
           (0, 'part-key', 'partKey', 'INTEGER', 'number(9)', 'first'), (1, 'part_key', 'partKey2', 'STRING', 'varchar(10)', ''),
           (2, 'class', 'classValue', 'BIG_DECIMAL', 'decimal(10,2)', 'third'), (4, 'flag', 'flag', 'STRING', '', 'fifth'))
           d(col_no, source_name, field_name, kind, source_type, comment)""",
)
def sheet_dictionary(spark, sf_dir):
    return catalog.sheet_dictionary(v.cells(spark, sf_dir), 1, 2, 3)


@query(
    "sheet_errors",
    SHEETS
    + """SELECT file, sheet, CASE WHEN max(row_no) < 8 THEN 'MISSING_HEADER_ROW' ELSE 'NO_FIELD' END AS error FROM cells
         GROUP BY file, sheet HAVING count(*) FILTER (row_no = 8) = 0""",
)
def sheet_errors(spark, sf_dir):
    return catalog.sheet_errors(v.cells(spark, sf_dir), 9)


@query(
    "jdbc_kind",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'STRING' WHEN 1 THEN CASE WHEN p_size <= 9 THEN 'INTEGER' WHEN p_size <= 18
         THEN 'LONG' ELSE 'BIG_INTEGER' END WHEN 2 THEN 'LOCAL_DATE_TIME' WHEN 3 THEN 'BYTE_ARRAY' WHEN 4 THEN 'LONG' ELSE 'UNKNOWN' END AS kind
       FROM part""",
)
def jdbc_kind(spark, sf_dir):
    codes = F.array(*[F.lit(c) for c in [12, 2, 93, 2004, 1111, 1111]])
    type_name = F.when(F.col("p_partkey") % 6 == 4, "BIGINT").otherwise("mystery")
    return v.table(spark, sf_dir, "part").select(
        "p_partkey",
        names.jdbc_kind(F.get(codes, (F.col("p_partkey") % 6).cast("int")), F.col("p_size"), F.lit(0), type_name).alias("kind"),
    )


@query(
    "columns_dictionary",
    NAMED
    + f"""SELECT 'table_' || p_size AS table_name, p_partkey AS position, field_name, {v.kind_sql('p_partkey % 20')} AS kind, '' AS comment
         FROM named_fields""",
)
def columns_dictionary(spark, sf_dir):
    labels = v.labels_of_parts(spark, sf_dir)
    types = v.type_strings(spark, sf_dir).select("p_partkey", "type_text")
    columns = labels.join(types, "p_partkey").select(
        v._cat("table_", F.col("p_size")).alias("table_name"),
        F.col("p_partkey").alias("position"),
        F.col("label").alias("name"),
        F.col("type_text").alias("type"),
        F.lit(None).cast("string").alias("comment"),
    )
    return catalog.columns_dictionary(columns).select("table_name", "position", "field_name", "kind", "comment")


@query(
    "apply_dictionary",
    """SELECT l_orderkey AS "orderKey", l_linenumber AS "lineNo", l_shipdate::DATE::VARCHAR AS "shipDate",
       CASE WHEN l_orderkey % 5 <> 0 THEN l_quantity::BIGINT END AS quantity FROM lineitem""",
)
def apply_dictionary(spark, sf_dir):
    raw = v.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("order-key"),
        F.col("l_linenumber").cast("string").alias("line no"),
        F.col("l_shipdate").cast("date").cast("string").alias("ship_date"),
        F.when(F.col("l_orderkey") % 5 == 0, "many").otherwise(F.col("l_quantity").cast("bigint").cast("string")).alias("QUANTITY"),
    )
    columns = raw.sparkSession.createDataFrame(
        [("t", 0, "order-key", "bigint", ""), ("t", 1, "line no", "int", ""), ("t", 2, "ship_date", "date", ""),
         ("t", 3, "QUANTITY", "number(12)", "")],
        "table_name string, position int, name string, type string, comment string",
    )
    typed = catalog.apply_dictionary(raw, catalog.columns_dictionary(columns))
    return typed.withColumn("shipDate", F.col("shipDate").cast("string"))


@query(
    "epoch_to_text",
    """SELECT o_orderkey, strftime(o_orderdate + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS text, epoch_ms(o_orderdate) AS ms,
       epoch_ms(o_orderdate) // 1000 AS sec FROM orders""",
)
def epoch_to_text(spark, sf_dir):
    shown = v.epochs(spark, sf_dir).select(
        "o_orderkey", text.epoch_to_text(F.col("raw"), "yyyy-MM-dd HH:mm:ss", "+08:00").alias("t")
    )
    return shown.select("o_orderkey", "t.text", "t.ms", "t.sec")


@query(
    "text_to_epoch",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_orderkey % 9 <> 0 THEN epoch_ms(l_shipdate) - 28800000 END AS ms,
       CASE WHEN l_orderkey % 9 <> 0 THEN (epoch_ms(l_shipdate) - 28800000) // 1000 END AS sec FROM lineitem""",
)
def text_to_epoch(spark, sf_dir):
    shown = F.when(F.col("l_orderkey") % 9 == 0, "1999-13-01 00:00").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm"))
    rows = v.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        text.text_to_epoch(shown, "yyyy-MM-dd HH:mm", "+08:00").alias("t"),
    )
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "t.ms", "t.sec")


@query(
    "expand_ranges",
    """WITH n AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 10 = 0 THEN range(1, 2001)
         ELSE list_concat(range(p_size, p_size + 6), range(65530, 65536)) END AS l FROM part)
       SELECT p_partkey, len(l)::INTEGER AS total, list_sum(l)::BIGINT AS sum, l[1]::INTEGER AS first, len(l) > 1000 AS rejected FROM n""",
)
def expand_ranges(spark, sf_dir):
    size = F.col("p_size")
    listed = F.when(F.col("p_partkey") % 10 == 0, "1-2000").otherwise(
        v._cat(size, ", ", size + 5, "-", size, "，x 7- 1-2-3 70000-65530")
    )
    rows = v.table(spark, sf_dir, "part").select("p_partkey", text.expand_ranges(listed).alias("r"))
    total = F.aggregate("r.numbers", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return rows.select(
        "p_partkey", "r.total", total.alias("sum"), F.get("r.numbers", F.lit(0)).alias("first"), "r.rejected"
    )


@query(
    "probe_rollup",
    """SELECT 'host_' || l_suppkey AS ip, count(*) FILTER (l_returnflag = 'A') AS open_count,
       count(*) FILTER (l_returnflag <> 'A') AS closed_count, count(*) AS total_count FROM lineitem GROUP BY 1""",
)
def probe_rollup(spark, sf_dir):
    return catalog.probe_rollup(
        v.table(spark, sf_dir, "lineitem").select(
            v._cat("host_", F.col("l_suppkey")).alias("ip"),
            F.col("l_linenumber").alias("port"),
            (F.col("l_returnflag") == "A").alias("open"),
        )
    )


@query(
    "page_of_orders",
    """SELECT o_orderkey, o_orderstatus, 3::BIGINT AS page, ceil(n / 100)::BIGINT AS total_pages, n AS total_rows
       FROM orders, (SELECT count(*) AS n FROM orders) ORDER BY o_orderkey LIMIT 100 OFFSET 200""",
)
def page_of_orders(spark, sf_dir):
    rows = v.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return ordered.page(rows, [F.col("o_orderkey")], 3, 100)


@query(
    "last_page_of_lines",
    """WITH n AS (SELECT count(*) AS n, ceil(count(*) / 999)::BIGINT AS pages FROM lineitem),
       ranked AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey,
         l_linenumber, l_extendedprice) AS rn FROM lineitem)
       SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, pages AS page, pages AS total_pages, n AS total_rows
       FROM ranked, n WHERE rn > (pages - 1) * 999""",
)
def last_page_of_lines(spark, sf_dir):
    """A page number beyond the end is clamped to the last page, which is cut out by position."""
    rows = v.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    order = [F.col(c) for c in rows.columns]
    return ordered.page(rows, order, 10**9, 999).drop("l_extendedprice")


@query(
    "sheet_summary",
    SHEETS + "SELECT file, sheet, max(row_no)::BIGINT + 1 AS total_rows, max(col_no)::BIGINT + 1 AS total_cols FROM cells GROUP BY file, sheet",
)
def sheet_summary(spark, sf_dir):
    return catalog.sheet_summary(v.cells(spark, sf_dir))


@query(
    "densify",
    SHEETS
    + """, size AS (SELECT file, sheet, max(row_no) AS r, max(col_no) AS c FROM cells GROUP BY file, sheet),
         grid AS (SELECT file, sheet, row_no, unnest(range(c + 1)) AS col_no FROM (SELECT file, sheet, c, unnest(range(r + 1)) AS row_no FROM size))
         SELECT g.file, g.sheet, g.row_no::INTEGER AS row_no, g.col_no::INTEGER AS col_no, coalesce(value, '') AS value
         FROM grid g LEFT JOIN cells USING (file, sheet, row_no, col_no)""",
)
def densify(spark, sf_dir):
    return catalog.densify(materialize(v.cells(spark, sf_dir), "cells"))


@query(
    "merged_cells",
    """SELECT 'book' AS file, 'order_' || o_orderkey AS sheet, 2 AS first_row, 1 AS first_col, row_no::INTEGER AS row_no,
         unnest(range(1, 1 + (o_custkey % 3)::INT + 1))::INTEGER AS col_no
       FROM (SELECT *, unnest(range(2, 2 + (o_orderkey % 4)::INT + 1)) AS row_no FROM orders)""",
)
def merged_cells(spark, sf_dir):
    regions = v.table(spark, sf_dir, "orders").select(
        F.lit("book").alias("file"),
        v._cat("order_", F.col("o_orderkey")).alias("sheet"),
        F.lit(2).alias("first_row"),
        (F.col("o_orderkey") % 4 + 2).cast("int").alias("last_row"),
        F.lit(1).alias("first_col"),
        (F.col("o_custkey") % 3 + 1).cast("int").alias("last_col"),
    )
    return catalog.merged_cells(regions)


# ------------------------------------------------------------------------------------------------- history (H)

HISTORY = with_sql(v.HISTORY_SQL)
ORDER = ["created_ms", "id"]
HASHED = ", hashed AS (SELECT *, type || ':' || hash AS print FROM history WHERE hash IS NOT NULL)"
CHANGES = (
    HISTORY
    + HASHED
    + """, seen AS (SELECT *, lag(print) OVER (PARTITION BY key ORDER BY created_ms, id) AS before FROM hashed)
         SELECT key, id, created_ms, type, hash FROM seen WHERE print IS DISTINCT FROM before"""
)


@query(
    "content_hash",
    """SELECT event_id, sha256(CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END) AS hash,
       sha256('/tmp/' || event_type || chr(10) || 'b' || chr(10)) AS path_hash FROM events""",
)
def content_hash(spark, sf_dir):
    body = F.when(F.col("event_id") % 3 != 0, F.col("event_type"))
    paths = F.array(v._cat("/tmp/", F.col("event_type")), F.lit("b"))
    return v.table(spark, sf_dir, "events").select(
        "event_id", text.content_hash(body).alias("hash"), text.path_list_hash(paths).alias("path_hash")
    )


@query("drop_consecutive", CHANGES)
def drop_consecutive(spark, sf_dir):
    rows = v.history(spark, sf_dir).select("key", "id", "created_ms", "type", "hash")
    return history.drop_consecutive(rows, "key", ORDER)


def _in_slices(spark: SparkSession, rows: DataFrame, time: str, start: Callable[[DataFrame, str], StreamingQuery]) -> str:
    """Run a stream over rows that arrive in four slices of time; it stops and starts again between them."""
    folder = scratch_path(spark, "stream")
    ends = rows.agg(F.min(time).alias("low"), F.max(time).alias("high")).first()
    low, step = ends["low"] or 0, ((ends["high"] or 0) - (ends["low"] or 0)) // 4 + 1
    for n in range(4):
        rows.where(((F.col(time) - low) / step).cast("int") == n).write.mode("append").parquet(f"{folder}/in")
        start(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), folder).awaitTermination()
    return folder


AT_ONCE = {"availableNow": True}


@query("drop_consecutive_stream", CHANGES)
def drop_consecutive_stream(spark, sf_dir):
    """The same rows through a stream that keeps the last fingerprint per key over batches and restarts."""
    rows = v.history(spark, sf_dir).select("key", "id", "created_ms", "type", "hash")
    folder = _in_slices(
        spark, rows, "created_ms", lambda stream, at: keyed.drop_consecutive(stream, at, "key", ORDER, AT_ONCE)
    )
    return keyed.emitted(spark, folder, rows.schema)


MARKED = with_sql(v.MARKED_SQL)


@query(
    "suppress_marked",
    MARKED
    + """, rows_ AS (SELECT *, CASE WHEN event = 'item' THEN type || ':' || hash END AS print FROM marked
           WHERE event = 'suppress' OR (event = 'item' AND hash IS NOT NULL)),
         seen AS (SELECT *, lag(CASE WHEN event = 'suppress' THEN hash END) OVER w AS marker,
           last_value(print IGNORE NULLS) OVER (PARTITION BY key ORDER BY created_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
           FROM rows_ WINDOW w AS (PARTITION BY key ORDER BY created_ms, id))
         SELECT key, id, created_ms, event, type, hash FROM seen
         WHERE event = 'item' AND marker IS DISTINCT FROM hash AND print IS DISTINCT FROM before""",
)
def suppress_marked(spark, sf_dir):
    return history.suppress_marked(v.marked_history(spark, sf_dir), "key", ORDER)


@query(
    "drop_paused",
    MARKED
    + """, seen AS (SELECT *, last_value(CASE WHEN event IN ('pause', 'resume') THEN event END IGNORE NULLS) OVER (PARTITION BY key
           ORDER BY created_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS switch FROM marked)
         SELECT key, id, created_ms, event, type, hash FROM seen
         WHERE event NOT IN ('pause', 'resume') AND NOT (event = 'item' AND coalesce(switch, '') = 'pause')""",
)
def drop_paused(spark, sf_dir):
    return history.drop_paused(v.marked_history(spark, sf_dir), "key", ORDER)


NEWEST = ", newest AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY created_ms DESC, id DESC) AS rn FROM history WHERE NOT pinned)"
ENTRY = ["key", "id", "created_ms", "type", "text", "pinned"]


@query(
    "retain",
    HISTORY
    + NEWEST
    + """ SELECT key, id, created_ms, type, text, pinned FROM newest WHERE rn <= 20
          UNION ALL SELECT key, id, created_ms, type, text, pinned FROM history WHERE pinned""",
)
def retain(spark, sf_dir):
    return history.retain(v.history(spark, sf_dir).select(*ENTRY), "key", 20)


@query("evicted", HISTORY + NEWEST + " SELECT key, id, created_ms, type, text, pinned FROM newest WHERE rn > 20")
def evicted(spark, sf_dir):
    return history.evicted(v.history(spark, sf_dir).select(*ENTRY), "key", 20)


def _eviction(spark: SparkSession, sf_dir: str) -> str:
    rows = v.history(spark, sf_dir).select(*ENTRY)
    return _in_slices(spark, rows, "created_ms", lambda stream, at: keyed.evict(stream, at, "key", 20, AT_ONCE))


@query("evicted_stream", ORACLES["evicted"])
def evicted_stream(spark, sf_dir):
    """Rows leave the history of their key one batch after the other, each once."""
    return keyed.emitted(spark, _eviction(spark, sf_dir), v.history(spark, sf_dir).select(*ENTRY).schema)


@query("retained_stream", ORACLES["retain"])
def retained_stream(spark, sf_dir):
    """What the state of the stream holds at the end."""
    return keyed.held(spark, _eviction(spark, sf_dir), v.history(spark, sf_dir).select(*ENTRY).schema)


@query("history_order", HISTORY + "SELECT key, id, created_ms, pinned FROM history ORDER BY pinned DESC, created_ms DESC, id DESC")
def history_order(spark, sf_dir):
    return history.history_order(v.history(spark, sf_dir).select("key", "id", "created_ms", "pinned"))


@query(
    "search_history",
    HISTORY
    + """SELECT key, id FROM history WHERE type = 'FILES' AND (contains(lower(type), 'click') OR contains(lower(text), 'click')
         OR contains(lower(path), 'click'))""",
)
def search_history(spark, sf_dir):
    return history.search_history(v.history(spark, sf_dir), " Click ", "FILES").select("key", "id")


@query("search_pinned", HISTORY + "SELECT key, id FROM history WHERE pinned AND (contains(lower(text), '.tx') OR coalesce(contains(path, '.tx'), false))")
def search_pinned(spark, sf_dir):
    return history.search_history(v.history(spark, sf_dir), ".TX", "PINNED").select("key", "id")


@query(
    "preview",
    """WITH flat AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '[\\r\\n\\t]', ' ', 'g'),
         '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'), ' {2,}', ' ', 'g') AS t FROM conversations)
       SELECT conv_id, turn, CASE WHEN length(t) > 160 THEN substr(t, 1, 157) || '...' ELSE t END AS preview FROM flat""",
)
def preview(spark, sf_dir):
    return v.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.preview(F.col("text")).alias("preview"))


@query(
    "entry_preview",
    HISTORY + "SELECT key, id, CASE WHEN type = 'FILES' THEN path || '  (+1 files)' ELSE text END AS preview FROM history",
)
def entry_preview(spark, sf_dir):
    paths = F.concat(F.coalesce("file_paths", F.array().cast("array<string>")), F.array(F.lit("b")))
    return v.history(spark, sf_dir).select(
        "key", "id", text.entry_preview(F.col("type"), F.col("text"), paths, F.col("image_path")).alias("preview")
    )


@query(
    "load_history",
    HISTORY
    + """SELECT count(*) FILTER (id % 9 <> 0) AS good, count(*) FILTER (id % 9 = 0) AS damaged,
         sum(id) FILTER (id % 9 <> 0)::BIGINT AS id_sum FROM history""",
)
def load_history(spark, sf_dir):
    """History lines written out, every ninth damaged, and loaded again."""
    path = scratch_path(spark, "history")
    line = F.to_json(F.struct("key", "id", "created_ms", "type", "text", "pinned"))
    damaged = F.when(F.col("id") % 9 == 0, F.substring(line, F.lit(1), F.length(line) - 5)).otherwise(line)
    v.history(spark, sf_dir).select(damaged.alias("value")).write.text(path)
    good, bad = history_files.load_history(spark, path)
    counted = good.agg(F.count(F.lit(1)).alias("good"), F.sum("id").alias("id_sum"))
    return counted.join(F.broadcast(bad.agg(F.count(F.lit(1)).alias("damaged"))), F.lit(True))


@query(
    "assign_ids",
    HISTORY
    + """, coarse AS (SELECT key, id, created_ms // 86400000 AS day FROM history),
         n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY day, id) AS n FROM coarse)
         SELECT key, id, day, n + max(day - n) OVER (PARTITION BY key ORDER BY day, id ROWS UNBOUNDED PRECEDING) AS assigned_id FROM n""",
)
def assign_ids(spark, sf_dir):
    """Ids from a coarse clock, so that many rows share a moment."""
    coarse = v.history(spark, sf_dir).select("key", "id", F.expr("created_ms div 86400000").alias("day"))
    return history.assign_ids(coarse, "key", ["day", "id"], "day")


@query("assign_ids_stream", ORACLES["assign_ids"])
def assign_ids_stream(spark, sf_dir):
    """Ids that go on from the last one of the key in the batches before."""
    coarse = v.history(spark, sf_dir).select("key", "id", F.expr("created_ms div 86400000").alias("day"))
    folder = _in_slices(spark, coarse, "day", lambda stream, at: keyed.assign_ids(stream, at, "key", ["day", "id"], "day", AT_ONCE))
    return keyed.emitted(spark, folder, coarse.schema.add("assigned_id", "long"))


@query(
    "expired_stream",
    HISTORY + "SELECT key, id, created_ms FROM history WHERE (SELECT max(created_ms) FROM history) - created_ms > 432000000",
)
def expired_stream(spark, sf_dir):
    """Rows more than five days older than the newest one so far, emitted once, without another row of their key."""
    rows = v.history(spark, sf_dir).select("key", "id", "created_ms")
    folder = _in_slices(spark, rows, "created_ms", lambda stream, at: keyed.expire(stream, at, 432_000_000, AT_ONCE))
    return keyed.emitted(spark, folder, rows.schema)


@query(
    "expire",
    HISTORY + "SELECT key, id, created_ms FROM history WHERE 1706000000000 - created_ms <= 3600000",
)
def expire(spark, sf_dir):
    return history.expire(v.history(spark, sf_dir).select("key", "id", "created_ms"), 1_706_000_000_000)
