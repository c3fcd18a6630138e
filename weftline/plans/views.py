"""Inputs of the registered queries, derived from the given tables.

Each view is written twice: as a DataFrame, and as a DuckDB common table expression for the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.rows import spread

ORD_STEP = 1_000_000_000_000  # spacing of the ordinals of the job families


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def _cat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def millis(col: Column) -> Column:
    return F.unix_millis(col.cast("timestamp"))


# --------------------------------------------------------------------------------------------------------------
# job catalogue
# --------------------------------------------------------------------------------------------------------------


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue of five job families; the SQL text is derived from the table lists."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("r"))
    buyers = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    sellers = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    orders = (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey")
        .join(buyers.select("c_custkey", "c_nationkey", F.col("n_regionkey").alias("region")), F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "c_nationkey", "region")
    )
    lines = (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_suppkey")
        .join(sellers.select("s_suppkey", F.col("n_regionkey").alias("from_region")), F.col("l_suppkey") == F.col("s_suppkey"))
        .select("l_orderkey", "l_suppkey", "from_region")
    )
    # the grouping keys contain the join keys, so the aggregate reuses the exchange of the join
    per_order = (
        orders.join(lines, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("region") == F.col("from_region")))
        .groupBy("o_orderkey", "region", "c_nationkey")
        .agg(F.collect_set("l_suppkey").alias("suppliers"))
        .withColumn("input_tables", F.sort_array(F.transform("suppliers", lambda s: _cat("ods_supplier_", s))))
        .select(
            F.col("o_orderkey").alias("ord"),
            F.lit("orders").alias("source"),
            _cat("ord_", F.col("o_orderkey")).alias("name"),
            "input_tables",
            F.array(_cat("dwd_nation_", F.col("c_nationkey"))).alias("output_tables"),
        )
    )

    def family(df: DataFrame, offset: int, key: str, source: str, prefix: str, inputs: Column, outputs: Column) -> DataFrame:
        return df.select(
            (F.lit(offset * ORD_STEP) + F.col(key)).cast("bigint").alias("ord"),
            F.lit(source).alias("source"),
            _cat(prefix, F.col(key)).alias("name"),
            inputs.alias("input_tables"),
            outputs.alias("output_tables"),
        )

    region_table = _cat("dws_region_", F.col("r"))
    first_nation = nation.groupBy(F.col("n_regionkey").alias("r")).agg(F.min("n_nationkey").alias("n"))
    roll = family(
        nation, 1, "n_nationkey", "nations", "roll_",
        F.array(_cat("dwd_nation_", F.col("n_nationkey"))), F.array(_cat("dws_region_", F.col("n_regionkey"))),
    )
    report = family(
        region, 2, "r", "regions", "rpt_",
        F.array(region_table), F.array(_cat("rpt_region_", F.col("r")), _cat("DWS_REGION_", F.col("r"))),
    )
    feedback = family(
        first_nation, 3, "r", "regions", "feedback_", F.array(region_table), F.array(_cat("dwd_nation_", F.col("n")))
    )
    orphans = family(
        table(spark, sf_dir, "part").where("p_size = 1"), 4, "p_partkey", "parts", "orphan_",
        F.array().cast("array<string>"), F.array(_cat("tmp_part_", F.col("p_partkey"))),
    )
    catalogue = per_order.unionByName(roll).unionByName(report).unionByName(feedback).unionByName(orphans)
    reads = F.array_join("input_tables", " join ")
    statement = F.when(
        F.size("input_tables") > 0,
        F.array_join(
            F.transform("output_tables", lambda t: F.concat(F.lit("insert into "), t, F.lit(" select * from "), reads)), "; "
        ),
    ).otherwise(F.concat(F.lit("create table "), F.get("output_tables", F.lit(0)), F.lit(" (id int)")))
    return catalogue.select(
        "ord",
        "source",
        "name",
        F.concat(F.lit("builds "), F.array_join("output_tables", " and ")).alias("description"),
        statement.alias("sql"),
        "input_tables",
        "output_tables",
    )


JOBS_SQL = """
first_nation AS (SELECT n_regionkey r, min(n_nationkey) n FROM nation GROUP BY n_regionkey),
catalogue AS (
  SELECT o_orderkey::BIGINT AS ord, 'orders' AS source, 'ord_' || o_orderkey AS name,
         list_sort(list(DISTINCT 'ods_supplier_' || l_suppkey)) AS input_tables,
         ['dwd_nation_' || c_nationkey] AS output_tables
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey
  JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation sn ON s_nationkey = sn.n_nationkey
  WHERE cn.n_regionkey = sn.n_regionkey
  GROUP BY o_orderkey, c_nationkey
  UNION ALL SELECT 1000000000000 + n_nationkey, 'nations', 'roll_' || n_nationkey,
         ['dwd_nation_' || n_nationkey], ['dws_region_' || n_regionkey] FROM nation
  UNION ALL SELECT 2000000000000 + r_regionkey, 'regions', 'rpt_' || r_regionkey,
         ['dws_region_' || r_regionkey], ['rpt_region_' || r_regionkey, 'DWS_REGION_' || r_regionkey] FROM region
  UNION ALL SELECT 3000000000000 + r, 'regions', 'feedback_' || r,
         ['dws_region_' || r], ['dwd_nation_' || n] FROM first_nation
  UNION ALL SELECT 4000000000000 + p_partkey, 'parts', 'orphan_' || p_partkey,
         []::VARCHAR[], ['tmp_part_' || p_partkey] FROM part WHERE p_size = 1
),
jobs AS (
  SELECT *, 'builds ' || array_to_string(output_tables, ' and ') AS description,
    CASE WHEN len(input_tables) > 0 THEN array_to_string(list_transform(output_tables,
           lambda t: 'insert into ' || t || ' select * from ' || array_to_string(input_tables, ' join ')), '; ')
         ELSE 'create table ' || output_tables[1] || ' (id int)' END AS sql
  FROM catalogue
),
job_inputs AS (SELECT DISTINCT name AS job, unnest(input_tables) AS tbl FROM jobs),
job_outputs AS (SELECT DISTINCT name AS job, unnest(output_tables) AS tbl FROM jobs),
edge_jobs AS (
  SELECT i.tbl AS src, o.tbl AS dst, i.job AS name FROM job_inputs i JOIN job_outputs o ON i.job = o.job
  WHERE lower(i.tbl) <> lower(o.tbl)
),
edges AS (SELECT src, dst, count(DISTINCT name) AS weight FROM edge_jobs GROUP BY src, dst),
names AS (SELECT tbl AS name FROM job_inputs UNION SELECT tbl FROM job_outputs),
cards AS (
  SELECT n.name, regexp_extract(n.name, '[^.]*$') AS short_name,
    CASE WHEN lower(n.name) LIKE 'ods%' THEN 'ODS' WHEN lower(n.name) LIKE 'dwd%' THEN 'DWD'
         WHEN lower(n.name) LIKE 'dws%' THEN 'DWS'
         WHEN lower(n.name) LIKE 'ads%' OR lower(n.name) LIKE 'app\\_%' ESCAPE '\\'
           OR lower(n.name) LIKE 'rpt\\_%' ESCAPE '\\' THEN 'ADS'
         WHEN lower(n.name) LIKE 'dim%' THEN 'DIM' ELSE 'UNKNOWN' END AS layer,
    coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree,
    coalesce(p.n, 0) AS producing_sql_count, coalesce(c.n, 0) AS consuming_sql_count,
    coalesce(o.n, 0) = 0 AS is_leaf, coalesce(i.n, 0) = 0 AS is_source
  FROM names n
  LEFT JOIN (SELECT dst, count(*) n FROM edges GROUP BY dst) i ON n.name = i.dst
  LEFT JOIN (SELECT src, count(*) n FROM edges GROUP BY src) o ON n.name = o.src
  LEFT JOIN (SELECT tbl, count(*) n FROM job_outputs GROUP BY tbl) p ON n.name = p.tbl
  LEFT JOIN (SELECT tbl, count(*) n FROM job_inputs GROUP BY tbl) c ON n.name = c.tbl
)"""

# Connected components in DuckDB: spread the least name over undirected edges.
COMPONENTS_SQL = """
both_ways AS (SELECT src a, dst b FROM edges UNION SELECT dst, src FROM edges),
spread(name, label) AS (
  SELECT name, name FROM names
  UNION
  SELECT b.b, s.label FROM spread s JOIN both_ways b ON s.name = b.a WHERE s.label < b.b
),
components AS (
  SELECT name, min(label) AS representative, dense_rank() OVER (ORDER BY min(label)) - 1 AS cluster_id
  FROM spread GROUP BY name
)"""


def closure_sql(seeds: str, depth: int) -> str:
    """Shortest hops upstream of the seeds; the hop cap keeps cycles finite."""
    cap = depth if depth > 0 else "(SELECT count(*) FROM cards)"  # no shortest path is longer
    return f"""
walk(seed, name, hop) AS (
  SELECT name, name, 0 FROM ({seeds}) s
  UNION
  SELECT w.seed, e.src, w.hop + 1 FROM walk w JOIN edges e ON e.dst = w.name WHERE w.hop < {cap}
),
closure AS (SELECT seed, name, min(hop)::INTEGER AS distance FROM walk GROUP BY seed, name)"""


# --------------------------------------------------------------------------------------------------------------
# SQL corpus
# --------------------------------------------------------------------------------------------------------------


def sql_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).select("ord", F.col("name").alias("sql_id"), "sql")


# Statements in forms that announce no table, or an unusual one; with the writes and reads they hold.
ODD_STATEMENTS = [
    ("select extract(year from d), trim(both from x) from odd_a where a is distinct from b", "", "odd_a"),
    ("with c(x, y) as (select a, b from odd_b), d as materialized (select 1 from odd_c) select * from c, d", "", "odd_b,odd_c"),
    ("insert into odd_d values (1) on duplicate key update c = 2", "odd_d", ""),
    ("insert overwrite odd_e select * from odd_f join lateral (select 1 from odd_g) s on true for update", "odd_e", "odd_f,odd_g"),
    ("delete odd_h where k = 1", "odd_h", ""),
    ("update odd_i set a = s.b from odd_j s where s.k = 1", "odd_i", "odd_j"),
]


def odd_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with one odd statement before every text."""
    odd = F.get(F.array(*[F.lit(text) for text, _, _ in ODD_STATEMENTS]), (F.col("ord") % len(ODD_STATEMENTS)).cast("int"))
    return sql_inputs(spark, sf_dir).withColumn("sql", F.concat_ws(";\n", odd, "sql"))


def judged_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with blank texts and texts that end in a statement of unknown kind."""
    rule = F.col("ord") % 7
    text = F.when(rule == 0, " ").when(rule == 1, F.concat_ws("; ", "sql", F.lit("vacuum x"))).otherwise(F.col("sql"))
    return sql_inputs(spark, sf_dir).withColumn("sql", text)


TEXT_FACTS_SQL = """
texts AS (
  SELECT ord, name AS sql_id, output_tables AS writes, input_tables AS reads,
    CASE WHEN ord % 7 = 0 THEN 'PARSE_FAILED' WHEN ord % 7 = 1 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status,
    CASE WHEN len(input_tables) > 0 THEN 'INSERT' ELSE 'CREATE_TABLE' END AS kind
  FROM jobs
)"""


def sql_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the catalogue; the status comes from the order, other families succeed."""
    status = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ord"),
        F.when(F.col("o_orderstatus") == "F", "SUCCESS")
        .when(F.col("o_orderstatus") == "O", "PARTIAL")
        .otherwise("PARSE_FAILED")
        .alias("status"),
    )
    return (
        jobs(spark, sf_dir)
        .join(status, "ord", "left")
        .select(
            "ord",
            F.col("name").alias("sql_id"),
            F.coalesce("status", F.lit("SUCCESS")).alias("status"),
            F.when(F.size("input_tables") > 0, F.transform("output_tables", lambda t: F.lit("INSERT")))
            .otherwise(F.array(F.lit("CREATE_TABLE")))
            .alias("statement_types"),
            F.col("input_tables").alias("read_tables"),
            F.transform("output_tables", lambda t: F.concat(F.lit(" "), t)).alias("write_tables"),
            F.transform("input_tables", lambda t: F.concat(t, F.lit(".id"))).alias("columns"),
        )
    )


SQL_FACTS_SQL = """
facts AS (
  SELECT j.ord, j.name AS sql_id,
    CASE WHEN o_orderkey IS NULL OR o_orderstatus = 'F' THEN 'SUCCESS' WHEN o_orderstatus = 'O' THEN 'PARTIAL'
         ELSE 'PARSE_FAILED' END AS status,
    input_tables AS reads, list_transform(output_tables, lambda t: ' ' || t) AS writes,
    len(input_tables) > 0 AS has_input
  FROM jobs j LEFT JOIN orders ON o_orderkey = j.ord
)"""

# --------------------------------------------------------------------------------------------------------------
# metric items
# --------------------------------------------------------------------------------------------------------------


def metric_items(spark: SparkSession, sf_dir: str, part: DataFrame | None = None) -> DataFrame:
    """Two items per part: a dimension and an expression of the family ``p_partkey % 10``."""
    part = part or table(spark, sf_dir, "part")
    b = F.regexp_replace("p_brand", "#", "_")
    even = F.col("p_size") % 2 == 0
    family = F.col("p_partkey") % 10
    expression = (
        F.when((family == 0) & even, _cat("SUM(", b, ")"))
        .when(family == 0, _cat("sum(  ", F.lower(b), " )"))
        .when(family == 1, "COUNT(*)")
        .when(family == 2, _cat("COUNT(DISTINCT ", b, ")"))
        .when(family == 3, _cat("AVG(t.", b, ")"))
        .when(family == 4, _cat("MIN(", b, ")"))
        .when(family == 5, _cat("MAX(-1)"))
        .when(family == 6, _cat("SUM(CASE WHEN s = 'Paid' THEN ", b, " ELSE 0 END)"))
        .when(family == 7, _cat("SUM(", b, ") / NULLIF(COUNT(*), 0)"))
        .when(family == 8, _cat("SUM(", b, " * 2)"))
        .otherwise(_cat("SUM(", b, ") OVER (PARTITION BY p_type)"))
    )
    dim = _cat("dept_", F.col("p_size") % 5)
    items = F.array(
        F.struct(
            F.lit(1).alias("item_no"), F.when(even, "department").alias("alias"), dim.alias("expression")
        ),
        F.struct(
            F.lit(2).alias("item_no"),
            F.when(F.col("p_partkey") % 9 == 0, F.lit(None))
            .when(even, _cat('"m_', F.col("p_partkey") % 100, '"'))
            .otherwise(_cat("m_", F.col("p_partkey") % 100))
            .alias("alias"),
            expression.alias("expression"),
        ),
    )
    return part.select(
        _cat("sql-", F.col("p_partkey")).alias("sql_id"),
        F.col("p_partkey").alias("ord"),
        F.lit(1).alias("branch_no"),
        F.array(F.upper(dim)).alias("group_by"),
        _cat("p_size > ", F.col("p_size")).alias("where_text"),
        F.when(even, "SUM(x) > 100").alias("having_text"),
        F.array(_cat("app.", F.lower("p_type"))).alias("source_tables"),
        F.explode(items).alias("i"),
    ).select(
        "sql_id", "ord", "branch_no", "i.item_no", "i.alias", "i.expression", "group_by", "where_text", "having_text",
        "source_tables",
    )


def metric_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, sql_id, sql): the metric items as SQL texts, with queries around them that give no items.

    By the key, a text also holds an INSERT, or nothing but an UPDATE, or no statement at all.
    """
    items = metric_items(spark, sf_dir, spread(table(spark, sf_dir, "part"))).where("item_no = 2")
    even = F.col("having_text").isNotNull()
    dim = F.get(F.col("group_by"), F.lit(0))
    query = F.concat(
        F.lit("WITH base AS (SELECT SUM(q) AS s FROM raw.facts GROUP BY r)\nSELECT "), F.lower(dim), F.when(even, " AS department").otherwise(""),
        F.lit(", "), "expression", F.coalesce(F.concat(F.when(even, " AS ").otherwise(" "), F.col("alias")), F.lit("")),
        F.lit(" -- FROM here\nFROM "), F.replace(F.get(F.col("source_tables"), F.lit(0)), F.lit(" "), F.lit("_")), F.lit(" t CROSS JOIN base WHERE "),
        "where_text", F.lit(" GROUP BY "), dim, F.coalesce(F.concat(F.lit(" HAVING "), F.col("having_text")), F.lit("")),
    )
    rule = F.col("ord") % 5
    text = (
        F.when(rule == 1, F.concat(query, F.lit("; INSERT INTO app.kept SELECT SUM(z) AS lost FROM app.other")))
        .when(rule == 2, F.lit("UPDATE app.kept SET a = (SELECT MAX(z) FROM app.other)"))
        .when(rule == 3, F.lit(" -- SELECT SUM(z) FROM app.other"))
        .otherwise(query)
    )
    return items.select("ord", "sql_id", text.alias("sql"))


METRIC_TEXTS_SQL = """
written AS (
  SELECT * REPLACE (CASE WHEN family = 0 AND NOT even THEN 'sum(' || lower(b) || ')' ELSE expression END AS expression,
    CASE WHEN plain_alias IS NULL AND family = 0 AND NOT even THEN 'sum(' || lower(b) || ')' ELSE name END AS name),
    'app.' || replace(lower(p_type), ' ', '_') AS source_table
  FROM named WHERE p_partkey % 5 NOT IN (2, 3)
)"""


def column_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, sql_id, sql): the jobs with inputs as statements with aliases, a common table expression and a subquery."""
    inputs = F.col("input_tables")
    first = F.get(inputs, F.lit(0))
    text = F.concat(
        F.lit("WITH c0 AS (SELECT x.k FROM "), first, F.lit(" x WHERE f = 1) INSERT INTO "), F.get(F.col("output_tables"), F.lit(0)), F.lit(" SELECT "),
        F.array_join(F.transform(inputs, lambda t, i: F.format_string("max(t%d.c%d) m%d", i, i, i)), ", "), F.lit(", c0.k FROM "),
        F.array_join(F.transform(inputs, lambda t, i: F.format_string("%s AS t%d", t, i)), " JOIN "),
        F.lit(" JOIN c0 ON c0.k = t0.k WHERE EXISTS (SELECT 1 FROM "), first, F.lit(" t1 WHERE t1.d = t0.e AND g > 0) GROUP BY c0.k"),
    )
    return jobs(spark, sf_dir).where(F.size("input_tables") > 0).select("ord", F.col("name").alias("sql_id"), text.alias("sql"))


METRICS_SQL = """
parts AS (
  SELECT *, 'sql-' || p_partkey AS sql_id, p_partkey % 10 AS family, p_size % 2 = 0 AS even,
         replace(p_brand, '#', '_') AS b FROM part
),
metrics AS (
  SELECT sql_id, p_partkey AS ord,
    CASE family
      WHEN 0 THEN CASE WHEN even THEN 'SUM(' || b || ')' ELSE 'sum(  ' || lower(b) || ' )' END
      WHEN 1 THEN 'COUNT(*)' WHEN 2 THEN 'COUNT(DISTINCT ' || b || ')' WHEN 3 THEN 'AVG(t.' || b || ')'
      WHEN 4 THEN 'MIN(' || b || ')' WHEN 5 THEN 'MAX(-1)'
      WHEN 6 THEN 'SUM(CASE WHEN s = ''Paid'' THEN ' || b || ' ELSE 0 END)'
      WHEN 7 THEN 'SUM(' || b || ') / NULLIF(COUNT(*), 0)' WHEN 8 THEN 'SUM(' || b || ' * 2)'
      ELSE 'SUM(' || b || ') OVER (PARTITION BY p_type)' END AS expression,
    CASE family
      WHEN 0 THEN 'SUM ( ' || upper(b) || ' )' WHEN 1 THEN 'COUNT ( * )'
      WHEN 2 THEN 'COUNT ( DISTINCT ' || upper(b) || ' )' WHEN 3 THEN 'AVG ( T.' || upper(b) || ' )'
      WHEN 4 THEN 'MIN ( ' || upper(b) || ' )' WHEN 5 THEN 'MAX ( - 1 )'
      WHEN 6 THEN 'SUM ( CASE WHEN S = ''Paid'' THEN ' || upper(b) || ' ELSE 0 END )'
      WHEN 7 THEN 'SUM ( ' || upper(b) || ' ) / NULLIF ( COUNT ( * ) , 0 )'
      WHEN 8 THEN 'SUM ( ' || upper(b) || ' * 2 )'
      ELSE 'SUM ( ' || upper(b) || ' ) OVER ( PARTITION BY P_TYPE )' END AS normalized_expression,
    CASE family WHEN 0 THEN 'SUM' WHEN 1 THEN 'COUNT' WHEN 2 THEN 'COUNT_DISTINCT' WHEN 3 THEN 'AVG'
      WHEN 4 THEN 'MIN' WHEN 5 THEN 'MAX' WHEN 6 THEN 'CONDITIONAL_AGGREGATION' WHEN 7 THEN 'RATIO'
      WHEN 8 THEN 'DERIVED' ELSE 'WINDOW' END AS type,
    CASE family WHEN 1 THEN 'COUNT' WHEN 2 THEN 'COUNT' WHEN 3 THEN 'AVG' WHEN 4 THEN 'MIN' WHEN 5 THEN 'MAX'
      WHEN 7 THEN 'SUM,COUNT' ELSE 'SUM' END AS aggregation,
    family, even, b, p_partkey, p_size, p_type,
    CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 'm_' || (p_partkey % 100) END AS plain_alias
  FROM parts
),
named AS (SELECT *, coalesce(plain_alias, expression) AS name FROM metrics)"""

# --------------------------------------------------------------------------------------------------------------
# JSON, text, types, epochs, cells, histories
# --------------------------------------------------------------------------------------------------------------


def json_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a document per customer; the edit is chosen by ``c_custkey % 6``."""
    c = table(spark, sf_dir, "customer")
    k, n, rule = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_custkey") % 6
    cents = F.round(F.col("c_acctbal") * 100).cast("bigint")

    def document(changed: bool) -> Column:
        def on(r: int, new: Column, old: Column) -> Column:
            return F.when(rule == r, new).otherwise(old) if changed else old

        seg = _cat('"seg":"', F.col("c_mktsegment"), '",')
        return F.concat(
            _cat('{"id":', k, ","),
            on(1, F.lit(""), seg),
            F.lit('"nation":'),
            on(2, _cat('"', n, '"'), n.cast("string")),
            F.lit(',"bal":'),
            on(3, (cents + 1).cast("string"), cents.cast("string")),
            F.lit(',"tags":["a","b"'),
            on(4, F.lit(',"c"'), F.lit("")),
            F.lit('],"addr":{"zip":'),
            on(3, (n + 1).cast("string"), n.cast("string")),
            F.lit(',"city":'),
            on(5, F.lit("null"), _cat('"c', n, '"')),
            F.lit("}"),
            on(5, F.lit(',"new":{"x":[true]}'), F.lit("")),
            F.lit("}"),
        )

    return c.select(k.alias("key"), document(False).alias("a"), document(True).alias("b"))


JSON_DIFF_SQL = """
cust AS (SELECT c_custkey AS key, c_nationkey AS n, c_custkey % 6 AS rule, c_mktsegment AS seg,
                round(c_acctbal * 100)::BIGINT AS cents FROM customer),
diffs AS (
  SELECT key, 'REMOVED' AS type, '$.seg' AS path, seg AS old_value, NULL AS new_value FROM cust WHERE rule = 1
  UNION ALL SELECT key, 'TYPE_CHANGE', '$.nation', n::VARCHAR, n::VARCHAR FROM cust WHERE rule = 2
  UNION ALL SELECT key, 'VALUE_CHANGE', '$.bal', cents::VARCHAR, (cents + 1)::VARCHAR FROM cust WHERE rule = 3
  UNION ALL SELECT key, 'VALUE_CHANGE', '$.addr.zip', n::VARCHAR, (n + 1)::VARCHAR FROM cust WHERE rule = 3
  UNION ALL SELECT key, 'ADDED', '$.tags[2]', NULL, 'c' FROM cust WHERE rule = 4
  UNION ALL SELECT key, 'VALUE_CHANGE', '$.addr.city', 'c' || n, NULL FROM cust WHERE rule = 5
  UNION ALL SELECT key, 'ADDED', '$.new', NULL, '{"x":[true]}' FROM cust WHERE rule = 5
)"""


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document text and an edited copy: lines dropped, marked and inserted by position."""
    edited = F.flatten(
        F.transform(
            F.split("text", "\n", -1),
            lambda line, i: F.concat(
                F.when(i % 11 == 0, F.array(_cat("inserted ", i))).otherwise(F.array().cast("array<string>")),
                F.when(i % 5 == 0, F.array().cast("array<string>"))
                .when(i % 7 == 0, F.array(F.concat(F.lit(">> "), line)))
                .when(i % 3 == 0, F.array(F.concat(line, F.lit("  "))))
                .otherwise(F.array(line)),
            ),
        )
    )
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("pair_id"), F.col("text").alias("a"), F.array_join(edited, "\n").alias("b")
    )


TEXT_SQL = """
a_lines AS (
  SELECT doc_id AS pair_id, unnest(range(len(string_split(text, chr(10))))) AS pos,
         unnest(string_split(text, chr(10))) AS line
  FROM documents WHERE text IS NOT NULL AND text <> ''
),
edits AS (
  SELECT pair_id, pos, 0 AS part, 'inserted ' || pos AS line FROM a_lines WHERE pos % 11 = 0
  UNION ALL
  SELECT pair_id, pos, 1, CASE WHEN pos % 7 = 0 THEN '>> ' || line WHEN pos % 3 = 0 THEN line || '  ' ELSE line END
  FROM a_lines WHERE pos % 5 <> 0
),
b_lines AS (
  SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY pos, part) - 1 AS pos, line FROM edits
)"""


def align_sql(key: str) -> str:
    """The alignment rule in SQL over ``a_lines`` and ``b_lines``; ``key`` is the comparison expression."""
    return f"""
a_nth AS (SELECT *, row_number() OVER (PARTITION BY pair_id, {key} ORDER BY pos) AS nth, {key} AS k FROM a_lines),
b_nth AS (SELECT *, row_number() OVER (PARTITION BY pair_id, {key} ORDER BY pos) AS nth, {key} AS k FROM b_lines),
met AS (
  SELECT a.pair_id, a.pos AS a_pos, b.pos AS b_pos, a.line
  FROM a_nth a JOIN b_nth b ON a.pair_id = b.pair_id AND a.k = b.k AND a.nth = b.nth
),
highs AS (
  SELECT *, max(b_pos) OVER (PARTITION BY pair_id ORDER BY a_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high
  FROM met
),
anchors AS (SELECT pair_id, a_pos, b_pos, line FROM highs WHERE b_pos > coalesce(high, -1))"""


HUNKS_SQL = """
sides AS (
  SELECT l.pair_id, 'A' AS side, l.pos, l.line, x.a_pos IS NOT NULL AS anchored, x.a_pos, x.b_pos
  FROM a_lines l LEFT JOIN anchors x ON l.pair_id = x.pair_id AND l.pos = x.a_pos
  UNION ALL
  SELECT l.pair_id, 'B', l.pos, l.line, x.b_pos IS NOT NULL, x.a_pos, x.b_pos
  FROM b_lines l LEFT JOIN anchors x ON l.pair_id = x.pair_id AND l.pos = x.b_pos
),
gaps AS (
  SELECT *, sum(anchored::INT) OVER (PARTITION BY pair_id, side ORDER BY pos
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gap FROM sides
),
grouped AS (
  SELECT pair_id, gap,
    coalesce(max(a_pos) FILTER (WHERE anchored) + 1, 0) AS source_pos,
    coalesce(max(b_pos) FILTER (WHERE anchored) + 1, 0) AS target_pos,
    count(*) FILTER (WHERE NOT anchored AND side = 'A') AS source_size,
    count(*) FILTER (WHERE NOT anchored AND side = 'B') AS target_size,
    string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT anchored AND side = 'A') AS source_text,
    string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT anchored AND side = 'B') AS target_text,
    string_agg('-' || line, chr(10) ORDER BY pos) FILTER (WHERE NOT anchored AND side = 'A') AS minus,
    string_agg('+' || line, chr(10) ORDER BY pos) FILTER (WHERE NOT anchored AND side = 'B') AS plus
  FROM gaps GROUP BY pair_id, gap
),
hunks AS (
  SELECT *, CASE WHEN source_size > 0 AND target_size > 0 THEN 'CHANGE' WHEN source_size > 0 THEN 'DELETE'
                 ELSE 'INSERT' END AS type
  FROM grouped WHERE source_size + target_size > 0
)"""

# Type texts by ``p_partkey % 20`` and the kind each one has.
TYPE_TEXTS = [
    ("VARCHAR(20)", "STRING"),
    ("nvarchar2(10)", "STRING"),
    ("java.lang.Integer", "INTEGER"),
    ("bigint", "LONG"),
    ("NUMBER(9)", "INTEGER"),
    ("NUMBER(18)", "LONG"),
    ("number(30, 0)", "BIG_INTEGER"),
    ("Decimal(10,2)", "BIG_DECIMAL"),
    ("numeric", "BIG_DECIMAL"),
    ("double precision", "BIG_DECIMAL"),
    ("date", "LOCAL_DATE"),
    ("java.time.LocalDateTime", "LOCAL_DATE_TIME"),
    ("timestamp(6)", "LOCAL_DATE_TIME"),
    ("time", "LOCAL_TIME"),
    ("blob", "BYTE_ARRAY"),
    ("byte[]", "BYTE_ARRAY"),
    ("bit", "BOOLEAN"),
    ("  ", "STRING"),
    ("geometry", "UNKNOWN"),
    ("java.math.BigInteger", "BIG_INTEGER"),
]


def type_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.array(*[F.lit(t) for t, _ in TYPE_TEXTS])
    part = table(spark, sf_dir, "part")
    return part.select(
        "p_partkey", "p_size", F.get(texts, (F.col("p_partkey") % 20).cast("int")).alias("type_text")
    )


def kind_sql(index: str) -> str:
    return f"[{', '.join(repr(k) for _, k in TYPE_TEXTS)}][({index}) + 1]"


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = millis(F.col("o_orderdate"))
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.call_function("div", ms, F.lit(1000))).otherwise(ms)
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.cast("string").alias("raw"))


def labels_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column labels by ``p_partkey % 6``."""
    rule = F.col("p_partkey") % 6
    label = (
        F.when(rule == 0, F.col("p_name"))
        .when(rule == 1, F.col("p_brand"))
        .when(rule == 2, F.col("p_type"))
        .when(rule == 3, F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))))
        .when(rule == 4, F.concat(F.lit("9-"), F.col("p_name")))
        .otherwise(F.when(F.col("p_size") % 2 == 0, "class").otherwise("--"))
    )
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", label.alias("label"))


LABELS_SQL = """
labelled AS (
  SELECT p_partkey, p_size, p_partkey % 6 AS rule, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2,
         p_brand, p_type FROM part
),
camel AS (
  SELECT *, CASE rule
    WHEN 0 THEN w1 || upper(w2[1]) || w2[2:] WHEN 1 THEN 'brand' || split_part(p_brand, '#', 2) WHEN 2 THEN lower(p_type)
    WHEN 3 THEN w1 || upper(w2[1]) || w2[2:]
    WHEN 4 THEN 'field9' || upper(w1[1]) || w1[2:] || upper(w2[1]) || w2[2:]
    ELSE CASE WHEN p_size % 2 = 0 THEN 'classValue' ELSE 'field' END END AS camel
  FROM labelled
)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sheet per order: header, type and comment rows, then a row per line number with gaps."""
    heads = table(spark, sf_dir, "orders").select("o_orderkey")
    fixed = [
        ["part-key", "part_key", "class", " ", "flag"],
        ["number(9)", "varchar(10)", "decimal(10,2)", "int", ""],
        ["first", "", "third", "", "fifth"],
    ]
    head = F.flatten(
        F.array(
            *[
                F.array(
                    *[
                        F.struct(F.lit(r).alias("row_no"), F.lit(c).alias("col_no"), F.lit(v).alias("value"))
                        for c, v in enumerate(row)
                    ]
                )
                for r, row in enumerate(fixed)
            ]
        )
    )
    body = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.max("l_partkey").alias("p"), F.max("l_quantity").cast("int").alias("q"), F.char(F.max(F.ascii("l_returnflag"))).alias("f"))
    )
    values = F.array(
        F.struct(F.lit(0).alias("col_no"), _text("p").alias("value")),
        F.struct(F.lit(2).alias("col_no"), _text("q").alias("value")),
        F.struct(F.lit(4).alias("col_no"), F.col("f").alias("value")),
    )

    def placed(key: str) -> list[Column]:
        return [_cat("book_", F.col(key) % 10).alias("file"), _cat("order_", F.col(key)).alias("sheet")]

    top = heads.select(*placed("o_orderkey"), F.explode(head).alias("h")).select(
        "file", "sheet", "h.row_no", "h.col_no", "h.value"
    )
    rest = body.select(*placed("l_orderkey"), (F.col("l_linenumber") + 2).cast("int").alias("row_no"), F.explode(values).alias("v")).select(
        "file", "sheet", "row_no", "v.col_no", "v.value"
    )
    return top.unionByName(rest)


CELLS_SQL = """
heads AS (SELECT * FROM (VALUES
  (0,0,'part-key'),(0,1,'part_key'),(0,2,'class'),(0,3,' '),(0,4,'flag'),
  (1,0,'number(9)'),(1,1,'varchar(10)'),(1,2,'decimal(10,2)'),(1,3,'int'),(1,4,''),
  (2,0,'first'),(2,1,''),(2,2,'third'),(2,3,''),(2,4,'fifth')) v(row_no, col_no, value)),
body AS (SELECT l_orderkey, l_linenumber, max(l_partkey) p, max(l_quantity)::INT q, max(l_returnflag) f
         FROM lineitem GROUP BY 1, 2),
cells AS (
  SELECT 'book_' || (o_orderkey % 10) AS file, 'order_' || o_orderkey AS sheet, row_no, col_no, value FROM orders, heads
  UNION ALL SELECT 'book_' || (l_orderkey % 10), 'order_' || l_orderkey, l_linenumber + 2, 0, p::VARCHAR FROM body
  UNION ALL SELECT 'book_' || (l_orderkey % 10), 'order_' || l_orderkey, l_linenumber + 2, 2, q::VARCHAR FROM body
  UNION ALL SELECT 'book_' || (l_orderkey % 10), 'order_' || l_orderkey, l_linenumber + 2, 4, f FROM body
)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as history entries of a user."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("key"),
        F.col("event_id").alias("id"),
        millis(F.col("ts")).alias("created_ms"),
        F.when(F.col("event_id") % 11 == 0, "FILES").otherwise("TEXT").alias("type"),
        F.col("event_type").alias("text"),
        F.when(F.col("event_id") % 11 == 0, F.array(_cat("/tmp/", F.col("event_type"), ".txt"))).alias("file_paths"),
        F.lit(None).cast("string").alias("image_path"),
        F.when(F.col("event_id") % 13 != 0, F.sha2("event_type", 256)).alias("hash"),
        (F.col("event_id") % 50 == 0).alias("pinned"),
    )


HISTORY_SQL = """
history AS (
  SELECT user_id AS key, event_id AS id, epoch_ns(ts) // 1000000 AS created_ms,
         CASE WHEN event_id % 11 = 0 THEN 'FILES' ELSE 'TEXT' END AS type, event_type AS text,
         CASE WHEN event_id % 11 = 0 THEN '/tmp/' || event_type || '.txt' END AS path,
         CASE WHEN event_id % 13 <> 0 THEN sha256(event_type) END AS hash, event_id % 50 = 0 AS pinned
  FROM events
)"""


def marked_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History with suppress, pause and resume events in between."""
    i = F.col("id")
    event = (
        F.when(i % 17 == 0, "suppress").when(i % 29 == 0, "pause").when(i % 23 == 0, "resume").otherwise("item")
    )
    return history(spark, sf_dir).select("key", "id", "created_ms", event.alias("event"), "type", "hash")


MARKED_SQL = (
    HISTORY_SQL
    + """,
marked AS (
  SELECT key, id, created_ms, type, hash, CASE WHEN id % 17 = 0 THEN 'suppress' WHEN id % 29 = 0 THEN 'pause'
         WHEN id % 23 = 0 THEN 'resume' ELSE 'item' END AS event FROM history
)"""
)
