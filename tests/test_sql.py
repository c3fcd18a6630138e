"""SQL corpus and metric catalogue goldens."""

import pytest
from pyspark.sql import functions as F

from weftline.functions.tokens import begins_operand, begins_word, is_operand, is_word, sql_tokens, tokens_of
from weftline.operators import metrics, selectitems, sqlcorpus
from weftline.plans import views
from weftline.plans.queries import QUERIES

JOIN = """SELECT p.parcel, d.label, p.weight_kg
FROM depot.parcels p
LEFT OUTER JOIN depot.drivers d ON d.driver = p.driver
WHERE p.closed = 'n';"""
INSERT = """INSERT INTO depot.routes (route, stops)
SELECT s.route, s.stops FROM depot.stop_log s INNER JOIN depot.drivers d ON d.driver = s.driver;"""
MERGE = """MERGE INTO depot.routes r USING (SELECT route, stops FROM depot.stop_log) n ON (r.route = n.route)
WHEN MATCHED THEN UPDATE SET r.stops = n.stops WHEN NOT MATCHED THEN INSERT (route, stops) VALUES (n.route, n.stops);"""
CTE = "WITH late AS (SELECT hub FROM depot.routes) SELECT hub, COUNT(hub) FROM late GROUP BY hub"


def inputs(spark, *texts):
    return spark.createDataFrame([(i, f"s{i}", t) for i, t in enumerate(texts)], "ord long, sql_id string, sql string")


def refs(spark, text):
    rows = sqlcorpus.table_refs(inputs(spark, text)).collect()
    return {r.name for r in rows if r.role == "read"}, {r.name for r in rows if r.role == "write"}


@pytest.mark.parametrize(
    "text, reads, writes",
    [
        (JOIN, {"depot.parcels", "depot.drivers"}, set()),
        (INSERT, {"depot.stop_log", "depot.drivers"}, {"depot.routes"}),
        (MERGE, {"depot.stop_log"}, {"depot.routes"}),
        (CTE, {"depot.routes"}, set()),
        ("select extract(year from o_date), trim(both from x) from t", {"t"}, set()),
        ("select substring(a from 2) from t, u where a is distinct from b", {"t", "u"}, set()),
        ("select a from t where k = 1 for update of a", {"t"}, set()),
        ("select a from t for update nowait", {"t"}, set()),
        ("insert into t values (1) on duplicate key update c = 2", set(), {"t"}),
        ("select * from t join lateral (select 1 from u) x on true", {"t", "u"}, set()),
        ("with c(x, y) as (select a, b from t) select * from c", {"t"}, set()),
        ("with c as materialized (select a from t), d as not materialized (select b from u) select * from c, d", {"t", "u"}, set()),
        ("with c as (select a from t) update u set b = 1 where a in (select a from c)", {"t"}, {"u"}),
        ("insert overwrite t select * from u", {"u"}, {"t"}),
        ("insert overwrite table t select * from u", {"u"}, {"t"}),
        ("delete t where a = 1", set(), {"t"}),
        ("update t set a = u.b from u where t.k = u.k", {"u"}, {"t"}),
        ("from t insert overwrite table u select a", {"t"}, {"u"}),
        ("select * from a x, (select 1 from b, c) y, d where f(x, e) in (1, 2)", {"a", "b", "c", "d"}, set()),
        ("delete from t where k in (select k from u)", {"u"}, {"t"}),
        ("update t set a = 1, b = 2 where c in (select k from u)", {"u"}, {"t"}),
        ("create or replace view v as select * from t", {"t"}, {"v"}),
        ("drop table if exists t", set(), {"t"}),
        ("create table if not exists t (id int)", set(), {"t"}),
        ("alter table t add c int", set(), {"t"}),
        ("select 'from x' from t -- from y\n/* join z */", {"t"}, set()),
        ('select * from "My Table" join `u`.`v` on 1 = 1', {'"My Table"', "`u`.`v`"}, set()),
    ],
)
def test_table_refs(spark, text, reads, writes):
    assert refs(spark, text) == (reads, writes)


def test_facts_of_texts(spark):
    rows = sqlcorpus.extract_facts(
        inputs(spark, INSERT, "vacuum t; " + INSERT, "", None, " ; -- none", "select 1; select 1 from b, a; update c set x = 1")
    ).orderBy("ord").collect()
    assert [r.status for r in rows] == ["SUCCESS", "PARTIAL", "PARSE_FAILED", "PARSE_FAILED", "PARSE_FAILED", "SUCCESS"]
    assert rows[0].read_tables == ["depot.drivers", "depot.stop_log"] and rows[0].write_tables == ["depot.routes"]
    assert rows[1].statement_types == ["UNKNOWN", "INSERT"]
    assert (rows[5].statement_types, rows[5].read_tables, rows[5].write_tables) == (["SELECT", "UPDATE"], ["a", "b"], ["c"])
    assert rows[2].read_tables == [] and rows[2].columns == []


SCOPED = [
    # a common table expression hides a table only where it is visible
    ("with t as (select a from t) select * from t", {"t"}, set()),
    ("with recursive t as (select a from u union all select a from t) select * from t", {"u"}, set()),
    ("select * from (with c as (select 1 from a) select * from c) x join c on true", {"a", "c"}, set()),
    ("with a as (select 1 from b), b as (select 1 from a) select * from a, b", {"b"}, set()),
    ("with c as (select 1 from t) select * from u where k in (select k from c) union select 1 from c", {"t", "u"}, set()),
    ("select 1 from c; with c as (select 1 from d) select 1 from c", {"c", "d"}, set()),
    ("select case when a = 1 then b else c end from t", {"t"}, set()),
    ("select * from (a join b on a.k = b.k) join c using (k)", {"a", "b", "c"}, set()),
    ("select * from a join b on a.k = b.k, c", {"a", "b", "c"}, set()),
    ("select * from unnest(x) u, range(1, 2) r, t", {"t"}, set()),
    ("(select a from t) union all (select a from u) order by a", {"t", "u"}, set()),
    ("merge into r using s on (r.a = s.a) when not matched then insert (a) values (s.a)", {"s"}, {"r"}),
]


def test_table_refs_by_scope(spark):
    rows = sqlcorpus.table_refs(inputs(spark, *[text for text, _, _ in SCOPED])).collect()
    for i, (text, reads, writes) in enumerate(SCOPED):
        got = [{r.name for r in rows if r.ord == i and r.role == role} for role in ("read", "write")]
        assert got == [reads, writes], text


def columns(spark, text):
    return {r.column_name for r in sqlcorpus.column_refs(inputs(spark, text)).collect()}


COLUMNS = [
    ("select p.a, q.b x, c from t p join s.u as q on p.k = q.k", {"t.a", "s.u.b", "UNKNOWN.c", "t.k", "s.u.k"}),
    ("select a, count(b) total from t where c = 'd' group by e having max(f) > 1 order by g", {"t.a", "t.b", "t.c", "t.e", "t.f", "t.g"}),
    ("select t.a from t where exists (select 1 from t x where x.b = t.c and d = 1)", {"t.a", "t.b", "t.c", "t.d"}),
    ("with c as (select a from t) select c.a, x from c", {"t.a"}),
    ("select d.a, u.b from (select a from t) d, u", {"t.a", "u.b"}),
    ("select a from t union select a from u", {"t.a", "u.a"}),
    ("select p.a from t p union select p.b from u p order by a", {"t.a", "u.b"}),
    ("update t set a = 1 where b in (select c from u)", {"t.a", "t.b", "u.c"}),
    ("insert into t (a, b) select c, 1 from u", {"t.a", "t.b", "u.c"}),
    ("merge into r using s on (r.a = s.b) when matched then update set r.c = s.d", {"r.a", "s.b", "r.c", "s.d"}),
    ("select t.*, z.a from t join u on true", {"t.*", "UNKNOWN.z.a"}),
    ('select x."My Col", "T y"."a.b" from `q`.`t` x, "T y"', {'`q`.`t`."My Col"', '"T y"."a.b"'}),
    ("select date '2020-01-01', interval '1' day, cast(a as int), extract(year from b) from t", {"t.a", "t.b"}),
    ("select case when a then b else c end total, sum(d) over (partition by e order by f) w from t", {f"t.{c}" for c in "abcdef"}),
    ("select 1", set()),
]


def test_columns(spark):
    rows = sqlcorpus.column_refs(inputs(spark, *[text for text, _ in COLUMNS])).collect()
    for i, (text, expected) in enumerate(COLUMNS):
        got = {r.column_name for r in rows if r.ord == i}
        got = {c for c in got if not c.endswith((".int", ".year"))}  # types and units look like names
        assert got == expected, text


def test_columns_are_facts(spark):
    row = sqlcorpus.extract_facts(inputs(spark, "select a from t; select b from u")).first()
    assert row.columns == ["t.a", "u.b"] and row.read_tables == ["t", "u"]


def text_items(spark, *texts):
    rows = selectitems.metric_items(inputs(spark, *texts)).orderBy("ord", "branch_no", "item_no").collect()
    return [(r.sql_id, r.branch_no, r.item_no, r.alias, r.expression) for r in rows]


def test_items_of_texts(spark):
    grouped = """SELECT DISTINCT hub, SUM(w) AS load, COUNT(DISTINCT id) n, SUM(p) / NULLIF(SUM(w), 0) AS "Rate"
        FROM depot.parcels WHERE state = 'IN' GROUP BY hub, f(a, b) HAVING SUM(w) > 100 ORDER BY 1"""
    assert text_items(spark, grouped) == [
        ("s0", 1, 1, None, "hub"), ("s0", 1, 2, "load", "SUM(w)"), ("s0", 1, 3, "n", "COUNT(DISTINCT id)"),
        ("s0", 1, 4, '"Rate"', "SUM(p) / NULLIF(SUM(w), 0)"),
    ]
    row = selectitems.metric_items(inputs(spark, grouped)).where("item_no = 2").first()
    assert (row.group_by, row.where_text, row.having_text) == (["hub", "f(a, b)"], "state = 'IN'", "SUM(w) > 100")
    assert row.source_tables == ["depot.parcels"]


BRANCHES = [
    ("select a from t union all select b, c from u", [(1, "a"), (2, "b"), (2, "c")]),
    ("(select a from t) union ((select b from u) except select c from w) limit 3", [(1, "a"), (2, "b"), (3, "c")]),
    ("with x as (select q from t) select a, (select max(b) from u) m from x", [(1, "a"), (1, "(select max(b) from u)")]),
    ("select sum(case when a = 'x, y' then b else -1 end) from t -- , z", [(1, "sum(case when a = 'x, y' then b else -1 end)")]),
    ("select sum(a) over (partition by b order by c) from t", [(1, "sum(a) over (partition by b order by c)")]),
    ("select listagg(a, ',') within group (order by b) l from t", [(1, "listagg(a, ',') within group (order by b)")]),
    ("select a is distinct from b, extract(year from c) from t", [(1, "a is distinct from b"), (1, "extract(year from c)")]),
    ("insert into t select sum(a) from u", []),
    ("select 1; select x from t; select from u where", [(1, "1"), (1_000_001, "x")]),
    ("select a from t join u using (k) where b in (1, 2) group by c", [(1, "a")]),
    ("select count(*), max(-1), a - -b, - c from t", [(1, "count(*)"), (1, "max(-1)"), (1, "a - -b"), (1, "-c")]),
]


def test_branches_of_texts(spark):
    got = text_items(spark, *[text for text, _ in BRANCHES])
    for i, (text, expected) in enumerate(BRANCHES):
        assert [(b, e) for name, b, _, _, e in got if name == f"s{i}"] == expected, text


def test_metric_statuses_of_texts(spark):
    texts = ["select sum(a) from t", "select a from t", "update t set a = 1", "select max(a) from t; drop table t", "", None]
    rows = sorted(tuple(r) for r in selectitems.metric_statuses(inputs(spark, *texts)).collect())
    assert rows == [
        ("s0", "SUCCESS", 1), ("s1", "SUCCESS", 0), ("s2", "UNSUPPORTED", 0), ("s3", "PARTIAL", 1), ("s4", "PARSE_FAILED", 0), ("s5", "PARSE_FAILED", 0),
    ]


def test_dimensions_need_no_first_item(spark):
    items = selectitems.metric_items(inputs(spark, "select hub h, sum(w) from t group by hub, day")).where("item_no = 2")
    rows = sorted((r.dim_no, r.name) for r in metrics.metric_dimensions(items).collect())
    assert rows == [(0, "hub"), (1, "day")]


def test_scopes_of_long_statements(spark):
    text = "select " + ", ".join(f"t{i % 50}.c{i}" for i in range(1500)) + " from " + ", ".join(f"s{i} t{i}" for i in range(50))
    assert columns(spark, text) == {f"s{i % 50}.c{i}" for i in range(1500)}


def test_statement_kinds(spark):
    text = "; ".join(
        [
            JOIN.rstrip(";"), INSERT.rstrip(";"), MERGE.rstrip(";"), CTE, "(select 1)", "create view v as select 1",
            "create or replace table t (a int)", "update t set a = 1", "delete from t", "alter table t add b int",
            "drop table t", "grant select on t to u", " ; ",
        ]
    )
    rows = sorted(sqlcorpus.statement_kinds(inputs(spark, text)).collect(), key=lambda r: r.statement_no)
    assert [r.kind for r in rows] == (
        "SELECT INSERT MERGE SELECT SELECT CREATE_VIEW CREATE_TABLE UPDATE DELETE ALTER DROP UNKNOWN".split()
    )


def test_blank_text_has_no_statement(spark):
    assert sqlcorpus.statement_kinds(inputs(spark, "", "  ;; ", "-- only")).count() == 0
    got = sqlcorpus.triage(inputs(spark, "", None, "x")).orderBy("ord").collect()
    assert [r.status for r in got] == ["PARSE_FAILED", "PARSE_FAILED", None]


def test_long_literals_are_one_token(spark):
    text = "select '" + "it''s " * 20_000 + "' from t"
    df = spark.createDataFrame([(text,)], "t string").select(F.size(sql_tokens(F.col("t"))).alias("n"))
    assert df.first().n == 4


FACTS = "ord long, sql_id string, status string, statement_types array<string>, read_tables array<string>, write_tables array<string>, columns array<string>"


def test_batch_edges_show_the_first_spelling(spark):
    facts = spark.createDataFrame(
        [
            (2, "b", "SUCCESS", [], ["ods.A"], [" DWD.B "], []),
            (1, "a", "PARTIAL", [], ["ODS.a", "dwd.b"], ["dwd.B"], []),
            (0, "c", "PARSE_FAILED", [], ["x"], ["y"], []),
            (3, " ", "SUCCESS", [], ["ods.a"], ["dwd.b"], []),
        ],
        FACTS,
    )
    assert [tuple(r) for r in sqlcorpus.batch_edges(facts).collect()] == [("ODS.a", "dwd.B", 2)]
    merged = {(r.role, r.name) for r in sqlcorpus.merged_tables(facts).collect()}
    assert ("read", "x") in merged and len(merged) == 9
    assert sqlcorpus.status_rollup(facts).first()[:] == (4, 2, 1, 0, 1)
    assert sqlcorpus.status_rollup(facts.limit(0)).first()[:] == (0, 0, 0, 0, 0)


ITEMS = (
    "sql_id string, ord long, branch_no int, item_no int, alias string, expression string, group_by array<string>, "
    "where_text string, having_text string, source_tables array<string>"
)


def items(spark, *rows):
    return spark.createDataFrame(
        [(s, i, 1, n, alias, text, ["hub"], None, None, ["t"]) for i, (s, n, alias, text) in enumerate(rows)], ITEMS
    )


def classes(spark, *texts):
    rows = metrics.probe_metrics(items(spark, *[("s", i + 1, None, t) for i, t in enumerate(texts)])).collect()
    return {r.expression: r.type for r in rows}


def test_metric_corpus(spark):
    basic = items(
        spark,
        ("s", 1, None, "hub"),
        ("s", 2, "kilos", "SUM(weight_kg)"),
        ("s", 3, "drivers_seen", "COUNT(DISTINCT driver)"),
        ("s", 4, "late_share", "SUM(late) / NULLIF(COUNT(parcel), 0)"),
    )
    got = metrics.probe_metrics(basic).orderBy("item_no").collect()
    assert [(r.name, r.type, r.aggregation) for r in got] == [
        ("kilos", "SUM", "SUM"), ("drivers_seen", "COUNT_DISTINCT", "COUNT"), ("late_share", "RATIO", "SUM,COUNT"),
    ]
    assert [r["name"] for r in metrics.metric_dimensions(basic).collect()] == ["hub"]


def test_metric_classes(spark):
    want = {
        "SUM(CASE WHEN closed = 'y' THEN weight_kg ELSE 0 END)": "CONDITIONAL_AGGREGATION",
        "SUM(weight_kg) OVER (PARTITION BY hub)": "WINDOW",
        "row_number() over (order by a)": "WINDOW",
        "COUNT(*)": "COUNT",
        "count ( * ) * 2": "DERIVED",
        "SUM(a) - SUM(b)": "DERIVED",
        "SUM(a - b)": "DERIVED",
        "MAX(-1)": "MAX",
        "SUM(CASE WHEN a THEN -1 END)": "CONDITIONAL_AGGREGATION",
        "avg(x)": "AVG",
        "STDDEV(x)": "DERIVED",
        "MIN(x) || MAX(y)": "DERIVED",
        "SUM(a % 2)": "DERIVED",
        "SUM(x) / -1": "RATIO",
        "MEDIAN(x)": "DERIVED",
        "STDDEV_POP(x)": "DERIVED",
        "percentile_cont(0.5) within group (order by x)": "DERIVED",
        "own_agg(x) within group (order by x)": "DERIVED",
        "own_agg(x) over (order by x)": "WINDOW",
    }
    assert classes(spark, *want) == want
    assert classes(spark, "parcel", "a + b", "sum", "'SUM(x)'") == {}


def test_literals_keep_their_meaning(spark):
    texts = ["SUM(CASE WHEN s = 'Sent' THEN 1 END)", "SUM(CASE WHEN s = 'sent' THEN 1 END)",
             "MAX('a b')", "MAX('a  b')", "MAX('it''s')", "MAX('its')", 'SUM("Amount")', 'SUM("amount")']
    found = metrics.probe_metrics(items(spark, *[(f"s{i}", 1, None, t) for i, t in enumerate(texts)]))
    assert metrics.duplicate_metrics(found).count() == 0


def test_duplicates(spark):
    found = metrics.probe_metrics(
        items(spark, ("sql-a", 1, "x", "SUM(kilos)"), ("sql-b", 1, "y", "sum( KILOS )"), ("sql-b", 2, "z", "SUM(other)"))
    )
    groups = metrics.duplicate_metrics(found)
    assert [tuple(r) for r in groups.collect()] == [("SUM ( KILOS )", "SUM(kilos)", 2, 2, 2)]
    members = metrics.duplicate_members(found, groups).collect()
    assert {(r.name, r.sql_id) for r in members} == {("x", "sql-a"), ("y", "sql-b")}


def test_metric_status(spark):
    statements = spark.createDataFrame(
        [("a", "SELECT"), ("b", "SELECT"), ("b", "INSERT"), ("c", "UPDATE"), ("d", None), ("e", "SELECT")],
        "sql_id string, kind string",
    )
    found = spark.createDataFrame([("a",), ("b",)], "sql_id string")
    statuses = metrics.metric_status(statements, found)
    assert {r.sql_id: r.status for r in statuses.collect()} == {
        "a": "SUCCESS", "b": "PARTIAL", "c": "UNSUPPORTED", "d": "PARSE_FAILED", "e": "SUCCESS",
    }
    assert metrics.metric_rollup(statuses).first()[:] == (5, 2, 1, 1, 1, 2)


ODD_TOKENS = [
    "select 'it''s', \"a\nb\".c, `x``y`.* from t -- end\n/* b */ , u /* open", "a.b.*<>1.5||.5;$%'open ''", "é.Ä straße 漢字.列 Ⅷ x² ١ a١ \u00a0\u2028 b\u0301", " \n\t", "--",
]


def test_tokens_in_python_are_those_of_the_column(spark):
    rows = spark.createDataFrame([(t,) for t in ODD_TOKENS], "t string").select("t", sql_tokens(F.col("t")).alias("tokens"))
    kinds = [F.transform("tokens", is_word).alias("words"), F.transform("tokens", is_operand).alias("operands")]
    for r in rows.select("*", *kinds).collect():
        assert tokens_of(r.t) == r.tokens
        assert [begins_word(t) for t in r.tokens] == r.words and [begins_operand(t) for t in r.tokens] == r.operands


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_facts_walk_texts_once_and_join_nothing(spark):
    plan = plan_of(sqlcorpus.column_usage(sqlcorpus.extract_facts(inputs(spark, JOIN, CTE))))
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    assert "lambdafunction" not in plan and plan.count("Exchange hashpartitioning") == 2


def test_facts_of_repeated_and_missing_keys(spark):
    rows = [(1, "s", "select a from t"), (1, "s", ""), (1, "s", "select 1; update u set b = 1; vacuum x"), (None, None, "select c from w"), (None, "s", None)]
    facts = sqlcorpus.extract_facts(spark.createDataFrame(rows, "ord long, sql_id string, sql string")).collect()
    shared = (["SELECT", "UPDATE", "UNKNOWN"], ["t"], ["u"], ["t.a", "u.b"])
    got = sorted(((r.ord, r.sql_id), r.status, (r.statement_types, r.read_tables, r.write_tables, r.columns)) for r in facts if r.ord)
    assert got == [((1, "s"), "PARSE_FAILED", shared), ((1, "s"), "PARTIAL", shared), ((1, "s"), "PARTIAL", shared)]
    assert {(r.sql_id, r.status, tuple(r.columns)) for r in facts if r.ord is None} == {(None, "SUCCESS", ("w.c",)), ("s", "PARSE_FAILED", ())}


def part_table(spark, folder, rows=400):
    part = spark.range(1, rows + 1, 1, 1).selectExpr(
        "id p_partkey", "concat('part ', id) p_name", "concat('Brand#', id % 7) p_brand", "'LARGE TIN' p_type", "cast(id % 50 as int) p_size", "1.5D p_retailprice"
    )
    part.write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_metric_texts_of_one_small_file_are_spread(spark, tmp_path):
    texts = views.metric_texts(spark, part_table(spark, tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(texts) >= spark.sparkContext.defaultParallelism and sum(r["count"] for r in texts) == 400


def test_dimensions_of_texts_walk_texts_once(spark, tmp_path):
    dimensions = QUERIES["text_metric_dimensions"](spark, part_table(spark, tmp_path))
    assert "MapInArrow" not in plan_of(dimensions) and "aggregate(" not in plan_of(dimensions)  # the items are written
    rows = {tuple(r) for r in dimensions.where("sql_id in ('sql-4', 'sql-5')").collect()}
    assert rows == {
        ("sql-4", 1, 0, "department", "DEPT_4"), ("sql-4", 2, 0, "DEPT_4", "DEPT_4"), ("sql-5", 1, 0, "DEPT_0", "DEPT_0"), ("sql-5", 2, 0, "DEPT_0", "DEPT_0"),
    }
    assert dimensions.count() == 320


def test_statuses_of_texts_join_kinds_to_nothing(spark):
    statuses = selectitems.metric_statuses(inputs(spark, "select sum(a) from t", "update t set a = 1"))
    assert plan_of(statuses).count("Join") == 1  # with the metrics

    rows = [(1, "s", "select sum(a) from t"), (1, "s", None), (None, "s", "drop table t"), (2, None, "select max(a) from t"), (3, "u", "")]
    repeated = spark.createDataFrame(rows, "ord long, sql_id string, sql string")
    got = {tuple(r) for r in selectitems.metric_statuses(repeated).collect()}
    assert got == {("s", "PARTIAL", 1), (None, "SUCCESS", 0), ("u", "PARSE_FAILED", 0)}
