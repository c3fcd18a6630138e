"""Lineage graph goldens and properties."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import closure, components, graph

JOBS = "name string, input_tables array<string>, output_tables array<string>"


def catalogue(spark, *jobs):
    rows = [(n, i, o) for n, i, o in jobs]
    return (
        spark.createDataFrame(rows, JOBS)
        .withColumn("ord", F.monotonically_increasing_id())
        .withColumns({c: F.lit(c) for c in ["source", "description", "sql"]})
    )


def toy(spark):
    return catalogue(
        spark,
        ("job1", ["ods_raw_a"], ["dwd_x"]),
        ("job2", ["ods_raw_b"], ["dwd_x"]),
        ("job3", ["dwd_x"], ["dws_y"]),
        ("job4", ["dws_y"], ["ads_z"]),
        ("job5", ["dwd_x"], ["ads_w"]),
    )


def column(df, name="name"):
    return [r[name] for r in df.collect()]


def distances(df):
    return {r["name"]: r["distance"] for r in df.collect()}


def test_toy_graph(spark):
    jobs = toy(spark)
    edges = graph.lineage_edges(jobs)
    cards = graph.table_cards(jobs, edges)
    assert (edges.count(), cards.count()) == (5, 6)
    assert column(graph.leaf_tables(cards)) == ["ads_w", "ads_z"]
    assert column(graph.source_tables(cards)) == ["ods_raw_a", "ods_raw_b"]
    x = cards.where("name = 'dwd_x'").first()
    assert (x.in_degree, x.out_degree, x.producing_sql_count, x.consuming_sql_count, x.layer) == (2, 2, 2, 2, "DWD")
    assert column(graph.search_tables(cards, "A")) == ["ads_w", "ads_z", "ods_raw_a", "ods_raw_b"]
    assert column(graph.search_tables(cards, " ", 2)) == ["ads_w", "ads_z"]
    assert column(graph.table_list(cards, "no such scope")) == ["ads_w", "ads_z"]


def test_weights_and_self_loops(spark):
    edges = graph.lineage_edges(catalogue(spark, ("j1", ["a"], ["b"]), ("j2", ["a"], ["b"]), ("j3", ["a"], ["b"])))
    assert [tuple(r) for r in edges.collect()] == [("a", "b", 3)]
    blank = graph.lineage_edges(catalogue(spark, (" ", ["a"], ["b"]), (None, ["a"], ["b"])))
    assert blank.first().weight == 1
    loop = catalogue(spark, ("j", ["t"], ["t"]), ("k", ["T"], ["t"]))
    assert graph.lineage_edges(loop).count() == 0
    assert sorted(column(graph.lineage_nodes(loop))) == ["T", "t"]
    usage = graph.table_usage(catalogue(spark, ("j", ["a", "a"], ["b", "b"]))).collect()
    assert {(r.name, r.producing_sql_count, r.consuming_sql_count) for r in usage} == {("a", 0, 1), ("b", 1, 0)}


def clusters(spark, jobs):
    return components.components(graph.lineage_nodes(jobs), graph.lineage_edges(jobs))


def test_components_small(spark):
    jobs = catalogue(spark, ("1", ["a"], ["b"]), ("2", ["c"], ["d"]), ("3", [], ["alone"]))
    got = {r["name"]: (r.representative, r.cluster_id) for r in clusters(spark, jobs).collect()}
    assert got == {"a": ("a", 0), "b": ("a", 0), "alone": ("alone", 1), "c": ("c", 2), "d": ("c", 2)}


@pytest.mark.parametrize("seed", range(2))
def test_components_against_union_find(spark, seed):
    rnd = random.Random(seed)
    pairs = [(f"t{rnd.randrange(70):02}", f"t{rnd.randrange(70):02}") for _ in range(45)]
    pairs += [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]  # a chain needs several rounds
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        lo, hi = sorted([find(a), find(b)])
        parent[hi] = lo
    jobs = catalogue(spark, *[(f"j{i}", [a], [b]) for i, (a, b) in enumerate(pairs)])
    got = {r["name"]: r.representative for r in clusters(spark, jobs).collect()}
    assert got == {x: find(x) for x in parent}
    positions = components.component_members(clusters(spark, jobs)).collect()
    by_cluster = {}
    for r in positions:
        by_cluster.setdefault(r.cluster_id, []).append((r.position, r["name"]))
    for members in by_cluster.values():
        assert [n for _, n in sorted(members)] == sorted(n for _, n in members)
        assert sorted(p for p, _ in members) == list(range(len(members)))


def test_subgraph(spark):
    jobs = toy(spark)
    nodes, edges = graph.lineage_nodes(jobs), graph.lineage_edges(jobs)
    up = closure.subgraph_nodes(edges, nodes, "ads_z", 0)
    assert distances(up) == {"ads_z": 0, "dws_y": 1, "dwd_x": 2, "ods_raw_a": 3, "ods_raw_b": 3}
    assert closure.max_upstream_depth(up).first()[0] == 3
    assert distances(closure.subgraph_nodes(edges, nodes, "ads_z", 1)) == {"ads_z": 0, "dws_y": 1}
    assert distances(closure.subgraph_nodes(edges, nodes, "dwd_x", 0)) == {
        "dwd_x": 0, "ods_raw_a": 1, "ods_raw_b": 1, "dws_y": -1, "ads_w": -1,
    }
    assert closure.subgraph_nodes(edges, nodes, "unknown").count() == 0
    sub_nodes, sub_edges = closure.subgraph(edges, nodes, "dws_y", 1)
    assert sorted(column(sub_nodes)) == ["ads_z", "dwd_x", "dws_y"]
    assert {(r.src, r.dst) for r in sub_edges.collect()} == {("dwd_x", "dws_y"), ("dws_y", "ads_z")}


def test_cycle_has_no_downstream(spark):
    jobs = catalogue(spark, ("1", ["a"], ["b"]), ("2", ["b"], ["c"]), ("3", ["c"], ["a"]))
    got = closure.subgraph_nodes(graph.lineage_edges(jobs), graph.lineage_nodes(jobs), "c", 0)
    assert distances(got) == {"c": 0, "b": 1, "a": 2}


def hops(pairs, seed):
    dist, queue = {seed: 0}, [seed]
    for x in queue:
        for a, b in pairs:
            if b == x and a not in dist:
                dist[a] = dist[x] + 1
                queue.append(a)
    return dist


@pytest.mark.parametrize("after", [0, 3, 24])
def test_closure_against_search(spark, monkeypatch, after):
    """Hop by hop, doubling from the start and doubling after three hops give the same distances."""
    monkeypatch.setattr(closure, "DOUBLING_AFTER", after)
    rnd = random.Random(after)
    pairs = [(f"c{i}", f"c{i + 1}") for i in range(11)] + [("c9", "c2")]
    pairs += [(f"c{rnd.randrange(12)}", f"x{rnd.randrange(6)}") for _ in range(8)]
    pairs = sorted({p for p in pairs if p[0] != p[1]})
    edges = spark.createDataFrame([(a, b, 1) for a, b in pairs], "src string, dst string, weight int")
    seeds = ["c11", "x1", "c0"]
    got = closure.upstream_closure(edges, spark.createDataFrame([(s,) for s in seeds], "name string"), 0).collect()
    want = {(s, n): d for s in seeds for n, d in hops(pairs, s).items()}
    assert {(r.seed, r["name"]): r.distance for r in got} == want
    assert len(got) == len(want)


def test_dense_walks_fall_back_to_single_hops(spark, monkeypatch):
    monkeypatch.setattr(closure, "DOUBLING_AFTER", 1)
    monkeypatch.setattr(closure, "WALK_GROWTH", 0)
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("a", "e")]
    edges = spark.createDataFrame([(a, b, 1) for a, b in pairs], "src string, dst string, weight int")
    got = closure.upstream_closure(edges, spark.createDataFrame([("e",)], "name string"), 0).collect()
    assert {r["name"]: r.distance for r in got} == hops(pairs, "e")


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(closure, "DOUBLING_AFTER", 2)
    edges = spark.range(300).selectExpr("concat('t', id) src", "concat('t', id + 1) dst", "1 weight")
    got = closure.upstream_closure(edges, spark.createDataFrame([("t300",)], "name string"), 0)
    assert got.agg(F.count("name"), F.max("distance"), F.sum("distance")).first()[:] == (301, 300, 300 * 301 // 2)


def test_edge_detail_and_resolution(spark):
    jobs = toy(spark)
    found = graph.edge_detail(jobs, "dwd_x", "dws_y").collect()
    assert [(r["name"], r.edge_exists, r.weight, r.sql) for r in found] == [("job3", True, 1, "sql")]
    missing = graph.edge_detail(jobs, "ads_z", "dwd_x").collect()
    assert [(r["name"], r.edge_exists, r.weight) for r in missing] == [(None, False, 0)]
    links = spark.createDataFrame([("p", "q", "gone")], "src string, dst string, name string")
    unknown = graph.edge_detail(jobs, "p", "q", links).collect()
    assert [(r["name"], r.edge_exists, r.sql) for r in unknown] == [("gone", True, None)]
    assert column(graph.resolve_sqls(jobs, "dwd_x")) == ["job1", "job2"]
    assert column(graph.resolve_sqls(jobs, "job4")) == ["job4"]
    assert column(graph.resolve_sqls(jobs, "ods_raw_a")) == []
    both = catalogue(spark, ("t", ["a"], ["b"]), ("j", ["t"], ["c"]))  # a source table named like a job
    assert column(graph.resolve_sqls(both, "t")) == ["t"]


def test_nameless_jobs_sort_last(spark):
    jobs = catalogue(spark, (None, ["a"], ["b"]), ("z", ["a"], ["b"]))
    assert column(graph.producers_of(jobs, "b")) == ["z", None]


def test_duplicate_names_are_refused(spark):
    jobs = catalogue(spark, ("same", ["a"], ["b"]), ("same", ["c"], ["d"]))
    with pytest.raises(ValueError, match="same"):
        graph.assert_unique_names(jobs)


def test_wide_catalogue(spark):
    jobs = (
        spark.range(10_000)
        .selectExpr("concat('j', id) name", "array(concat('ods_', id)) input_tables", "array(concat('ads_', id)) output_tables")
    )
    edges = graph.lineage_edges(jobs, unique_names=True)
    cards = graph.table_cards(jobs, edges)
    assert (edges.count(), graph.leaf_tables(cards).count()) == (10_000, 10_000)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edge_plan_reads_no_text_and_joins_nothing(spark, tmp_path):
    toy(spark).write.parquet(str(tmp_path / "jobs"))
    jobs = spark.read.parquet(str(tmp_path / "jobs"))
    plan = plan_of(graph.lineage_edges(jobs, unique_names=True))
    scan = plan[plan.index("ReadSchema"):]
    assert "sql" not in scan and "description" not in scan
    assert plan.count("Exchange") == 1 and "Join" not in plan
    cards = plan_of(graph.table_cards(jobs, graph.lineage_edges(jobs, unique_names=True)))
    assert "CartesianProduct" not in cards and "NestedLoop" not in cards
