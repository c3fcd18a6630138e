"""The stored graph after changes against a graph built anew."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import components, graph, graphstore

JOBS = "name string, input_tables array<string>, output_tables array<string>"


def job(i):
    rng = random.Random(i)
    pick = lambda n: [f"t{rng.randint(0, 14)}" for _ in range(n)]
    return (f"j{i}" if i % 7 else f" {i}"[:-1] or None, pick(rng.randint(0, 3)), pick(rng.randint(0, 2)))


def frame(spark, jobs):
    rows = spark.createDataFrame(jobs, JOBS).withColumn("ord", F.monotonically_increasing_id())
    return rows.withColumns({"source": F.lit("s"), "description": F.lit(None).cast("string"), "sql": F.concat(F.lit("sql of "), "name")})


def rows(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


def same_as_rebuilt(spark, store, jobs):
    catalogue = frame(spark, jobs)
    edges = graph.lineage_edges(catalogue, unique_names=True)
    cards = graph.table_cards(catalogue, edges)
    assert rows(store.edges()) == rows(edges)
    assert rows(store.cards()) == rows(cards)
    built = components.components(graph.lineage_nodes(catalogue), edges)
    assert rows(store.components()) == rows(built.select("name", "representative", "cluster_id"))
    return catalogue, edges, cards


def test_any_order_of_changes_equals_a_rebuild(spark, tmp_path):
    jobs = [("keep", ["t1"], ["t2"])] + [(f"j{i}", *job(i)[1:]) for i in range(1, 40)]
    passing = [(f"x{i}", *job(100 + i)[1:]) for i in range(12)]
    changes = [(jobs[:15] + passing[:6], []), (jobs[15:30], passing[:3]), (passing[6:], passing[3:6]), (jobs[30:], passing[6:])]
    for turn in (1, -1):
        root = str(tmp_path / f"store{turn}")
        # in the other order, jobs go before they came
        for added, removed in changes[::turn]:
            graphstore.apply_changes(spark, root, frame(spark, added), frame(spark, removed) if removed else None)
        same_as_rebuilt(spark, graphstore.open_store(spark, root), jobs)


def test_lookups_of_the_store(spark, tmp_path):
    root = str(tmp_path / "store")
    jobs = [(f"j{i}", *job(i)[1:]) for i in range(1, 30)]
    graphstore.apply_changes(spark, root, frame(spark, jobs))
    changed = [(n, [*i, "t3"], o) for n, i, o in jobs[:4]]
    store = graphstore.apply_changes(spark, root, frame(spark, changed), frame(spark, jobs[:4]))
    now = changed + jobs[4:]
    catalogue, edges, cards = same_as_rebuilt(spark, store, now)
    fields = ["name", *graph.JOB_FIELDS]
    for name in ("t2", "t3", "nothing"):
        assert rows(store.producers_of(name)) == rows(graph.producers_of(catalogue, name).select(*fields))
        assert rows(store.consumers_of(name)) == rows(graph.consumers_of(catalogue, name).select(*fields))
        assert rows(store.upstream_of(name)) == rows(graph.upstream_of(edges, name))
        assert rows(store.downstream_of(name)) == rows(graph.downstream_of(edges, name))
        assert rows(store.table_detail(name).drop("representative")) == rows(cards.where(F.col("name") == name))
        assert rows(store.resolve_sqls(name)) == rows(graph.resolve_sqls(catalogue, name))
    src, dst = edges.orderBy("src", "dst").first()[:2]
    assert rows(store.edge_detail(src, dst)) == rows(graph.edge_detail(catalogue, src, dst, unique_names=True))
    assert rows(store.resolve_sqls("j5")) == rows(graph.resolve_sqls(catalogue, "j5"))
    plan = store.producers_of("t2")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,t2)" in plan  # read by the statistics of the sorted files
    whole = graphstore.compact(spark, root)
    assert whole.version == 0 and graphstore.open_store(spark, root) == whole
    same_as_rebuilt(spark, whole, now)


def test_only_touched_components_are_written(spark, tmp_path):
    root = str(tmp_path / "store")
    graphstore.apply_changes(spark, root, frame(spark, [("a", ["a1"], ["a2"]), ("b", ["b1"], ["b2"]), ("c", ["c1"], ["c2"])]))
    store = graphstore.apply_changes(spark, root, frame(spark, [("d", ["b2"], ["b3"])]), frame(spark, [("c", ["c1"], ["c2"])]))
    last = store._rows("members").where("version = 1").orderBy("name").collect()
    assert [(r.name, r.representative) for r in last] == [("b1", "b1"), ("b2", "b1"), ("b3", "b1"), ("c1", None), ("c2", None)]
    assert {r.name for r in store.members().collect()} == {"a1", "a2", "b1", "b2", "b3"}


def test_unfinished_versions_are_not_seen(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    graphstore.apply_changes(spark, root, frame(spark, [("a", ["a1"], ["a2"])]))

    def lost(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(graphstore, "write_pointer", lost)
        with pytest.raises(RuntimeError):
            graphstore.apply_changes(spark, root, frame(spark, [("x", ["x1"], ["x2"])]))
    assert rows(graphstore.open_store(spark, root).edges()) == [("a1", "a2", "1")]
    graphstore.apply_changes(spark, root, frame(spark, [("b", ["a2"], ["b2"])]))
    same_as_rebuilt(spark, graphstore.open_store(spark, root), [("a", ["a1"], ["a2"]), ("b", ["a2"], ["b2"])])
    assert graphstore.open_store(spark, str(tmp_path / "none")).edges().count() == 0
    with pytest.raises(ValueError):
        graphstore.apply_changes(spark, root)
