"""Ordered operators: the split path for hot keys must equal the plain window and a loop."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import history, ordered
from weftline.operators.ordered import Running, running


def rows_with_hot_key(n=600, seed=1):
    rnd = random.Random(seed)
    keys = ["hot"] * (n // 2) + [None] * (n // 4) + [f"k{i % 40}" for i in range(n // 4)]
    rnd.shuffle(keys)
    # many rows share a moment, so ties are broken by id
    return [(k, rnd.randrange(5), i, rnd.choice([None, 1, 2, 3])) for i, k in enumerate(keys)]


@pytest.fixture
def narrow(spark):
    """Many small range partitions, so that keys are cut."""
    names = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


SCHEMA = "key string, ts int, id int, x int"


def reference(rows):
    out = {}
    state = {}
    for k, ts, i, x in sorted(rows, key=lambda r: (r[1], r[2])):
        s = state.setdefault(k, dict(prev=None, last=None, n=0, total=None, high=None))
        before_sum, before_max = s["total"], s["high"]
        prev, last = s["prev"], s["last"]
        s["n"] += 1
        if x is not None:
            s["total"] = (s["total"] or 0) + x
            s["high"] = x if s["high"] is None else max(s["high"], x)
            s["last"] = x
        s["prev"] = x
        out[i] = (prev, last, s["n"], s["total"], s["high"], before_sum, before_max)
    return out


@pytest.mark.parametrize("rows", [rows_with_hot_key(), rows_with_hot_key()[:1], []])
def test_running_values(spark, narrow, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    x = F.col("x")
    specs = {
        "p": Running("previous", x),
        "l": Running("last", x),
        "n": Running("count"),
        "s": Running("sum", x),
        "m": Running("max", x),
        "sb": Running("sum_before", x),
        "mb": Running("max_before", x),
    }
    got = running(df, ["key"], ["ts", "id"], specs).collect()
    assert {r["id"]: (r.p, r.l, r.n, r.s, r.m, r.sb, r.mb) for r in got} == reference(rows)
    assert len(got) == len(rows)


def test_many_hot_keys_are_spread(spark, narrow):
    """Keys on disjoint ranges of the order: each lies in several partitions, and each running count is whole."""
    rows = [(f"k{k}", k * 1000 + i, i, 1) for k in range(4) for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    placed = ordered.range_sorted(df, [F.col("key"), F.col("ts"), F.col("id")])
    parts = {r["key"]: r["parts"] for r in placed.groupBy("key").agg(F.count_distinct("_part").alias("parts")).collect()}
    assert min(parts.values()) >= 3
    got = running(df, ["key"], ["ts", "id"], {"n": Running("count")})
    assert got.where("n <> id + 1").isEmpty() and got.count() == len(rows)


def test_ranked_and_page(spark):
    rnd = random.Random(3)
    values = [(rnd.randrange(1000), i) for i in range(500)]
    df = spark.createDataFrame(values, "a int, b int").repartition(7)
    got = ordered.ranked(df, [F.col("a").desc(), F.col("b")]).collect()
    want = sorted(values, key=lambda r: (-r[0], r[1]))
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.idx)] == want
    assert sorted(r.idx for r in got) == list(range(500))

    last = ordered.page(df, [F.col("b")], 99, 60).collect()
    assert [r.b for r in last] == list(range(480, 500))
    assert (last[0].page, last[0].total_pages, last[0].total_rows) == (9, 9, 500)
    assert [r.b for r in ordered.page(df, [F.col("b")], 0, 3).collect()] == [0, 1, 2]
    assert ordered.page(df.where("a < 0"), [F.col("b")], 2, 10).count() == 0
    with pytest.raises(ValueError):
        ordered.page(df, [F.col("b")], 1, 0)


HISTORY = "key string, id long, created_ms long, type string, text string, hash string, pinned boolean"


def entries(spark, letters, key="k", types=None, pinned=()):
    types = types or ["TEXT"] * len(letters)
    return spark.createDataFrame(
        [(key, i, i, t, x, x, i in pinned) for i, (x, t) in enumerate(zip(letters, types))], HISTORY
    )


def test_consecutive_duplicates(spark, narrow):
    df = entries(spark, ["A", "A", "B", "A"])
    assert sorted(r.id for r in history.drop_consecutive(df, "key", ["id"]).collect()) == [0, 2, 3]
    other = entries(spark, ["A", "A", None, "A"], types=["TEXT", "IMAGE", "TEXT", "IMAGE"])
    assert sorted(r.id for r in history.drop_consecutive(other, "key", ["id"]).collect()) == [0, 1]


def events(spark, items):
    return spark.createDataFrame(
        [("k", i, event, "TEXT", value) for i, (event, value) in enumerate(items)],
        "key string, id long, event string, type string, hash string",
    )


def watcher(items):
    """The rules as a loop: one marker, one last fingerprint, one pause switch."""
    kept, last, marker, paused = [], None, None, False
    for i, (event, value) in enumerate(items):
        if event == "pause":
            paused = True
        elif event == "resume":
            paused = False
        elif event == "suppress":
            marker = value
        elif not paused and value is not None:
            pending, marker = marker, None
            if value != pending and value != last:
                kept.append(i)
            last = value
    return kept


@pytest.mark.parametrize("seed", range(4))
def test_markers_and_pauses_against_a_loop(spark, narrow, seed):
    rnd = random.Random(seed)
    items = [
        (rnd.choice(["item"] * 8 + ["suppress", "pause", "resume", "resume"]), rnd.choice(["A", "B", None]))
        for _ in range(80)
    ]
    live = history.drop_paused(events(spark, items), "key", ["id"])
    got = history.suppress_marked(live, "key", ["id"])
    assert sorted(r.id for r in got.collect()) == watcher(items)


def test_marker_expires_on_other_content(spark):
    items = [("suppress", "A"), ("item", "B"), ("item", "A"), ("suppress", "C"), ("item", "C"), ("item", "C")]
    got = history.suppress_marked(events(spark, items), "key", ["id"])
    assert sorted(r.id for r in got.collect()) == [1, 2]


def test_retention(spark):
    df = entries(spark, ["keep", "old", "middle", "new"], pinned={0})
    assert {r.text for r in history.retain(df, "key", 2).collect()} == {"keep", "middle", "new"}
    assert {r.text for r in history.evicted(df, "key", 2).collect()} == {"old"}
    two_pins = entries(spark, ["a", "b", "c", "d"], pinned={0, 1})
    assert {r.text for r in history.retain(two_pins, "key", 1).collect()} == {"a", "b", "d"}
    assert [r.text for r in history.history_order(two_pins).collect()] == ["b", "a", "d", "c"]
    with pytest.raises(ValueError):
        history.retain(df, "key", 0)


def test_retention_splits_the_input(spark):
    rnd = random.Random(5)
    rows = [
        (rnd.choice(["a", "b", None]), i, rnd.randrange(9), "TEXT", "x", "x", rnd.choice([True, False, False, None]))
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, HISTORY)
    kept = [r.id for r in history.retain(df, "key", 25).collect()]
    gone = [r.id for r in history.evicted(df, "key", 25).collect()]
    assert sorted(kept + gone) == list(range(300))
    for key in ("a", "b", None):
        loose = sorted((r for r in rows if r[0] == key and not r[6]), key=lambda r: (r[2], r[1]), reverse=True)
        assert {r[1] for r in loose[25:]} == {i for i in gone if rows[i][0] == key}


def test_rank_limit_runs_before_the_exchange(spark):
    df = entries(spark, ["a", "b", "c"])
    plan = history.retain(df, "key", 9_000)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_ids_against_a_loop(spark, narrow):
    rnd = random.Random(7)
    rows = [("k", i, rnd.randrange(30)) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, id long, created_ms long")
    last, want = None, {}
    for _, i, ms in sorted(rows, key=lambda r: (r[2], r[1])):
        last = ms if last is None else max(last + 1, ms)
        want[i] = last
    got = history.assign_ids(df, "key", ["created_ms", "id"]).collect()
    assert {r.id: r.assigned_id for r in got} == want


def test_expiry_is_strict(spark):
    df = spark.createDataFrame([(1, 0), (2, 1)], "id long, created_ms long")
    limit = history.DEFAULT_TTL_MS
    assert [r.id for r in history.expire(df, limit + 1).collect()] == [2]
    assert sorted(r.id for r in history.expire(df, limit).collect()) == [1, 2]
