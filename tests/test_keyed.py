"""Streams with written state: any cut into batches gives the rows of the batch operators."""

import random

import pytest

from weftline.operators import history
from weftline.streaming import keyed

ENTRY = "key string, id long, created_ms long, type string, hash string, pinned boolean"
AT_ONCE = {"availableNow": True}


def entries(n=240, seed=3):
    """In order of time, half of them of one key, some without key or hash, many at one moment."""
    rnd = random.Random(seed)
    keys = ["hot", "hot", None, "a", "b"]
    return [(rnd.choice(keys), i, i // 7, "TEXT", rnd.choice(["x", "y", None]), rnd.choice([True, None, False, False])) for i in range(n)]


def run(spark, folder, batches, start, schema=ENTRY):
    """One start of the stream per batch; rows of a batch arrive in any order."""
    for n, batch in enumerate(batches):
        mixed = random.Random(n).sample(batch, len(batch))
        spark.createDataFrame(mixed, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        start(spark.readStream.schema(schema).parquet(f"{folder}/in"), folder).awaitTermination()


def ids(df):
    return sorted(r.id for r in df.collect())


CUTS = {"one": [240], "some": [1, 70, 71, 71, 200, 240], "with an empty first": [0, 120, 240]}


def cut(rows, name):
    ends = CUTS[name]
    return [rows[a:b] for a, b in zip([0, *ends], ends)]


@pytest.mark.parametrize("name", CUTS)
def test_consecutive_duplicates_over_batches(spark, tmp_path, name):
    rows = entries()
    run(spark, str(tmp_path), cut(rows, name), lambda s, f: keyed.drop_consecutive(s, f, "key", ["created_ms", "id"], AT_ONCE))
    df = spark.createDataFrame(rows, ENTRY)
    assert ids(keyed.emitted(spark, str(tmp_path), df.schema)) == ids(history.drop_consecutive(df, "key", ["created_ms", "id"]))


@pytest.mark.parametrize("name", CUTS)
def test_ids_go_on_over_batches(spark, tmp_path, name):
    rows = entries()
    run(spark, str(tmp_path), cut(rows, name), lambda s, f: keyed.assign_ids(s, f, "key", ["created_ms", "id"], "created_ms", AT_ONCE))
    last, want = {}, {}
    for key, i, ms, *_ in rows:
        last[key] = max(last[key] + 1, ms) if key in last else ms
        want[i] = last[key]
    schema = spark.createDataFrame([], ENTRY).schema.add("assigned_id", "long")
    assert {r.id: r.assigned_id for r in keyed.emitted(spark, str(tmp_path), schema).collect()} == want


@pytest.mark.parametrize("name", CUTS)
def test_retention_over_batches(spark, tmp_path, name):
    rows = entries()
    run(spark, str(tmp_path), cut(rows, name), lambda s, f: keyed.evict(s, f, "key", 9, AT_ONCE))
    df = spark.createDataFrame(rows, ENTRY)
    assert ids(keyed.emitted(spark, str(tmp_path), df.schema)) == ids(history.evicted(df, "key", 9))
    assert ids(keyed.held(spark, str(tmp_path), df.schema)) == ids(history.retain(df, "key", 9))


def test_expiry_needs_no_row_of_the_key(spark, tmp_path):
    rows = [("a", 1, 0), ("b", 2, 10), ("b", 3, 11), ("c", 4, None), ("c", 5, 30), ("c", 6, 2)]
    schema = "key string, id long, created_ms long"
    folder, seen = str(tmp_path), []
    shape = spark.createDataFrame([], schema).schema
    for n in range(4):
        run(spark, folder, [rows[n : n + 1] if n < 3 else rows[3:]], lambda s, f: keyed.expire(s, f, 10, AT_ONCE), schema)
        seen.append(ids(keyed.emitted(spark, folder, shape)))
    # at ten "a" is exactly as old as allowed; row 6 is late and has expired when it comes
    assert seen == [[], [], [1], [1, 2, 3, 6]]
    assert ids(keyed.held(spark, folder, shape)) == [4, 5]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    schema = spark.createDataFrame([], "key string, n long").schema
    log = keyed.StateLog(spark, str(tmp_path), schema, compact_every=2)

    def frame(*rows):
        return spark.createDataFrame(list(rows), schema)

    def live(**how):
        return sorted(tuple(r) for r in log.live(**how).collect())

    steps = [([("a", 1), ("a", 1)], []), ([("b", 1)], [("a", 1)]), ([(None, 5)], []), ([("a", 2)], [("a", 1)]), ([("b", 2)], [("b", 1)])]
    states = []
    for n, (added, removed) in enumerate(steps):
        for _ in range(2):  # the second time as after a failure
            log.change(n, frame(*added), frame(*removed))
        states.append(sorted((str(k), v) for k, v in log.live().collect()))
        assert sorted((str(k), v) for k, v in log.live(before=n).collect()) == (states[n - 1] if n else [])
    assert states[0] == [("a", 1), ("a", 1)] and states[-1] == [("None", 5), ("a", 2), ("b", 2)]
    assert live(keys=spark.createDataFrame([("a",), ("x",)], "key string")) == [("a", 2)]
    assert live(keys=spark.createDataFrame([(None,)], "key string")) == [(None, 5)]
    assert [p.name for p in sorted((tmp_path / "base").iterdir())] == ["batch=1", "batch=3"]


def test_scratch_tables_of_a_batch_go(spark, tmp_path):
    from weftline.runtime import checkpoint_root, list_folder

    root = checkpoint_root(spark)
    before = set(list_folder(spark, root))
    run(spark, str(tmp_path), [entries(20)], lambda s, f: keyed.evict(s, f, "key", 2, AT_ONCE))
    assert set(list_folder(spark, root)) == before
