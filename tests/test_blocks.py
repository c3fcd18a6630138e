"""Documents read by many tasks against the same documents read whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.sources import blocks, jobs, sql_batch


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def files(folder, *bodies):
    folder.mkdir()
    for i, body in enumerate(bodies):
        (folder / f"f{i:03d}.json").write_text(body, encoding="utf-8")
    return str(folder)


def record(i):
    rng = random.Random(i)
    odd = ['quote " and }, inside', "brackets [ { ] }", 'ends with backslash \\', '\\"},{"', "日本語 },", "line\nbreak", "", "},},},"]
    return {
        "name": f"job {i} {rng.choice(odd)}",
        "sql": " ".join(rng.choices(odd, k=4)),
        "source": rng.choice([None, "s", {"nested": {"a": 1}}]),
        "inputTables": rng.choice([["a", "b"], "a;b", [{"x": 1}, "c"], None]),
        "outputTables": ["t" + str(i)],
    }


def whole_jobs(spark, path):
    documents = spark.read.text(path, wholetext=True)
    return jobs.jobs_from_documents(documents).drop("ord").orderBy("name").collect()


@pytest.mark.parametrize("shape", ["array", "pretty", "records", "other"])
def test_catalogues_in_blocks_equal_whole_ones(spark, tmp_path, small_splits, shape):
    records = [record(i) for i in range(120)]
    halves = [records[:70], records[70:], []]
    body = {
        "array": lambda r: json.dumps(r, ensure_ascii=False),
        "pretty": lambda r: "﻿ \n" + json.dumps(r, indent=2) + "\n\n",
        "records": lambda r: json.dumps({"records": r}, indent=1, ensure_ascii=False) + "\n",
        "other": lambda r: json.dumps({"meta": {"x": {"records": [{"name": "no"}, {}]}}, "records": r, "n": {"y": 1}}),
    }[shape]
    path = files(tmp_path / "c", *[body(r) for r in halves])
    got = jobs.read_jobs(spark, path)
    rows = got.orderBy("ord").collect()
    assert [r.name for r in rows] == [r["name"] for r in records]  # by file and position
    assert [r.ord for r in rows] == sorted({r.ord for r in rows})
    assert got.drop("ord").orderBy("name").collect() == whole_jobs(spark, path)
    if shape == "array":
        texts = blocks.fragments(spark, path, blocks.SEPARATOR)
        raw = spark.read.option("lineSep", blocks.SEPARATOR).text(path)
        tasks = raw.select(F.col("_metadata.file_path").alias("f"), F.spark_partition_id().alias("p")).distinct().groupBy("f").count()
        assert max(r["count"] for r in tasks.collect()) > 5
        assert texts.count() == raw.count()


BROKEN = [
    '[{"name":"a"}', '[{"name":"a"},', '[{"name":"a"},]', '[{"name":"a"}}]', '[{"name":"a}]', '{"records":[{"name":"a"}]', "[1]", '["x"]', '[{"name":"a"}, 5]',
    '[{"name":"a"},,{"name":"b"}]', '{"a":1}', "x", " ", "", '{"records":{"name":"a"}}', '[[{"name":"a"}]]',
]


@pytest.mark.parametrize("body", BROKEN)
def test_broken_catalogues_are_refused(spark, tmp_path, body):
    with pytest.raises(ValueError):
        jobs.read_jobs(spark, files(tmp_path / "b", '[{"name":"fine"}]', body))


def whole_batch(spark, path):
    texts = spark.read.text(path, wholetext=True).collect()
    return sorted((r.sql_id, r.sql, r.source, str(r.metadata)) for t in texts for r in sql_batch.parse_sql_batch(spark.createDataFrame([t])).collect())


def test_batches_in_blocks_equal_whole_ones(spark, tmp_path, small_splits):
    items = [random.Random(i).choice([f"select '{record(i)['sql']}' from t{i}", {"sql": f" select {i} ", "source": "s", "metadata": {"k": "},"}}]) for i in range(60)]
    text = "\n -- @SQL \n".join(["", "select 1\n  from t -- @SQL not alone", "  ", *[f"select {i},\n'[' from u{i}" for i in range(40)]])
    path = files(tmp_path / "s", json.dumps(items, ensure_ascii=False), text, "select 9", '["one"]')
    got = sql_batch.read_sql_batch(spark, path)
    rows = got.orderBy("ord").collect()
    assert sorted((r.sql_id, r.sql, r.source, str(r.metadata)) for r in rows) == whole_batch(spark, path)
    assert [r.sql_id for r in rows] == [f"sql-{i + 1:04d}" for n in (60, 41, 1, 1) for i in range(n)]


@pytest.mark.parametrize("body", ["[]", " ", "-- @SQL\n", '["a", 5]', '["a"', '[""]', '[{"x":1}]', ""])
def test_broken_batches_are_refused(spark, tmp_path, body):
    with pytest.raises(ValueError):
        sql_batch.read_sql_batch(spark, files(tmp_path / "b", '["select 1"]', body))


def test_lines_are_numbered_by_place(spark, tmp_path, small_splits):
    path = files(tmp_path / "l", *["\n".join(json.dumps({**record(i), "name": f"{f}-{i}"}) for i in range(30)) for f in "ab"])
    rows = jobs.read_jobs_lines(spark, path).orderBy("ord").collect()
    assert [r.name for r in rows] == [f"{f}-{i}" for f in "ab" for i in range(30)]
