"""Dictionaries, cells, scalar functions, sources and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from weftline.functions import names, text
from weftline.operators import catalog, history
from weftline.sources import history_files, jdbc
from weftline.sources import jobs as job_source
from weftline.sources.sql_batch import parse_sql_batch, read_sql_batch
from weftline.streaming import histories, refresh


def values(spark, column, *inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.v for r in df.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


def test_field_names(spark):
    assert values(
        spark, names.camel_name, "user-id", "user_id", "class", "123name", "USER_NAME", "", None, "--", "用户 id", "a1B2", "X"
    ) == ["userId", "userId", "classValue", "field123name", "userName", "field", "field", "field", "用户Id", "a1B2", "x"]


def test_suffixes_stay_unique(spark):
    df = spark.createDataFrame(
        [("t", 0, "id"), ("t", 1, "id"), ("t", 2, "id2"), ("t", 3, "id"), ("u", 0, "id")], "t string, pos int, base string"
    )
    got = {(r.t, r.pos): r.field_name for r in catalog.unique_names(df, ["t"], "base", "pos").collect()}
    assert got[("t", 0)] == "id" and got[("t", 1)] == "id2" and got[("u", 0)] == "id"
    assert len({v for (t, _), v in got.items() if t == "t"}) == 4


def test_type_mapping(spark):
    assert values(
        spark, names.kind_of, None, "", "java.lang.String", "LONGVARCHAR", "tinyint", "decimal ( 19 )", "number(5,-2)",
        "number(18,2)", "NUMBER", "timestamp(6)", "timestamp with time zone", "varbinary(3)", "raw(4)", "nclob", "enum",
    ) == ["STRING", "STRING", "STRING", "STRING", "INTEGER", "BIG_INTEGER", "UNKNOWN", "BIG_DECIMAL", "BIG_DECIMAL",
          "LOCAL_DATE_TIME", "UNKNOWN", "BYTE_ARRAY", "BYTE_ARRAY", "STRING", "UNKNOWN"]
    pairs = spark.createDataFrame([(9, 0), (10, 0), (30, 0), (18, 2), (0, 0)], "p int, s int")
    got = [r[0] for r in pairs.select(names.numeric_kind(F.col("p"), F.col("s"))).collect()]
    assert got == ["INTEGER", "LONG", "BIG_INTEGER", "BIG_DECIMAL", "BIG_DECIMAL"]


def test_table_lists(spark):
    assert values(spark, names.parse_table_list, "a, b;c", "a，b；`c`", " null ,NULL,x", "", None) == [
        ["a", "b", "c"], ["a", "b", "c"], ["x"], [], []
    ]
    assert values(spark, names.split_tables, "a, `b`;null", " ") == [["a", "`b`", "null"], []]


def test_ranges(spark):
    def numbers(x):
        return text.expand_ranges(x)

    got = values(spark, numbers, "80,443 8000-8002", "90-88，x 88", "0-2 65534-70000 -5 5- 1-2-3", "1-2000", "", None)
    assert [r.numbers for r in got[:3]] == [[80, 443, 8000, 8001, 8002], [88, 89, 90], [1, 2, 65534, 65535]]
    assert [(r.total, r.rejected) for r in got[3:]] == [(2000, True), (0, True), (0, True)]


def test_epochs(spark):
    got = values(spark, text.epoch_to_text, " 1700000000 ", "1700000000123", "-1", "-1234567890123", "x")
    assert [(r.text, r.ms, r.sec) for r in got[:4]] == [
        ("2023-11-14 22:13:20", 1700000000000, 1700000000), ("2023-11-14 22:13:20", 1700000000123, 1700000000),
        ("1969-12-31 23:59:59", -1000, -1), ("1930-11-18 00:28:29", -1234567890123, -1234567890),
    ]
    assert got[4].ms is None
    back = values(spark, lambda c: text.text_to_epoch(c, zone="Asia/Shanghai"), "2023-11-15 06:13:20", "2023-13-01 00:00:00")
    assert [(r.ms, r.sec) for r in back] == [(1700000000000, 1700000000), (None, None)]


def test_previews(spark):
    got = values(spark, text.preview, "  a\tb\r\n  c ", "x" * 161, "y" * 160, None)
    assert got == ["a b c", "x" * 157 + "...", "y" * 160, ""]
    df = spark.createDataFrame(
        [("FILES", [], None), ("FILES", ["p"], None), ("FILES", ["p", "q", "r"], None), ("IMAGE", None, None), ("IMAGE", None, "i.png")],
        "kind string, paths array<string>, image string",
    )
    shown = df.select(text.entry_preview(F.col("kind"), F.lit("t"), F.col("paths"), F.col("image")).alias("v")).collect()
    assert [r.v for r in shown] == ["(empty file list)", "p", "p  (+2 files)", "(image)", "i.png"]


CELLS = "file string, sheet string, row_no int, col_no int, value string"


def test_sheets(spark):
    cells = spark.createDataFrame(
        [("f", "s", 0, 0, "user-id"), ("f", "s", 0, 1, "user_id"), ("f", "s", 0, 3, " class "), ("f", "s", 1, 0, "bigint"),
         ("f", "s", 2, 3, "note"), ("f", "s", 4, 1, "v"), ("f", "t", 0, 0, " "), ("f", "u", 3, 0, "late")],
        CELLS,
    )
    got = catalog.sheet_dictionary(cells, 1, 2, 3).orderBy("col_no").collect()
    assert [(r.source_name, r.field_name, r.kind, r.comment) for r in got] == [
        ("user-id", "userId", "LONG", ""), ("user_id", "userId2", "STRING", ""), ("class", "classValue", "STRING", "note"),
    ]
    assert {(r.sheet, r.error) for r in catalog.sheet_errors(cells, 1).collect()} == {("t", "NO_FIELD"), ("u", "NO_FIELD")}
    assert {r.sheet: (r.total_rows, r.total_cols) for r in catalog.sheet_summary(cells).collect()} == {
        "s": (5, 4), "t": (1, 1), "u": (4, 1)
    }
    grid = catalog.densify(cells.where("sheet = 's'"))
    assert grid.count() == 20 and grid.where("value = ''").count() == 14
    with pytest.raises(ValueError):
        catalog.sheet_dictionary(cells, 0)


def test_apply_dictionary(spark):
    raw = spark.createDataFrame([("1", "x", "2.50", "2024-02-03"), ("no", "y", "z", "bad")], ["user-id", "n", "AMOUNT", "d"])
    columns = spark.createDataFrame(
        [("t", 0, "user-id", "int", None), ("t", 1, "n", "varchar", None), ("t", 2, "AMOUNT", "number(9,2)", None), ("t", 3, "d", "date", None)],
        "table_name string, position int, name string, type string, comment string",
    )
    rows = catalog.apply_dictionary(raw, catalog.columns_dictionary(columns)).collect()
    assert (rows[0].userId, rows[0].n, float(rows[0].amount), rows[0].d) == (1, "x", 2.5, dt.date(2024, 2, 3))
    assert rows[1][:] == (None, "y", None, None)


def write(path, body):
    path.mkdir(exist_ok=True)
    (path / "jobs.json").write_text(body, encoding="utf-8")
    return str(path)


def job(name, inputs, outputs):
    return {"name": name, "sql": "select 1", "inputTables": inputs, "outputTables": outputs}


def test_catalogue_forms(spark, tmp_path):
    body = json.dumps({"records": [job("j1", "a，b;c", ["`d`", None, "e;f"]), {"name": " "}, {"name": "j2", "inputtables": ["x"]}]})
    rows = job_source.read_jobs(spark, write(tmp_path / "a", "﻿" + body)).orderBy("ord").collect()
    assert [(r.name, r.input_tables, r.output_tables) for r in rows] == [
        ("j1", ["a", "b", "c"], ["d", "e;f"]), ("j2", ["x"], [])
    ]
    assert job_source.read_jobs(spark, write(tmp_path / "b", "[]")).count() == 0
    lines = "\n".join(json.dumps(job(f"j{i}", ["a"], ["b"])) for i in range(5))
    assert job_source.read_jobs_lines(spark, write(tmp_path / "c", lines)).count() == 5


BAD = ["{}", "null", "42", '{"records":{}}', "[42]", "", " ", json.dumps([job("same", ["a"], ["b"]), job("same", ["c"], ["d"])])]


@pytest.mark.parametrize("body", BAD)
def test_rejected_catalogues(spark, tmp_path, body):
    with pytest.raises(ValueError):
        job_source.read_jobs(spark, write(tmp_path / "bad", body))


def test_invalid_replacement_keeps_the_snapshot(spark, tmp_path):
    root = str(tmp_path / "snap")
    good = job_source.read_jobs(spark, write(tmp_path / "g", json.dumps([job("j", ["a"], ["b"])])))
    job_source.replace_snapshot(good, root)
    with pytest.raises(ValueError):
        job_source.replace_snapshot(good.unionByName(good), root)
    assert [r.name for r in job_source.current_snapshot(spark, root).collect()] == ["j"]
    job_source.replace_snapshot(good.limit(0), root)
    assert job_source.current_snapshot(spark, root).count() == 0


def batch(spark, body):
    df = parse_sql_batch(spark.createDataFrame([(body,)], "value string"))
    return [(r.sql_id, r.sql, r.source, r.file_name, r.metadata) for r in df.orderBy("ord").collect()]


def test_sql_batches(spark, tmp_path):
    body = ' ["select 1 ", {"sqlId":" x ","sql":" select 2 ","source":"s","metadata":{"a":1,"b":null,"c":"t"}}]'
    assert batch(spark, body) == [
        ("sql-0001", "select 1 ", None, None, None),
        ("x", "select 2", "s", "", {"a": "1", "b": None, "c": "t"}),
    ]
    text_body = "-- @SQL\n\nselect 1;\n  --   @SQL  \n\n--@SQL\nselect 2\nfrom t"
    assert [b[:2] for b in batch(spark, text_body)] == [("sql-0001", "select 1;"), ("sql-0002", "select 2\nfrom t")]
    assert read_sql_batch(spark, write(tmp_path / "batch", body)).count() == 2


@pytest.mark.parametrize("body", ["", "  ", "-- @SQL", "[]", "[1]", '[{"sql":" "}]', '["a", null]', "[", '[" "]'])
def test_rejected_batches(spark, body):
    with pytest.raises(ValueError):
        parse_sql_batch(spark.createDataFrame([(body,)], "value string")).count()


def test_jdbc_options():
    opts = jdbc.query_options("jdbc:oracle:thin:@x", " WITH a AS (SELECT 1) SELECT * FROM a; ")
    assert opts["driver"] == "oracle.jdbc.OracleDriver" and opts["query"].startswith("WITH") and opts["queryTimeout"] == "30"
    split = jdbc.query_options("jdbc:x:y", "select 1", "d.D", partitionColumn="id", numPartitions="8")
    assert split["dbtable"] == "(select 1) q" and "query" not in split and split["driver"] == "d.D"
    for bad in ("delete from t", "", None, "update t set a = 1"):
        with pytest.raises(ValueError):
            jdbc.query_options("jdbc:x:y", bad)


def test_damaged_history_lines(spark, tmp_path):
    lines = ['{"key":1,"id":5,"created_ms":9,"type":"TEXT","pinned":true}', '{"key":1,"id"', "[]", '{"id":"x"}', "", '{"id":6}']
    good, bad = history_files.load_history(spark, write(tmp_path / "h", "\n".join(lines)))
    assert sorted(r.id for r in good.collect()) == [5, 6]
    assert sorted(r.line for r in bad.collect()) == sorted(['{"key":1,"id"', "[]", '{"id":"x"}'])


ENTRY = "key long, id long, created_ms long, type string, hash string"


def test_stream_keeps_state_between_batches(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [["A", "A", "B"], ["B", "A"], ["A", None, "C"]]
    rows, n = [], 0
    for letters in batches:
        part = []
        for x in letters:
            part.append((1, n, n, "TEXT", x))
            n += 1
        rows += part
        spark.createDataFrame(part[::-1], ENTRY).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ENTRY).parquet(source)
        run = (
            histories.drop_consecutive_stream(stream).writeStream.format("parquet").option("path", sink)
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        run.awaitTermination()
    got = sorted(r.id for r in spark.read.parquet(sink).collect())
    plain = history.drop_consecutive(spark.createDataFrame(rows, ENTRY), "key", ["created_ms", "id"])
    assert got == sorted(r.id for r in plain.collect()) == [0, 2, 4, 7]


def test_expiry_on_a_stream(spark, tmp_path):
    now = int(dt.datetime.now(dt.timezone.utc).timestamp() * 1000)
    spark.createDataFrame([(1, 1, now), (1, 2, now - 2 * history.DEFAULT_TTL_MS)], "key long, id long, created_ms long").write.parquet(
        str(tmp_path / "in")
    )
    stream = histories.expire_stream(spark.readStream.schema("key long, id long, created_ms long").parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("alive").trigger(availableNow=True).start()
    run.awaitTermination()
    assert [r.id for r in spark.table("alive").collect()] == [1]


def test_refresh_stream(spark, tmp_path):
    folder, root = tmp_path / "catalogues", str(tmp_path / "snap")
    folder.mkdir()

    def drop(name, body):
        (folder / name).write_text(body, encoding="utf-8")
        refresh.refresh_stream(
            spark, str(folder), root, str(tmp_path / "check"), {"availableNow": True}
        ).awaitTermination()
        return sorted(r.name for r in job_source.current_snapshot(spark, root).collect())

    assert drop("1.json", json.dumps([job("j1", ["a"], ["b"])])) == ["j1"]
    assert drop("2.json", "[42]") == ["j1"]
    assert drop("3.json", json.dumps([job("j2", ["a"], ["b"]), job("j3", [], [])])) == ["j2", "j3"]
    assert drop("4.json", "[]") == []


def test_dictionary_of_a_read_frame(spark):
    df = spark.createDataFrame([], "`order id` bigint, order_id int, price decimal(12,2), big decimal(30,0), day date, at timestamp, raw binary, ok boolean, note string")
    got = {r.source_name: (r.field_name, r.kind) for r in catalog.frame_dictionary(df, "t").collect()}
    assert got == {
        "order id": ("orderId", "LONG"), "order_id": ("orderId2", "INTEGER"), "price": ("price", "BIG_DECIMAL"), "big": ("big", "BIG_INTEGER"),
        "day": ("day", "LOCAL_DATE"), "at": ("at", "LOCAL_DATE_TIME"), "raw": ("raw", "BYTE_ARRAY"), "ok": ("ok", "BOOLEAN"), "note": ("note", "STRING"),
    }


def test_suffixes_skip_names_that_are_taken(spark):
    rows = [("t", i, n) for i, n in enumerate(["a", "a", "a2", "a", "b1", "b", "b", "b1"])] + [("u", 0, "a")]
    df = spark.createDataFrame(rows, "k string, pos int, base string")
    got = {(r.k, r.pos): r.field_name for r in catalog.unique_names(df, ["k"], "base", "pos").collect()}
    assert got == {
        ("t", 0): "a", ("t", 1): "a2", ("t", 2): "a22", ("t", 3): "a3", ("t", 4): "b1", ("t", 5): "b", ("t", 6): "b2",
        ("t", 7): "b12", ("u", 0): "a",
    }


def test_a_dictionary_with_two_tables_is_refused(spark):
    raw = spark.createDataFrame([("1",)], "x string")
    dictionary = spark.createDataFrame([("x", "x", "LONG"), ("x", "x", "STRING")], "source_name string, field_name string, kind string")
    with pytest.raises(ValueError):
        catalog.apply_dictionary(raw, dictionary)
