"""JSON and text comparison: goldens, a recursive reference and properties."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators import jsonops, textdiff


def json_pairs(spark, *pairs):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "key int, a string, b string")


def kind(x):
    return {dict: "OBJECT", list: "ARRAY", bool: "BOOLEAN", str: "STRING"}.get(type(x), "NUMBER")


def shown(x):
    return x if x is None or isinstance(x, str) else json.dumps(x, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def compare(a, b, path="$"):
    if a is None or b is None:
        return [] if a is b else [("VALUE_CHANGE", path, shown(a), shown(b))]
    if kind(a) != kind(b):
        return [("TYPE_CHANGE", path, shown(a), shown(b))]
    out = []
    if isinstance(a, dict):
        for k in a.keys() | b.keys():
            if k not in b:
                out.append(("REMOVED", f"{path}.{k}", shown(a[k]), None))
            elif k not in a:
                out.append(("ADDED", f"{path}.{k}", None, shown(b[k])))
            else:
                out += compare(a[k], b[k], f"{path}.{k}")
    elif isinstance(a, list):
        for i in range(max(len(a), len(b))):
            at = f"{path}[{i}]"
            if i >= len(b):
                out.append(("REMOVED", at, shown(a[i]), None))
            elif i >= len(a):
                out.append(("ADDED", at, None, shown(b[i])))
            else:
                out += compare(a[i], b[i], at)
    elif a != b:
        out.append(("VALUE_CHANGE", path, shown(a), shown(b)))
    return out


def random_json(rnd, depth):
    if depth == 0 or rnd.random() < 0.3:
        return rnd.choice([None, True, False, 1, 2, 2.5, "x", "", "a \"q\"", "é"])
    if rnd.random() < 0.5:
        return {k: random_json(rnd, depth - 1) for k in rnd.sample(["a", "b", "c", "d.e", "[0]"], rnd.randrange(4))}
    return [random_json(rnd, depth - 1) for _ in range(rnd.randrange(4))]


@pytest.mark.parametrize("plan_levels", [8, 2])
def test_json_diff_against_recursion(spark, monkeypatch, plan_levels):
    monkeypatch.setattr(jsonops, "PLAN_LEVELS", plan_levels)
    rnd = random.Random(plan_levels)
    pairs = [(random_json(rnd, 5), random_json(rnd, 5)) for _ in range(150)]
    pairs += [(p[0], json.loads(json.dumps(p[0]))) for p in pairs[:20]]
    df = json_pairs(spark, *[(json.dumps(a), json.dumps(b)) for a, b in pairs])
    got = {}
    for r in jsonops.json_diff(df, ["key"], "a", "b").collect():
        got.setdefault(r.key, []).append((r.type, r.path, r.old_value, r.new_value))
    for i, (a, b) in enumerate(pairs):
        assert sorted(got.get(i, []), key=repr) == sorted(compare(a, b), key=repr)


def test_json_summary_states(spark):
    df = json_pairs(spark, ('{"a":1}', '{"a":1.0}'), (" ", "{}"), ("{}", "{"), ("[1]", "[2,3]"), (None, "{}"))
    rows = jsonops.json_diff_summary(df, ["key"], "a", "b").orderBy("key").collect()
    assert [(r.status, r.diff_count, r.identical) for r in rows] == [
        ("OK", 0, True), ("BLANK", None, None), ("INVALID", None, None), ("OK", 2, False), ("BLANK", None, None),
    ]


def test_deep_documents_are_walked_to_the_end(spark):
    deep = "[" * 60 + "1" + "]" * 60
    df = json_pairs(spark, (deep, deep.replace("1", "2")))
    rows = jsonops.json_diff(df, ["key"], "a", "b").collect()
    assert [(r.path, r.old_value, r.new_value) for r in rows] == [("$" + "[0]" * 60, "1", "2")]


def schema(spark, *docs):
    df = spark.createDataFrame([(d,) for d in docs], "j string")
    rows = jsonops.json_schema(df, "j")
    return {r.path: r.kind for r in rows.collect()}, rows


def test_json_schema_lattice(spark):
    kinds, rows = schema(
        spark,
        '{"i":2147483647,"l":2147483648,"b":9999999999999999999999999999,"d":1.25,"m":[1,"x"],"e":[],"o":{},"n":null,'
        '"r":[{"x":1},{"y":null}],"z":null}',
        '{"i":-2147483648,"l":1,"b":1,"d":1,"z":true,"mix":{"deep":1},"r":null}',
        '{"mix":3}',
        "[1]",
    )
    assert kinds == {
        "$": "OBJECT", "$.i": "INTEGER", "$.l": "LONG", "$.b": "BIG_INTEGER", "$.d": "BIG_DECIMAL", "$.m": "LIST",
        "$.m[]": "UNKNOWN", "$.e": "LIST", "$.o": "OBJECT", "$.n": "UNKNOWN", "$.r": "LIST", "$.r[]": "OBJECT",
        "$.r[].x": "INTEGER", "$.r[].y": "UNKNOWN", "$.z": "BOOLEAN", "$.mix": "UNKNOWN",
    }
    shape = jsonops.to_struct_type(rows)
    assert shape["r"].dataType == T.ArrayType(
        T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.VariantType())])
    )
    assert shape["e"].dataType == T.ArrayType(T.VariantType())
    assert shape["b"].dataType == T.DecimalType(38, 0)
    assert shape["mix"].dataType == T.VariantType()


def test_wrap_and_unwrap(spark):
    texts = ['{"a": "b\\n"}', 'tab\t"quote" \\ é \u0001', "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    back = jsonops.wrap_json(df, "t").withColumn("w", F.col("wrapped"))
    got = jsonops.unwrap_json(back, "w").collect()
    assert [r.json for r in got] == texts
    assert [r.ok for r in got] == [True, False, False, False]


def test_duplicate_documents(spark):
    df = spark.createDataFrame(
        [(1, '{"a":1,"b":2.50}'), (2, '{ "b": 2.5, "a": 1 }'), (3, "[]"), (4, "{")], "id int, j string"
    )
    assert [(r.copies, r.first_key) for r in jsonops.json_duplicates(df, "j", "id").collect()] == [(2, 1)]
    assert [r.canonical for r in jsonops.json_duplicate_texts(df, "j", "id").collect()] == ['{"a":1,"b":2.5}']
    assert sorted(r.id for r in jsonops.json_duplicate_members(df, "j", "id").collect()) == [1, 2]


def test_diff_plan_has_no_exchange(spark, tmp_path):
    json_pairs(spark, ("{}", "[]")).write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    plan = jsonops._descend(jsonops._compared(df, ["key"], "a", "b").withColumn("_pending", F.array().cast(jsonops.PENDING)))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_tables_with_variants_and_null_keys(spark):
    def rows(*values):
        return spark.createDataFrame(values, "k int, j string").select("k", F.parse_json("j").alias("v"))

    left = rows((1, '{"a":{"b":{"c":[1,{"d":1}]}}}'), (None, "1"), (2, "{}"))
    right = rows((1, '{"a":{"b":{"c":[1,{"d":2}]}}}'), (None, "2"), (3, "{}"))
    got = {(r.k, r.type, r.path, r.old_value, r.new_value) for r in jsonops.table_json_diff(left, right, ["k"]).collect()}
    assert got == {
        (1, "VALUE_CHANGE", "$.v.a.b.c[1].d", "1", "2"), (None, "VALUE_CHANGE", "$.v", "1", "2"),
        (2, "REMOVED", "$", '{"k":2,"v":{}}', None), (3, "ADDED", "$", None, '{"k":3,"v":{}}'),
    }
    with pytest.raises(ValueError):
        jsonops.table_json_diff(left.unionByName(left), right, ["k"])


def test_schema_goes_by_the_text(spark):
    wide = "1" * 42
    kinds, rows = schema(
        spark,
        '{"a.b":1,"a":{"c":2},"f":12345678901234567890.0,"w":' + wide + ',"e":1e3,"q\\"k":-5,"s":"\\u00017","t":"12"}',
        '{"[]":[[2147483648]]}',
        "[1]", "3", "{", None,
    )
    assert kinds == {
        "$": "OBJECT", '$."a.b"': "INTEGER", "$.a": "OBJECT", "$.a.c": "INTEGER", "$.f": "BIG_DECIMAL", "$.w": "BIG_INTEGER",
        "$.e": "BIG_DECIMAL", '$."q""k"': "INTEGER", "$.s": "STRING", "$.t": "STRING", '$."[]"': "LIST", '$."[]"[]': "LIST",
        '$."[]"[][]': "LONG",
    }
    shape = jsonops.to_struct_type(rows)
    assert shape["a.b"].dataType == T.IntegerType() and shape["a"].dataType == T.StructType([T.StructField("c", T.IntegerType())])
    df = spark.createDataFrame([(x,) for x in ("{}", "[1]", "3", "{", None)], "j string")
    assert jsonops.json_roots(df, "j").first()[:] == (1, 2, 2)


def test_deep_schema(spark):
    deep = '{"a":' * 30 + "1" + "}" * 30
    kinds, _ = schema(spark, deep, "{}")
    assert kinds["$" + ".a" * 30] == "INTEGER" and len(kinds) == 31


def text_pairs(spark, pairs):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id int, a string, b string")


def split(text):
    return text.split("\n") if text else []


def patch(a, hunks):
    """Apply hunks from the end, so that earlier positions stay valid."""
    lines = list(a)
    for h in sorted(hunks, key=lambda h: h.source_pos, reverse=True):
        assert lines[h.source_pos:h.source_pos + len(h.source_lines)] == list(h.source_lines)
        lines[h.source_pos:h.source_pos + len(h.source_lines)] = h.target_lines
    return lines


def test_hunks_turn_a_into_b(spark):
    rnd = random.Random(11)

    def text():
        return "\n".join(rnd.choice(["a", "b", "c", "", "d "]) for _ in range(rnd.randrange(14)))

    pairs = [(text(), text()) for _ in range(300)] + [("", ""), (None, "x"), ("x\n", "x"), ("a\nb", "a\nb")]
    df = text_pairs(spark, pairs)
    hunks = textdiff.text_hunks(df, "id", "a", "b").collect()
    by_id = {}
    for h in hunks:
        by_id.setdefault(h.id, []).append(h)
    for i, (a, b) in enumerate(pairs):
        mine = by_id.get(i, [])
        assert patch(split(a or ""), mine) == split(b)
        for h in mine:
            assert (b and split(b) or [])[h.target_pos:h.target_pos + len(h.target_lines)] == list(h.target_lines)
    counts = {r.id: (r.change_count, r.identical) for r in textdiff.diff_summary(df, textdiff.text_hunks(df, "id", "a", "b"), "id").collect()}
    assert counts == {i: (len(by_id.get(i, [])), i not in by_id) for i in range(len(pairs))}


def test_unified_text(spark):
    df = text_pairs(spark, [("a\nb\nc\nd", "x\na\nc\nD"), ("a", "a"), ("", None)])
    got = textdiff.unified_diff(df, textdiff.text_hunks(df, "id", "a", "b"), "id").orderBy("id").collect()
    head = "--- original\n+++ revised"
    assert [r.unified for r in got] == [
        head + "\n@@ -0,0 +1,1 @@\n+x\n@@ -2,1 +2,0 @@\n-b\n@@ -4,1 +4,1 @@\n-d\n+D", head, head
    ]


def test_whitespace_option_and_delta(spark):
    df = text_pairs(spark, [("a \n\tb", "a\nb"), ("x\nx\ny", "y\nx\nz"), ("", None)])
    assert textdiff.text_hunks(df.where("id = 0"), "id", "a", "b", ignore_whitespace=True).count() == 0
    assert textdiff.text_hunks(df.where("id = 0"), "id", "a", "b").count() == 1
    assert [tuple(r) for r in textdiff.line_delta(df, "id", "a", "b").orderBy("id").collect()] == [(0, 2, 2), (1, 1, 1), (2, 0, 0)]


def test_hunks_use_one_exchange(spark, tmp_path):
    text_pairs(spark, [("a", "b")]).write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    plan = textdiff.text_hunks(df, "id", "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
