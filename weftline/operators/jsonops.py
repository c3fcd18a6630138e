"""Comparison, schema merge and quality checks over JSON columns.

Documents are walked level by level inside their row (array of pending nodes), so a comparison of two columns
needs no shuffle at all.  The walk ends when the data ends, never at a fixed level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.jsontext import json_type, marked_kind, marked_numbers, node_text, unwrap_text, wrap_text
from weftline.functions.names import is_blank
from weftline.functions.rows import unfold
from weftline.runtime import materialize


PLAN_LEVELS = 4  # levels expanded in one plan before the pending nodes are written out


def _as_map(value: Column) -> Column:
    return value.try_cast("map<string,variant>")


def _as_array(value: Column) -> Column:
    return value.try_cast("array<variant>")


PENDING = "array<struct<path:string,a:variant,b:variant>>"
FOUND = "array<struct<type:string,path:string,old_value:string,new_value:string>>"


def _typed(node: Column) -> Column:
    return F.struct(
        node["path"].alias("path"),
        node["a"].alias("a"),
        node["b"].alias("b"),
        json_type(node["a"]).alias("kind_a"),
        json_type(node["b"]).alias("kind_b"),
    )


def _change(node: Column) -> Column:
    """Kind of difference of a typed node, or null where the sides differ only further down.

    Pending nodes are unequal.  An absent side is SQL null, a JSON null has kind NULL.
    """
    kind_a, kind_b = node["kind_a"], node["kind_b"]
    return (
        F.when(kind_b.isNull(), "REMOVED")
        .when(kind_a.isNull(), "ADDED")
        .when((kind_a == "NULL") | (kind_b == "NULL"), "VALUE_CHANGE")
        .when(kind_a != kind_b, "TYPE_CHANGE")
        .when(~kind_a.isin("OBJECT", "ARRAY"), "VALUE_CHANGE")
    )


def _difference(node: Column) -> Column:
    return F.struct(
        _change(node).alias("type"),
        node["path"].alias("path"),
        node_text(node["a"]).alias("old_value"),
        node_text(node["b"]).alias("new_value"),
    )


def _same_container(node: Column) -> Column:
    return (node["kind_a"] == node["kind_b"]) & node["kind_a"].isin("OBJECT", "ARRAY")


def _unequal(pair: Column) -> Column:
    """Compact text has sorted keys and plain numbers, so unequal text means unequal content."""
    return ~F.to_json(pair["a"]).eqNullSafe(F.to_json(pair["b"]))


def _children(node: Column) -> Column:
    """Unequal children of a container, as pending nodes."""
    a, b, path = node["a"], node["b"], node["path"]
    fields = F.map_zip_with(_as_map(a), _as_map(b), lambda k, x, y: F.struct(x.alias("a"), y.alias("b")))
    by_key = F.transform(
        F.filter(F.map_entries(fields), lambda e: _unequal(e["value"])),
        lambda e: F.struct(
            F.concat(path, F.lit("."), e["key"]).alias("path"), e["value"]["a"].alias("a"), e["value"]["b"].alias("b")
        ),
    )
    items = F.transform(
        F.arrays_zip(_as_array(a).alias("a"), _as_array(b).alias("b")),
        lambda e, i: F.struct(
            F.concat(path, F.lit("["), i.cast("string"), F.lit("]")).alias("path"), e["a"].alias("a"), e["b"].alias("b")
        ),
    )
    return F.when(node["kind_a"] == "OBJECT", by_key).otherwise(F.filter(items, _unequal))


def _descend(df: DataFrame) -> DataFrame:
    """Work off PLAN_LEVELS levels of ``_pending`` into ``differences``."""
    for _ in range(PLAN_LEVELS):
        df = df.withColumn("_pending", F.transform("_pending", _typed))
        found = F.transform(F.filter("_pending", lambda n: _change(n).isNotNull()), _difference)
        below = F.flatten(F.transform(F.filter("_pending", _same_container), _children))
        df = df.withColumns({"differences": F.concat("differences", found), "_pending": below})
    return df


def _walk(df: DataFrame) -> DataFrame:
    """Turn the column ``_pending`` into the column ``differences``.

    The rows are written every PLAN_LEVELS levels; only those with pending nodes are walked on, until none is left.
    """
    done: DataFrame | None = None
    df = df.withColumn("differences", F.array().cast(FOUND))
    while True:
        df = materialize(_descend(df), "json")
        ended = df.where(F.size("_pending") == 0).drop("_pending")
        done = ended if done is None else done.unionByName(ended)
        df = df.where(F.size("_pending") > 0)
        if df.isEmpty():
            return done


def _compared(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    left, right = F.try_parse_json(a), F.try_parse_json(b)
    start = F.when(
        F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.to_json("_a") != F.to_json("_b")),
        F.array(F.struct(F.lit("$").alias("path"), F.col("_a").alias("a"), F.col("_b").alias("b"))),
    ).otherwise(F.array().cast(PENDING))
    status = (
        F.when(is_blank(F.col(a)) | is_blank(F.col(b)), "BLANK")
        .when(F.col("_a").isNull() | F.col("_b").isNull(), "INVALID")
        .otherwise("OK")
    )
    parsed = df.select(*keys, a, b, left.alias("_a"), right.alias("_b"))
    return _walk(parsed.select(*keys, status.alias("status"), start.alias("_pending")))


def json_diff(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, type, path, old_value, new_value) of two JSON text columns, at every depth."""
    rows = unfold(_compared(df, keys, a, b), keys, "differences", "d")
    return rows.select(*keys, "d.type", "d.path", "d.old_value", "d.new_value")


def json_diff_summary(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, status, diff_count, identical); blank and invalid texts keep a row with null counts."""
    count = F.when(F.col("status") == "OK", F.size("differences").cast("bigint"))
    return _compared(df, keys, a, b).select(
        *keys, "status", count.alias("diff_count"), (count == 0).alias("identical")
    )


def _unique_keys(df: DataFrame, keys: list[str], side: str) -> None:
    if not df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
        raise ValueError(f"the keys of the {side} table are not unique")


def table_json_diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Differences of two keyed tables: rows as JSON documents, unmatched keys are ADDED or REMOVED at ``$``.

    Keys must be unique on either side; null keys meet each other.  Variant columns are walked like any other.
    """
    _unique_keys(left, keys, "left")
    _unique_keys(right, keys, "right")
    a = left.select(*[F.col(k).alias(f"_a_{k}") for k in keys], F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("_left"))
    b = right.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("_right"))
    same = reduce(lambda x, y: x & y, [F.col(f"_a_{k}").eqNullSafe(F.col(f"_b_{k}")) for k in keys])
    both = (
        a.join(b, same, "full_outer")
        .where(~F.col("_left").eqNullSafe(F.col("_right")))
        .select(*[F.coalesce(f"_a_{k}", f"_b_{k}").alias(k) for k in keys], "_left", "_right")
    )
    pending = F.array(
        F.struct(F.lit("$").alias("path"), F.parse_json("_left").alias("a"), F.parse_json("_right").alias("b"))
    )
    rows = unfold(_walk(both.select(*keys, pending.alias("_pending"))), keys, "differences", "d")
    return rows.select(*keys, "d.type", "d.path", "d.old_value", "d.new_value")


NODES = "array<struct<steps:array<string>,v:variant>>"
KINDS = "array<struct<steps:array<string>,kind:string>>"
ITEM = "[]"  # step to the items of a list; the step to a field is a dot and its key
SHAPES = ["OBJECT", "ARRAY", "STRING", "BOOLEAN", "INTEGER", "LONG", "BIG_INTEGER", "BIG_DECIMAL"]


def _deeper(rows: DataFrame) -> DataFrame:
    """One level: the kinds of the nodes in ``todo`` go to ``seen``, their children become ``todo``."""

    def below(node: Column) -> Column:
        fields = F.transform(
            F.map_entries(_as_map(node["v"])),
            lambda e: F.struct(F.array_append(node["steps"], F.concat(F.lit("."), e["key"])).alias("steps"), e["value"].alias("v")),
        )
        items = F.transform(
            _as_array(node["v"]), lambda x: F.struct(F.array_append(node["steps"], F.lit(ITEM)).alias("steps"), x.alias("v"))
        )
        return F.when(json_type(node["v"]) == "OBJECT", fields).otherwise(items)

    kinds = F.transform("todo", lambda n: F.struct(n["steps"].alias("steps"), marked_kind(n["v"]).alias("kind")))
    containers = F.filter("todo", lambda n: json_type(n["v"]).isin("OBJECT", "ARRAY"))
    return rows.withColumns({"seen": F.concat("seen", kinds), "todo": F.flatten(F.transform(containers, below))})


def _written_path(steps: Column) -> Column:
    """``$.key[].key``; a key that could be read as a path is quoted, its quotes doubled."""
    plain = lambda s: s.rlike(r'^\.[^."\[\]]+$') | (s == ITEM)
    quoted = lambda s: F.concat(F.lit('."'), F.replace(F.substring(s, F.lit(2), F.length(s)), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.concat(F.lit("$"), F.array_join(F.transform(steps, lambda s: F.when(plain(s), s).otherwise(quoted(s))), ""))


def json_roots(df: DataFrame, column: str) -> DataFrame:
    """(object_rows, other_rows, invalid_rows): what ``json_schema`` reads, and what it leaves out."""
    root = json_type(F.try_parse_json(column))
    return df.select(root.alias("root")).agg(
        F.count_if(F.col("root") == "OBJECT").alias("object_rows"),
        F.count_if(F.col("root") != "OBJECT").alias("other_rows"),
        F.count_if(F.col("root").isNull()).alias("invalid_rows"),
    )


def json_schema(df: DataFrame, column: str) -> DataFrame:
    """(path, steps, kind, present_rows, nullable_rows): merged schema of a column of JSON objects.

    ``steps`` is the path as an array, which no key can imitate.  Rows are counted per occurrence of the path.
    Number kinds go by the spelling in the text.  Below a path whose values mix shapes nothing is reported.
    Documents that are no objects take no part; ``json_roots`` counts them.
    """
    rows = df.select(
        F.when(F.try_parse_json(column).isNotNull(), F.try_parse_json(marked_numbers(F.col(column)))).alias("v")
    ).select(
        F.array().cast(KINDS).alias("seen"),
        F.when(
            json_type(F.col("v")) == "OBJECT", F.array(F.struct(F.array().cast("array<string>").alias("steps"), F.col("v").alias("v")))
        )
        .otherwise(F.array().cast(NODES))
        .alias("todo"),
    )
    has = {k: F.max(F.col("kind") == k) for k in SHAPES}
    counted: DataFrame | None = None
    while True:
        for _ in range(PLAN_LEVELS):
            rows = _deeper(rows)
        rows = materialize(rows, "json")
        # counts and flags only: a hash aggregate that leaves one row per path and task before the exchange
        part = unfold(rows, [], "seen", "d").select("d.steps", "d.kind").groupBy("steps").agg(
            F.count(F.lit(1)).alias("present_rows"),
            F.count_if(F.col("kind") == "NULL").alias("nullable_rows"),
            *[flag.alias(f"has_{k}") for k, flag in has.items()],
        )
        counted = part if counted is None else counted.unionByName(part)
        rows = rows.where(F.size("todo") > 0).withColumn("seen", F.array().cast(KINDS))
        if rows.isEmpty():
            break
    merged = counted.groupBy("steps").agg(
        F.sum("present_rows").alias("present_rows"),
        F.sum("nullable_rows").alias("nullable_rows"),
        *[F.max(f"has_{k}").alias(f"has_{k}") for k in has],
    )
    number = F.col("has_INTEGER") | F.col("has_LONG") | F.col("has_BIG_INTEGER") | F.col("has_BIG_DECIMAL")
    shapes = sum([F.col(f"has_{k}").cast("int") for k in ["OBJECT", "ARRAY", "STRING", "BOOLEAN"]], number.cast("int"))
    verdict = (
        F.when(shapes != 1, "UNKNOWN")
        .when(F.col("has_OBJECT"), "OBJECT")
        .when(F.col("has_ARRAY"), "LIST")
        .when(F.col("has_STRING"), "STRING")
        .when(F.col("has_BOOLEAN"), "BOOLEAN")
        .when(F.col("has_BIG_DECIMAL"), "BIG_DECIMAL")
        .when(F.col("has_BIG_INTEGER"), "BIG_INTEGER")
        .when(F.col("has_LONG"), "LONG")
        .otherwise("INTEGER")
    )
    kinds = materialize(merged.select("steps", verdict.alias("kind"), "present_rows", "nullable_rows"), "schema")
    closed = kinds.where("kind = 'UNKNOWN'").select(F.col("steps").alias("_above"))
    above = F.transform(F.sequence(F.lit(0), F.size("steps") - 1), lambda i: F.slice("steps", F.lit(1), i))
    below_root = kinds.where(F.size("steps") > 0).select("steps", F.explode(above).alias("_above"))
    hidden = below_root.join(closed, "_above", "left_semi").select("steps").distinct()
    return kinds.join(hidden, "steps", "left_anti").select(
        _written_path(F.col("steps")).alias("path"), "steps", "kind", "present_rows", "nullable_rows"
    )


LARGEST_SCHEMA = 100_000  # paths; a schema beyond that has keys that are data


def to_struct_type(schema_rows: DataFrame) -> T.StructType:
    """Spark schema from the rows of ``json_schema``; refused where keys are data and the schema grows with the rows."""
    rows = schema_rows.select("steps", "kind").limit(LARGEST_SCHEMA + 1).collect()
    if len(rows) > LARGEST_SCHEMA:
        raise ValueError(f"more than {LARGEST_SCHEMA} paths: read such keys as a map")
    kinds = {tuple(r["steps"]): r["kind"] for r in rows}
    children: dict[tuple, list[str]] = {}
    for steps in sorted(kinds):
        if steps and steps[-1] != ITEM:
            children.setdefault(steps[:-1], []).append(steps[-1])
    scalars = {
        "STRING": T.StringType(),
        "BOOLEAN": T.BooleanType(),
        "INTEGER": T.IntegerType(),
        "LONG": T.LongType(),
        "BIG_INTEGER": T.DecimalType(38, 0),
        "BIG_DECIMAL": T.DecimalType(38, 18),
    }

    def build(steps: tuple) -> T.DataType:
        kind = kinds.get(steps, "UNKNOWN")
        if kind == "LIST":
            return T.ArrayType(build((*steps, ITEM)))
        if kind == "OBJECT":
            return T.StructType([T.StructField(s[1:], build((*steps, s))) for s in children.get(steps, [])])
        return scalars.get(kind, T.VariantType())

    return build(())


def json_quality(df: DataFrame, column: str, group: str) -> DataFrame:
    """(group, valid_rows, invalid_rows)."""
    judged = df.select(group, F.try_parse_json(column).isNotNull().alias("_valid"))
    return judged.groupBy(group).agg(
        F.count_if("_valid").alias("valid_rows"), F.count_if(~F.col("_valid")).alias("invalid_rows")
    )


def invalid_json(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.try_parse_json(column).isNull())


def _digests(df: DataFrame, column: str, key: str) -> DataFrame:
    """(key, digest) of the rows with a valid document; the digest is over the compact text with sorted keys."""
    digest = F.sha2(F.to_json(F.try_parse_json(column)), 256)
    return unfold(df, [key], F.array(digest), "digest")


def json_duplicates(df: DataFrame, column: str, key: str) -> DataFrame:
    """(digest, copies, first_key): groups of equal documents.  Only digests and keys are shuffled."""
    return (
        _digests(df, column, key)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_key"))
        .where("copies > 1")
    )


def json_duplicate_texts(df: DataFrame, column: str, key: str) -> DataFrame:
    """(digest, copies, canonical): the duplicate groups with the text of their first member."""
    groups = json_duplicates(df, column, key)
    texts = df.select(F.col(key).alias("first_key"), F.to_json(F.try_parse_json(column)).alias("canonical"))
    return groups.join(texts, "first_key").select("digest", "copies", "canonical")


def json_duplicate_members(df: DataFrame, column: str, key: str) -> DataFrame:
    """(digest, key): members of the duplicate groups, as rows."""
    keyed = _digests(df, column, key).select("digest", key)
    again = keyed.groupBy("digest").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("digest")
    return keyed.join(again, "digest", "left_semi")


def unwrap_json(df: DataFrame, column: str) -> DataFrame:
    """Add ``json`` (unescaped text) and ``ok`` (it parses as JSON)."""
    return df.withColumn("json", unwrap_text(F.col(column))).withColumn("ok", F.try_parse_json("json").isNotNull())


def wrap_json(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("wrapped", wrap_text(F.col(column)))
