"""Column expressions over variants and JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Leading word of a variant's schema -> type name.
SHAPES = {
    "OBJECT": "OBJECT",
    "ARRAY": "ARRAY",
    "STRING": "STRING",
    "BOOLEAN": "BOOLEAN",
    "VOID": "NULL",
    "BIGINT": "NUMBER",
    "DECIMAL": "NUMBER",
    "DOUBLE": "NUMBER",
}


def json_type(value: Column) -> Column:
    """OBJECT, ARRAY, NUMBER, BOOLEAN, STRING or NULL; SQL null stays null.

    A lookup, not a chain of conditions: the schema of the value is built once per call.
    """
    names = F.create_map(*[F.lit(x) for pair in SHAPES.items() for x in pair])
    return F.try_element_at(names, F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0))


def number_kind(value: Column) -> Column:
    """Width of a number: INTEGER, LONG, BIG_INTEGER or BIG_DECIMAL."""
    shape = F.schema_of_variant(value)
    whole = F.try_variant_get(value, "$", "bigint")
    digits = F.regexp_extract(shape, r"^DECIMAL\((\d+),\s*0\)$", 1).try_cast("int")
    return (
        F.when((shape == "BIGINT") & whole.between(-(2**31), 2**31 - 1), "INTEGER")
        .when(shape == "BIGINT", "LONG")
        .when(digits >= 19, "BIG_INTEGER")
        .otherwise("BIG_DECIMAL")
    )


# A number written as a string that begins with this mark keeps its text; strings that begin with it get one more.
MARK = "\u0001"


def marked_numbers(text: Column) -> Column:
    """Valid JSON with every number turned into a marked string, since parsed numbers lose their spelling."""
    parts = F.regexp_extract_all(text, F.lit(r'("(?:[^"\\]++|\\.)*+"|[^"]++)'), 1)

    def marked(part: Column) -> Column:
        string = F.regexp_replace(part, r'^"(\\u0001|\x01)', '"\\\\u0001$1')
        return F.when(part.startswith('"'), string).otherwise(
            F.regexp_replace(part, r"(-?\d[\d.eE+-]*+)", '"\\\\u0001$1"')
        )

    return F.array_join(F.transform(parts, marked), "")


def marked_kind(value: Column) -> Column:
    """Type of a node of a marked document; numbers give their width, by their own spelling."""
    return let_kind(json_type(value), F.try_variant_get(value, "$", "string"))


def let_kind(shape: Column, text: Column) -> Column:
    number = F.substring(text, 2, F.length(text))
    return (
        F.when((shape != "STRING") | ~text.startswith(MARK) | text.startswith(MARK + MARK), shape)
        .when(~number.rlike(r"^-?\d+$"), "BIG_DECIMAL")
        .when(number.try_cast("int").isNotNull(), "INTEGER")
        .when(number.try_cast("bigint").isNotNull(), "LONG")
        .otherwise("BIG_INTEGER")
    )


def node_text(value: Column) -> Column:
    """Strings raw, JSON null as null, everything else as compact JSON with sorted keys."""
    return F.try_variant_get(value, "$", "string")


def field_text(value: Column, field: str) -> Column:
    """``node_text`` of a field of an object."""
    return F.try_variant_get(value, f"$.{field}", "string")


def unwrap_text(body: Column) -> Column:
    """Undo string escaping; null where the text is not a valid string body."""
    return F.from_json(F.concat(F.lit('{"x":"'), body, F.lit('"}')), "x string")["x"]


def wrap_text(text: Column) -> Column:
    """Escape a text for use inside a JSON string."""
    whole = F.to_json(F.struct(text.alias("x")))
    return F.when(text.isNotNull(), F.substring(whole, F.lit(7), F.length(whole) - 8))


