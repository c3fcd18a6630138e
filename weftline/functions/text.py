"""Column expressions for text, ranges and points in time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.names import strip
from weftline.functions.rows import let

PREVIEW_LIMIT = 160       # fixed values: longest preview, and what is kept of a longer text
PREVIEW_KEPT = 157
PORT_LOW, PORT_HIGH, PORT_CAP = 1, 65535, 1000


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def path_list_hash(paths: Column) -> Column:
    """Hash of a file list: every path followed by a line feed."""
    return F.sha2(F.array_join(F.transform(paths, lambda p: F.concat(p, F.lit("\n"))), ""), 256)


def preview(text: Column) -> Column:
    one_line = F.regexp_replace(strip(F.translate(F.coalesce(text, F.lit("")), "\r\n\t", "   ")), " {2,}", " ")
    return let(
        one_line,
        lambda t: F.when(F.length(t) > PREVIEW_LIMIT, F.concat(F.substring(t, 1, PREVIEW_KEPT), F.lit("..."))).otherwise(t),
    )


def entry_preview(kind: Column, text: Column, paths: Column, image: Column) -> Column:
    count = F.coalesce(F.size(paths), F.lit(0))
    files = (
        F.when(count <= 0, "(empty file list)")
        .when(count == 1, F.get(paths, F.lit(0)))
        .otherwise(F.concat(F.get(paths, F.lit(0)), F.lit("  (+"), (count - 1).cast("string"), F.lit(" files)")))
    )
    return (
        F.when(kind == "TEXT", preview(text))
        .when(kind == "FILES", files)
        .otherwise(F.coalesce(image, F.lit("(image)")))
    )


def epoch_millis(raw: Column) -> Column:
    """Epoch text of mixed unit to milliseconds: up to ten characters (sign included) are seconds."""
    text = strip(raw)
    number = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))
    return F.when(F.length(text) <= 10, number * 1000).otherwise(number)


def epoch_to_text(raw: Column, pattern: str = "yyyy-MM-dd HH:mm:ss", zone: str = "UTC") -> Column:
    """Struct (text, ms, sec).  The session time zone must be UTC, as set by ``runtime.configure``."""
    millis = epoch_millis(raw)
    local = F.from_utc_timestamp(F.timestamp_millis(millis), zone)
    return F.struct(
        F.date_format(local, pattern).alias("text"),
        millis.alias("ms"),
        F.call_function("div", millis, F.lit(1000)).alias("sec"),
    )


def text_to_epoch(raw: Column, pattern: str = "yyyy-MM-dd HH:mm:ss", zone: str = "UTC") -> Column:
    """Struct (ms, sec) of a local time text; null where the text does not match the pattern."""
    moment = F.to_utc_timestamp(F.try_to_timestamp(raw, F.lit(pattern)), zone)
    millis = F.unix_millis(moment)
    return F.struct(millis.alias("ms"), F.call_function("div", millis, F.lit(1000)).alias("sec"))


def expand_ranges(raw: Column, low: int = PORT_LOW, high: int = PORT_HIGH, cap: int = PORT_CAP) -> Column:
    """Struct (numbers, total, rejected) of a list like ``80,443 8000-8002``.

    Ranges are clamped before they are generated, so a row never builds more than the span low..high per part.
    """
    parts = F.filter(F.split(F.coalesce(raw, F.lit("")), r"[,，\s]+"), lambda p: p != "")

    def numbers(part: Column) -> Column:
        single = F.when(part.rlike(r"^[+-]?\d+$"), part.try_cast("int"))
        left = F.regexp_extract(part, r"^\+?(\d+)-\+?(\d+)-*$", 1).try_cast("int")
        right = F.regexp_extract(part, r"^\+?(\d+)-\+?(\d+)-*$", 2).try_cast("int")
        first = F.greatest(F.least(left, right), F.lit(low))
        last = F.least(F.greatest(left, right), F.lit(high))
        ranged = F.when(left.isNotNull() & right.isNotNull() & (first <= last), F.sequence(first, last))
        return F.when(single.between(low, high), F.array(single)).otherwise(
            F.coalesce(ranged, F.array().cast("array<int>"))
        )

    values = F.array_distinct(F.flatten(F.transform(parts, numbers)))
    return let(
        values,
        lambda found: F.struct(
            found.alias("numbers"),
            F.size(found).alias("total"),
            ((F.size(found) > cap) | (F.size(found) == 0)).alias("rejected"),
        ),
    )
