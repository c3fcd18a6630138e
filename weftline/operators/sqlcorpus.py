"""Rollups over a corpus of SQL texts or of facts extracted from them.

Facts: ``ord, sql_id, status, statement_types, read_tables, write_tables, columns``.  The scans at the end are
lexical triage over the tokens of one text; they accept any text and do not judge its grammar.  They walk every text
once, in Python tasks over Arrow batches: as nested array functions the same steps took milliseconds a text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from weftline.functions.names import is_blank, strip
from weftline.functions.tokens import tokens_of
from weftline.operators import scopes
from weftline.runtime import ship

BLANK_MESSAGE = "sql is blank"
ROWS_AT_ONCE = 20_000  # rows that a task makes of texts before it hands them on; those of one text stay together


def triage(sql_inputs: DataFrame, *kept: str) -> DataFrame:
    """Blank texts become PARSE_FAILED rows with a message; the others carry no verdict.  ``kept``: more columns to keep."""
    blank = is_blank(F.col("sql"))
    return sql_inputs.select(
        "ord",
        "sql_id",
        F.when(blank, "PARSE_FAILED").alias("status"),
        F.when(blank, BLANK_MESSAGE).alias("error"),
        *kept,
    )


def status_rollup(sql_facts: DataFrame) -> DataFrame:
    status = F.col("status")
    known = status.isin("SUCCESS", "PARTIAL", "UNSUPPORTED")
    return sql_facts.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "SUCCESS").alias("success"),
        F.count_if(status == "PARTIAL").alias("partial"),
        F.count_if(status == "UNSUPPORTED").alias("unsupported"),
        F.count_if(~F.coalesce(known, F.lit(False))).alias("failed"),
    )


def merged_tables(sql_facts: DataFrame) -> DataFrame:
    """(role, name): the distinct tables read and written, failed rows included."""
    tagged = F.concat(
        F.transform(_names("read_tables"), lambda t: F.struct(F.lit("read").alias("role"), t.alias("name"))),
        F.transform(_names("write_tables"), lambda t: F.struct(F.lit("write").alias("role"), t.alias("name"))),
    )
    return sql_facts.select(F.explode(tagged).alias("t")).select("t.role", "t.name").distinct()


def _names(column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast("array<string>"))


def _table_key(name: Column) -> Column:
    return F.lower(strip(F.coalesce(name, F.lit(""))))


def _batch_pairs(sql_facts: DataFrame) -> DataFrame:
    """Read x write within a record; the key of a name is computed once per record, not once per pair."""

    def keyed(column: str) -> Column:
        return F.transform(
            _names(column), lambda t, i: F.struct(i.alias("pos"), t.alias("name"), _table_key(t).alias("key"))
        )

    return (
        sql_facts.where(F.col("status").isin("SUCCESS", "PARTIAL"))
        .select("ord", "sql_id", keyed("read_tables").alias("reads"), keyed("write_tables").alias("writes"))
        .select("ord", "sql_id", F.explode("reads").alias("r"), "writes")
        .select("ord", "sql_id", "r", F.explode("writes").alias("w"))
        .where("r.key <> w.key")
        .select(
            "ord",
            "sql_id",
            F.col("r.pos").alias("read_pos"),
            F.col("r.name").alias("src"),
            F.col("r.key").alias("src_key"),
            F.col("w.pos").alias("write_pos"),
            F.col("w.name").alias("dst"),
            F.col("w.key").alias("dst_key"),
        )
    )


def batch_edges(sql_facts: DataFrame) -> DataFrame:
    """Dependency edges keyed by lower-case names; the spelling is that of the first occurrence.

    The pairs are made once and reduced by hash to one row per spelling and statement, with the first place as one number;
    only those rows go through the (sorting) choice of the first spelling.
    """
    pairs = _batch_pairs(sql_facts)
    place = F.col("ord").cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)") + (
        F.col("read_pos").cast("bigint") * 10**9 + F.col("write_pos")
    ).cast("decimal(19,0)")
    spellings = pairs.groupBy("src_key", "dst_key", "src", "dst", "sql_id").agg(F.min(place).alias("place"))
    ids = F.count_distinct(F.when(~is_blank(F.col("sql_id")), F.col("sql_id")))
    edges = spellings.groupBy("src_key", "dst_key").agg(F.min_by(F.struct("src", "dst"), "place").alias("shown"), ids.alias("sql_count"))
    return edges.select(F.col("shown.src").alias("src"), F.col("shown.dst").alias("dst"), "sql_count")


def batch_edge_sqls(sql_facts: DataFrame) -> DataFrame:
    """(src_key, dst_key, sql_id): the statements behind every dependency edge, as rows."""
    return _batch_pairs(sql_facts).where(~is_blank(F.col("sql_id"))).select("src_key", "dst_key", "sql_id").distinct()


def column_usage(sql_facts: DataFrame) -> DataFrame:
    """(sql_id, column_name): distinct columns used per input."""
    return sql_facts.select("sql_id", F.explode("columns").alias("column_name")).distinct()


def corpus_profile(sql_facts: DataFrame) -> DataFrame:
    """Statements per type and status."""
    return (
        sql_facts.select("status", F.explode("statement_types").alias("statement_type"))
        .groupBy("statement_type", "status")
        .agg(F.count(F.lit(1)).alias("statements"))
    )


def facts_to_jobs(sql_facts: DataFrame) -> DataFrame:
    """Facts as a job catalogue, so that the lineage operators run on them."""
    none = F.lit(None).cast("string")
    return sql_facts.where(F.col("status").isin("SUCCESS", "PARTIAL")).select(
        "ord",
        none.alias("source"),
        F.col("sql_id").alias("name"),
        none.alias("description"),
        none.alias("sql"),
        F.col("read_tables").alias("input_tables"),
        F.col("write_tables").alias("output_tables"),
    )


def by_text(sql_inputs: DataFrame, found: Callable[[str], Iterable[tuple]], fields: str, kept: tuple[str, ...] = ("ord", "sql_id")) -> DataFrame:
    """The ``kept`` columns of every text with each of the rows, of the columns ``fields``, that ``found`` makes of the
    text.  A null text is read as an empty one.  Row-local: no shuffle."""
    source = sql_inputs.select(*kept, F.make_valid_utf8(F.col("sql").cast("string")).alias("sql"))
    made = StructType.fromDDL(fields)
    kinds = [to_arrow_type(f.dataType) for f in made]
    names = [*kept, *made.names]

    def walk(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows_of(batch: pa.RecordBatch, places: list[int], rows: list[tuple]) -> pa.RecordBatch:
            at = pa.array(places, pa.int32())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in kept], *columns], names=names)

        for batch in batches:
            places, rows = [], []
            for i, text in enumerate(batch.column("sql").to_pylist()):
                of_text = list(found(text or ""))
                places += [i] * len(of_text)
                rows += of_text
                if len(rows) >= ROWS_AT_ONCE:
                    yield rows_of(batch, places, rows)
                    places, rows = [], []
            yield rows_of(batch, places, rows)

    ship(sql_inputs.sparkSession)
    return source.mapInArrow(walk, StructType([*source.select(*kept).schema, *made]))


def statements(text: str) -> list[list[str]]:
    """The tokens of every non-empty statement of a text."""
    found, words = [], []
    for token in tokens_of(text):
        if token == ";":
            found.append(words)
            words = []
        else:
            words.append(token)
    return [words for words in [*found, words] if words]


def kind_of_statement(words: list[str]) -> str:
    """Kind by the leading words; WITH counts as SELECT."""
    lead = []
    for word in words:
        if word != "(":
            lead.append(word.upper())
            if len(lead) == 6:
                break
    first = lead[0] if lead else ""
    if first == "CREATE":
        made = next((w for w in lead[1:] if w in ("VIEW", "TABLE")), None)
        return f"CREATE_{made}" if made else "UNKNOWN"
    if first in ("SELECT", "WITH"):
        return "SELECT"
    return first if first in ("INSERT", "UPDATE", "DELETE", "MERGE", "ALTER", "DROP") else "UNKNOWN"


def statement_kinds(sql_inputs: DataFrame) -> DataFrame:
    """(ord, sql_id, statement_no, kind)."""

    def kinds(text: str) -> Iterator[tuple]:
        return ((no, kind_of_statement(words)) for no, words in enumerate(statements(text)))

    return by_text(sql_inputs, kinds, "statement_no int, kind string")


def _shown_refs(statement: scopes.Scoped) -> Iterable[tuple[str, str]]:
    """Distinct (role, name) of the references that mean tables."""
    return dict.fromkeys((r.role, r.name) for r in statement.refs if not r.hidden)


def table_refs(sql_inputs: DataFrame) -> DataFrame:
    """(ord, sql_id, statement_no, role, name): tables after the words that announce a read or a write."""

    def refs(text: str) -> Iterator[tuple]:
        return ((no, *ref) for no, words in enumerate(statements(text)) for ref in _shown_refs(scopes.scoped(words)))

    return by_text(sql_inputs, refs, "statement_no int, role string, name string")


def column_refs(sql_inputs: DataFrame) -> DataFrame:
    """(ord, sql_id, statement_no, column_name): columns of every statement as ``table.column``."""

    def columns(text: str) -> Iterator[tuple]:
        return ((no, column) for no, words in enumerate(statements(text)) for column in scopes.column_refs(scopes.scoped(words)))

    return by_text(sql_inputs, columns, "statement_no int, column_name string")


FACTS = {"statement_types": "kind", "read_tables": "read", "write_tables": "write", "columns": "column"}


def _facts(text: str) -> list[tuple]:
    """One row: per role the distinct names with the first statement of each, in the order of ``extract_facts``."""
    first = {role: {} for role in FACTS.values()}
    for no, words in enumerate(statements(text)):
        statement = scopes.scoped(words)
        first["kind"].setdefault(kind_of_statement(words), no)
        for role, name in _shown_refs(statement):
            first[role].setdefault(name, no)
        for column in scopes.column_refs(statement):
            first["column"].setdefault(column, no)
    return [tuple(sorted((no, name) for name, no in names.items()) for names in first.values())]


def extract_facts(sql_inputs: DataFrame) -> DataFrame:
    """Facts of SQL texts: ``ord, sql_id, status, statement_types, read_tables, write_tables, columns``.

    A blank text, or one without a statement, is PARSE_FAILED; a text with a statement of unknown kind is PARTIAL.
    The lists hold distinct values by statement, then by name; texts of the same ``ord`` and ``sql_id`` share theirs.
    Every text is one row of one exchange, with its names inside.
    """
    fields = ", ".join(f"{role} array<struct<statement_no: int, name: string>>" for role in FACTS.values())
    each = by_text(triage(sql_inputs, "sql"), _facts, fields, ("ord", "sql_id", "status"))
    same = each.groupBy("ord", "sql_id").agg(F.collect_list(F.struct("status", *FACTS.values())).alias("texts"))

    def listed(role: str) -> Column:
        return F.array_distinct(F.sort_array(F.flatten(F.col(f"texts.{role}")))["name"])

    judged = same.select("ord", "sql_id", F.explode("texts.status").alias("status"), *[listed(role).alias(c) for c, role in FACTS.items()])
    status = (
        F.when(F.col("status").isNotNull() | (F.size("statement_types") == 0), "PARSE_FAILED")
        .when(F.array_contains("statement_types", "UNKNOWN"), "PARTIAL")
        .otherwise("SUCCESS")
    )
    return judged.withColumn("status", status)
