"""A stored lineage graph that is kept up to date by the jobs that come and go, and answers lookups without the catalogue.

Every version of the store appends signed counts: +1 for each pair, table use or record of an added job, -1 for a
removed one.  What is read is the sum over the versions up to the pointer, so the order of the changes does not matter,
and a version that was not finished is never seen.  Components are recomputed for the tables that a version touches:
the ends of edges and the tables that appear or vanish, with all members of their old components; all others keep
their rows.  ``compact`` sums the versions up into a new generation.

Lookup tables are sorted by the name that is looked up, so the statistics of the files leave out the others.  Job names
are unique in a catalogue; a job that changes is removed with its old record and added with the new one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.names import is_blank, layer_of, short_name
from weftline.operators import components, graph
from weftline.operators.ordered import ranked
from weftline.runtime import materialize, read_pointer, write_pointer

_TABLES = {
    "edges": "src string, dst string, n bigint, named bigint",
    "usage": "name string, produced bigint, consumed bigint",
    "records": "key string, role string, name string, source string, description string, sql string, "
    "input_tables array<string>, output_tables array<string>, n bigint",
    "members": "name string, representative string",
}
_RECORD = ["name", *graph.JOB_FIELDS]


@dataclass(frozen=True)
class Store:
    """The store at a root folder as of one version."""

    spark: SparkSession
    root: str
    generation: str
    version: int

    def _rows(self, table: str) -> DataFrame:
        """(…, version) of the versions up to this one."""
        schema = f"{_TABLES[table]}, version int"
        if self.version < 0:
            return self.spark.createDataFrame([], schema)
        read = self.spark.read.schema(schema).parquet(f"{self.root}/{self.generation}/{table}")
        return read.where(F.col("version") <= self.version)

    def edges(self, where: Column | None = None) -> DataFrame:
        """(src, dst, weight), of all edges or of those that ``where`` names by their ends."""
        rows = self._rows("edges")
        rows = rows if where is None else rows.where(where)
        sums = rows.groupBy("src", "dst").agg(F.sum("n").alias("n"), F.sum("named").alias("named")).where("n > 0")
        return sums.select("src", "dst", F.greatest("named", F.lit(1)).cast("bigint").alias("weight"))

    def usage(self, where: Column | None = None) -> DataFrame:
        """(name, producing_sql_count, consuming_sql_count)."""
        rows = self._rows("usage")
        rows = rows if where is None else rows.where(where)
        sums = rows.groupBy("name").agg(F.sum("produced").alias("producing_sql_count"), F.sum("consumed").alias("consuming_sql_count"))
        return sums.where("producing_sql_count + consuming_sql_count > 0")

    def cards(self) -> DataFrame:
        return _cards(self.usage(), self.edges())

    def members(self) -> DataFrame:
        """(name, representative): the least name of every table's component."""
        latest = self._rows("members").groupBy("name").agg(F.max_by(F.struct("representative"), "version").alias("m"))
        return latest.select("name", "m.representative").where("representative is not null")

    def components(self) -> DataFrame:
        """(name, representative, cluster_id) as ``components.components`` gives them."""
        members = materialize(self.members(), "stored-members")
        heads = ranked(members.where("name = representative").select("representative"), [F.col("representative")], "cluster_id")
        return members.join(heads, "representative").select("name", "representative", "cluster_id")

    def _records(self, key: str, role: str) -> DataFrame:
        rows = self._rows("records").where((F.col("key") == key) & (F.col("role") == role))
        return rows.groupBy(*_RECORD).agg(F.sum("n").alias("n")).where("n > 0").drop("n")

    def producers_of(self, name: str) -> DataFrame:
        return self._records(name, "producer").orderBy(F.col("name").asc_nulls_last())

    def consumers_of(self, name: str) -> DataFrame:
        return self._records(name, "consumer").orderBy(F.col("name").asc_nulls_last())

    def upstream_of(self, name: str) -> DataFrame:
        return self.edges(F.col("dst") == name).select(F.col("src").alias("name"), "weight").orderBy("name")

    def downstream_of(self, name: str) -> DataFrame:
        return self.edges(F.col("src") == name).select(F.col("dst").alias("name"), "weight").orderBy("name")

    def table_detail(self, name: str) -> DataFrame:
        """Card of one table with the representative of its component; empty for an unknown table."""
        near = self.edges((F.col("src") == name) | (F.col("dst") == name))
        mine = self._rows("members").where(F.col("name") == name).agg(F.max_by("representative", "version").alias("representative"))
        card = _cards(self.usage(F.col("name") == name), near)
        return card.join(F.broadcast(mine), F.lit(True))  # exactly one row

    def edge_detail(self, src: str, dst: str) -> DataFrame:
        """Jobs behind one edge with full records, from the producers of ``dst`` alone."""
        return graph.edge_detail(self._records(dst, "producer"), src, dst, unique_names=True)

    def resolve_sqls(self, name: str) -> DataFrame:
        """Producers of the table of that name; without any, the job of that name; else nothing."""
        made = self._records(name, "producer")
        found = made.limit(1).select(F.lit(True).alias("_found"))
        named = self._records(name, "job").join(found, F.lit(True), "left_anti")
        return made.unionByName(named).orderBy(F.col("name").asc_nulls_last())


def _cards(usage: DataFrame, edges: DataFrame) -> DataFrame:
    return graph.degrees(usage, edges).select(
        "name",
        short_name(F.col("name")).alias("short_name"),
        layer_of(F.col("name")).alias("layer"),
        "in_degree",
        "out_degree",
        "producing_sql_count",
        "consuming_sql_count",
        (F.col("out_degree") == 0).alias("is_leaf"),
        (F.col("in_degree") == 0).alias("is_source"),
    )


def open_store(spark: SparkSession, root: str) -> Store:
    """The store as its pointer says; a root without one is an empty store."""
    pointer = read_pointer(spark, root)
    if pointer is None:
        return Store(spark, root, f"g-{uuid.uuid4().hex}", -1)
    generation, version = pointer.split(":")
    return Store(spark, root, generation, int(version))


def _signed(added: DataFrame | None, removed: DataFrame | None) -> DataFrame:
    parts = [jobs.select(*_RECORD, F.lit(sign).cast("bigint").alias("sign")) for jobs, sign in ((added, 1), (removed, -1)) if jobs is not None]
    if not parts:
        raise ValueError("neither added nor removed jobs")
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def _changes(jobs: DataFrame) -> dict[str, DataFrame]:
    """The signed counts of the jobs (record, sign), summed per key."""
    named = F.col("sign") * (~is_blank(F.col("name"))).cast("bigint")
    pairs = jobs.select("name", "sign", F.explode(F.array_distinct("input_tables")).alias("src"), "output_tables").select(
        "src", F.explode(F.array_distinct("output_tables")).alias("dst"), "sign", named.alias("named")
    )
    edges = pairs.where("lower(src) <> lower(dst)").groupBy("src", "dst").agg(F.sum("sign").alias("n"), F.sum("named").alias("named"))

    def tagged(column: str, role: str) -> Column:
        return F.transform(F.array_distinct(column), lambda t: F.struct(t.alias("key"), F.lit(role).alias("role")))

    own = F.array(F.struct(F.col("name").alias("key"), F.lit("job").alias("role")))
    records = jobs.select(F.explode(F.concat(tagged("output_tables", "producer"), tagged("input_tables", "consumer"), own)).alias("e"), *_RECORD, "sign")
    records = records.select("e.key", "e.role", *_RECORD, F.col("sign").alias("n"))
    made = F.sum(F.when(F.col("role") == "producer", F.col("n")).otherwise(0))
    used = F.sum(F.when(F.col("role") == "consumer", F.col("n")).otherwise(0))
    usage = records.where("role <> 'job'").groupBy(F.col("key").alias("name")).agg(made.alias("produced"), used.alias("consumed"))
    return {
        "edges": edges.where("n <> 0 or named <> 0"),
        "usage": usage.where("produced <> 0 or consumed <> 0"),
        "records": records,
    }


_SORT = {"edges": ["src", "dst"], "usage": ["name"], "records": ["key"], "members": ["name"]}


def _write(rows: DataFrame, store: Store, table: str, version: int) -> DataFrame:
    """Append one version, sorted by the name looked up; what an unfinished attempt left there is replaced."""
    names = [f.split()[0] for f in _TABLES[table].split(", ")]
    path = f"{store.root}/{store.generation}/{table}/version={version}"
    rows.select(*names).orderBy(*_SORT[table]).write.mode("overwrite").parquet(path)
    return store.spark.read.schema(_TABLES[table]).parquet(path)


def apply_changes(spark: SparkSession, root: str, added: DataFrame | None = None, removed: DataFrame | None = None) -> Store:
    """The store after the jobs ``added`` and ``removed`` (name, source, description, sql, input_tables, output_tables)."""
    old = open_store(spark, root)
    version = old.version + 1
    jobs = materialize(_signed(added, removed), "job-changes")
    written = {table: _write(rows, old, table, version) for table, rows in _changes(jobs).items()}
    new = Store(spark, root, old.generation, version)

    # tables whose edges appear or vanish, or that do so themselves
    changed = written["edges"].select("src", "dst")
    was = old.edges().join(changed, ["src", "dst"], "left_semi").select("src", "dst", F.lit(1).alias("was"))
    now = new.edges().join(changed, ["src", "dst"], "left_semi").select("src", "dst", F.lit(1).alias("now"))
    flipped = was.join(now, ["src", "dst"], "full").where("was is null or now is null")
    names = written["usage"].select("name")
    had = old.usage().join(names, "name", "left_semi").select("name", F.lit(1).alias("was"))
    has = new.usage().join(names, "name", "left_semi").select("name", F.lit(1).alias("now"))
    moved = had.join(has, "name", "full").where("was is null or now is null").select("name")
    touched = moved.unionByName(flipped.select(F.explode(F.array("src", "dst")).alias("name"))).distinct()
    touched = materialize(touched, "touched")

    before = materialize(old.members(), "old-members")
    heads = materialize(before.join(touched, "name", "left_semi").select("representative").distinct(), "touched-components")
    affected = before.join(heads, "representative", "left_semi").select("name").unionByName(touched).distinct()
    affected = materialize(affected, "affected")
    alive = materialize(new.usage().join(affected, "name", "left_semi").select("name"), "alive")
    links = new.edges().join(affected.withColumnRenamed("name", "src"), "src", "left_semi")  # both ends are affected
    found = components.components(alive, materialize(links.select("src", "dst"), "affected-edges")).select("name", "representative")
    gone = affected.join(alive, "name", "left_anti").select("name", F.lit(None).cast("string").alias("representative"))
    _write(found.unionByName(gone), old, "members", version)
    write_pointer(spark, root, f"{old.generation}:{version}")
    return new


def compact(spark: SparkSession, root: str) -> Store:
    """The same store as the only version of a new generation; the old one stays until it is deleted."""
    old = open_store(spark, root)
    new = Store(spark, root, f"g-{uuid.uuid4().hex}", 0)
    sums = {
        "edges": old._rows("edges").groupBy("src", "dst").agg(F.sum("n").alias("n"), F.sum("named").alias("named")).where("n <> 0"),
        "usage": old._rows("usage").groupBy("name").agg(F.sum("produced").alias("produced"), F.sum("consumed").alias("consumed")),
        "records": old._rows("records").groupBy("key", "role", *_RECORD).agg(F.sum("n").alias("n")).where("n <> 0"),
        "members": old.members(),
    }
    for table, rows in sums.items():
        _write(rows, new, table, 0)
    write_pointer(spark, root, f"{new.generation}:0")
    return new
