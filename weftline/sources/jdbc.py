"""Read-only JDBC queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERY_TIMEOUT_SECONDS = 30

# URL prefix -> driver class.
DRIVERS = {
    "jdbc:dm:": "dm.jdbc.driver.DmDriver",
    "jdbc:oracle:": "oracle.jdbc.OracleDriver",
}


def query_options(url: str, query: str, driver: str | None = None, **extra: str) -> dict[str, str]:
    """Reader options of a checked query; the text must start with SELECT or WITH."""
    text = (query or "").strip().rstrip(";").strip()
    if not text.lower().startswith(("select", "with")):
        raise ValueError("only SELECT or WITH queries are read")
    chosen = driver or next((d for prefix, d in DRIVERS.items() if url.lower().startswith(prefix)), None)
    options = {"url": url, "queryTimeout": str(QUERY_TIMEOUT_SECONDS)}
    if chosen:
        options["driver"] = chosen
    if "partitionColumn" in extra:
        options["dbtable"] = f"({text}) q"  # a partitioned read needs a table expression
    else:
        options["query"] = text
    return options | extra


def read_jdbc_query(spark: SparkSession, url: str, query: str, driver: str | None = None, **extra: str) -> DataFrame:
    """Result of a query.  Pass partitionColumn, lowerBound, upperBound and numPartitions to read it in parallel."""
    return spark.read.format("jdbc").options(**query_options(url, query, driver, **extra)).load()
