"""From a source's description to a DataFrame."""

from __future__ import annotations

import os
import re
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from ..model import Source


class Connector(Protocol):
    """What reads one kind of source, lazily."""

    def __call__(self, spark: SparkSession, source: Source) -> DataFrame: ...


#: File functions that a table's name may be, and Spark's reader and options for each.
FILE_FUNCTIONS = {
    "read_csv": ("csv", {"header": "true", "inferSchema": "true"}),
    "read_parquet": ("parquet", {}),
    "read_json": ("json", {}),
    "read_json_auto": ("json", {}),
}
_CALL = re.compile(r"\s*(\w+)\s*\(\s*(?:'([^']*)'|\"([^\"]*)\")\s*\)\s*")
_NAME = re.compile(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)*")

#: Hosts that are read over JDBC, by their names and aliases, and the driver's class.
JDBC = {
    "postgres": "org.postgresql.Driver",
    "postgresql": "org.postgresql.Driver",
    "redshift": "com.amazon.redshift.jdbc42.Driver",
    "mysql": "com.mysql.cj.jdbc.Driver",
    "sqlite": "org.sqlite.JDBC",
    "snowflake": "net.snowflake.client.jdbc.SnowflakeDriver",
    "bigquery": "com.simba.googlebigquery.jdbc.Driver",
    "databricks": "com.databricks.client.jdbc.Driver",
    "sqlalchemy": "",
    "jdbc": "",
}


def expand(text: str) -> str:
    """``${NAME}`` replaced by the environment's value; a bare ``$NAME`` stays."""

    def value(found: re.Match) -> str:
        if found[1] not in os.environ:
            raise ValueError(f"Environment variable {found[1]} is not set")
        return os.environ[found[1]]

    return re.sub(r"\$\{([^}]+)\}", value, text)


def file_call(table: str) -> tuple[str, str] | None:
    """(function, path) if a table's name is a file function with one quoted path."""
    found = _CALL.fullmatch(table)
    if found and found[1] in FILE_FUNCTIONS:
        return found[1], found[2] if found[2] is not None else found[3]
    if re.match(r"\s*read_\w+\s*\(", table):
        raise ValueError(f"Not a file function with one quoted path: {table!r}")
    return None


def checked_name(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise ValueError(f"Invalid identifier {name!r}")
    return name


def _table(spark: SparkSession, source: Source) -> DataFrame:
    if call := file_call(source.table):
        kind, options = FILE_FUNCTIONS[call[0]]
        return spark.read.format(kind).options(**options | source.options).load(expand(call[1]))
    name = checked_name(source.table)
    if source.connection:
        # A folder of files, or a database of the catalog.
        place = expand(source.connection)
        if re.search(r"[/:]", place):
            return spark.read.format(source.options.get("format", "parquet")).load(f"{place}/{name}.parquet" if source.options.get("format", "parquet") == "parquet" else f"{place}/{name}")
        return spark.table(f"{checked_name(place)}.{name}")
    return spark.table(name)


def _jdbc(spark: SparkSession, source: Source) -> DataFrame:
    url = expand(source.connection)
    options = {"url": url if url.startswith("jdbc:") else f"jdbc:{url}", "dbtable": checked_name(source.table)}
    if driver := JDBC.get(source.type):
        options["driver"] = driver
    return spark.read.format("jdbc").options(**options | source.options).load()


def _stream_only(spark: SparkSession, source: Source) -> DataFrame:
    raise ValueError(f"Source type {source.type!r} is a stream: read it with streaming.read_stream")


CONNECTORS: dict[str, Connector] = {"spark": _table, "duckdb": _table, "parquet": _table, "csv": _table, "json": _table}
CONNECTORS |= dict.fromkeys(JDBC, _jdbc) | {"kafka": _stream_only}
_BUILT_IN = frozenset(CONNECTORS)


def register_connector(name: str, connector: Connector) -> None:
    """Adds a kind of source; the built-in ones can't be replaced."""
    if name in _BUILT_IN:
        raise ValueError(f"{name} is built in")
    CONNECTORS[name] = connector


def resolve(spark: SparkSession, source: Source | DataFrame | object) -> DataFrame:
    """A DataFrame for a source, a Spark frame as it is, or a Pandas or Arrow table."""
    if isinstance(source, DataFrame):
        return source
    if not isinstance(source, Source):
        if hasattr(source, "to_arrow"):  # Polars
            source = source.to_arrow()
        return spark.createDataFrame(source)
    kind = source.type.lower()
    if kind in ("dataframe", "pandas", "polars"):
        raise ValueError(f"A {kind} source is passed as an object, not by name")
    if kind not in CONNECTORS:
        raise ValueError(f"Unknown source type {kind!r}; known: {', '.join(sorted(CONNECTORS))}")
    return CONNECTORS[kind](spark, source)


def describe(df: DataFrame) -> list[dict]:
    """Name, type and nullability of every column."""
    return [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for f in df.schema.fields]
