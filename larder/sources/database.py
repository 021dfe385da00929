"""A table of an SQLite database as a data source: ranges of row numbers are read side by side, conditions go to the database.

Conditions are an option of the read and not taken from the plan: a Python source that accepts pushed
filters keeps those of one query for the next one on the same DataFrame (Spark 4.1). For server databases
Spark's own JDBC reader with bounds does the same. An SQLite database is one file, so it must stand where
all executors see it; it is opened for reading only.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator, Sequence
from datetime import date, datetime
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from larder.functions.shipping import ship

ship(__name__)

#: Rows of a batch.
ROWS = 10_000
#: What a condition may say of a column, as SQL. Texts are compared as bytes, as Spark does; ``LIKE`` would ignore case.
CONDITIONS = {
    **{o: f"{{c}} {o} ?" for o in ("=", "<", "<=", ">", ">=")},
    "<>": "{c} <> ?",
    "is null": "{c} IS NULL",
    "is not null": "{c} IS NOT NULL",
    "contains": "instr({c}, ?) > 0",
}


class Rows(InputPartition):
    """Row numbers from ``start`` on and under ``stop``."""

    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def kind(declared: str) -> str:
    """SQLite's affinity of a declared type as a Spark type."""
    up = (declared or "").upper()
    if "INT" in up:
        return "bigint"
    if any(x in up for x in ("CHAR", "CLOB", "TEXT", "DATE", "TIME")):
        return "string"
    if any(x in up for x in ("REAL", "FLOA", "DOUB")):
        return "double"
    return "binary" if "BLOB" in up else "double" if up else "string"


def clause(column: str, said: str, value: object = None) -> tuple[str, list]:
    """A condition as SQL with its values."""
    c = quoted(column)
    if said == "in":
        return (f"{c} IN ({', '.join('?' * len(value))})", list(value)) if value else ("0", [])
    if said == "starts with":
        return f"substr({c}, 1, ?) = ?", [len(value), value]
    if said not in CONDITIONS:
        raise ValueError(f"{said!r} is no condition; there are {', '.join(CONDITIONS)}, starts with and in")
    return CONDITIONS[said].format(c=c), [value] * CONDITIONS[said].count("?")


class Reader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType, partitions: int, where: Sequence):
        self.path, self.table, self.columns, self.parts = path, table, schema, max(1, partitions)
        said = [clause(*w) for w in where]
        self.clauses, self.values = [c for c, _ in said], [v for _, own in said for v in own]

    def opened(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[Rows]:
        """Ranges of row numbers, from the least and the greatest: two look-ups, no scan."""
        db = self.opened()
        try:
            low, high = db.execute(f"SELECT (SELECT min(rowid) FROM {quoted(self.table)}), (SELECT max(rowid) FROM {quoted(self.table)})").fetchone()
        finally:
            db.close()
        if low is None:
            return [Rows(0, 0)]
        width = -(-(high - low + 1) // self.parts)
        return [Rows(a, min(a + width, high + 1)) for a in range(low, high + 1, width)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.columns)
        where = " AND ".join(["rowid >= ? AND rowid < ?", *(f"({c})" for c in self.clauses)])
        names = ", ".join(quoted(n) for n in schema.names) or "1"
        db = self.opened()
        try:
            cursor = db.execute(f"SELECT {names} FROM {quoted(self.table)} WHERE {where} ORDER BY rowid", [partition.start, partition.stop, *self.values])
            while rows := cursor.fetchmany(ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        finally:
            db.close()


class SqliteTable(DataSource):
    """``spark.read.format("sqlite_table").option("table", name).option("partitions", n).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        db = sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)
        try:
            columns = db.execute("SELECT name, type FROM pragma_table_info(?)", [self.options["table"]]).fetchall()
        finally:
            db.close()
        if not columns:
            raise ValueError(f"no table {self.options['table']!r} in {self.options['path']}")
        return ", ".join(f"`{n}` {kind(t)}" for n, t in columns)

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], self.options["table"], schema, int(self.options.get("partitions", 8)), json.loads(self.options.get("where", "[]")))


def sqlite_table(spark: SparkSession, path: str, table: str, partitions: int = 8, where: Sequence[tuple] = ()) -> DataFrame:
    """A table of an SQLite file, in ranges of row numbers.

    ``where`` holds conditions that all must hold, (column, what is said, value), answered by the database:
    =, <>, <, <=, >, >=, in, is null, is not null, starts with, contains. A null never fits a comparison.
    """
    for w in where:
        clause(*w)
    spark.dataSource.register(SqliteTable)
    return spark.read.format(SqliteTable.name()).option("table", table).option("partitions", partitions).option("where", json.dumps([list(w) for w in where])).load(path)


def save_sqlite(rows: DataFrame, path: str, table: str) -> None:
    """Write a small table to an SQLite file, row by row as they come: a file has one writer, so this is for parity and tests."""
    types = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "boolean": "INTEGER"}
    kept = lambda v: v.isoformat() if isinstance(v, (date, datetime)) else float(v) if isinstance(v, Decimal) else v
    db = sqlite3.connect(path)
    try:
        db.execute(f"CREATE TABLE {quoted(table)} ({', '.join(quoted(n) + ' ' + types.get(t, 'TEXT') for n, t in rows.dtypes)})")
        db.executemany(f"INSERT INTO {quoted(table)} VALUES ({', '.join('?' * len(rows.columns))})", ([kept(v) for v in r] for r in rows.toLocalIterator()))
        db.commit()
    finally:
        db.close()
