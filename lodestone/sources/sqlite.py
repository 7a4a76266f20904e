"""Tables of SQLite files: catalog, example values, and a partitioned scan.

SQLite opens local files only.  A file on another file system that Spark reads is fetched once by the driver and
by each executor; a path without a scheme, or of scheme ``file``, is opened where it is and must be shared.
"""

from __future__ import annotations

import re
import sqlite3
from contextlib import closing
from urllib.parse import quote

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    local = SparkFiles.get(path[8:]) if path.startswith("fetched:") else path
    return sqlite3.connect(f"file:{quote(local)}?mode=ro", uri=True)


def fetched(spark: SparkSession, path: str) -> str:
    """A path to give the functions below: a local one, or ``fetched:NAME`` of a file that tasks will have in their own folder."""
    if (m := re.match(r"([a-zA-Z][\w+.-]*):/*", path)) is None:
        return path
    if m[1].lower() == "file":
        return "/" + path[m.end() :]
    spark.sparkContext.addFile(path)
    return "fetched:" + path.rsplit("/", 1)[1]


def statements(path: str) -> dict[str, str]:
    """The CREATE statement of each table."""
    with closing(_open(path)) as c:
        return dict(c.execute("SELECT name, sql FROM sqlite_master WHERE type = 'table'"))


def columns(path: str) -> list[tuple[str, str, str, bool]]:
    """Table, column, declared type and whether it is in the primary key."""
    with closing(_open(path)) as c:
        return [(t, r[1], r[2], bool(r[5])) for t in statements(path) for r in c.execute(f"PRAGMA table_info({_quoted(t)})")]


def references(path: str) -> list[tuple[str, str, str, str]]:
    """Table and column of each foreign key, and the table and column that it refers to; an unnamed target is the other table's primary key."""
    with closing(_open(path)) as c:
        primary = {t: name for t, name, _, key in reversed(columns(path)) if key}
        rows = [(t, r) for t in statements(path) for r in c.execute(f"PRAGMA foreign_key_list({_quoted(t)})")]
    return [(t, r[3], r[2], r[4] or primary[r[2]]) for t, r in rows]


def examples(path: str, limit: int = 3, chars: int = 40) -> dict[str, list]:
    """Up to ``limit`` distinct values of each ``table.column`` in lower case, texts cut to ``chars``; columns without values are left out."""
    out = {}
    with closing(_open(path)) as c:
        for table, column, _, _ in columns(path):
            q = _quoted(column)
            rows = c.execute(f"SELECT DISTINCT {q} FROM {_quoted(table)} WHERE {q} IS NOT NULL AND {q} <> '' LIMIT {int(limit)}")
            values = [v[:chars] if isinstance(v, str) else v for (v,) in rows]
            if values:
                out[f"{table}.{column}".lower()] = values
    return out


def scan(spark: SparkSession, path: str, table: str, parts: int = 8) -> DataFrame:
    """A table's rows, all columns as text, read in ``parts`` runs of row ids; a table without row ids is one run."""
    path = fetched(spark, path)
    names = [c for t, c, _, _ in columns(path) if t == table]
    if not names:
        raise KeyError(f"no table {table!r} in {path}")
    with closing(_open(path)) as c:
        try:
            low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(table)}").fetchone()
        except sqlite3.OperationalError:
            bounds = [(None, None)]
        else:
            bounds = [] if low is None else [(low + (high + 1 - low) * i // parts, low + (high + 1 - low) * (i + 1) // parts) for i in range(parts)]
    listed = ", ".join(f"CAST({_quoted(n)} AS TEXT)" for n in names)

    def read(batches):
        import pyarrow as pa

        kind = pa.schema([(n, pa.string()) for n in names])
        for b in batches:
            for low, high in zip(b["low"].to_pylist(), b["high"].to_pylist(), strict=True):
                where, args = ("", ()) if low is None else (" WHERE rowid >= ? AND rowid < ?", (low, high))
                with closing(_open(path)) as c:
                    cursor = c.execute(f"SELECT {listed} FROM {_quoted(table)}{where}", args)
                    while rows := cursor.fetchmany(10_000):
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], schema=kind)

    runs = spark.createDataFrame(bounds, "low long, high long").repartition(max(1, len(bounds)), F.col("low"))
    return runs.mapInArrow(read, ", ".join(f"`{n}` string" for n in names))
