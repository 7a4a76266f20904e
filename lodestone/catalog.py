"""Registry of the library's queries and their SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Register a query ``(spark, sf_dir) -> DataFrame`` under its function name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def load(spark, sf_dir: str, name: str):
    """A table of the test data."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from lodestone.queries import data, engine, relations, retrieval, sequences, text2sql  # noqa: E402,F401  (they register themselves)
