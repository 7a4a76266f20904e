"""Database schemas as prompt text, and the choice of columns for training prompts.

A catalog is four narrow tables keyed by ``db_id``: ``columns`` (table_pos, table_name, column_pos, column_name,
column_type, comment), ``keys`` (column_pos of primary keys), ``references`` (src, dst column_pos) and
``examples`` (column_pos, values: texts in the order to show).  Each text is one row a database; what is gathered into a row is one
schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import quoted
from lodestone.plans.running import HASH_BITS, order_hash
from lodestone.sources import sqlite

#: The columns that a prompt may show, and the example values of each.
MOST_COLUMNS, SHOWN = 225, 6


def catalog_of(spark: SparkSession, files: dict[str, str], limit: int = SHOWN) -> dict[str, DataFrame]:
    """The catalog of SQLite files by ``db_id``, read on the driver: schemas, and up to ``limit`` example values a column."""
    columns, keys, references, examples = [], [], [], []
    for db, at in files.items():
        path = sqlite.fetched(spark, at)
        places: dict[tuple[str, str], int] = {}
        tables: dict[str, int] = {}
        found = sqlite.examples(path, limit)
        for i, (table, column, kind, primary) in enumerate(sqlite.columns(path)):
            columns.append((db, tables.setdefault(table, len(tables)), table, i, column, kind, ""))
            places[table.lower(), column.lower()] = i
            if primary:
                keys.append((db, i))
            if values := found.get(f"{table}.{column}".lower()):
                examples.append((db, i, [str(v) for v in values]))
        for table, column, other, target in sqlite.references(path):
            references.append((db, places[table.lower(), column.lower()], places[other.lower(), target.lower()]))
    return {
        "columns": spark.createDataFrame(columns, "db_id string, table_pos int, table_name string, column_pos int, column_name string, column_type string, comment string"),
        "keys": spark.createDataFrame(keys, "db_id string, column_pos int"),
        "references": spark.createDataFrame(references, "db_id string, src int, dst int"),
        "examples": spark.createDataFrame(examples, "db_id string, column_pos int, values array<string>"),
    }


_METADATA = "db_id string, table_names_original array<string>, column_names_original array<array<string>>, column_names array<array<string>>, column_types array<string>, primary_keys array<string>, foreign_keys array<array<int>>"


def metadata_catalog(spark: SparkSession, *paths: str, examples: DataFrame | None = None) -> dict[str, DataFrame]:
    """The catalog of published metadata files, each a JSON list with an object a database.

    ``column_names_original`` pairs a table's number with a column's name (-1 for the star, which is left out), ``column_names`` holds the
    readable names, which become comments; a primary key is a column's number or a list of them.  ``examples`` may give values (``db_id,
    column_pos, values``); the files hold none.
    """
    found = spark.read.schema(_METADATA).option("multiLine", True).json(list(paths))
    each = found.select("*", F.posexplode("column_names_original").alias("column_pos", "__c"))
    table = F.col("__c")[0].cast("int")
    columns = each.filter(table >= 0).select(
        "db_id", table.alias("table_pos"), F.get("table_names_original", table).alias("table_name"), "column_pos", F.col("__c")[1].alias("column_name"),
        F.get("column_types", F.col("column_pos")).alias("column_type"), F.coalesce(F.get(F.get("column_names", F.col("column_pos")), F.lit(1)), F.lit("")).alias("comment"),
    )
    # a number stands as itself, a list as its JSON
    numbers = F.flatten(F.transform(F.coalesce("primary_keys", F.array().cast("array<string>")), lambda k: F.regexp_extract_all(k, F.lit(r"\d+"), F.lit(0))))
    keys = found.select("db_id", F.explode(numbers.cast("array<int>")).alias("column_pos"))
    references = found.select("db_id", F.explode("foreign_keys").alias("p")).select("db_id", F.col("p")[0].alias("src"), F.col("p")[1].alias("dst"))
    none = spark.createDataFrame([], "db_id string, column_pos int, values array<string>")
    return {"columns": columns, "keys": keys, "references": references, "examples": none if examples is None else examples}


def _described(catalog: dict[str, DataFrame]) -> DataFrame:
    """Columns with ``primary``, their example ``values`` and ``targets``, the (table, column) pairs that they refer to."""
    at = ["db_id", "column_pos"]
    columns = catalog["columns"]
    ends = columns.select("db_id", F.col("column_pos").alias("dst"), F.col("table_name").alias("t"), F.col("column_name").alias("c"))
    targets = catalog["references"].join(ends, ["db_id", "dst"]).groupBy("db_id", F.col("src").alias("column_pos")).agg(F.array_sort(F.collect_list(F.struct("dst", "t", "c"))).alias("targets"))
    primary = catalog["keys"].select(*at).distinct().withColumn("primary", F.lit(True))
    whole = columns.join(primary, at, "left").join(catalog["examples"], at, "left").join(targets, at, "left")
    return whole.withColumn("primary", F.coalesce("primary", F.lit(False)))


def _joined(rows: DataFrame, line: Column, between: str) -> DataFrame:
    """Lines of each table in column order: ``db_id, table_pos, table_name, lines``."""
    listed = F.array_sort(F.collect_list(F.struct("column_pos", "line")))
    return rows.withColumn("line", line).groupBy("db_id", "table_pos", "table_name").agg(F.array_join(F.transform(listed, lambda x: x["line"]), between).alias("lines"))


def _by_database(tables: DataFrame, order: Column) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct(order.alias("o"), "text")))
    return tables.groupBy("db_id").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n\n").alias("schema_text"))


def plain_schema(catalog: dict[str, DataFrame], shown: int = 3) -> DataFrame:
    """``db_id, schema_text``: a paragraph a table, a line a column with type, example values, key and reference."""
    values = F.transform(F.slice(F.coalesce("values", F.array().cast("array<string>")), 1, shown), lambda v: F.concat(F.lit('"'), v, F.lit('"')))
    last = F.element_at("targets", -1)
    reference = F.when(F.size("targets") > 0, F.concat("table_name", F.lit("."), "column_name", F.lit("="), last["t"], F.lit("."), last["c"])).otherwise("")
    line = F.concat("column_name", F.lit(" [ "), F.upper("column_type"), F.lit(" ] ( "), F.array_join(values, ", "), F.lit(" ) "), F.when(F.col("primary"), "primary_key").otherwise(""), F.lit(" "), reference)
    tables = _joined(_described(catalog), F.trim(line), "\n")
    return _by_database(tables.withColumn("text", F.concat("table_name", F.lit(" :\n"), "lines")), F.col("table_pos"))


def _literal(value: Column) -> Column:
    """A text as a literal in a list: single quotes, double ones around a text that has single ones only."""
    safe = F.regexp_replace(value, r"\\", r"\\\\")
    inner = F.when(safe.contains('"'), F.concat(F.lit("'"), F.replace(safe, F.lit("'"), F.lit("\\'")), F.lit("'"))).otherwise(F.concat(F.lit('"'), safe, F.lit('"')))
    return F.when(safe.contains("'"), inner).otherwise(F.concat(F.lit("'"), safe, F.lit("'")))


def ddl_schema(catalog: dict[str, DataFrame], reserved: list[str], shuffle_seed: int | None = None) -> DataFrame:
    """``db_id, schema_text``: a CREATE TABLE statement a table, with comments, up to six example values, and key clauses.

    A comment that only repeats the column's name is left out.  With ``shuffle_seed`` tables come in a seeded order.
    """
    name = lambda c: quoted(c, reserved)
    low = F.lower(F.trim("comment"))
    plain = F.lower("column_name").isin(low, F.replace(low, F.lit(" "), F.lit("_")), F.replace(low, F.lit(" "), F.lit(""))) | (low == "") | F.col("comment").isNull()
    values = F.slice(F.array_distinct(F.coalesce("values", F.array().cast("array<string>"))), 1, SHOWN)
    listed = F.concat(F.lit("["), F.array_join(F.transform(values, _literal), ", "), F.lit("]"))
    example = F.when(F.size(values) > 0, F.concat(F.lit("example: "), listed))
    note = F.concat_ws(", ", F.when(~plain, F.col("comment")), example)
    line = F.concat(F.lit("    "), name(F.col("column_name")), F.lit(" "), "column_type", F.lit(","), F.when(note != "", F.concat(F.lit(" -- "), note)).otherwise(""))
    rows = _described(catalog)
    tables = _joined(rows, line, "\n")
    snake = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("_"))
    clause = lambda t: F.concat(F.lit("    CONSTRAINT fk_"), snake(F.col("table_name")), F.lit("_"), snake(F.col("column_name")), F.lit(" FOREIGN KEY ("), name(F.col("column_name")), F.lit(") REFERENCES "), name(t["t"]), F.lit(" ("), name(t["c"]), F.lit("),"))
    at = ["db_id", "table_pos"]
    in_order = lambda item: F.transform(F.array_sort(F.collect_list(F.struct("column_pos", item.alias("x")))), lambda s: s["x"])
    primary = rows.filter("primary").groupBy(*at).agg(F.concat(F.lit("    PRIMARY KEY ("), F.array_join(in_order(name(F.col("column_name"))), ", "), F.lit("),")).alias("pk"))
    foreign = rows.filter("size(targets) > 0").groupBy(*at).agg(F.array_join(F.array_distinct(F.flatten(in_order(F.transform("targets", clause)))), "\n").alias("fk"))
    body = F.regexp_replace(F.concat_ws("\n", "lines", "pk", "fk"), ",$", "")
    made = tables.join(primary, at, "left").join(foreign, at, "left").withColumn("text", F.concat(F.lit("CREATE TABLE "), name(F.col("table_name")), F.lit(" (\n"), body, F.lit("\n);")))
    order = F.col("table_pos") if shuffle_seed is None else order_hash(F.lit(shuffle_seed), F.col("db_id"), F.col("table_pos"))
    return _by_database(made, order)


def training_columns(catalog: dict[str, DataFrame], used: DataFrame, seed: int = 42, most: int = MOST_COLUMNS) -> DataFrame:
    """``sample_id, db_id, column_pos`` to show for each training sample (``sample_id, db_id, answer``).

    Keys, columns on either side of a reference and columns whose name the answer holds are always shown; of the others a seeded
    share, one of ten tenths drawn for the sample, as far as ``most`` columns allow.
    """
    columns, links = catalog["columns"], catalog["references"]
    fixed = catalog["keys"].select("db_id", "column_pos").unionByName(links.select("db_id", F.col("src").alias("column_pos"))).unionByName(links.select("db_id", F.col("dst").alias("column_pos"))).distinct().withColumn("fixed", F.lit(True))
    each = used.join(columns.select("db_id", "column_pos", "column_name"), "db_id").join(fixed, ["db_id", "column_pos"], "left")
    marked = each.withColumn("needed", F.coalesce("fixed", F.lit(False)) | F.contains(F.lower("answer"), F.lower("column_name")))
    by = Window.partitionBy("sample_id", "db_id")
    rank = F.row_number().over(by.orderBy("needed", order_hash(F.lit(seed), F.col("sample_id"), F.col("column_pos")), "column_pos"))
    n_needed, n = F.sum(F.col("needed").cast("int")).over(by), F.count(F.lit(1)).over(by)
    tenths = F.floor(order_hash(F.lit(seed + 1), F.col("sample_id")) / float(1 << HASH_BITS) * 10) + 1
    room = F.least(F.floor(tenths * (n - n_needed) / 10), F.greatest(F.lit(most) - n_needed, F.lit(0)))
    return marked.withColumn("r", rank).withColumn("room", room).filter("needed OR r <= room").select("sample_id", "db_id", "column_pos")
