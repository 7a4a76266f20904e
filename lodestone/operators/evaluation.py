"""Text-to-SQL evaluation: guarded execution, result comparison, votes and metrics."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Plan nodes that only read; a statement with any other node, at any depth, is refused.
READ_ONLY = frozenset(
    ("Project", "Aggregate", "Filter", "Sort", "GlobalLimit", "LocalLimit", "Join", "Distinct", "Deduplicate", "SubqueryAlias", "Union", "UnresolvedWith", "UnresolvedHaving", "Offset", "UnresolvedOrderBy", "Intersect",
     "Except", "UnresolvedSubqueryColumnAliases", "OneRowRelation", "UnresolvedRelation", "UnresolvedInlineTable", "UnresolvedTableValuedFunction", "WithWindowDefinition", "Generate", "Pivot", "UnresolvedPivot", "Window", "LocalRelation", "LateralJoin", "Sample", "View", "UnresolvedHint", "Expand")
)
#: Built-in functions that run named code or read files beside the tables.
REACHES_OUT = frozenset(("reflect", "try_reflect", "java_method", "from_protobuf", "to_protobuf", "python_worker_logs", "input_file_name", "input_file_block_start", "input_file_block_length"))
#: Expressions of the analysed plan that run a user's code, under whatever name they were called.
RUNS_CODE = frozenset(("CallMethodViaReflection", "ScalaUDF", "PythonUDF", "PythonUDAF", "PythonUDTF", "UnresolvedPolymorphicPythonUDTF", "ScalaAggregator", "ScalaUDAF", "SimpleTypedAggregateExpression", "ComplexTypedAggregateExpression", "UserDefinedGenerator", "ApplyFunctionExpression", "V2Aggregator", "InvokeLike"))
#: Sources of rows in the analysed plan that hold no data but the statement's own.
OWN_ROWS = frozenset(("OneRowRelation", "LocalRelation", "Range", "CTERelationRef"))
CATALOGS = ("spark_catalog",)


def _listed(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _nodes(plan) -> Iterator:
    """A plan's nodes, those of subqueries and of common tables among them; what a view holds is its owner's and left out."""
    open_plans = [plan]
    while open_plans:
        at = open_plans.pop()
        yield at
        if at.nodeName() != "View":
            for parts in (at.children(), at.innerChildren(), at.subqueries()):
                open_plans += _listed(parts)


def _expressions(node) -> Iterator:
    """All expressions of a node, at any depth."""
    found = _listed(node.expressions())
    while found:
        at = found.pop()
        yield at
        found += _listed(at.children())


def _class(x) -> str:
    return x.getClass().getSimpleName()


def _built_in(spark: SparkSession) -> frozenset[str]:
    """Names of Spark's own functions, without those that reach out."""
    analysis = spark._jvm.org.apache.spark.sql.catalyst.analysis
    names = [f.funcName().lower() for r in (analysis.FunctionRegistry, analysis.TableFunctionRegistry) for f in _listed(r.builtin().listFunction())]
    return frozenset(names) - REACHES_OUT


def _refused_parse(spark: SparkSession, plan, catalogs: tuple[str, ...]) -> str | None:
    """What a parsed statement holds that is no query over tables of known databases by Spark's own functions."""
    known = _built_in(spark)
    for node in _nodes(plan):
        name = node.nodeName()
        if name not in READ_ONLY:
            return name
        if name == "UnresolvedRelation":
            parts = _listed(node.multipartIdentifier())
            if len(parts) == 2 and parts[0] != "global_temp" and not spark.catalog.databaseExists(parts[0]) or len(parts) > 2 and parts[0] not in catalogs:
                return f"relation {'.'.join(parts)}"
        called = [_listed(node.name())] if name == "UnresolvedTableValuedFunction" else []
        called += [_listed(e.nameParts()) for e in _expressions(node) if _class(e) == "UnresolvedFunction"]
        for parts in called:
            if parts[-1].lower() not in known or [p.lower() for p in parts[:-1]] not in ([], ["builtin"], ["system", "builtin"]):
                return f"function {'.'.join(parts)}"
    return None


def _refused_analysis(analysed, catalogs: tuple[str, ...]) -> str | None:
    """What an analysed statement reads or runs that is neither a view, a table of the catalogs, nor Spark's own."""
    for node in _nodes(analysed):
        for e in _expressions(node):
            kind, package = _class(e), e.getClass().getName()
            if kind in RUNS_CODE or not package.startswith("org.apache.spark.sql.catalyst."):
                return f"expression {kind}"
        kind = _class(node)
        if kind == "View" or node.children().nonEmpty() or kind in OWN_ROWS:
            continue
        if kind in ("LogicalRelation", "HiveTableRelation"):
            table = node.catalogTable() if kind == "LogicalRelation" else None
            if table is not None and not table.isDefined():
                return "path relation"
            catalog = CATALOGS[0]
        elif kind == "DataSourceV2Relation" and node.catalog().isDefined() and node.identifier().isDefined():
            catalog = node.catalog().get().name()
        else:
            return f"source {kind}"
        if catalog not in catalogs:
            return f"catalog {catalog}"
    return None


def refusal(spark: SparkSession, sql: str, catalogs: tuple[str, ...] = CATALOGS) -> str | None:
    """Why a statement is no read-only query, or nothing.

    The parsed plan may hold only nodes that read and only Spark's own functions, none of which runs named code or opens files;
    so quoted names and comments are seen through and literals are left alone.  The analysed plan may read only views,
    tables of ``catalogs`` and its own rows, and hold no user's code, which a temporary function may have put behind a built-in name.
    """
    refused = _refused_parse(spark, spark._jsparkSession.sessionState().sqlParser().parsePlan(sql), catalogs)
    return refused or _refused_analysis(spark.sql(sql)._jdf.queryExecution().analyzed(), catalogs)


def _guard(spark: SparkSession, statements: list[str], action, seconds: float):
    """``action`` of the statements' DataFrames, or an error; only read-only statements run, cancelled after ``seconds``."""
    try:
        for sql in statements:
            if refused := refusal(spark, sql):
                return None, f"not a query: {refused}"
        tag = f"guarded-{uuid.uuid4().hex}"
        spark.addTag(tag)
        timer = threading.Timer(seconds, spark.interruptTag, [tag])
        timer.start()
        try:
            return action(*map(spark.sql, statements)), None
        finally:
            timer.cancel()
            spark.removeTag(tag)
    except Exception as e:  # any failure of a generated statement is its result
        return None, str(e).strip().split("\n")[0] or type(e).__name__


def guarded(spark: SparkSession, sql: str, limit: int = 1000, seconds: float = 5.0) -> tuple[list[tuple] | None, str | None]:
    """Rows of one read-only statement, or an error, which more than ``limit`` rows are too; cancelled after ``seconds``."""
    rows, error = _guard(spark, [sql], lambda df: [tuple(r) for r in df.limit(limit + 1).collect()], seconds)
    if rows is not None and len(rows) > limit:
        return None, f"more than {limit} rows"
    return rows, error


def run_statements(spark: SparkSession, statements: DataFrame, limit: int = 1000, seconds: float = 5.0, threads: int = 8) -> Iterator[tuple]:
    """``statement_id``, rows and error of each statement (``statement_id, sql``), ``threads`` at a time; the statements are streamed to the driver, which has to start them anyway."""
    with ThreadPoolExecutor(threads) as pool:
        held = []
        for r in statements.select("statement_id", "sql").toLocalIterator():
            held.append((r.statement_id, pool.submit(guarded, spark, r.sql, limit, seconds)))
            if len(held) >= 4 * threads:
                key, result = held.pop(0)
                yield key, *result.result()
        for key, result in held:
            yield key, *result.result()


def execution_match(spark: SparkSession, gold: str, answer: str, seconds: float = 30.0, empty_matches: bool = True) -> tuple[bool | None, str | None]:
    """Whether two statements give the same set of rows, all rows compared in Spark, or an error.

    Two empty results match, whatever their columns, unless ``empty_matches`` is false: then an empty gold result matches nothing.
    """

    def same(a: DataFrame, b: DataFrame) -> bool:
        if a.isEmpty():
            return empty_matches and b.isEmpty()
        return _comparable(a, b) and same_set(a, b)

    return _guard(spark, [gold, answer], same, seconds)


def verify_answers(spark: SparkSession, items: DataFrame, seconds: float = 30.0, threads: int = 4) -> Iterator[tuple]:
    """``item``, places of the right and of the wrong answers of each item (``item, gold, answers``: statements), ``threads`` items at a time.

    An answer is right if it gives the gold statement's set of rows; one that is null, is refused or fails is wrong, and an empty gold result, or one that
    cannot be had, makes all wrong.
    """

    def judge(gold: str, answers: list[str | None]) -> tuple[list[int], list[int]]:
        right = [i for i, a in enumerate(answers) if a is not None and gold is not None and execution_match(spark, gold, a, seconds, empty_matches=False)[0]]
        return right, [i for i in range(len(answers)) if i not in right]

    with ThreadPoolExecutor(threads) as pool:
        held = []
        for r in items.select("item", "gold", "answers").toLocalIterator():
            held.append((r.item, pool.submit(judge, r.gold, r.answers)))
            if len(held) >= 4 * threads:
                key, result = held.pop(0)
                yield key, *result.result()
        for key, result in held:
            yield key, *result.result()


def _comparable(a: DataFrame, b: DataFrame) -> bool:
    """Whether rows can be equal without a cast of text: as many columns, each of one type, or both numbers, or one only nulls."""
    number = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    kinds = [["number" if t.startswith(number) else t for _, t in df.dtypes] for df in (a, b)]
    return len(kinds[0]) == len(kinds[1]) and all(x == y or "void" in (x, y) for x, y in zip(*kinds, strict=True))


def _without_maps(df: DataFrame) -> DataFrame:
    """Columns with maps or variants as JSON, a map itself as its entries in order: set operations take neither."""
    df = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    entries = lambda c, t: F.array_sort(F.map_entries(c)) if t.startswith("map<") else c
    return df.select(*[F.to_json(F.struct(entries(F.col(c), t).alias("v"))).alias(c) if "map<" in t or "variant" in t else F.col(c) for c, t in df.dtypes])


def same_set(a: DataFrame, b: DataFrame) -> bool:
    """Whether two results hold the same rows, ignoring order and multiplicity."""
    a, b = _without_maps(a), _without_maps(b)
    return a.subtract(b).isEmpty() and b.subtract(a).isEmpty()


def verify(gold: list[tuple] | None, answers: list[list[tuple] | None]) -> tuple[list[int], list[int]]:
    """Indices of correct and wrong answers; an empty gold result makes all wrong."""
    right = [i for i, a in enumerate(answers) if gold and a is not None and set(a) == set(gold)]
    return right, [i for i in range(len(answers)) if i not in right]


def majority(votes: DataFrame) -> DataFrame:
    """``item, result``: the result most candidates agree on, the first seen on ties; ``votes`` holds ``item, pos, result``."""
    counted = votes.groupBy("item", "result").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    best = Window.partitionBy("item").orderBy(F.col("n").desc(), "first")
    return counted.withColumn("r", F.row_number().over(best)).filter("r = 1").select("item", "result")


def soft_similarity(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Multiset Jaccard of two long tables of ``by..., name, value``: sum of least over sum of greatest counts."""
    keys = [*by, "name", "value"]
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("a"))
    b = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("b"))
    both = a.join(b, keys, "full").fillna(0, ["a", "b"])
    return both.groupBy(*by).agg((F.sum(F.least("a", "b")) / F.sum(F.greatest("a", "b"))).alias("similarity"))


def nearest_pair(pairs: DataFrame, farthest: bool = False) -> DataFrame:
    """The correct and wrong answer at the least (or greatest) edit distance per item; first wins ties.

    ``pairs`` holds ``item`` and the arrays ``correct`` and ``wrong``: the samples of one item, as many as were
    drawn.  Each row folds over its own two arrays and keeps the best pair so far; no pair becomes a row.  Items without either are left out.
    """
    sign = -1 if farthest else 1

    def best(start, c, i):
        one = lambda acc, w, j: F.least(acc, F.struct((F.levenshtein(c, w) * sign).alias("d"), i.alias("i"), j.alias("j")))
        numbered = F.transform("wrong", lambda w, j: F.struct(w.alias("w"), j.alias("j")))
        return F.aggregate(numbered, start, lambda acc, x: one(acc, x["w"], x["j"]))

    none = F.lit(None).cast("struct<d:int,i:int,j:int>")
    numbered = F.transform("correct", lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    found = F.aggregate(numbered, none, lambda acc, x: best(acc, x["c"], x["i"]))
    return pairs.withColumn("b", found).filter("b IS NOT NULL").select("item", F.get("correct", F.col("b.i")).alias("chosen"), F.get("wrong", F.col("b.j")).alias("rejected"))


def valid_executions(results: DataFrame) -> DataFrame:
    """Executed statements (``error``, ``n_rows``) that succeeded and gave rows."""
    return results.filter("error IS NULL AND n_rows > 0")


def accuracy(results: DataFrame, *by: str) -> DataFrame:
    """Per group of ``by``, or over all: ``n``, the share ``correct`` and the share ``executed`` (no error) of ``correct, error`` rows."""
    share = lambda c: F.avg(c.cast("int"))
    return results.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), share(F.coalesce("correct", F.lit(False))).alias("accuracy"), share(F.col("error").isNull()).alias("executed"))


def pass_at(samples: DataFrame, k: int) -> DataFrame:
    """``pass_at_k``: the share of items of which one of the first ``k`` samples (``item, pos, correct``) is correct."""
    hit = samples.filter(F.col("pos") < k).groupBy("item").agg(F.bool_or("correct").alias("hit"))
    whole = samples.select("item").distinct().join(hit, "item", "left")
    return whole.agg(F.avg(F.coalesce("hit", F.lit(False)).cast("int")).alias("pass_at_k"))


def right_and_wrong(samples: DataFrame) -> DataFrame:
    """``item, right_n, wrong_n`` of the items (``item, correct``) that have both."""
    counted = samples.groupBy("item").agg(F.count_if("correct").alias("right_n"), F.count_if(~F.col("correct")).alias("wrong_n"))
    return counted.filter("right_n > 0 AND wrong_n > 0")


def first_correct(samples: DataFrame) -> DataFrame:
    """``item, answer``: the earliest correct sample of each item (``item, pos, answer, correct``)."""
    return samples.filter("correct").groupBy("item").agg(F.min_by("answer", "pos").alias("answer"))


def checkpoint_sweep(results: DataFrame) -> DataFrame:
    """``checkpoint, n, accuracy, executed, best``: accuracy of each checkpoint, the earliest of the best marked."""
    scored = accuracy(results, "checkpoint")
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("accuracy").desc(), "checkpoint")  # one row a checkpoint
    return scored.withColumn("best", F.row_number().over(order) == 1)
