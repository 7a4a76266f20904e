"""Written intermediate tables in the folder that the cluster shares.

A long plan is cut by writing a table and reading it back, so that a lost executor costs only the
tasks it ran.  The folder is the session's ``spark.checkpoint.dir``, qualified by Hadoop's default file
system where it names none; where it is unset (tests on one machine) a temporary folder is made.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}


def _setting(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None)


def shared_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; local sessions without one get a temporary folder for the application."""
    folder = _setting(spark)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        folder = _own[app]
    return qualified(spark, folder).rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system, so that Spark, the driver and Python in tasks mean the same place by it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed at the end of the session where possible."""
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the table read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table to read twice: itself if it is a plain scan of files or was written here, else :func:`materialise` of it."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.getClass().getSimpleName() == "Project":
        names = plan.projectList()
        if any(names.apply(i).getClass().getSimpleName() != "AttributeReference" for i in range(names.size())):
            break
        plan = plan.child()
    return df if plan.getClass().getSimpleName() == "LogicalRelation" else materialise(df, name)


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`materialise` returned; nothing may read it any more."""
    path = df._scratch
    remove(df.sparkSession, path)
    _written[:] = [w for w in _written if w[1] != path]


def put(spark: SparkSession, local: str, path: str) -> None:
    """Copy a file of the driver to a path on any file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyFromLocalFile(jvm.org.apache.hadoop.fs.Path(f"file://{local}"), target)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path on whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the JVM may have gone first; the folder is then left to the cluster's own cleaning
            return
