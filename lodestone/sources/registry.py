"""Sources by name, resolved from plain configuration.

A source class registers itself when it is defined.  ``Source.load`` runs load, sampling, the non-empty
check and ``process``, with the hooks that were given before and after each step, and can keep its
result in a content-addressed cache.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import warnings
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from lodestone.operators.position import sample_exact, with_position
from lodestone.plans.hooks import Hooked, registered

SOURCES: dict[str, type[Source]] = {}
#: Datasets whose splits have names of their own.
KNOWN: dict[str, dict] = {
    "HuggingFaceH4/ultrachat_200k": {"split_mapping": {"train": "train_sft", "eval": "test_sft"}},
    "HuggingFaceH4/ultrafeedback_binarized": {"split_mapping": {"train": "train_prefs", "eval": "test_prefs"}},
    "nvidia/AceMath-Instruct-Training-Data": {"split_mapping": {"train": "general_sft_stage2"}},
}
_DATASET = re.compile(r"\w+://dataset/([A-Za-z_][\w.$]*)/versions/([\w.\-]+)")


@dataclass
class Config:
    """What a source is told."""

    type: str
    name: str | None = None
    split: str = "train"
    sample_ratio: float | None = None
    sample_count: int | None = None
    sample_seed: int = 42
    process: bool = True
    options: dict = field(default_factory=dict)
    split_mapping: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.sample_ratio is not None and self.sample_count is not None:
            raise ValueError("sample_ratio and sample_count exclude each other")
        if self.name and ":" in self.name and "://" not in self.name and not self.name.startswith(("/", "file:")):
            self.name, self.split = self.name.split(":", 1)
        known = KNOWN.get(self.options.get("dataset") or self.name, {})
        self.split_mapping = self.split_mapping or dict(known.get("split_mapping", {}))
        self.options = {**known.get("options", {}), **self.options}

    def base_split(self) -> str:
        """The split to read, under its dataset's own name and without its slice."""
        return parse_split(self.split, self.split_mapping)[0]

    def key(self, **more) -> str:
        """A cache key: the MD5 of the canonical JSON of the configuration and whatever else shapes the rows."""
        return hashlib.md5(json.dumps({**asdict(self), **more}, sort_keys=True, default=str).encode()).hexdigest()


def parse_split(split: str, mapping: dict[str, str] | None = None) -> tuple[str, str | None]:
    """A split's base name, mapped unless it is a target already, and its slice such as ``10:20`` or ``10%:20%``."""
    m = re.fullmatch(r"([^\[\]]+)(?:\[([^\]]*)\])?", split)
    if not m:
        raise ValueError(f"bad split {split!r}")
    base = m[1]
    mapping = mapping or {}
    return (base if base in mapping.values() else mapping.get(base, base)), m[2]


def slice_bounds(text: str, rows: int) -> tuple[int, int]:
    """Row bounds of a slice."""
    parts = [p.strip() for p in text.split(":")]
    if len(parts) != 2:
        raise ValueError(f"bad slice {text!r}")

    def bound(p: str, default: int) -> int:
        if not p:
            return default
        n = round(float(p[:-1]) / 100 * rows) if p.endswith("%") else int(p)
        return min(rows, n if n >= 0 else max(0, rows + n))

    return bound(parts[0], 0), bound(parts[1], rows)


class Source(Hooked):
    """Base of all sources; subclasses set ``name`` and define ``read`` and, where rows change, ``process``.

    Callbacks may stand before and after ``load`` (arguments: the session) and ``process`` (the rows).
    """

    name: str | None = None
    order: tuple[str, ...] = ()

    def __init_subclass__(cls, **kwargs):
        super().__init_subclass__(**kwargs)
        if cls.name:
            registered(SOURCES, cls, "source", {"read": ("spark",), "process": ("df",)})

    def __init__(self, config: Config, hooks: dict[str, list[Callable[[DataFrame], DataFrame]]] | None = None):
        self.config, self.hooks = config, hooks or {}

    def read(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError

    def process(self, df: DataFrame) -> DataFrame:
        return df

    def _hooked(self, when: str, df: DataFrame) -> DataFrame:
        for hook in self.hooks.get(when, []):
            df = df.transform(hook)
        return df

    def load(self, spark: SparkSession, cache: str | None = None, fail_on_missing_cache: bool = False) -> DataFrame:
        """The source's rows; with ``cache``, from or into a folder named by the configuration's key.

        Slices and samples go by ``order`` (else the first column) and then by a hash of the whole row, so reruns
        agree; only rows that are equal are interchangeable.
        """
        path = f"{cache}/{self.config.key()}" if cache else None
        if path:
            if exists(spark, path):
                return spark.read.parquet(path)
            if fail_on_missing_cache:
                raise FileNotFoundError(path)
        df = self._hooked("post-load", self.step("load", self.read, spark))
        _, cut = parse_split(self.config.split)
        sampled = self.config.sample_ratio is not None or self.config.sample_count is not None
        names = df.columns
        if cut or sampled:
            df = df.withColumn("__row", F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"})))
        if cut:
            a, z = slice_bounds(cut, df.count())
            df = with_position(df, *(self.order or names[:1]), "__row").filter(F.col("pos").between(a, z - 1)).drop("pos")
        if sampled:
            df = sample_exact(df, "__row", self.config.sample_ratio, self.config.sample_count, self.config.sample_seed).drop("pos")
        df = df.select(*[F.col(f"`{c}`") for c in names])
        if df.isEmpty():
            raise ValueError(f"source {self.config.type} gave no rows")
        if self.config.process:
            df = self._hooked("post-process", self.step("process", self.process, self._hooked("pre-process", df)))
            if df.isEmpty():
                raise ValueError(f"source {self.config.type} has no rows left after processing")
        return write_whole(df, path) if path else df


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system holds it."""
    files, at = _file_system(spark, path)
    return files.exists(at)


def write_whole(df: DataFrame, path: str) -> DataFrame:
    """Write a table aside and rename it, so that ``path`` is either whole or absent; who comes second keeps the first's."""
    spark = df.sparkSession
    aside = f"{path}.incomplete-{uuid.uuid4().hex}"
    df.write.parquet(aside)
    files, at = _file_system(spark, path)
    _, written = _file_system(spark, aside)
    if files.exists(at) or not files.rename(written, at):
        files.delete(written, True)
    return spark.read.parquet(path)


def combined_key(configs: list, **more) -> str:
    """The cache key of several sources in their order."""
    keys = [resolve(c).config.key() for c in configs]
    return hashlib.md5(json.dumps({"sources": keys, **more}, sort_keys=True, default=str).encode()).hexdigest()


class FileSource(Source):
    """Parquet, JSON, CSV, ORC or text files; where a folder has a child named after the split, only that is read."""

    name = "files"
    #: Options that are not the reader's.
    own: tuple[str, ...] = ("format", "dataset")

    def read(self, spark):
        options = {k: v for k, v in self.config.options.items() if k not in self.own}
        path, split = self.config.name, self.config.base_split()
        if not re.search(r"[*?{\[]", path) and exists(spark, f"{path}/{split}"):
            path = f"{path}/{split}"
        return spark.read.format(self.config.options.get("format", "parquet")).options(**options).load(path)


class TextSource(FileSource):
    """One text column: ``column``, else ``text``, else the only column."""

    name = "text"
    own = (*FileSource.own, "column")

    def process(self, df):
        column = self.config.options.get("column") or ("text" if "text" in df.columns else df.columns[0] if len(df.columns) == 1 else None)
        if column is None or column not in df.columns:
            raise ValueError(f"no text column among {df.columns}")
        return df.select(F.col(f"`{column}`").alias("text"))


class UserTextSource(TextSource):
    """Each text as a chat of one user message."""

    name = "user_text"

    def process(self, df):
        message = F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))
        return super().process(df).select(F.array(message).alias("messages"))


class TokenSource(FileSource):
    """Generated sequences from JSON lines at any depth below a folder: ``output`` becomes ``input_ids`` and ``labels``."""

    name = "generated_tokens"

    def read(self, spark):
        return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").schema("output array<int>").json(self.config.name)

    def process(self, df):
        return df.filter("output IS NOT NULL").select(F.col("output").alias("input_ids"), F.col("output").alias("labels"))


class PreferenceSource(FileSource):
    """Preference pairs of message lists ``chosen`` and ``rejected``: the common beginning becomes ``prompt``, what follows the answers."""

    name = "preference"

    def process(self, df):
        from lodestone.functions.messages import common_prefix

        n = common_prefix(F.col("chosen"), F.col("rejected"), compat=True)
        rest = lambda c: F.slice(c, F.col("__n") + 1, F.greatest(F.size(c) - F.col("__n"), F.lit(0)))
        cut = df.withColumn("__n", n)
        return cut.select(F.slice("chosen", F.lit(1), F.col("__n")).alias("prompt"), rest("chosen").alias("chosen"), rest("rejected").alias("rejected"))


class SavedSource(Source):
    """A dataset folder of Arrow stream files, one child folder a split or files at the top, read a file a task."""

    name = "saved"

    def read(self, spark):
        path, split = self.config.name, self.config.base_split()
        folder = f"{path}/{split}" if exists(spark, f"{path}/{split}") else path
        files, at = _file_system(spark, folder)
        listed = sorted(f.getPath().toString() for f in files.listStatus(at) if f.getPath().getName().endswith(".arrow"))
        if not listed:
            raise FileNotFoundError(f"no Arrow files in {folder}")
        with _arrow_stream(listed[0]) as first:
            schema = from_arrow_schema(first.schema)

        def read(batches):
            for b in batches:
                for name in b["path"].to_pylist():
                    with _arrow_stream(name) as stream:
                        yield from stream

        paths = spark.createDataFrame([(p,) for p in listed], "path string").repartition(len(listed), "path")
        return paths.mapInArrow(read, schema)


@contextmanager
def _arrow_stream(path: str):
    """An Arrow stream on a file system that pyarrow knows."""
    system, at = (pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else pafs.FileSystem.from_uri(path)
    with system.open_input_file(at) as f:
        yield pa.ipc.open_stream(f)


class SqlSource(Source):
    """Exactly one of ``sql``, ``table_name`` and ``dataset_uri``; renames by ``column_mapping``, cut by ``limit``."""

    name = "sql"

    def read(self, spark):
        o = self.config.options
        given = [k for k in ("sql", "table_name", "dataset_uri") if o.get(k)]
        if len(given) != 1:
            raise ValueError("give exactly one of sql, table_name and dataset_uri")
        if given[0] == "sql":
            df = spark.sql(o["sql"])
        elif given[0] == "table_name":
            df = spark.table(o["table_name"])
        else:
            m = _DATASET.fullmatch(o["dataset_uri"])
            if not m:
                raise ValueError(f"bad dataset address {o['dataset_uri']!r}")
            df = spark.read.parquet(f"{o['root']}/dataset={m[1]}/version={m[2]}")
        df = df.withColumnsRenamed(o.get("column_mapping", {}))
        return df.limit(o["limit"]) if o.get("limit") is not None else df


class FolderSource(Source):
    """All child folders of a folder one after the other, columns by name; ``skip_unreadable`` leaves out what cannot be read."""

    name = "folders"

    def read(self, spark):
        options = dict(self.config.options)
        form, skip = options.pop("format", "parquet"), options.pop("skip_unreadable", True)
        top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.config.name)
        found = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(top)
        frames = []
        for path in sorted(f.getPath().toString() for f in found if f.isDirectory()):
            try:
                frames.append(spark.read.format(form).options(**options).load(path))
            except AnalysisException as e:
                if not skip:
                    raise
                warnings.warn(f"left out {path}: {e.getCondition()}", stacklevel=2)
        if not frames:
            raise ValueError(f"nothing to read below {self.config.name}")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


class InstructSource(FileSource):
    """Chat messages by role from files: ``role_fields`` (role to path), or those known for ``dataset``.

    Rows without any message are left out; if none has one, the error names the fields that were there.
    """

    name = "instruct"
    own = (*FileSource.own, "role_fields")

    def process(self, df):
        from lodestone.sources.corpora import ROLE_FIELDS, instruct_messages

        o = self.config.options
        roles = o.get("role_fields") or ROLE_FIELDS.get(o.get("dataset"))
        if not roles:
            raise ValueError("give role_fields or the name of a known dataset")
        found = instruct_messages(df, roles).select("messages").filter(F.size("messages") > 0)
        if found.isEmpty():
            raise ValueError(f"no messages under {roles}; the rows have\n{key_structure(df.schema)}")
        return found


def key_structure(kind: T.DataType, depth: int = 3, indent: str = "") -> str:
    """The names of a schema's fields, ``depth`` levels deep."""
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    if not isinstance(kind, T.StructType) or not depth:
        return ""
    lines = [f"{indent}{f.name}: {f.dataType.simpleString() if depth == 1 else f.dataType.typeName()}\n{key_structure(f.dataType, depth - 1, indent + '  ')}" for f in kind]
    return "".join(lines)


def resolve(config: str | dict | Config) -> Source:
    """A source from a file path, a dictionary or a configuration."""
    if isinstance(config, str):
        config = {"type": "files", "name": config}
    if isinstance(config, dict):
        config = Config(**config)
    if config.type not in SOURCES:
        raise KeyError(f"no source {config.type!r}; there are {sorted(SOURCES)}")
    return SOURCES[config.type](config)
