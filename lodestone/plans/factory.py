"""From configuration to batches: sources, concatenation, shuffle, steps, split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import messages as M
from lodestone.functions import sequences as S
from lodestone.functions.messages import chat_text
from lodestone.functions.tokenizer import HashTokenizer, Tokenizer, encoded, from_file, masked_chat
from lodestone.operators import packing
from lodestone.operators.metrics import Stages
from lodestone.operators.position import chunk_of, fill_iterations, shuffled_position, split_exact, with_position
from lodestone.plans.hooks import Hooked, named, registered
from lodestone.plans.scratch import materialise
from lodestone.sources.registry import combined_key, exists, resolve, write_whole


def combine(spark: SparkSession, sources: list, seed: int = 42, stages: Stages | None = None) -> DataFrame:
    """All sources one after the other, then shuffled; ``pos`` is the new order.  ``stages`` notes their rows as ``combined``."""
    frames = [resolve(s).load(spark).withColumn("__source", F.lit(i)) for i, s in enumerate(sources)]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if stages is not None:
        whole = stages.watch("combined", whole)
    key = F.md5(F.to_json(F.struct(*[F.col(c) for c in whole.columns])))
    return shuffled_position(whole.withColumn("__k", key), "__k", seed).drop("__k", "__source")


def chunk_rows(rows: int, workers: int, most: int) -> int:
    """Rows that are packed together: a worker's share, but no more than ``most``."""
    return min(rows // workers + 1, most)


def guard_rows(df: DataFrame, world_size: int, what: str, rows: int | None = None) -> int:
    """The number of rows, counted if it is not known; an error if there are fewer than ranks, or none."""
    rows = df.count() if rows is None else rows
    if rows < max(1, world_size):
        raise ValueError(f"{what} has {rows} rows for {world_size} ranks")
    return rows


def causal(docs: DataFrame, limit: int, chunk: int = 1000, bos: int = 1, eos: int = 2, tokenizer: Tokenizer | None = None, stages: Stages | None = None) -> DataFrame:
    """Packs of exactly ``limit`` token ids from positioned texts: ``chunk, kind, pack, pos, input_ids, labels``."""
    ids = F.concat(F.array(F.lit(bos)), encoded(F.col("text"), tokenizer), F.array(F.lit(eos)))
    tokens = docs.filter("text IS NOT NULL").select("pos", ids.alias("ids")).withColumn("chunk", chunk_of(chunk)).withColumn("length", F.size("ids").cast("long"))
    rows = materialise(tokens if stages is None else stages.watch("tokenised", tokens, tokens="length"), "token-rows")
    pieces = packing.slice_and_pack(rows.select("chunk", "pos", "length"), limit).join(rows.select("chunk", "pos", "ids"), ["chunk", "pos"])
    cut = pieces.withColumn("part", F.slice("ids", (F.col("first") + 1).cast("int"), F.col("n").cast("int")))
    key = F.when(F.col("kind") == "full", F.col("pos"))
    packs = cut.groupBy("chunk", "kind", "pack", key.alias("pos")).agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("parts"))
    whole = packs.select("chunk", "kind", "pack", "pos", F.flatten(F.transform("parts", lambda p: p["part"])).alias("input_ids"))
    return whole.withColumn("labels", F.col("input_ids"))


def tokenised_chats(chats: DataFrame, tokenizer: Tokenizer | None = None, mask_inputs: bool = True, ignore_empty_think: bool = False) -> DataFrame:
    """``messages`` rendered and tokenised beside the other columns: ``input_ids, labels``; only answers have labels, unless ``mask_inputs`` is off."""
    others = [F.col(f"`{c}`") for c in chats.columns if c != "messages"]
    answers = F.transform(F.filter("messages", lambda m: m["role"] == "assistant"), lambda m: F.coalesce(m["content"], F.lit("")))
    ids = masked_chat(chat_text(F.col("messages")), answers, tokenizer or HashTokenizer(), mask_inputs, ignore_empty_think)
    return chats.select(*others, ids.alias("__t")).select(*others, "__t.input_ids", "__t.labels")


def sft(
    chats: DataFrame, max_length: int, tokenizer: Tokenizer | None = None, mask_inputs: bool = True, ignore_empty_think: bool = False,
    pack: bool = False, chunk: int = 1000, always_max_length: bool = False, drop_last: bool = False, fused_share: float = 0.0, repeat: bool = False,
    pad_to: int | None = None, pad_id: int = 0, seed: int = 42, stages: Stages | None = None,
) -> DataFrame:
    """Training rows from positioned chats (``pos, messages``): tokenised, masked, no longer than ``max_length``, packed and padded.

    Without ``pack``: ``pos, input_ids, labels, position_ids, lengths``, one row a chat.  With it: ``chunk, pack`` in place of ``pos``, chats
    shuffled, dealt to chunks of ``chunk`` rows and packed in order; ``repeat`` first repeats them to fill
    ``max_length``, ``fused_share`` of the packs get positions that run through.  ``pad_to`` pads every row to a
    multiple, or to ``max_length`` if it is 0; padded labels are ignored, padded places are no sample (``lengths`` are the samples').
    """
    tokens = tokenised_chats(chats.select("pos", "messages"), tokenizer, mask_inputs, ignore_empty_think).filter(F.size("input_ids").between(1, max_length))
    tokens = tokens.withColumn("length", F.size("input_ids").cast("long"))
    tokens = materialise(tokens if stages is None else stages.watch("tokenised", tokens, tokens="length"), "chat-tokens")
    if tokens.isEmpty():
        raise ValueError("no chat is short enough")
    if pack:
        rows = tokens.withColumnRenamed("pos", "__id")
        if repeat:
            numbered = packing.repeat_to_fill(rows.withColumn("pos", F.col("__id")), max_length)
            rows = numbered.withColumn("__id", F.struct("copy", "__id")).drop("copy", "pos")
        keyed = shuffled_position(rows.withColumn("__k", F.to_json(F.struct("__id"))), "__k", seed).withColumn("chunk", chunk_of(chunk))
        packed = packing.next_fit(keyed.select("chunk", "pos", "length", "input_ids", "labels"), max_length, always_max_length, drop_last)
        if packed.isEmpty():
            raise ValueError("no pack is left")
        grouped = packed.groupBy("chunk", "pack").agg(F.array_sort(F.collect_list(F.struct("pos", "length", "input_ids", "labels"))).alias("rows"))
        part = lambda name: F.flatten(F.transform("rows", lambda r: r[name]))
        lengths = F.transform("rows", lambda r: r["length"].cast("int"))
        out = grouped.select("chunk", "pack", part("input_ids").alias("input_ids"), part("labels").alias("labels"), lengths.alias("lengths"))
        key = F.concat_ws("|", F.col("chunk").cast("string"), F.col("pack").cast("string"))
        out = out.withColumn("position_ids", packing.fused_positions(packing.position_ids(F.col("lengths")), key, fused_share, seed))
    else:
        out = tokens.select("pos", "input_ids", "labels", F.array(F.col("length").cast("int")).alias("lengths"))
        out = out.withColumn("position_ids", packing.position_ids(F.col("lengths")))
    if pad_to is None:
        return out
    size = F.lit(max_length) if pad_to == 0 else (F.ceil(F.size("input_ids") / pad_to) * pad_to).cast("int")
    filled = out.withColumn("__size", F.greatest(size, F.size("input_ids")))
    for name, value in (("input_ids", pad_id), ("labels", S.IGNORE), ("position_ids", 0)):
        filled = filled.withColumn(name, M.pad(F.col(name), F.col("__size"), value))
    return filled.drop("__size")


def preference(pairs: DataFrame, max_length: int, max_prompt: int, bos: int = 1, eos: int = 2, keep_end: bool = False, tokenizer: Tokenizer | None = None) -> DataFrame:
    """Token sequences of preference pairs: ``chosen_input_ids, chosen_labels, rejected_input_ids, rejected_labels`` beside the pairs' columns.

    ``pairs`` holds the message lists ``prompt``, ``chosen`` and ``rejected``.  Each answer is tokenised with its
    prompt; a merged token at the border is in neither.  Prompts get BOS, answers EOS, and both are truncated
    together.  A pair whose two prompts disagree by more than the merged token is an error.
    """
    names = pairs.columns
    rows = pairs.withColumn("__p", encoded(chat_text(F.col("prompt")), tokenizer))
    for side in ("chosen", "rejected"):
        rows = rows.withColumn(f"__w_{side}", encoded(F.concat(chat_text(F.col("prompt")), chat_text(F.col(side))), tokenizer))
        whole, n = F.col(f"__w_{side}"), F.size("__p")
        rows = rows.withColumn(f"__p_{side}", F.slice(whole, F.lit(1), M.boundary(F.col("__p"), whole)))
        rows = rows.withColumn(f"__a_{side}", M.with_eos(F.slice(whole, n + 1, F.greatest(F.size(whole) - n, F.lit(0))), eos))
    rows = rows.withColumn("__p_chosen", S.aligned(F.col("__p_chosen"), F.col("__p_chosen"), F.col("__p_rejected")))
    for side, at in (("chosen", 1), ("rejected", 2)):
        cut = M.pair_truncation(M.with_bos(F.col(f"__p_{side}"), bos), F.col("__a_chosen"), F.col("__a_rejected"), max_length, max_prompt, keep_end)
        rows = rows.withColumn(f"{side}_input_ids", F.concat(cut[0], cut[at])).withColumn(f"{side}_labels", S.answer_labels(cut[0], cut[at]))
    return rows.select(*names, *[f"{side}_{kind}" for side in ("chosen", "rejected") for kind in ("input_ids", "labels")])


class Factory(Hooked):
    """What makes training data of a kind from positioned rows; subclasses set ``name`` and define ``process``.

    Callbacks may stand before and after ``load`` (arguments: the session and the sources' configurations; result: the combined rows),
    ``split`` (the rows; result: the parts by name) and ``process`` (a part's rows; result: training rows).  What a process needs beside
    the rows is in ``options``, ``rows`` (their number), ``seed``, ``tokenizer`` and ``stages`` of the object.
    """

    name: str | None = None
    source: str | None = None

    def __init_subclass__(cls, **kwargs):
        super().__init_subclass__(**kwargs)
        if cls.name:
            registered(FACTORIES, cls, "kind of training data", {"process": ("df",), "load": ("spark", "sources"), "split": ("df",)})

    def __init__(self, config: dict, tokenizer: Tokenizer | None = None, stages: Stages | None = None):
        self.config, self.tokenizer, self.stages = config, tokenizer, stages
        self.seed, self.rows = config.get("seed", 42), 0

    @property
    def options(self) -> dict:
        return dict(self.config.get("options", {}))

    def chunk(self, most: int) -> int:
        return chunk_rows(self.rows, self.config.get("workers", 8), most)

    def load(self, spark: SparkSession, sources: list) -> DataFrame:
        return combine(spark, sources, self.seed, self.stages)

    def split(self, df: DataFrame) -> dict[str, DataFrame]:
        shares = self.config.get("train_eval_split", (1.0, 0.0))
        if not shares[1]:
            return {"train": df}
        cut = split_exact(df.withColumnRenamed("pos", "__pos"), "__pos", shares[1], self.seed)
        parts = {name: cut.filter(F.col("split") == name).drop("split") for name in ("train", "eval")}
        if self.name:  # places within the part, which the packers need without gaps
            parts = {name: with_position(part.drop("pos"), "__pos").drop("__pos") for name, part in parts.items()}
        return parts

    def process(self, df: DataFrame) -> DataFrame:
        return df

    def made(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """A part's training rows: guarded, repeated to ``min_rows`` if set, processed between callbacks."""
        if self.name:
            self.rows = guard_rows(df, self.config.get("world_size", 1), f"{self.name} data", rows)
            if least := self.config.get("min_rows"):
                df, self.rows = fill_iterations(df, self.rows, least), max(self.rows, least)
        return self.step("process", self.process, df)


FACTORIES: dict[str | None, type[Factory]] = {None: Factory}


class Causal(Factory):
    name, source = "causal", "text"

    def process(self, df: DataFrame) -> DataFrame:
        options = self.options
        return causal(df, options.pop("max_length"), self.chunk(100), tokenizer=self.tokenizer, stages=self.stages, **options)


class SupervisedChats(Factory):
    name, source = "sft", "instruct"

    def process(self, df: DataFrame) -> DataFrame:
        options = self.options
        return sft(df, options.pop("max_length"), self.tokenizer, chunk=self.chunk(1000), seed=self.seed, stages=self.stages, **options)


class PreferencePairs(Factory):
    name, source = "preference", "preference"

    def process(self, df: DataFrame) -> DataFrame:
        return preference(df, tokenizer=self.tokenizer, **self.options)


def with_source(config: str | dict, factory: type[Factory]) -> str | dict:
    """A source's configuration with the kind's own source where it names none."""
    if isinstance(config, str):
        config = {"name": config}
    return {"type": factory.source or "files", **config} if isinstance(config, dict) else config


def build(spark: SparkSession, config: dict, stages: Stages | None = None) -> dict[str, DataFrame]:
    """``{"train": ..., "eval": ...}`` from ``sources``, ``eval_sources`` or ``train_eval_split``, and ``seed``.

    With a ``type`` (sft, causal, preference, or the name of a :class:`Factory` of the user's) the parts are made ready for training by
    ``options``; ``tokenizer`` names a tokenizer file.  With ``cache`` the parts come from or go into a folder named by the key of all
    that shapes them; ``fail_on_missing_cache`` makes an absent one an error.  ``stages`` notes the training rows' counts by stage, if the
    parts are not read from the cache.
    """
    shares = config.get("train_eval_split", (1.0, 0.0))
    if sum(shares) != 1.0:
        raise ValueError("the parts of train_eval_split must sum to 1")
    if config.get("eval_sources") and shares[1]:
        raise ValueError("eval_sources and train_eval_split exclude each other")
    kind = named(FACTORIES, config.get("type"), "kind of training data")
    listed = lambda name: [with_source(s, kind) for s in config.get(name) or []]
    names = ["train", "eval"] if config.get("eval_sources") or shares[1] else ["train"]
    folder = None
    if config.get("cache"):
        shape = {k: v for k, v in config.items() if k not in ("sources", "eval_sources", "cache", "fail_on_missing_cache")}
        folder = f"{config['cache']}/{combined_key(listed('sources'), eval=combined_key(listed('eval_sources')), **shape)}"
        if all(exists(spark, f"{folder}/{name}") for name in names):
            return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
        if config.get("fail_on_missing_cache"):
            raise FileNotFoundError(folder)
    tokenizer = from_file(spark, config["tokenizer"]) if config.get("tokenizer") else None
    stages = Stages() if stages is None else stages
    factory = kind(config, tokenizer, stages)
    whole = factory.step("load", factory.load, spark, listed("sources"))
    parts = factory.step("split", factory.split, whole)
    out = {}
    for name, part in parts.items():
        # the rows of an undivided part that no callback has changed were counted as they were combined
        known = "combined" in stages.seen and part is whole and not list(factory._callbacks("post-load"))
        out[name] = factory.made(part, stages.of("combined")["rows"] if known else None)
        factory.stages = None  # the other parts are not watched
    if config.get("eval_sources"):
        out["eval"] = factory.made(factory.step("load", factory.load, spark, listed("eval_sources")))
    return {name: write_whole(part, f"{folder}/{name}") for name, part in out.items()} if folder else out
