import pytest
from pyspark.sql import functions as F

from lodestone.operators.metrics import Stages
from lodestone.plans import factory, hooks
from lodestone.sources import registry

SF = "/root/testdata/sf0.001"
DOCS = f"{SF}/documents.parquet"


@pytest.fixture
def clean(monkeypatch):
    monkeypatch.setattr(registry, "SOURCES", dict(registry.SOURCES))
    monkeypatch.setattr(factory, "FACTORIES", dict(factory.FACTORIES))


def test_callbacks_run_in_inherited_order():
    seen = []

    class Base(hooks.Hooked):
        callbacks = [("pre-load", lambda self, x: seen.append("base") or x + 1), ("post-load", "halved")]

        def halved(self, x):
            return x / 2

    class Child(Base):
        callbacks = [("pre-load", [lambda self, x: seen.append("child"), "doubled"]), ("post-load", lambda self, x: None)]

        def doubled(self, x):
            return (x * 2,)

        def halved(self, x):
            return x / 4

    assert Child().step("load", lambda x: x + 10, 1) == (2 * 2 + 10) / 4 and seen == ["base", "child"]
    assert Base().step("load", lambda x: x + 10, 1) == 6 and Base().step("split", lambda: 3) == 3
    with pytest.raises(ValueError, match="no event 'pre-sleep'"):
        type("Bad", (hooks.Hooked,), {"callbacks": [("pre-sleep", print)]})
    with pytest.raises(AttributeError, match="no method 'none'"):
        type("Bad", (hooks.Hooked,), {"callbacks": [("pre-load", "none")]})


def test_source_callbacks_and_signatures(spark, clean):
    class Few(registry.FileSource):
        name = "few"
        callbacks = [("post-load", lambda self, df: df.filter("doc_id < 5")), ("pre-process", "plain")]

        def plain(self, df):
            return df.select("doc_id")

        def process(self, df):
            return df.withColumn("twice", F.col("doc_id") * 2)

    assert sorted(map(tuple, registry.resolve({"type": "few", "name": DOCS}).load(spark).collect())) == [(i, 2 * i) for i in range(5)]
    with pytest.raises(ValueError, match="exists"):
        type("Again", (registry.FileSource,), {"name": "few"})
    with pytest.raises(TypeError, match="read takes"):
        type("Odd", (registry.FileSource,), {"name": "odd", "read": lambda self: None})
    assert "odd" not in registry.SOURCES


def test_factory_plugins(spark, clean):
    class Lengths(factory.Factory):
        name, source = "lengths", "text"
        callbacks = [("pre-load", lambda self, spark, sources: (spark, sources[:1])), ("post-split", lambda self, parts: {k: v.filter("pos < 3") for k, v in parts.items()})]

        def process(self, df):
            return df.select("pos", F.length("text").alias("n"), F.lit(self.options["mark"]).alias("mark"))

    parts = factory.build(spark, {"type": "lengths", "sources": [DOCS, "/not/there"], "options": {"mark": "x"}, "train_eval_split": (0.5, 0.5)})
    assert sorted(parts) == ["eval", "train"] and [sorted(r.pos for r in parts[p].collect()) for p in ("train", "eval")] == [[0, 1, 2]] * 2
    assert parts["train"].columns == ["pos", "n", "mark"]
    with pytest.raises(KeyError, match="causal, lengths, preference, sft"):
        factory.build(spark, {"type": "none", "sources": [DOCS]})
    with pytest.raises(TypeError, match="process takes"):
        type("Odd", (factory.Factory,), {"name": "odd", "process": lambda self, df, more: df})


def test_combined_cache(spark, tmp_path):
    config = {"type": "causal", "sources": [DOCS], "options": {"max_length": 64}, "cache": str(tmp_path), "train_eval_split": (0.75, 0.25)}
    with pytest.raises(FileNotFoundError):
        factory.build(spark, {**config, "fail_on_missing_cache": True})
    made = factory.build(spark, config)
    stages = Stages()
    again = factory.build(spark, {**config, "fail_on_missing_cache": True}, stages)
    assert not stages.seen and all(sorted(map(str, made[p].collect())) == sorted(map(str, again[p].collect())) for p in ("train", "eval"))
    assert len(list(tmp_path.iterdir())) == 1
    factory.build(spark, {**config, "seed": 7})
    assert len(list(tmp_path.iterdir())) == 2


def test_stages_note_rows_without_a_scan(spark):
    n = spark.read.parquet(DOCS).count()
    stages = Stages()
    factory.build(spark, {"type": "causal", "sources": [DOCS, DOCS], "options": {"max_length": 64}}, stages)
    report = stages.report()
    assert report["combined"] == {"rows": 2 * n} and report["tokenised"]["rows"] == 2 * n and report["tokenised"]["dropped"] == 0 and report["tokenised"]["tokens"] > n
    with pytest.raises(KeyError):
        stages.watch("combined", spark.range(1))
    with pytest.raises(ValueError, match="for 100000 ranks"):
        factory.build(spark, {"type": "causal", "sources": [DOCS], "options": {"max_length": 64}, "world_size": 100_000})
