"""Texts to vectors by a pluggable embedder, in batches of texts of like length."""

from __future__ import annotations

import hashlib
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts that a task orders by length at once, and the padded characters of a batch.
HELD, BATCH_CHARS = 4096, 1 << 18


class Embedder(Protocol):
    """What a model must offer; it is sent to each worker once, and loads there when first used."""

    dimension: int

    def encode(self, texts: list[str]) -> np.ndarray:
        """One row of ``dimension`` numbers a text."""


class HashedEmbedder:
    """A deterministic embedder without a model: signed counts of words, by the head of a word's MD5, normalised; zeros without words."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts, strict=True):
            for word in text.split(" "):
                if word:
                    place = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % (2 * self.dimension)
                    row[place // 2] += 1 - 2 * (place % 2)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1.0)


def length_batches(lengths: np.ndarray, chars: int) -> list[np.ndarray]:
    """Row numbers in batches, longest first, each no more than ``chars`` when padded to its longest; a longer text is alone."""
    order = np.argsort(-lengths, kind="stable")
    out, at = [], 0
    while at < len(order):
        n = max(1, int(chars // max(1, lengths[order[at]])))
        out.append(order[at : at + n])
        at += n
    return out


def embed(rows: DataFrame, embedder: Embedder, text: str = "text", out: str = "vector", held: int = HELD, chars: int = BATCH_CHARS) -> DataFrame:
    """``rows`` with a vector of each text in column ``out``; null for null.  Rows keep their order and all columns.

    A task takes up to ``held`` rows, embeds them from the longest to the shortest in batches of bounded padded size, and puts the vectors
    back in the rows' order.
    """
    names = rows.columns
    hidden = [f"c{i}" for i in range(len(names))]
    bare = rows.toDF(*hidden)
    column = hidden[names.index(text)]
    schema = bare.withColumn("vector", F.lit(None).cast("array<double>")).schema

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, held):
                part = batch.slice(at, held)
                texts = part.column(column).to_pylist()
                some = np.flatnonzero([t is not None for t in texts])
                vectors = np.zeros((len(texts), embedder.dimension))
                for chosen in length_batches(np.array([len(texts[i]) for i in some]), chars):
                    vectors[some[chosen]] = embedder.encode([texts[i] for i in some[chosen]])
                offsets = pa.array(np.arange(len(texts) + 1) * embedder.dimension, pa.int32())
                made = pa.ListArray.from_arrays(offsets, pa.array(vectors.reshape(-1)), mask=pa.array([t is None for t in texts]))
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*hidden, "vector"])

    return bare.mapInArrow(run, schema).toDF(*names, out)
