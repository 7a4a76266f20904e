"""Tokenizers as arguments: the built-in one, and any tokenizer file that the ``tokenizers`` library reads.

A tokenizer gives token ids with the place of each token in the text.  It is sent to the workers as plain data,
so no file needs to be there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.messages import THINK
from lodestone.functions.text import VOCABULARY, token_ids

IGNORE = -100


class Tokenizer:
    """Ids of a text's tokens, where each starts and ends, and the size of the vocabulary."""

    vocabulary: int

    def encode(self, text: str) -> tuple[list[int], list[int], list[int]]:
        raise NotImplementedError


@dataclass
class HashTokenizer(Tokenizer):
    """Runs of letters and digits, and single marks, each named by the head of its MD5: the same ids as :func:`token_ids`."""

    vocabulary: int = VOCABULARY

    def encode(self, text):
        import regex

        if not hasattr(self, "_known"):
            self._known: dict[str, int] = {}
            self._token = regex.compile(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\x0b\f\r]")
        found = list(self._token.finditer(text))
        return [self._id(m[0]) for m in found], [m.start() for m in found], [m.end() for m in found]

    def _id(self, token: str) -> int:
        if len(self._known) > 500_000:
            self._known.clear()
        if token not in self._known:
            self._known[token] = int(hashlib.md5(token.encode()).hexdigest()[:6], 16) % self.vocabulary
        return self._known[token]

    def __getstate__(self):
        return {"vocabulary": self.vocabulary}


class FileTokenizer(Tokenizer):
    """A tokenizer from the JSON of a tokenizer file."""

    def __init__(self, data: str):
        self.data = data
        self._load()

    def _load(self):
        import tokenizers

        self._own = tokenizers.Tokenizer.from_str(self.data)
        self._own.no_truncation()
        self._own.no_padding()
        self.vocabulary = self._own.get_vocab_size()

    def encode(self, text):
        e = self._own.encode(text, add_special_tokens=False)
        return e.ids, [a for a, _ in e.offsets], [z for _, z in e.offsets]

    def __getstate__(self):
        return self.data

    def __setstate__(self, data):
        self.data = data
        self._load()


def from_file(spark: SparkSession, path: str) -> FileTokenizer:
    """A tokenizer file, on any file system that Spark reads."""
    return FileTokenizer(spark.read.text(path, wholetext=True).first()[0])


def encoded(text: Column, tokenizer: Tokenizer | None = None, limit: int | None = None) -> Column:
    """Token ids, cut to ``limit``; null for null.  The built-in tokenizer stays in the JVM."""
    if tokenizer is None or type(tokenizer) is HashTokenizer:
        ids = F.when(text.isNotNull(), token_ids(text, tokenizer.vocabulary if tokenizer else VOCABULARY))
        return F.slice(ids, 1, limit) if limit else ids

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else tokenizer.encode(t)[0][:limit])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<int>")(text)


def label_spans(ids: list[int], starts: list[int], ends: list[int], ranges: list[tuple[int, int]]) -> list[int]:
    """Labels: tokens that lie within a range, and the one token after each such run; the others are ignored."""
    inside = np.zeros(len(ids) + 1, dtype=bool)
    first, last = np.array(starts, dtype=np.int64), np.array(ends, dtype=np.int64)
    for a, z in ranges:
        inside[1:] |= (first >= a) & (last <= z)
    return np.where(inside[1:] | inside[:-1], np.array(ids, dtype=np.int64), IGNORE).tolist()


def masked_chat(rendered: Column, answers: Column, tokenizer: Tokenizer, mask_inputs: bool = True, ignore_empty_think: bool = False) -> Column:
    """``struct<input_ids, labels>`` of a rendered chat: an answer counts from where its content first occurs in the text.

    With ``ignore_empty_think`` an answer's empty reasoning block is looked past.  Without ``mask_inputs`` labels are the ids.
    """

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, lists in batches:
            out: list[tuple[list[int], list[int]]] = []
            for text, contents in zip(texts, lists, strict=True):
                ids, starts, ends = tokenizer.encode(text)
                if mask_inputs:
                    wanted = [THINK.sub("", c) if ignore_empty_think else c for c in contents]
                    places = [text.find(c) for c in wanted]
                    out.append((ids, label_spans(ids, starts, ends, [(p, p + len(c)) for p, c in zip(places, wanted, strict=True)])))
                else:
                    out.append((ids, ids))
            yield pd.DataFrame(out, columns=["input_ids", "labels"])

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "input_ids array<int>, labels array<int>")(rendered, answers)
