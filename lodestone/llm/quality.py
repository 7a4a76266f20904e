"""A quality classifier by positive-unlabelled learning.

The model minimises the non-negative unbiased risk: the prior times the loss of trusted positives as
positive, plus the loss of unlabelled text as negative less the positives' part of it, which is kept from falling
below zero.  The class prior is the share of positives in all labelled training rows where both classes are
labelled, else estimated from how well positives can be told from unlabelled text (the two samples weighing the same).

A document is described by scale-free measures of its whole text, each split at the sample's quantiles,
so the additive model can follow any single-measure shape.  Fitting uses a sample of about
``sample_docs`` documents as unlabelled text, and all trusted positives, or about as many of them if there are
more; the prior counts every labelled training row.  Every document is scored.  Null text counts as empty;
empty texts get a score like any other.  Repeated labels of a document count as the least of them.
Repeated documents each get their own score; a score of exactly 0.5 counts as label 1.  Without any positive every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS = 30_000
CUTS = 12
STEPS, RATE, DECAY = 600, 0.05, 1e-4
_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()\-]")
_MARK = re.compile(r"[!?]")


def features(text: str | None, packer=None) -> list[float]:
    """Scale-free measures of a whole text."""
    t = text or ""
    words = t.split()
    n = len(words)
    if not n:
        return [0.0] * 15
    chars = len(t)
    lines = [x for x in t.split("\n") if x.strip()]
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    fours = len(set(zip(words, words[1:], words[2:], words[3:], strict=False)))
    letters = sum(map(len, re.findall(r"[^\W\d_]+", t)))
    upper = chars - len(re.sub(r"[A-ZÀ-ÖØ-Þ]", "", t))
    data = t.encode("utf-8", "replace")
    packed = len((packer or zstandard.ZstdCompressor(level=1)).compress(data))
    adjacent = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        float(np.log1p(n)),
        (chars - t.count(" ")) / n,
        len(_SYMBOL.findall(t)) / n,
        len(_MARK.findall(t)) / n,
        upper / max(1, letters),
        letters / chars,
        sum(map(str.isdigit, t)) / chars if any(c in t for c in "0123456789") else 0.0,
        1 - len(set(lines)) / max(1, len(lines)),
        n / max(1, len(lines)),
        len(seen) / n,
        max(seen.values()) / n,
        1 - pairs / max(1, n - 1),
        1 - fours / max(1, n - 3),
        packed / len(data),
        adjacent / n,
    ]


class Binned:
    """A matrix of indicators "measure i exceeds cut k", held as the bin of each measure, as the indicators of a measure come in order."""

    def __init__(self, x: np.ndarray, cuts: list[np.ndarray]):
        self.widths = [len(c) for c in cuts]
        self.first = np.cumsum([0, *[w + 1 for w in self.widths]])
        self.shape = (len(x), sum(self.widths))
        self.bins = np.stack([np.searchsorted(c, x[:, i], side="left") + self.first[i] for i, c in enumerate(cuts)], axis=1)

    def __len__(self) -> int:
        return self.shape[0]

    def times(self, w: np.ndarray) -> np.ndarray:
        """The matrix by a vector of weights."""
        levels = np.concatenate([np.append(0.0, np.cumsum(part)) for part in np.split(w, np.cumsum(self.widths)[:-1])])
        return levels[self.bins].sum(axis=1)

    def turned(self, e: np.ndarray) -> np.ndarray:
        """The transposed matrix by a vector over the rows."""
        held = np.bincount(self.bins.ravel(), weights=np.repeat(e, self.bins.shape[1]), minlength=self.first[-1])
        return np.concatenate([np.cumsum(held[a:z][::-1])[::-1][1:] for a, z in zip(self.first, self.first[1:], strict=False)])


@dataclass
class Model:
    """Quantile cuts per measure, weights of the resulting indicators, and a bias."""

    cuts: list[np.ndarray]
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(Binned(x, self.cuts).times(self.weights) + self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(gradient, width: int) -> tuple[np.ndarray, float]:
    """Adam over weights and bias."""
    w = np.zeros(width + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        g = gradient(w[:-1], w[-1])
        g[:-1] += DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def density_prior(p: Binned, u: Binned) -> float:
    """The prior from the mean probability of being a trusted positive, over the trusted positives themselves."""

    def gradient(w, b):
        ep, eu = _sigmoid(p.times(w) + b) - 1, _sigmoid(u.times(w) + b)
        return np.append(p.turned(ep) / len(p) + u.turned(eu) / len(u), ep.mean() + eu.mean())

    w, b = _descend(gradient, p.shape[1])
    g = _sigmoid(p.times(w) + b).mean()
    return float(np.clip((1 - g) / g, 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None) -> Model:
    """Minimise the non-negative risk; a ``prior`` of None is estimated from the two samples."""
    levels = np.linspace(0, 1, CUTS + 2)[1:-1]
    tails = [0.005, 0.02, 0.98, 0.995]
    cuts = [np.unique(np.quantile(unlabelled[:, i], [*levels, *tails])) for i in range(unlabelled.shape[1])]
    p, u = Binned(positive, cuts), Binned(unlabelled, cuts)
    prior = density_prior(p, u) if prior is None else prior

    def gradient(w, b):
        zp, zu = np.clip(p.times(w) + b, -30, 30), np.clip(u.times(w) + b, -30, 30)
        sp, su = _sigmoid(zp), _sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gn = np.append(u.turned(su) / len(u) - prior * p.turned(sp) / len(p), su.mean() - prior * sp.mean())
        gp = prior * np.append(p.turned(sp - 1) / len(p), (sp - 1).mean())
        return gp + gn if negative >= 0 else -gn

    w, b = _descend(gradient, p.shape[1])
    return Model(cuts, w, b, prior)


def _measured(batches):
    packer = zstandard.ZstdCompressor(level=1)
    for b in batches:
        yield pd.DataFrame({"drawn": b["drawn"], "positive": b["positive"], "x": [features(t, packer) for t in b["text"]]})


def train(docs: DataFrame, labels: DataFrame, allowed: Column, seed: int = 42, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """Fit on the rows that ``allowed`` (over ``doc_id``) admits; None without a positive."""
    rows = docs.select("doc_id", "text").filter(allowed)
    below = lambda n, *columns: F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 30)) < int(min(1.0, sample_docs / max(1, n)) * (1 << 30))
    marks = labels.filter("quality IS NOT NULL").select("doc_id", "quality").filter(allowed).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r.quality: r.n for r in rows.select("doc_id").join(marks, "doc_id", "left").groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    positives, seen = counts.get(1, 0), sum(n for q, n in counts.items() if q is not None and q >= 0)
    if not positives:
        return None
    trusted = marks.filter("quality = 1").join(rows.select("doc_id").distinct(), "doc_id", "left_semi").filter(below(positives, "doc_id")).select("doc_id", F.lit(True).alias("positive"))
    both = rows.join(F.broadcast(trusted), "doc_id", "left").withColumn("positive", F.coalesce("positive", F.lit(False))).withColumn("drawn", below(sum(counts.values()), "doc_id", "text"))
    sample = both.filter("drawn OR positive").select("drawn", "positive", "text").mapInPandas(_measured, "drawn boolean, positive boolean, x array<double>").collect()
    x = np.array([r.x for r in sample]).reshape(-1, 15)
    drawn, positive = (np.array([r[i] for r in sample], dtype=bool) for i in (0, 1))
    prior = float((positives + 1) / (seen + 2)) if counts.get(0) else None
    return fit(x[positive], x[drawn], prior)


def score(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``score`` and ``predicted`` for every row."""
    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], "text")

    def run(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for b in batches:
            s = np.zeros(len(b)) if model is None or not len(b) else model.score(np.array([features(t, packer) for t in b["text"]]))
            yield b[list(keep)].assign(score=s.astype(float), predicted=(s >= 0.5).astype("int32"))

    fields = ", ".join(f"`{n}` {t}" for n, t in chosen.dtypes[:-1])
    return chosen.mapInPandas(run, f"{fields}, score double, predicted int")
