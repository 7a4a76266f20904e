"""Language identification by compression.

A raw-content zstandard dictionary is taken from text of each language; a text is encoded with every
dictionary, in pieces of 4 KB so that the dictionaries matter from its first byte to its last, and the
language of the smallest total is chosen.  Narrow margins are rejected (column ``rejected``; the best guess is
still named).

The dictionaries are fitted on a bounded sample: about ``DOCS_PER_LANGUAGE`` labelled documents of each
language, an excerpt of ``EXCERPT`` characters from a random place of each, ``DICTIONARY`` bytes in all; with very many
labels fewer of each, so that all dictionaries together keep to ``DICTIONARIES`` bytes.  Excerpts that the dictionaries of
the other half of the sample clearly give to another language are left out, as their labels are doubtful.
Prediction reads every text whole.  Null texts and texts without a letter are ``und`` with score 0; with
nothing to learn from, so is every text.  Of languages with equal totals the least name is chosen.  Repeated rows each get their own prediction.
"""

from __future__ import annotations

import re

import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans.scratch import materialise

DOCS_PER_LANGUAGE, EXCERPT, DICTIONARY = 400, 600, 1 << 16
DICTIONARIES = 32 << 20
PIECE, LEVEL = 4096, 3
NARROW = 0.01
UNDETERMINED = "und"
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-case letters with single spaces for all else, as UTF-8: marks and digits tell no language."""
    return _OTHER.sub(" ", text.lower()).encode("utf-8", "replace")


def learn(docs: DataFrame, allowed: Column, seed: int = 42) -> dict[str, bytes]:
    """A dictionary per language, from the labelled rows that ``allowed`` admits."""
    rows = docs.filter(allowed & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # written, so that its size decides how it is joined
    counts = materialise(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    languages = counts.count()
    if not languages:
        return {}
    bytes_each = min(DICTIONARY, DICTIONARIES // languages)
    wanted = max(1, DOCS_PER_LANGUAGE * bytes_each // DICTIONARY)
    rows = rows.join(counts.select("lang", F.least(F.lit(1.0), wanted / F.col("n")).alias("share")), "lang")
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    room = F.greatest(F.length("text") - EXCERPT, F.lit(0)) + 1
    place = F.pmod(F.xxhash64("text", F.lit(seed)), room.cast("long")).cast("int") + 1
    drawn = rows.select("lang", draw.alias("draw"), "share", F.substring(F.col("text"), place, F.lit(EXCERPT)).alias("part")).filter("draw < share")
    parts: dict[str, list[tuple[float, bytes]]] = {}
    for r in drawn.select("lang", "draw", "part").collect():
        parts.setdefault(r.lang, []).append((r.draw, letters(r.part)))
    excerpts = {lang: [p for _, p in sorted(found)] for lang, found in sorted(parts.items())}
    return _dictionaries(_consistent(excerpts, bytes_each), bytes_each)


def _dictionaries(parts: dict[str, list[bytes]], size: int) -> dict[str, bytes]:
    return {lang: b" ".join(found)[-size:] for lang, found in parts.items()}


def _consistent(parts: dict[str, list[bytes]], size: int) -> dict[str, list[bytes]]:
    """Excerpts without those that the other half's dictionaries clearly give to another language: their labels are doubtful."""
    halves = [{lang: found[k::2] for lang, found in parts.items()} for k in (0, 1)]
    out: dict[str, list[bytes]] = {lang: [] for lang in parts}
    for k in (0, 1):
        judge = Classifier({lang: d for lang, d in _dictionaries(halves[1 - k], size).items() if d})
        for lang, found in halves[k].items():
            for p in found:
                guess, _, narrow = judge.encode(p)
                if guess == lang or narrow or lang not in judge.names:
                    out[lang].append(p)
    return {lang: found or parts[lang] for lang, found in out.items()}


class Classifier:
    """Compressors for every language."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = list(dictionaries)
        self.compressors = []
        for data in dictionaries.values():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, and whether the margin is too narrow."""
        if not self.names or text is None or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, True
        return self.encode(letters(text))

    def encode(self, data: bytes) -> tuple[str, float, bool]:
        """The same for letters that are already prepared."""
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        sizes = sorted((sum(len(c.compress(p)) for p in pieces), n) for c, n in zip(self.compressors, self.names, strict=True))
        best, name = sizes[0]
        if len(sizes) == 1:
            return name, 1.0, False
        margin = (sizes[1][0] - best) / best
        return name, margin / (margin + 0.02), margin < NARROW


def identify(docs: DataFrame, dictionaries: dict[str, bytes], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``lang_pred``, ``score`` and ``rejected`` for every row."""
    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], "text")

    def run(batches):
        classify = Classifier(dictionaries).predict
        for b in batches:
            found = [classify(t) for t in b["text"]]
            yield b[list(keep)].assign(lang_pred=[f[0] for f in found], score=[f[1] for f in found], rejected=[f[2] for f in found])

    fields = ", ".join(f"`{n}` {t}" for n, t in chosen.dtypes[:-1])
    return chosen.mapInPandas(run, f"{fields}, lang_pred string, score double, rejected boolean")
