"""Quality rules as a bitmask ledger, in DataFrame functions only.

:func:`ledger` evaluates every rule once per document and stores the measurements and one long whose
bit *i* is set if rule *i* fails.  A policy is a versioned set of rules; :func:`apply_policy` keeps a
document whose failure bits do not meet the policy's mask, and :func:`ablation` counts, for every rule
of a policy, the documents that only that rule rejects, by aggregating the stored bits.

:func:`store_ledger` writes it, narrow, for policies and ablations to come; :func:`quality_filter` applies one policy in the pass that measures, as
a copy of the texts beside their bits would cost as much disk as the input.

Null text counts as no text: all measurements are 0.  Texts of any length are measured whole.  A measurement that equals a rule's bound
passes.  Repeated rows are each measured and kept or dropped alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text import WORD
from lodestone.plans.scratch import materialise

WINDOW = 5
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def _let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``; a plain reference would be evaluated again per array element."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more, from the array of window hashes."""

    def covered(pairs: Column) -> Column:
        def twin(p: Column, i: Column) -> Column:
            return (F.get(pairs, i - 1)["h"] == p["h"]) | (F.get(pairs, i + 1)["h"] == p["h"])

        starts = F.sort_array(F.transform(F.filter(pairs, lambda p, i: F.coalesce(twin(p, i), F.lit(False))), lambda p: p["i"]))
        steps = _let(starts, lambda s: F.transform(s, lambda v, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - v, F.lit(WINDOW)))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, v: a + v)

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(pairs, covered))

    return _let(hashes, count)


def _window_hashes(words: Column) -> Column:
    def windows(w: Column) -> Column:
        inner = F.slice(w, 1, F.greatest(F.size(w) - (WINDOW - 1), F.lit(0)))
        return F.transform(inner, lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, WINDOW)]))

    return _let(F.transform(words, lambda x: F.xxhash64(x)), windows)


def measure(text: Column) -> dict[str, Column]:
    """The measurements of a text by name, as columns; ``w`` must not be used outside :func:`ledger`."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    letters = F.translate(t, SPACES, "")
    return {
        "word_chars": F.length(letters).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "lines": F.struct(F.size(lines).alias("n"), F.size(F.array_distinct(lines)).alias("d")),
        "words": F.regexp_extract_all(t, F.lit(WORD), F.lit(0)),
        "n_upper": (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", ""))).cast("long"),
        "n_letters": (F.length(t) - F.length(F.regexp_replace(t, r"\p{L}+", ""))).cast("long"),
    }


@dataclass(frozen=True)
class Rule:
    """A named predicate over the measurements; it fails where ``fails`` is true."""

    name: str
    fails: str


#: Bit i belongs to rule i; new rules are only ever appended, so stored ledgers stay readable.
RULES = (
    Rule("too_few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbol_heavy", "10 * n_symbols > n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("duplicate_lines", "n_lines > 3 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule("shouting", "n_letters > 0 AND 100 * n_upper > 40 * n_letters"),
    Rule("few_letters", "100 * n_letters < 50 * word_chars"),
    Rule("short_lines", "n_lines > 5 AND n_words < 2 * n_lines"),
    Rule("very_long", "n_words > 1000000"),
)

#: Policies by version: the names of the rules that reject.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "symbol_heavy", "short_words", "long_words", "duplicate_lines", "shouting"),
    "v2": ("too_few_words", "repeated_windows", "symbol_heavy", "short_words", "long_words", "duplicate_lines", "shouting", "few_letters", "short_lines"),
    "length_only": ("too_few_words", "very_long"),
}


def mask(rules) -> int:
    """The bits of the named rules."""
    names = [r.name for r in RULES]
    return sum(1 << names.index(r) for r in rules)


def ledger(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, every measurement, and ``failures``: bit i set if ``RULES[i]`` fails."""
    m = measure(F.col(f"`{text_col}`"))
    raw = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], *[v.alias(k) for k, v in m.items()])
    measured = raw.select(
        *[F.col(f"k{i}") for i in range(len(keep))],
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("lines.n").cast("long").alias("n_lines"),
        (F.col("lines.n") - F.col("lines.d")).cast("long").alias("n_dup_lines"),
        _repeat_words(_window_hashes(F.col("words"))).alias("n_repeat_words"),
        "n_upper",
        "n_letters",
    )
    bits = F.lit(0).cast("long")
    for i, r in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    out = measured.withColumn("failures", bits)
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def store_ledger(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ledger, written once in the shared folder and read back: what policies and ablations are then computed from."""
    return materialise(ledger(docs, text_col, keep), "ledger")


def apply_policy(ledger_df: DataFrame, version: str = "v1") -> DataFrame:
    """Add ``base_failed`` and ``kept`` under the named policy."""
    failed = lambda v: F.col("failures").bitwiseAND(F.lit(mask(POLICIES[v])).cast("long")) != 0
    return ledger_df.withColumn("base_failed", failed("base")).withColumn("kept", ~failed("base") & ~failed(version))


def kept_by(failures: Column) -> Column:
    """The policies that keep a document, by its failure bits; none keeps what the base policy rejects."""
    base = mask(POLICIES["base"])
    passed = [F.when(failures.bitwiseAND(F.lit(base | mask(rules)).cast("long")) == 0, v) for v, rules in POLICIES.items()]
    return F.array_compact(F.array(*passed))


def ablation(ledger_df: DataFrame, version: str = "v1") -> DataFrame:
    """One row per rule of the policy: ``rule``, ``fails``, and ``only`` (documents that would return without it).

    Ledger rows collapse to their distinct failure masks first (at most 2 to the number of rules), so a
    second policy or ablation never evaluates a rule again.
    """
    m = mask(POLICIES[version])
    masks = ledger_df.groupBy(F.col("failures").bitwiseAND(F.lit(m).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    aggs = []
    for i, r in enumerate(RULES):
        if m >> i & 1:
            bit = F.lit(1 << i).cast("long")
            aggs.append(
                F.struct(
                    F.lit(r.name).alias("rule"),
                    F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(bit) != 0, F.col("n"))), F.lit(0)).alias("fails"),
                    F.coalesce(F.sum(F.when(F.col("bits") == bit, F.col("n"))), F.lit(0)).alias("only"),
                )
            )
    return masks.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def quality_filter(docs: DataFrame, version: str = "v1") -> DataFrame:
    """The documents that the policy keeps, with their own columns only."""
    names = docs.columns
    hidden = [f"__c{i}" for i in range(len(names))]
    renamed = docs.toDF(*hidden).withColumn("__text", F.col(hidden[names.index("text")]))
    return apply_policy(ledger(renamed, "__text", tuple(hidden)), version).filter("kept").select(*hidden).toDF(*names)
