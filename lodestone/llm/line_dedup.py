"""Removal of repeated line runs by a suffix array over line IDs.

Every line that holds a word becomes a line ID.  IDs that occur once in the corpus end every repeated
run, so only stretches of repeated lines with at least ``MIN_WORDS`` words go on.  Their suffixes are
sorted by distributed prefix doubling: a suffix's rank is its place in the array sorted so far, and a
round orders the suffixes of equal rank by the rank of the suffix that starts 1, 2, 4 ... lines later, an
ended stretch first.  For every line the shortest run with ``MIN_WORDS`` words that begins with it and the
shortest that ends with it are windows of m lines; the ranks at depth 2^floor(log2 m) of a window's first and last such stretch
name the interval of all suffixes whose common prefix has its m lines or more.  In
each interval the first occurrence (by doc_id, then line) is kept and the later ones are deleted.

These windows cover every maximal repeated run whole: a line of a run either has ``MIN_WORDS`` words of the run up to and with it, so the
window that ends with it lies in the run, or the window that begins with the run reaches over it.  A window has
at most ``MIN_WORDS`` lines, so doubling ends there: deeper ranks only divide its interval.  Later
windows with the same first copy that touch join to maximal runs (column ``runs``).

Line IDs are 64-bit hashes; a line is deleted only if its SHA-256 equals that of the line kept in its place.

Null and empty texts have no lines.  Lines without a word are neither compared nor deleted and do not
end a run.  Lines are compared with the white space at their ends removed.  Rows that agree in doc_id
and text are one document.  A run that repeats within one document is kept whole where it occurs first: of a
copy that overlaps it only the lines beyond it are deleted.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.text import word_count
from lodestone.plans.running import HASH_BITS, running_sum
from lodestone.plans.scratch import discard, materialise

MIN_WORDS = 50
SPACES = " \t\n\x0b\f\r"


def line_id(line: Column) -> Column:
    """The symbol of a line in the suffix array."""
    return F.xxhash64(line)


def _lines(docs: DataFrame) -> DataFrame:
    """``doc_id, h, line`` (number in the text), ``i`` (among lines with words), ``id, sha, words``."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("line"), F.trim(x, F.lit(SPACES)).alias("t")))
    held = docs.filter("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("h"), F.filter(lines, lambda x: x["t"] != "").alias("ls"))
    each = held.select("doc_id", "h", F.posexplode("ls").alias("i", "l"))
    return each.select("doc_id", "h", "i", F.col("l.line").alias("line"), line_id(F.col("l.t")).alias("id"), F.unhex(F.sha2("l.t", 256)).alias("sha"), word_count(F.col("l.t")).alias("words")).dropDuplicates(["doc_id", "h", "i"])


def _stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """Repeated lines within long enough stretches: ``s`` (stretch), ``i, line, id``, and ``windows``: start, its line and m of the shortest runs from and up to the line that have the words."""
    # written, so that the join shuffles anew and a very common line can be split
    often = materialise(lines.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"), "repeated-ids")
    repeated = lines.drop("sha").join(often, "id")
    by_doc = Window.partitionBy("doc_id", "h").orderBy("i")
    numbered = repeated.withColumn("run", F.col("i") - F.row_number().over(by_doc))
    whole = Window.partitionBy("doc_id", "h", "run")
    long = numbered.withColumn("total", F.sum("words").over(whole)).filter(F.col("total") >= min_words)
    ordered = whole.orderBy("i")
    summed = long.withColumn("upto", F.sum("words").over(ordered)).withColumn("before", F.col("upto") - F.col("words"))
    # every line has a word, so min_words lines on either side are enough
    near = summed.withColumn("ends", F.collect_list("upto").over(ordered.rowsBetween(0, min_words - 1)))
    near = near.withColumn("starts", F.collect_list(F.struct("i", "line", "before")).over(ordered.rowsBetween(1 - min_words, 0)))
    onward = F.array_position(F.transform("ends", lambda e: e >= F.col("before") + min_words), True).cast("int")
    back = F.try_element_at(F.filter("starts", lambda x: F.col("upto") - x["before"] >= min_words), F.lit(-1))
    window = lambda i, line, m: F.when(m > 0, F.struct(i.alias("i"), line.alias("line"), m.cast("int").alias("m")))
    windows = F.array_compact(F.array(window(F.col("i"), F.col("line"), onward), window(back["i"], back["line"], F.col("i") - back["i"] + 1)))
    return near.select(F.xxhash64("doc_id", "h", "run").alias("s"), "doc_id", "h", "i", "id", windows.alias("windows"))


def suffix_intervals(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Suffixes whose first m lines occur elsewhere: ``doc_id, h, i, line, m, a, b``, the pair (a, b) with m naming the interval."""
    suffixes = materialise(_stretches(lines, min_words), "suffixes")
    windows = materialise(suffixes.select("s", "doc_id", "h", F.inline("windows")).dropDuplicates(["s", "i", "m"]), "windows")
    key = F.col("id").bitwiseAND(F.lit((1 << HASH_BITS) - 1))
    firsts = materialise(suffixes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).select("id", "n", key.alias("key"), F.lit(0).alias("all")), "line-ids")
    ranked = running_sum(firsts, ["all"], "key", ["id"], "n", "rank").select("id", "rank")
    ranks = materialise(suffixes.join(ranked, "id").select("s", "i", "rank"), "ranks")
    deepest, total = windows.agg(F.coalesce(F.max("m"), F.lit(0))).first()[0], suffixes.count()
    # ranks spread over the order key's range, in their own order
    spread = (1 << HASH_BITS) // max(1, total)
    depth, found = 1, None
    while depth <= deepest:
        wanted = windows.filter(F.col("m").between(depth, 2 * depth - 1)).withColumn("j", F.col("i") + F.col("m") - depth)
        here = ranks.select("s", "i", F.col("rank").alias("a"))
        there = ranks.select("s", F.col("i").alias("j"), F.col("rank").alias("b"))
        level = materialise(wanted.join(here, ["s", "i"]).join(there, ["s", "j"]).select("doc_id", "h", "i", "line", "m", "a", "b"), "level")
        found = level if found is None else found.unionByName(level)
        if 2 * depth > deepest:
            break
        after = ranks.select("s", (F.col("i") - depth).alias("i"), F.col("rank").alias("next"))
        pairs = materialise(ranks.join(after, ["s", "i"], "left").select("s", "i", "rank", F.coalesce("next", F.lit(-1).cast("long")).alias("next")), "pairs")
        groups = materialise(pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n")).withColumn("key", F.col("next") * spread), "rank-pairs")
        placed = running_sum(groups, ["rank"], "key", ["next"], "n", "before").filter("n > 1 AND next >= 0")
        # a suffix alone at its rank cannot repeat at this depth or deeper
        deeper = materialise(pairs.join(placed, ["rank", "next"]).select("s", "i", (F.col("rank") + F.col("before")).alias("rank")), "ranks")
        for done in (ranks, pairs, groups):
            discard(done)
        ranks = deeper
        depth *= 2
    for done in (suffixes, windows, firsts, ranks):
        discard(done)
    if found is None:
        return lines.filter("false").select("doc_id", "h", "i", "line", F.lit(0).alias("m"), F.col("id").alias("a"), F.col("id").alias("b"))
    return found


def _runs(later: DataFrame) -> DataFrame:
    """``doc_id, h, runs``: the maximal runs of each document that repeat a first copy, by their first line."""
    one = ["doc_id", "h", "f_doc", "f_h", "shift"]
    by = Window.partitionBy(*one).orderBy("i", "m")
    ends = later.withColumn("shift", F.col("f_i") - F.col("i")).withColumn("end", F.col("i") + F.col("m"))
    reached = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = ends.withColumn("new", F.when(F.col("i") <= reached, 0).otherwise(1)).withColumn("island", F.sum("new").over(by))
    run = marked.groupBy(*one, "island").agg(F.min("line").alias("line"), (F.max("end") - F.min("i")).cast("long").alias("lines"), F.min("f_line").alias("first_line"))
    item = F.struct("line", "lines", F.col("f_doc").alias("first_doc_id"), "first_line")
    return run.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(item)).alias("runs"))


def removals(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document that loses lines: ``doc_id, h, removed`` (line numbers), ``first_doc_ids`` (where the copies stay), ``removed_words, runs``.

    A run is ``line`` (its first), ``lines`` (with words), ``first_doc_id, first_line``.
    """
    lines = materialise(_lines(docs), "lines")
    suffixes = materialise(suffix_intervals(lines, min_words), "intervals")
    place = F.struct("doc_id", "h", "i", "line")
    # written, so that the join shuffles anew and an interval of very many suffixes can be split
    firsts = materialise(suffixes.groupBy("m", "a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "firsts")
    names = [F.col("first.doc_id").alias("f_doc"), F.col("first.h").alias("f_h"), F.col("first.i").alias("f_i"), F.col("first.line").alias("f_line")]
    later = materialise(suffixes.join(firsts, ["m", "a", "b"]).filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "h", "i", "line", "m", *names), "later")
    within = F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.col("h") == F.col("f_h"))
    start = F.when(within, F.greatest("i", F.col("f_i") + F.col("m"))).otherwise(F.col("i"))
    each = later.select("doc_id", "h", F.explode(F.sequence(start, F.col("i") + F.col("m") - 1)).alias("i"), "f_doc", "f_h", (F.col("f_i") - F.col("i")).alias("shift"))
    gone = materialise(each.select("doc_id", "h", "i", "f_doc", "f_h", (F.col("i") + F.col("shift")).alias("f_i")).distinct(), "gone")
    kept = lines.select(F.col("doc_id").alias("f_doc"), F.col("h").alias("f_h"), F.col("i").alias("f_i"), F.col("sha").alias("f_sha"))
    same = lambda left, right, names: reduce(and_, [left[x].eqNullSafe(right[x]) for x in names])
    first, own = ["f_doc", "f_h", "f_i"], ["doc_id", "h", "i"]
    wanted = materialise(gone.join(kept, same(gone, kept, first)).select(*own, gone["f_doc"], "f_sha"), "gone")
    hit = wanted.join(lines, same(wanted, lines, own)).filter("sha = f_sha").select(wanted["doc_id"], wanted["h"], F.col("f_doc").alias("kept"), "line", "words")
    per_line = hit.groupBy("doc_id", "h", "line").agg(F.min("words").alias("words"), F.collect_set("kept").alias("kept"))
    per_doc = per_line.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list("line")).alias("removed"), F.sum("words").alias("removed_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("kept")))).alias("first_doc_ids"))
    runs = _runs(later).select(F.col("doc_id").alias("r_doc"), F.col("h").alias("r_h"), "runs")
    joined = per_doc.join(runs, F.col("doc_id").eqNullSafe(F.col("r_doc")) & (F.col("h") == F.col("r_h")))
    return joined.select("doc_id", "h", "removed", "removed_words", "first_doc_ids", "runs")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with later copies of repeated runs deleted from their texts."""
    names = docs.columns
    hidden = [f"c{i}" for i in range(len(names))]
    bare = docs.toDF(*hidden)
    key, text = (F.col(hidden[names.index(n)]) for n in ("doc_id", "text"))
    out = removals(bare.select(key.alias("doc_id"), text.alias("text")), min_words).select("doc_id", "h", "removed")
    joined = bare.withColumn("k", F.xxhash64(text)).join(out, key.eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("h")), "left")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("removed", i)), "\n")
    cleaned = F.when(F.col("removed").isNull(), text).otherwise(kept)
    return joined.select(*[cleaned.alias(c) if n == "text" else F.col(c) for c, n in zip(hidden, names, strict=True)]).toDF(*names)
