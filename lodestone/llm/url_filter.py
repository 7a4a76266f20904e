"""URL filters by a Bloom filter cascade, with DataFrame functions only.

A rule is a host, a path and an action.  It fits its host and all subdomains if the URL's path starts with the
rule's; of the rules that fit the longest wins.  So the keys that can decide a URL are known from the URL
alone: each suffix of its host at a label, together with each prefix of its path that is as long as some rule's
path.  These candidate keys of all pages are the key universe.

The cascade makes membership in the list of rules exact over that universe without a join: level 0 holds the
listed keys, level 1 the keys of the universe that level 0 wrongly takes in, level 2 the listed keys that level 1
takes in, and so on until a level takes in none of the other side.  A key belongs to the side of the last
level that it passes.  A second, small cascade over the listed keys tells the blocked ones from the others.

Each level is a packed array of 64-bit words; a key sets ``BITS`` bits of one word, so a look-up reads eight
bytes.  The levels stand in the plan as literals of a proven size: at most ``PART_KEYS`` keys of a list go into one
cascade (8 MB a level); a longer list is split by a hash of the key into parts of that size, which are
tested in one written pass each.

A null URL, or one without ``://``, has an empty host and path.  A URL that no rule fits is not listed and allowed.
A rule that is listed both to block and to allow blocks; repeated rules count once; null parts of a rule count as
empty, and no rule without a host fits.  Of equally long rules the one with the longer host wins.  Repeated rows fare alike, ties
included; other columns, whatever their names, are ignored.
An empty table of pages gives no rows, an empty list allows all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans.scratch import materialise

BITS, BITS_PER_KEY = 5, 12
PART_KEYS = 1 << 22
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """The host of a URL, with A to Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_after(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """The path of a URL; empty without ``://``."""
    return F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _slot(key: Column, level: int, words: int) -> tuple[Column, Column]:
    """A key's word at a level, and its bits in the word."""
    word = F.pmod(F.xxhash64(F.lit(2 * level), key), F.lit(words)).cast("int")
    spread = F.xxhash64(F.lit(2 * level + 1), key)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(BITS)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return word, mask


def _encode(keys: DataFrame, level: int, n: int) -> bytes:
    """The packed words of a level that holds ``n`` keys."""
    words = max(1, -(-n * BITS_PER_KEY // 64))
    word, mask = _slot(F.col("key"), level, words)
    set_bits = keys.select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits"))
    every = keys.sparkSession.range(words).select(F.col("id").cast("int").alias("word")).join(set_bits, "word", "left")
    pair = F.struct("word", F.lpad(F.hex(F.coalesce("bits", F.lit(0).cast("long"))), 16, "0").alias("hex"))
    packed = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["hex"]), ""))
    return bytes(every.agg(packed.alias("packed")).first()["packed"])


@dataclass
class Cascade:
    """Levels of packed words; even ones hold listed keys, odd ones keys to leave out."""

    levels: list[bytes]

    def passes(self, key: Column, level: int) -> Column:
        """Whether a level takes the key in."""
        packed = self.levels[level]
        word, mask = _slot(key, level, len(packed) // 8)
        read = F.conv(F.hex(F.substring(F.lit(packed), word * 8 + 1, F.lit(8))), 16, -10).cast("long")
        return read.bitwiseAND(mask) == mask

    def contains(self, key: Column) -> Column:
        """Whether the key is listed; exact for the keys of the universe."""
        if not self.levels:
            return F.lit(False)
        found = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            found = F.when(self.passes(key, i), found).otherwise(F.lit(i % 2 == 1))
        return found


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade of the distinct keys ``listed`` (at most ``PART_KEYS``) over ``universe``, both with a column ``key``."""
    cascade, inside = Cascade([]), materialise(listed.select("key").distinct(), "listed")
    n = inside.count()
    if n > PART_KEYS:
        raise ValueError(f"{n} listed keys; split them into parts of {PART_KEYS}")
    here, there = inside, None
    while n:
        level = len(cascade.levels)
        cascade.levels.append(_encode(here, level, n))
        # the other side's keys that this level takes in; joined with the list only to tell which these are, while building
        if there is None:
            passed = universe.select("key").filter(cascade.passes(F.col("key"), 0)).distinct().join(inside, "key", "left_anti")
        else:
            passed = there.filter(cascade.passes(F.col("key"), level))
        here, there = materialise(passed, "passed"), here
        n = here.count()
    return cascade


def candidates(host: Column, path: Column, longest_host: int, path_lengths: list[int]) -> Column:
    """The keys that can decide a URL; hosts and paths beyond the lengths of the rules' give none."""
    cut = F.length(host) > longest_host + 1
    tail = F.when(cut, F.right(host, F.lit(longest_host + 1))).otherwise(host)
    labels = F.split(tail, r"\.")
    starts = F.sequence(F.lit(1), F.size(labels))
    suffixes = F.transform(F.filter(starts, lambda i: (i > 1) | ~cut), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = F.filter(F.array(*[F.lit(n) for n in path_lengths]), lambda n: n <= F.length(path))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(lengths, lambda n: F.concat(s, F.substring(path, F.lit(1), n)))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(keys)


def judge(pages: DataFrame, rules: DataFrame, part_keys: int = PART_KEYS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of each page (``page_id, url``) by ``rules`` (``host, path, action``)."""
    part = lambda key, parts: F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    wanted = rules.select(F.translate(text("host"), UPPER, LOWER).alias("host"), text("path").alias("path"), "action").filter("host <> ''")
    keyed = materialise(wanted.withColumn("key", F.concat("host", "path")).groupBy("key").agg(F.max("host").alias("host"), F.max("path").alias("path"), F.bool_or(F.col("action") == "block").alias("blocks")), "rules")
    longest = keyed.agg(F.coalesce(F.max(F.length("host")), F.lit(0)), F.sort_array(F.collect_set(F.length("path"))), F.count(F.lit(1))).first()
    if not longest[2]:
        return pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    parts = -(-longest[2] // part_keys)
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = split.withColumn("keys", candidates(F.col("host"), F.col("path"), longest[0], longest[1]))
    universe = rows.select(F.explode("keys").alias("key"))
    rows = rows.withColumn("fits", F.array().cast("array<struct<length:int,host:int,key:string,blocks:boolean>>"))
    for p in range(parts):
        own = lambda d: d if parts == 1 else d.filter(part(F.col("key"), parts) == p)  # noqa: B023,E731
        listed = own(keyed)
        members = build_cascade(listed, own(universe))
        blocked = build_cascade(listed.filter("blocks"), listed.filter("NOT blocks"))
        hit = lambda k: members.contains(k) if parts == 1 else (part(k, parts) == p) & members.contains(k)  # noqa: B023,E731
        fit = lambda k: F.struct(F.length(k).alias("length"), F.length(F.substring_index(k, "/", 1)).alias("host"), k.alias("key"), blocked.contains(k).alias("blocks"))  # noqa: B023,E731
        rows = rows.withColumn("fits", F.concat("fits", F.transform(F.filter("keys", hit), fit)))
        if parts > 1:
            rows = materialise(rows, "judged")
    won = F.array_max("fits")
    return rows.select("page_id", "host", "path", won["key"].alias("rule"), F.when(won["blocks"], "block").otherwise("allow").alias("verdict"))
