"""Text functions: tokens, n-grams, SQL text, JSON responses, numbers, vectors."""

from __future__ import annotations

import datetime
import html
import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
VOCABULARY = 65_536


def tokens(text: Column) -> Column:
    """Runs of letters and digits, and single marks."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    """Number of tokens, counted without building them; 0 for null.  What no word takes and is no space is a mark."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]++|\S")), F.lit(0)).cast("long")


def token_ids(text: Column, vocabulary: int = VOCABULARY) -> Column:
    """Ids of the built-in tokenizer: the head of each token's MD5 modulo the vocabulary."""
    return F.transform(tokens(text), lambda t: (F.conv(F.substring(F.md5(t), 1, 6), 16, 10).cast("int") % vocabulary).cast("int"))


def ngrams(words: Column, n: int) -> Column:
    """All runs of 1 to ``n`` words, joined by spaces."""

    def runs(k: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: i + (k - 1) <= F.size(words))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, k), " "))

    return F.flatten(F.array(*[runs(k) for k in range(1, n + 1)]))


def fenced_sql(message: Column) -> Column:
    """The last fenced SQL block, stripped; null without one."""
    return F.trim(F.try_element_at(F.regexp_extract_all(message, F.lit(r"(?s)```sql\s*(.*?)\s*```"), F.lit(1)), F.lit(-1)))


def clean_sql(sql: Column) -> Column:
    """Backticks to double quotes, trailing semicolons off."""
    return F.regexp_replace(F.translate(F.trim(sql), "`", '"'), r";+\s*$", "")


def without_comments(sql: Column) -> Column:
    """Without line and block comments."""
    return F.trim(F.regexp_replace(F.regexp_replace(sql, r"--[^\n]*", ""), r"(?s)/\*.*?\*/", ""))


def redact_blobs(text: Column) -> Column:
    """Blob examples emptied."""
    return F.regexp_replace(text, r"\[ BLOB \] \([^)]*\)", "[ BLOB ] ()")


def custom_id_number(custom_id: Column) -> Column:
    """The integer at the end of a request id."""
    return F.element_at(F.split(custom_id, "_"), -1).cast("long")


@F.pandas_udf(StringType())
def normalised(text: pd.Series) -> pd.Series:
    """HTML entities resolved, then Unicode NFKD."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", html.unescape(t)))


def title_and_body(title: Column, body: Column) -> Column:
    """Title and body on two lines; titles that are empty or a dash are left out."""
    return F.when(F.trim(title).isin("", "-") | title.isNull(), body).otherwise(F.concat_ws("\n", title, body))


_SCALES = {"k": 10**3, "m": 10**6, "b": 10**9, "t": 10**12, "ki": 2**10, "mi": 2**20, "gi": 2**30, "ti": 2**40}
_NUMBER = re.compile(
    r"""(?P<sign>[+-]?)(?P<size>\d+\.?\d*|\.\d+)
        (?: (?P<percent>%) | \^(?P<power>[+-]?\d+\.?\d*) | e(?P<ten>[+-]?\d+\.?\d*) | (?P<scale>[kmbt]|[kmgt]i) )?""",
    re.VERBOSE,
)


def human_number(value: str | int | float) -> float:
    """Numbers as people write them: 1K, 1Ki, 10^6, 1e6, 1.5%, 1_000; a sign belongs to the whole, so -2^0.5 is -(2^0.5)."""
    if not isinstance(value, str):
        return value
    plain = value.strip().lower().replace("_", "")
    found = _NUMBER.fullmatch(plain)
    if found is None:
        return float(plain)
    part = found.groupdict()
    size = float(part["size"]) * _SCALES.get(part["scale"], 1) * 10 ** float(part["ten"] or 0) / (100 if part["percent"] else 1)
    size **= float(part["power"] or 1)
    return -size if part["sign"] == "-" else size


@F.pandas_udf(DoubleType())
def human_numbers(texts: pd.Series) -> pd.Series:
    """:func:`human_number` of a column; null for null."""
    return texts.map(lambda t: None if t is None else float(human_number(t)))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """L2-normalised; NaN components for a zero vector."""
    share = lambda x, n: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(float("nan")))
    return F.transform(F.array(F.sqrt(dot(v, v))), lambda n: F.transform(v, lambda x: share(x, n)))[0]


def rounded(x: Column, digits: int) -> Column:
    """A double scaled, rounded half away from zero and scaled back, as SQL on doubles does; a small negative one gives -0.0, which Spark's decimal rounding loses."""
    size = F.round(F.abs(x) * 10.0**digits) / 10.0**digits
    return F.when(size < float("inf"), F.signum(x) * size).otherwise(x)


def sql_words(spark) -> list[str]:
    """All words of the session's SQL grammar, in upper case."""
    return sorted(r[0].upper() for r in spark.sql("SELECT keyword FROM sql_keywords()").collect())


def quoted(name: Column, reserved: list[str]) -> Column:
    """An identifier, in backticks if it is one of the reserved words or has other marks than letters, digits and underscores."""
    words = F.split(F.lit("\n".join(reserved)), "\n")
    odd = F.array_contains(words, F.upper(name)) | name.rlike("[^a-zA-Z0-9_]")
    return F.when(odd, F.concat(F.lit("`"), name, F.lit("`"))).otherwise(name)


def fenced_sql_or_empty(message: Column) -> Column:
    """The last fenced SQL block, empty without one."""
    return F.coalesce(fenced_sql(message), F.lit(""))


def common_substring_ratio(value: Column, question: Column) -> Column:
    """Length of the longest run of ``value`` inside ``question``, by the length of ``value``; case is ignored, 0 for nothing."""
    v, q = F.lower(value), F.lower(question)
    n = F.length(v)
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    # the longest run from each start: a longer one is in the question only if the shorter is
    longest = F.array_max(F.transform(starts, lambda i: F.aggregate(starts, F.lit(0), lambda m, k: F.when((i + k - 1 <= n) & (k == m + 1) & q.contains(v.substr(i, k)), k).otherwise(m))))
    return F.when(n > 0, longest / n).otherwise(0.0)


def filled_id(value: Column, text: Column) -> Column:
    """The id, or one made of the text's hash where it is missing."""
    return F.coalesce(value.cast("string"), F.concat(F.lit("__MISSING_ID__"), F.substring(F.md5(text), 1, 16)))


#: Marks of the powers of 1000 and of 1024.
_THOUSANDS = ("", "K", "M", "B", "T", "Qa", "Qi")
_BINARY = ("", "Ki", "Mi", "Gi", "Ti", "Pi", "Ei", "Zi", "Yi")


def _human(step: int, marks: tuple[str, ...]):
    def one(n: float) -> str | None:
        if n is None or n != n:
            return None
        if n == 0:
            return "0"
        power = min(int(math.log(abs(n), step)), len(marks) - 1)
        return f"{n / step**power:_.2f}{marks[power]}"

    @F.pandas_udf(StringType())
    def many(values: pd.Series) -> pd.Series:
        return values.map(one)

    return many


def human_count(value: Column, binary: bool = False) -> Column:
    """A count with two decimals and its scale, K, M, B ... or Ki, Mi, Gi ...; 0 alone, null for null."""
    return _human(1024, _BINARY)(value.cast("double")) if binary else _human(1000, _THOUSANDS)(value.cast("double"))


@F.pandas_udf(StringType())
def _seconds(values: pd.Series) -> pd.Series:
    def one(s: float) -> str | None:
        if s != s:
            return None
        return f"{s:.3f}s" if s < 60 else str(datetime.timedelta(seconds=s)).split(".")[0]

    return values.map(one)


def human_seconds(value: Column) -> Column:
    """Under a minute seconds with three decimals, else hours, minutes and seconds, and days in front of them."""
    return _seconds(value.cast("double"))


def streamed_content(body: Column, status: Column) -> Column:
    """The joined message contents of a streamed response, one JSON chunk a line; empty unless the status is 200."""
    chunks = F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(F.trim(x), "^data: ", ""))
    live = F.filter(chunks, lambda x: ~x.isin("", "[DONE]"))
    parts = F.transform(live, lambda x: F.coalesce(F.get_json_object(x, "$.choices[0].message.content"), F.lit("")))
    return F.when(status == 200, F.array_join(parts, "")).otherwise("")
