"""String similarities of two labels. All are symmetric and lie in [0, 1].

Those that Spark's own functions express are Columns; longest common parts are Arrow UDFs, to be
applied to distinct pairs of labels.
"""

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ontoloom.config import Settings
from ontoloom.functions.labels import STOPWORDS, words

DEFAULTS = Settings()


def _with(value: Column, then) -> Column:
    """``then`` of a value that is worked out once, however often it is named there."""
    return F.transform(F.array(value), then)[0]


def _jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if either is empty."""
    counts = _with(F.struct(a.alias("a"), b.alias("b")), lambda p: F.struct((F.size(p["a"]) + F.size(p["b"])).alias("n"), F.size(F.array_intersect(p["a"], p["b"])).alias("m")))
    return _with(counts, lambda c: F.when(c["m"] == 0, F.lit(0.0)).otherwise(c["m"] / (c["n"] - c["m"])))


def _grams(text: Column, n: int) -> Column:
    def of(t: Column) -> Column:
        # sequence() counts down, so texts that are too short are kept from it.
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))
        return F.when(F.length(t) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(each))

    return _with(text, of)


def ngram_similarity(a: Column, b: Column, n: int = 3) -> Column:
    """Jaccard of character n-grams, of bigrams where either is shorter than n."""
    a, b = F.lower(a), F.lower(b)
    return F.when(a == b, F.lit(1.0)).when(F.least(F.length(a), F.length(b)) >= n, _jaccard(_grams(a, n), _grams(b, n))).otherwise(_jaccard(_grams(a, 2), _grams(b, 2)))


def _unbalanced(a: Column, b: Column, ratio: float) -> Column:
    return F.greatest(F.length(a), F.length(b)) > ratio * F.least(F.length(a), F.length(b))


def _damped(raw: Column, a: Column, b: Column) -> Column:
    short = F.least(F.length(a), F.length(b))
    return F.when((short <= 3) & (raw < 1.0), raw * 0.4).when((short > 3) & (short <= 5) & (raw < 0.88), raw * 0.7).otherwise(raw)


def levenshtein_similarity(a: Column, b: Column, settings: Settings = DEFAULTS) -> Column:
    """One minus the edit distance over the longer length, 0 beyond 40 % difference in length; damped for short labels."""
    longest = F.greatest(F.length(a), F.length(b))
    raw = F.when(F.abs(F.length(a) - F.length(b)) > 0.4 * longest, F.lit(0.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == "") | _unbalanced(a, b, settings.length_ratio), F.lit(0.0)).otherwise(_damped(raw, a, b))


def _common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence: one bit of a whole number for each character of ``a``."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        match = row & where.get(c, 0)
        row = (row + match | row - match) & full
    return len(a) - row.bit_count()


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the longest common subsequence over the sum of lengths; two empty texts are equal."""
    return pd.Series([None if x is None or y is None else 1.0 if x == y else 2.0 * _common_length(x, y) / (len(x) + len(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def indel_similarity(a: Column, b: Column, settings: Settings = DEFAULTS) -> Column:
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == "") | _unbalanced(a, b, settings.length_ratio), F.lit(0.0)).otherwise(_damped(indel_ratio(a, b), a, b))


def _longest_run(a: str, b: str) -> tuple[int, int, int]:
    """(length, start in a, start in b) of the longest common substring, earliest in a, then in b."""
    size, at = 0, 0
    for i in range(len(a)):
        while i + size < len(a) and a[i : i + size + 1] in b:
            size, at = size + 1, i
    return size, at, b.find(a[at : at + size])


def _isub(a: str, b: str, ratio: float) -> float:
    a, b = sorted((a, b))
    if a == b:
        return 1.0
    if not a or not b or max(len(a), len(b)) > ratio * min(len(a), len(b)):
        return 0.0
    left, right, common = a, b, 0
    for _ in range(6):
        size, i, j = _longest_run(left, right)
        if size < 2:
            break
        left, right, common = left[:i] + left[i + size :], right[:j] + right[j + size :], common + size
    if not common:
        return 0.0
    score = 2.0 * common / (len(a) + len(b)) - 0.3 * (len(left) / len(a)) * (len(right) / len(b))
    return min(1.0, max(0.0, score))


@F.pandas_udf(DoubleType())
def isub_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Common substrings taken out one by one, less a penalty for what differs."""
    ratio = 2.5
    return pd.Series([None if x is None or y is None else _isub(x, y, ratio) for x, y in zip(a, b, strict=True)], dtype="float64")


def tokens(label: Column) -> Column:
    """The set of a label's words without stopwords."""
    return F.array_distinct(F.filter(F.split(label, " "), lambda w: (w != "") & ~w.isin(STOPWORDS)))


def token_set_similarity(a: Column, b: Column) -> Column:
    """Jaccard of words without stopwords; 0 where either label has none, even if the labels are equal."""
    return _jaccard(tokens(a), tokens(b))


def acronym_bonus(a: Column, b: Column) -> Column:
    """1.0 if the shorter label is the initials of the longer one's words, 0.8 if it begins them, else 0."""
    swap = F.length(a) <= F.length(b)
    short, long = F.lower(F.when(swap, a).otherwise(b)), F.lower(F.when(swap, b).otherwise(a))
    short = F.replace(short, F.lit(" "), F.lit(""))
    every = words(long)
    telling = F.filter(every, lambda w: ~w.isin(STOPWORDS))
    initials = F.array_join(F.transform(F.when(F.size(telling) >= 2, telling).otherwise(every), lambda w: F.substring(w, 1, 1)), "")
    return (
        F.when(~F.length(short).between(2, 8) | ~F.contains(long, F.lit(" ")), F.lit(0.0))
        .when(short == initials, F.lit(1.0))
        .when((F.length(short) >= 3) & F.startswith(initials, short), F.lit(0.8))
        .otherwise(F.lit(0.0))
    )


def structural_similarity(a: Column, b: Column, weight: float = DEFAULTS.structural_bonus) -> Column:
    """Weighted Jaccard of parent URIs; 0 where either side has none."""
    none = F.array().cast("array<string>")
    return weight * _jaccard(F.array_distinct(F.coalesce(a, none)), F.array_distinct(F.coalesce(b, none)))


def combined_score(exact: Column, sem: Column, ngram: Column, lev: Column, isub: Column, structural: Column, settings: Settings = DEFAULTS) -> Column:
    s = settings
    strings = s.ngram_weight * ngram + s.levenshtein_weight * lev + s.isub_weight * isub
    return F.when(exact, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), s.semantic_weight * sem + s.string_weight * strings + structural)))


def register(spark: SparkSession) -> None:
    """The kernels as SQL functions isub, indel_ratio and ascii_folded."""
    from ontoloom.functions.labels import ascii_folded

    spark.udf.register("isub", isub_similarity)
    spark.udf.register("indel_ratio", indel_ratio)
    spark.udf.register("ascii_folded", ascii_folded)
