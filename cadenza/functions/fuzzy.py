"""Likeness of strings by matching blocks, which no built-in function computes (edit distance is another measure), and joins by it.

The ratio is twice the matched characters by all characters. Matched characters are a
common subsequence, so a ratio bounds how many pairs of neighbouring characters two
strings share: with M matched ones of lengths a and b at least 3 M - a - b - 1. Strings are
therefore joined on the rarest few of their character pairs, and only candidates are compared.
"""

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Character pairs that are told apart by how common they are; all others count as rare.
COMMON = 4096


def _matched(x: str, y: str, least: float) -> float | None:
    m = difflib.SequenceMatcher(None, x, y)
    if least > 0 and (m.real_quick_ratio() < least or m.quick_ratio() < least):
        return None
    found = m.ratio()
    return found if found >= least else None


def ratio(a: Column | str, b: Column | str, least: float = 0.0) -> Column:
    """From 0 to 1; null where a string is, or where it is under least (which its bounds tell for most)."""

    @F.pandas_udf("double")
    def likeness(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_matched(p.casefold(), q.casefold(), least) if p is not None and q is not None else None for p, q in zip(x, y, strict=True)], dtype="float64")

    return likeness(a, b)


def folded(s: Column | str) -> Column:
    """s without case, as ratio compares it."""

    @F.pandas_udf("string")
    def fold(x: pd.Series) -> pd.Series:
        return x.map(lambda p: p.casefold() if p is not None else None)

    return fold(s)


def _grams(strings: DataFrame) -> DataFrame:
    """s, f, n (its length), g: each pair of neighbouring characters with its number among equal ones."""
    f = F.col("f")
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(f), F.lit(1))), lambda k: k < F.length(f))
    pairs = strings.withColumn("n", F.length(f)).withColumn("p", F.transform(at, lambda k: f.substr(k, F.lit(2))))
    numbered = F.transform("p", lambda x, k: F.concat(x, F.size(F.filter(F.slice("p", 1, k + 1), lambda y: y == x)).cast("string")))
    return pairs.select("s", "f", "n", numbered.alias("g"))


def _overlap(threshold: float) -> Column:
    """The fewest pairs that a string of length n shares with any that is as like it as threshold."""
    low, high = F.ceil(F.col("n") * threshold / (2 - threshold) - 1e-9), F.floor(F.col("n") * (2 - threshold) / threshold + 1e-9)
    shared = lambda b: 3 * F.ceil(threshold * (F.col("n") + b) / 2 - 1e-9) - F.col("n") - b - 1
    return F.array_min(F.transform(F.sequence(F.greatest(low, F.lit(1)).cast("long"), F.greatest(high, F.lit(1)).cast("long")), shared))


def _signed(strings: DataFrame, ranks: DataFrame, threshold: float) -> DataFrame:
    """s, f, n, token: the rarest pairs of each string, as many as it takes to share one with all that are like it.

    Where a like string may share none, which low thresholds and very short strings allow, its single characters are tokens too.
    """
    made = _grams(strings)
    long = made.select("s", F.explode("g").alias("g")).join(F.broadcast(ranks), "g", "left")
    ordered = long.groupBy("s").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("rank", F.lit(0)).alias("rank"), "g"))).alias("o"))
    sized = made.select("s", "f", "n", _overlap(threshold).alias("c")).join(ordered, "s", "left")
    rare = F.slice(F.col("o.g"), 1, F.greatest(F.size("o") - F.greatest("c", F.lit(1)) + 1, F.lit(1)).cast("int"))
    single = F.when((F.col("n") <= 3) | (F.col("c") < 1), F.array_distinct(F.filter(F.split("f", ""), lambda x: x != "")))
    empty = F.when(F.col("n") == 0, F.array(F.lit("")))
    return sized.select("s", "f", "n", F.explode(F.concat(F.coalesce(rare, F.array().cast("array<string>")), F.coalesce(single, F.array().cast("array<string>")), F.coalesce(empty, F.array().cast("array<string>")))).alias("token"))


def candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """a, b: pairs of the different strings s of left and right that may be as like as threshold; none that is so is missing."""
    one = lambda df: df.filter("s IS NOT NULL").select("s").distinct().withColumn("f", folded("s"))
    a, b = one(left), one(right)
    counts = _grams(a.unionByName(b)).select(F.explode("g").alias("g")).groupBy("g").count()
    ranks = counts.orderBy(F.desc("count"), "g").limit(COMMON).select("g", F.col("count").alias("rank"))
    x, y = _signed(a, ranks, threshold), _signed(b, ranks, threshold).toDF("s2", "f2", "n2", "token")
    near = 2 * F.least("n", "n2") >= threshold * (F.col("n") + F.col("n2")) - 1e-9
    return x.join(y, "token").filter(near).select(F.col("s").alias("a"), F.col("s2").alias("b")).distinct()


def joined(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """a, b, ratio of all pairs of the different strings s of left and right that are as like as threshold."""
    return candidates(left, right, threshold).withColumn("ratio", ratio("a", "b", threshold)).filter("ratio IS NOT NULL")
