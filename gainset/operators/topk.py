"""The k itemsets of highest expected utility."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gainset.scratch import stored

NOTHING = float("-inf")


def top(patterns: DataFrame, k: int) -> DataFrame:
    """By falling utility; of equal ones the shorter itemset, then the smaller, comes first."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return patterns.select("itemset", "eu", "ep").orderBy(F.desc("eu"), F.size("itemset"), "itemset").limit(k)


def merge(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """The top k of two tables; each task gives its own k, and those are merged."""
    return top(first.select("itemset", "eu", "ep").unionByName(second.select("itemset", "eu", "ep")), k)


def threshold(patterns: DataFrame, k: int) -> float:
    """The k-th utility, or minus infinity while there are fewer."""
    n, least = patterns.agg(F.count(F.lit(1)), F.min("eu")).first()
    return least if n >= k else NOTHING


def kept(best: DataFrame, k: int) -> tuple[DataFrame, float]:
    """The written table and its threshold, which is taken while it is written."""
    seen = Observation()
    out = stored(best.observe(seen, F.count(F.lit(1)).alias("n"), F.min("eu").alias("least")), "top", free=False)
    return out, seen.get["least"] if seen.get["n"] >= k else NOTHING
