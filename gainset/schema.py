"""Column names, types and tolerances shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Slack of every threshold, always in the direction that keeps a row.
EPS = 1e-9

TRANSACTIONS = "tid long, item int, qty int, prob double"
PROFITS = "item int, profit double"
PATTERNS = "itemset array<int>, eu double, ep double"


def at_least(value: Column, bound: float) -> Column:
    """``value >= bound``, with a slack that grows with the bound, as rounding does."""
    return value >= F.lit(bound - max(EPS, 1e-12 * abs(bound)) if bound > float("-inf") else bound)


def itemset_text(column: str = "itemset") -> Column:
    return F.array_join(F.col(column).cast("array<string>"), ",")
