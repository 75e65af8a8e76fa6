"""Aggregates over the transactions that hold an itemset.

They expect columns ``util`` (profit times quantity), ``prob``, ``rem`` (positive
utility of later items in the transaction) and ``ptu`` (positive utility of the
whole transaction).  All are plain aggregates that share one hash-aggregation and
combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def positive(util: Column, profit: Column) -> Column:
    """The utility of an item whose profit is positive, else 0."""
    return F.when(profit > 0, util).otherwise(F.lit(0.0))


def expected_utility() -> Column:
    return F.sum(F.col("util") * F.col("prob"))


def existential_probability() -> Column:
    """Of at least one occurrence; a product and not a sum of logarithms, so that a certain one gives 1."""
    return 1 - F.product(1 - F.col("prob"))


def weighted_utility() -> Column:
    """Bound on the expected utility of every itemset that holds this one."""
    return F.sum("ptu")


def suffix_bound() -> Column:
    """Bound on the expected utility of every extension by later items."""
    total = F.col("util") + F.col("rem")
    return F.sum(F.when(total > 0, F.col("prob") * total).otherwise(F.lit(0.0)))


def all_measures() -> list[Column]:
    return [expected_utility().alias("eu"), existential_probability().alias("ep"), weighted_utility().alias("ptwu"), suffix_bound().alias("pub")]
