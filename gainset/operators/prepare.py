"""From transactions and profits to ranked entries and one-item measures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gainset.functions import measures
from gainset.schema import EPS
from gainset.scratch import stored

#: Rows of a few columns that may be sent to all tasks, some 10 to 20 MB; larger tables are joined by shuffles.
MOST_SENT = 200_000


def few(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, which are ``n``, sent to all tasks of a join if they are few."""
    return F.broadcast(rows) if n <= MOST_SENT else rows


def split_valid(tx: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with a reason.

    Valid: no nulls, quantity of at least 1, probability in (0, 1] (not NaN), and one
    row for each transaction and item.
    """
    bad = (
        F.when(F.col("tid").isNull() | F.col("item").isNull() | F.col("qty").isNull() | F.col("prob").isNull(), "null")
        .when(F.isnan("prob") | (F.col("prob") <= 0) | (F.col("prob") > 1), "probability")
        .when(F.col("qty") < 1, "quantity")
    )
    rows = tx.withColumn("reason", bad)
    copies = F.count(F.lit(1)).over(Window.partitionBy("tid", "item"))
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(copies > 1, "repeated")))
    return rows.filter(F.col("reason").isNull()).drop("reason"), rows.filter(F.col("reason").isNotNull())


def known_entries(tx: DataFrame, profits: DataFrame) -> DataFrame:
    """Entries of items that have a profit, with utility, its positive part and the transaction's positive utility."""
    rows = tx.filter("item >= 0").join(profits, "item")
    util = F.col("profit") * F.col("qty")
    rows = rows.withColumn("util", util).withColumn("pos", measures.positive(util, F.col("profit")))
    return rows.withColumn("ptu", F.sum("pos").over(Window.partitionBy("tid"))).select("tid", "item", "util", "pos", "prob", "ptu")


def transaction_utilities(known: DataFrame) -> DataFrame:
    return known.groupBy("tid").agg(F.max("ptu").alias("ptu"))


def item_bounds(known: DataFrame) -> DataFrame:
    """Per item the weighted utility and the existential probability; a probability of 0 or less still counts for the former."""
    certain = F.when(F.col("prob") > 0, F.col("prob")).otherwise(F.lit(0.0))
    return known.groupBy("item").agg(F.sum("ptu").alias("ptwu"), (1 - F.product(1 - certain)).alias("ep"))


def admissible_items(bounds: DataFrame, min_prob: float, keep_zero_ptwu: bool = False) -> DataFrame:
    """Items probable enough that also occur beside positive utility (unless that isn't asked for)."""
    rows = bounds.filter(F.col("ep") >= min_prob - EPS)
    return rows if keep_zero_ptwu else rows.filter("ptwu > 0")


def ranked_items(items: DataFrame) -> DataFrame:
    """Positions by falling weighted utility.  One row per item of the catalogue, so one task orders them."""
    order = Window.orderBy(F.desc("ptwu"), "item")
    return items.withColumn("rank", (F.row_number().over(order) - 1).cast("int"))


def ranked_entries(known: DataFrame, items: DataFrame) -> DataFrame:
    """Entries of admissible items with ``rem``: the positive utility of later items in the transaction."""
    later = Window.partitionBy("tid").orderBy("rank").rowsBetween(1, Window.unboundedFollowing)
    rows = known.join(items.select("item", "rank", F.col("ptwu").alias("item_ptwu")), "item")
    rows = rows.withColumn("rem", F.coalesce(F.sum("pos").over(later), F.lit(0.0)))
    return rows.filter("prob > 0").select("tid", "item", "rank", "util", "prob", "rem", "ptu", "item_ptwu")


def one_item_patterns(entries: DataFrame) -> DataFrame:
    return entries.groupBy("item", "rank").agg(*measures.all_measures())


@dataclass(frozen=True)
class Prepared:
    items: DataFrame
    entries: DataFrame


def prepare(tx: DataFrame, profits: DataFrame, min_prob: float, keep_zero_ptwu: bool = False) -> Prepared:
    """Ranked entries of the valid rows; ``split_valid`` tells what the others are.

    Rows are dealt by transaction first, which serves the check for repeated items and the
    transaction's utility.  What is known of them is written, as items are measured before
    entries can be ranked; where the catalogue of items is small, no row moves by its item,
    of which a few may hold most rows.
    """
    profits = stored(profits, "profits", free=False)
    n = profits.count()
    known = stored(known_entries(split_valid(tx.repartition("tid"))[0], few(profits, n)), "known", free=False)
    items = stored(ranked_items(admissible_items(item_bounds(known), min_prob, keep_zero_ptwu)), "items", free=False)
    return Prepared(items, ranked_entries(known, few(items, n)))
