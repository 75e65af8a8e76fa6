"""Uncertain transactions and signed profits from plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gainset.sources.text import numbered_lines, parse_occurrences, parse_utilities

#: Share of the items, those of least average utility, whose profit turns negative.
NEGATIVE_SHARE = 0.3
DEFAULT_PROB = 0.1


def sales(spark: SparkSession, sf_dir: str, item: str) -> DataFrame:
    """Order lines as (tid, item, quantity, price, discount); item is ``part``, ``brand`` or ``type``."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if item == "part":
        key = lines.withColumn("item", F.col("l_partkey").cast("int"))
    else:
        part = spark.read.parquet(f"{sf_dir}/part.parquet")
        if item == "brand":
            part = part.select(F.col("p_partkey"), F.substring("p_brand", 7, 9).cast("int").alias("item"))
        else:
            number = part.select("p_type").distinct().withColumn("item", F.row_number().over(Window.orderBy("p_type")))
            part = part.join(number, "p_type").select("p_partkey", "item")
        key = lines.join(part, lines["l_partkey"] == part["p_partkey"])
    return key.select(F.col("l_orderkey").alias("tid"), "item", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"))


def transactions(rows: DataFrame) -> DataFrame:
    """One row for each transaction and item: the summed quantity, and a probability that falls with the discount."""
    return rows.groupBy("tid", "item").agg(F.sum("quantity").cast("int").alias("qty"), (1 / (1 + 10 * F.max("discount"))).alias("prob"))


def average_utilities(rows: DataFrame) -> DataFrame:
    return rows.groupBy("item").agg(F.avg(F.col("price") / F.col("quantity")).alias("average"))


def signed_profits(averages: DataFrame, share: float = NEGATIVE_SHARE) -> DataFrame:
    """Average utility, rounded to cents, negative for the lowest ``share`` of the items.

    Ranking takes one task and one row per item, which the item catalogue bounds.
    """
    order = Window.orderBy("average", "item")
    placed = averages.withColumn("at", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    value = F.round("average", 2)
    return placed.select("item", F.when(F.col("at") <= F.floor(F.col("n") * share), -value).otherwise(value).alias("profit"))


def merged_sources(utilities: DataFrame, occurrences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transactions of quantity 1 and signed profits from two files of the same lines.

    ``utilities`` has (line, item, util), ``occurrences`` (line, item, prob), with
    lines numbered by position.  An item without a probability gets a small one, and one
    with several the largest.
    """
    if utilities.select("line").distinct().count() != occurrences.select("line").distinct().count():
        raise ValueError("the two files have different numbers of lines")
    averages = utilities.groupBy("item").agg(F.avg("util").alias("average"))
    known = occurrences.groupBy("line", "item").agg(F.max("prob").alias("prob"))
    rows = utilities.join(known, ["line", "item"], "left")
    return rows.select(F.col("line").alias("tid"), "item", F.lit(1).alias("qty"), F.coalesce("prob", F.lit(DEFAULT_PROB)).alias("prob")), signed_profits(averages)


def read_merged(spark: SparkSession, utilities: str, occurrences: str) -> tuple[DataFrame, DataFrame]:
    """``merged_sources`` of two paths, whose lines go together by their positions."""
    return merged_sources(parse_utilities(numbered_lines(spark, utilities)), parse_occurrences(numbered_lines(spark, occurrences)))
