"""Readers and writers of the text formats.

Transactions: a line of ``item:qty:prob`` tokens.  Profits: ``item profit``.
Utilities: ``items : total : utilities``.  Occurrences: ``tid item:prob ...``.
Malformed tokens and lines are skipped, not fatal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A token's three parts; empty parts at the end don't count.
_TOKEN = r"^([^:]+):([^:]+):([^:]+):*$"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines numbered 0, 1, ... through the file, and through the files of a folder by their names: line, value.

    Spark deals files out by size, so the order of partitions says nothing.  The lines of
    each block of a file are counted, and each line adds those of the blocks before; one row a block meets in one task.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).withColumn("id", F.monotonically_increasing_id())
    blocks = rows.groupBy("file", "start").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.select("file", "start", (before - F.col("first")).alias("shift"))
    return rows.join(placed, ["file", "start"]).select((F.col("id") + F.col("shift")).alias("line"), "value")


def _tokens(value: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(value, r"\s+", " ")), " ")


def parse_transactions(lines: DataFrame) -> DataFrame:
    """Rows (tid, item, qty, prob) from rows (line, value); tid is the line's number."""
    token = lines.select(F.col("line").alias("tid"), F.explode(_tokens(F.col("value"))).alias("token"))
    part = [F.regexp_extract("token", _TOKEN, i) for i in (1, 2, 3)]
    rows = token.select("tid", *[p.try_cast(t).alias(n) for p, (n, t) in zip(part, (("item", "int"), ("qty", "int"), ("prob", "double")), strict=True)])
    return rows.filter(F.col("item").isNotNull() & F.col("qty").isNotNull() & F.col("prob").isNotNull())


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    return parse_transactions(numbered_lines(spark, path))


def parse_profits(lines: DataFrame) -> DataFrame:
    """Rows (item, profit) from rows (line, value); of an item given twice the last line counts."""
    field = _tokens(F.col("value"))
    rows = lines.select("line", F.get(field, F.lit(0)).try_cast("int").alias("item"), F.get(field, F.lit(1)).try_cast("double").alias("profit"))
    rows = rows.filter(F.col("item").isNotNull() & F.col("profit").isNotNull())
    return rows.groupBy("item").agg(F.max_by("profit", "line").alias("profit"))


def read_profits(spark: SparkSession, path: str) -> DataFrame:
    return parse_profits(numbered_lines(spark, path))


def parse_utilities(lines: DataFrame) -> DataFrame:
    """Rows (line, item, util) of ``items : total : utilities`` lines."""
    field = F.split("value", ":")
    pairs = F.arrays_zip(_tokens(F.get(field, F.lit(0))).alias("i"), _tokens(F.get(field, F.lit(2))).alias("u"))
    rows = lines.select("line", F.explode(pairs).alias("p")).select("line", F.col("p.i").try_cast("int").alias("item"), F.col("p.u").try_cast("double").alias("util"))
    return rows.filter(F.col("item").isNotNull() & F.col("util").isNotNull())


def parse_occurrences(lines: DataFrame) -> DataFrame:
    """Rows (line, item, prob) of ``tid item:prob ...`` lines; the tid is dropped."""
    tokens = _tokens(F.col("value"))
    rows = lines.select("line", F.explode(F.slice(tokens, F.lit(2), F.size(tokens))).alias("t"))
    rows = rows.select("line", F.split("t", ":").alias("p")).select("line", F.get("p", F.lit(0)).try_cast("int").alias("item"), F.get("p", F.lit(1)).try_cast("double").alias("prob"))
    return rows.filter(F.col("item").isNotNull() & F.col("prob").isNotNull())


def by_position(lines: DataFrame) -> DataFrame:
    """``line`` renumbered 0, 1, ... in order, for joining files line by line.

    Numbers within each input partition are counted first; only one count per
    partition is gathered, and each line adds those of the partitions before.
    """
    part = F.shiftright(F.col("line"), 33)
    counts = lines.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = lines.withColumn("part", part).join(F.broadcast(before.select("part", "before")), "part")
    return joined.withColumn("line", F.col("before") + F.col("line").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "before")


def encode_transactions(rows: DataFrame) -> DataFrame:
    """Lines (tid, value) of ``item:qty:prob`` tokens, ascending by item."""
    token = F.concat_ws(":", F.col("item").cast("string"), F.col("qty").cast("string"), F.col("prob").cast("string"))
    return rows.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("item", token.alias("token")))).alias("t")).select("tid", F.array_join("t.token", " ").alias("value"))


def encode_profits(profits: DataFrame) -> DataFrame:
    return profits.select(F.concat_ws(" ", F.col("item").cast("string"), F.col("profit").cast("string")).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)
