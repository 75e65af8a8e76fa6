"""Result files and console tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The columns of the performance file, in order.
PERFORMANCE_COLUMNS = ("dataset", "algorithm", "k", "minProb", "threads", "run", "timeTotal_ms", "timePhase1_ms", "timePhase2_ms", "timePhase3_ms", "patternsFound", "nodesExpanded", "joinsAttempted")


def ranked(patterns: DataFrame) -> DataFrame:
    """Patterns with their rank; at most k rows, so one task orders them."""
    order = Window.orderBy(F.desc("eu"), F.size("itemset"), F.col("itemset"))
    return patterns.withColumn("rank", F.row_number().over(order))


def pattern_lines(patterns: DataFrame) -> DataFrame:
    """Rows (rank, value): lines of rank, expected utility, probability and itemset."""
    items = F.concat(F.lit("["), F.array_join(F.col("itemset").cast("array<string>"), ", "), F.lit("]"))
    return ranked(patterns).select("rank", F.format_string("%d\t%.4f\t%.6f\t%s", "rank", "eu", "ep", items).alias("value"))


def write_patterns(patterns: DataFrame, path: str, title: str) -> None:
    """A text file of two header lines and one line for each pattern."""
    head = patterns.sparkSession.createDataFrame([(-1, f"# {title}"), (0, "# rank\tEU\tEP\titemset")], "rank int, value string")
    head.unionByName(pattern_lines(patterns)).coalesce(1).sortWithinPartitions("rank").select("value").write.mode("overwrite").text(path)


def write_performance(runs: DataFrame, path: str) -> None:
    runs.select(*PERFORMANCE_COLUMNS).coalesce(1).write.mode("overwrite").csv(path, header=True)
