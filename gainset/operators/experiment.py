"""Sweeps over parameters, and the tables that report them."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import product

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gainset.operators.mine import MiningResult, milliseconds, mine
from gainset.operators.strategies import mine_partitioned
from gainset.sources.sinks import write_patterns, write_performance
from gainset.sources.text import read_profits, read_transactions

STRATEGIES = {
    "local": lambda *a, tasks: mine_partitioned(*a, mode="local"),
    "level": lambda *a, tasks: mine(*a),
    "static": lambda *a, tasks: mine_partitioned(*a, mode="static", tasks=tasks),
    "merge": lambda *a, tasks: mine_partitioned(*a, mode="merge", tasks=tasks),
    "waves": lambda *a, tasks: mine_partitioned(*a, mode="waves", tasks=tasks),
}
RUNS = "dataset string, algorithm string, k int, minProb double, threads int, run int, timeTotal_ms long, timePhase1_ms long, timePhase2_ms long, timePhase3_ms long, patternsFound int, nodesExpanded long, joinsAttempted long"


def sweep(spark: SparkSession, datasets: dict[str, tuple[str, str]], ks: list[int], min_probs: list[float], runs: int = 3, strategies: tuple[str, ...] = tuple(STRATEGIES), threads: tuple[int, ...] = (), out: str | None = None) -> tuple[DataFrame, dict[tuple, MiningResult]]:
    """One row per run, and the last result of each setting; a dataset that can't be read is skipped.

    ``threads`` are the numbers of tasks that shuffles and prefixes are dealt to, by
    default as many as run at once; results of the last of them are kept.  ``local``
    has one and runs once.  With ``out`` each dataset gets a folder there, with the patterns
    of each setting and the performance table.
    """
    rows, results = [], {}
    for name, (db, profit) in datasets.items():
        try:
            tx, profits = read_transactions(spark, db), read_profits(spark, profit)
        except AnalysisException as missing:
            print(f"[SKIP] {name}: {missing.getCondition()}")
            continue
        print(dataset_header(name, tx.select("tid").distinct().count()))
        first = len(rows)
        for min_prob, k, strategy in product(min_probs, ks, strategies):
            for tasks in (1,) if strategy == "local" else threads or (spark.sparkContext.defaultParallelism,):
                for run in range(1, runs + 1):
                    began = time.perf_counter()
                    with shuffled_to(spark, tasks):
                        result = STRATEGIES[strategy](tx, profits, k, min_prob, tasks=tasks)
                        found = result.patterns.count()
                    ms = milliseconds(began, time.perf_counter())
                    rows.append((name, strategy, k, min_prob, tasks, run, ms, *result.phases, found, result.extended, result.tried))
                results[name, strategy, k, min_prob] = result
                if out:
                    setting = f"{name}_{strategy}_k{k}_p{min_prob:.2f}_t{tasks}"
                    write_patterns(result.patterns, f"{out}/{name}/patterns_{setting}.txt", f"Dataset={name}  Algo={strategy}  k={k}  minProb={min_prob:.2f}  threads={tasks}")
        if out:
            write_performance(spark.createDataFrame(rows[first:], RUNS), f"{out}/{name}/performance.csv")
    return spark.createDataFrame(rows, RUNS), results


@contextmanager
def shuffled_to(spark: SparkSession, tasks: int) -> Iterator[None]:
    """Shuffles go to this many tasks within the block."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def dataset_header(name: str, n: int) -> str:
    """The dataset and its number of transactions, between two bars."""
    title = f" Dataset: {name}  |  {n} transactions "
    bar = "=" * max(66, len(title) + 4)
    return f"{bar}\n{title}\n{bar}"


def medians(runs: DataFrame) -> DataFrame:
    """The upper median of each setting's times, and its counters."""
    times = F.sort_array(F.collect_list("timeTotal_ms"))
    keys = ["dataset", "k", "minProb", "algorithm", "threads"]
    return runs.groupBy(keys).agg(F.get(times, F.floor(F.count(F.lit(1)) / 2).cast("int")).alias("time_ms"), F.max("patternsFound").alias("patterns"), F.max("nodesExpanded").alias("nodes"), F.max("joinsAttempted").alias("joins"))


def speedups(summary: DataFrame, base: str = "level") -> DataFrame:
    """Time and work against the base strategy of the same setting; 0 where there is nothing to divide by, null without the base."""
    same = Window.partitionBy("dataset", "k", "minProb")
    base_time = F.max(F.when(F.col("algorithm") == base, F.col("time_ms"))).over(same)
    base_joins = F.max(F.when(F.col("algorithm") == base, F.col("joins"))).over(same)
    return summary.withColumn("speedup", F.when(F.col("time_ms") > 0, base_time / F.col("time_ms")).otherwise(F.lit(0.0))).withColumn("work_ratio", F.when(base_joins > 0, F.col("joins") / base_joins).otherwise(F.lit(0.0)))


def show(summary: DataFrame, base: str = "local") -> None:
    """Timing and work on the console, against the base strategy."""
    table = speedups(summary, base).orderBy("dataset", "minProb", "k", "algorithm")
    table.select("dataset", "k", "minProb", "algorithm", "threads", "time_ms", F.round("speedup", 2).alias("speedup"), "patterns").show(100, False)
    table.select("dataset", "k", "minProb", "algorithm", "nodes", "joins", F.round("work_ratio", 3).alias("work_ratio")).show(100, False)


def dataset_stats(tx: DataFrame) -> DataFrame:
    """Transactions, items, lengths, and density as the average length over the items."""
    sizes = tx.groupBy("tid").agg(F.count(F.lit(1)).alias("n"))
    per = sizes.agg(F.count(F.lit(1)).alias("transactions"), F.avg("n").alias("avg_length"), F.max("n").alias("max_length"))
    items = tx.agg(F.countDistinct("item").alias("items"))
    return per.join(F.broadcast(items)).select("transactions", "items", "avg_length", "max_length", (F.col("avg_length") / F.col("items")).alias("density"))


def profit_stats(profits: DataFrame) -> DataFrame:
    p = F.col("profit")
    return profits.agg(F.count(F.lit(1)).alias("items"), F.count_if(p < 0).alias("negative"), F.min(p).alias("least"), F.max(p).alias("most"), F.avg(F.when(p > 0, p)).alias("avg_positive"), F.avg(F.when(p < 0, p)).alias("avg_negative"))
