"""Registered queries of the mining engine and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gainset.functions import measures
from gainset.operators import prepare as prep
from gainset.operators import topk
from gainset.operators.experiment import dataset_stats, medians, profit_stats, speedups
from gainset.operators.mine import extensions, mine, seeds
from gainset.operators.strategies import mine_partitioned
from gainset.operators.synth import average_utilities, sales, signed_profits, transactions
from gainset.plans import oracles
from gainset.schema import EPS, itemset_text
from gainset.sources.text import encode_transactions, parse_transactions

MIN_PROB = 0.7
Query = Callable[[SparkSession, str], DataFrame]


def _data(spark: SparkSession, sf_dir: str, item: str, positive: bool = False) -> tuple[DataFrame, DataFrame]:
    rows = sales(spark, sf_dir, item)
    profits = signed_profits(average_utilities(rows))
    return transactions(rows), profits.withColumn("profit", F.abs("profit")) if positive else profits


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.known_entries(*_data(spark, sf_dir, "brand"))


def _prepared(spark: SparkSession, sf_dir: str) -> prep.Prepared:
    return prep.prepare(*_data(spark, sf_dir, "brand"), MIN_PROB)


def _measured(rows: DataFrame) -> DataFrame:
    names = [("eu", 2), ("ep", 6), ("ptwu", 2), ("pub", 2)]
    return rows.select(itemset_text().alias("itemset"), *[F.round(n, d).alias(n) for n, d in names])


def _patterns(rows: DataFrame) -> DataFrame:
    return rows.select(itemset_text().alias("itemset"), F.round("eu", 2).alias("eu"), F.round("ep", 6).alias("ep"))


def _level(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """All n-item patterns that are probable enough, by n - 1 joins and without other pruning."""
    entries = _prepared(spark, sf_dir).entries
    state = entries.select(F.array("item").alias("pid"), F.col("rank").alias("last_rank"), "tid", "util", "prob", "ptu", "rem")
    for _ in range(n - 1):
        grown = extensions(state.drop("rem"), entries)
        state = grown.select(F.array_append("pid", F.col("item")).alias("pid"), F.col("rank").alias("last_rank"), "tid", "util", "prob", "rem", "ptu")
    return state.groupBy(F.array_sort("pid").alias("itemset")).agg(*measures.all_measures()).filter(F.col("ep") >= MIN_PROB - EPS)


def uncertain_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _data(spark, sf_dir, "part")[0].select("tid", "item", "qty", F.round("prob", 9).alias("prob"))


def token_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = encode_transactions(_data(spark, sf_dir, "brand")[0])
    return parse_transactions(lines.withColumnRenamed("tid", "line")).select("tid", "item", "qty", F.round("prob", 9).alias("prob"))


def valid_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = prep.split_valid(_data(spark, sf_dir, "brand")[0])
    return good.agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("valid")).unionByName(bad.agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("invalid")))


def profit_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _data(spark, sf_dir, "part")[1]


def dataset_stats_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset_stats(_data(spark, sf_dir, "brand")[0]).select("transactions", "items", "max_length", F.round("avg_length", 6).alias("avg_length"), F.round("density", 6).alias("density"))


def profit_stats_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profit_stats(_data(spark, sf_dir, "brand")[1]).select("items", "negative", *[F.round(c, 4).alias(c) for c in ("least", "most", "avg_positive", "avg_negative")])


def tx_ptu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.transaction_utilities(_known(spark, sf_dir)).select("tid", F.round("ptu", 2).alias("ptu"))


def item_ptwu_ep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.item_bounds(_known(spark, sf_dir)).select("item", F.round("ptwu", 2).alias("ptwu"), F.round("ep", 6).alias("ep"))


def valid_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prep.known_entries(*_data(spark, sf_dir, "part"))
    return prep.admissible_items(prep.item_bounds(rows), 0.999999).select("item", F.round("ptwu", 2).alias("ptwu"))


def item_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir).items.select("item", "rank")


def suffix_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir).entries.select("tid", "item", F.round("rem", 2).alias("rem"))


def upu_list_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir).entries.select("item", "rank", "tid", F.round("util", 2).alias("util"), F.round("prob", 9).alias("prob"), F.round("rem", 2).alias("rem"), F.round("ptu", 2).alias("ptu"))


def upu_join_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _prepared(spark, sf_dir).entries
    grown = extensions(seeds(entries)[1], entries).join(entries.select(F.col("rank").cast("long").alias("pid"), F.col("item").alias("first")).distinct(), "pid")
    pair = F.array_join(F.array_sort(F.array("first", "item")).cast("array<string>"), ",")
    return grown.select("tid", pair.alias("itemset"), F.round("util", 2).alias("util"), F.round("prob", 9).alias("prob"), F.round("rem", 2).alias("rem"))


def prune_ep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _level(spark, sf_dir, 2).filter(F.col("ep") >= 0.999 - EPS).transform(_measured)


def _pruned(spark: SparkSession, sf_dir: str, bound: str) -> DataFrame:
    rows = _level(spark, sf_dir, 2)
    tau = rows.agg(F.expr(f"percentile({bound}, 0.5)").alias("tau"))
    return rows.join(F.broadcast(tau)).filter(F.col(bound) >= F.col("tau") * (1 - 1e-12)).transform(_measured)


def topk_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _patterns(topk.top(seeds(_prepared(spark, sf_dir).entries)[0], 10))


def topk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _patterns(topk.merge(topk.top(_level(spark, sf_dir, 1), 15), topk.top(_level(spark, sf_dir, 2), 15), 15))


def _mining(item: str, k: int, min_prob: float = MIN_PROB, positive: bool = False) -> Query:
    return lambda spark, sf_dir: _patterns(mine(*_data(spark, sf_dir, item, positive), k, min_prob).patterns)


def _partitioned(mode: str) -> Query:
    return lambda spark, sf_dir: _patterns(mine_partitioned(*_data(spark, sf_dir, "brand"), 500, MIN_PROB, mode=mode).patterns)


def _paper(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The worked example of four transactions."""
    lines = ["1:1:0.9 2:2:0.8 3:1:1.0", "1:2:0.6 3:3:0.7", "2:1:0.5 3:2:0.9", "1:1:0.8 2:1:1.0"]
    tx = parse_transactions(spark.createDataFrame(list(enumerate(lines)), "line long, value string"))
    return tx, spark.createDataFrame([(1, 5.0), (2, -3.0), (3, 2.0)], "item int, profit double")


def paper_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _patterns(mine(*_paper(spark), 8, MIN_PROB).patterns)


def work_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Itemsets tried on each level with all bounds, and with the probability bound only."""
    data = _data(spark, sf_dir, "type")
    rows = [(name, x["level"], x["tried"], x["probable"], x["extended"]) for name, prune in (("bounded", True), ("probability", False)) for x in mine(*data, 10, MIN_PROB, prune=prune).levels]
    return spark.createDataFrame(rows, "search string, level int, tried long, probable long, extended long")


def speedup_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, speedup and work ratio over fixed times, so that the arithmetic can be checked."""
    runs = [("d", "level", 5, 0.7, 8, i, t, 0, 0, 0, 5, 10, 40) for i, t in enumerate((90, 120, 100, 80))]
    runs += [("d", "static", 5, 0.7, 8, i, t, 0, 0, 0, 5, 10, 60) for i, t in enumerate((50, 40))] + [("d", "merge", 5, 0.7, 8, 0, 0, 0, 0, 0, 5, 10, 0)]
    from gainset.operators.experiment import RUNS

    return speedups(medians(spark.createDataFrame(runs, RUNS))).select("algorithm", "time_ms", F.round("speedup", 6).alias("speedup"), F.round("work_ratio", 6).alias("work_ratio"))


def queries() -> dict[str, Query]:
    return {
        "uncertain_tx": uncertain_tx,
        "token_roundtrip": token_roundtrip,
        "valid_tx": valid_tx,
        "profit_assign": profit_assign,
        "dataset_stats": dataset_stats_brand,
        "profit_stats": profit_stats_brand,
        "tx_ptu": tx_ptu,
        "item_ptwu_ep": item_ptwu_ep,
        "valid_items": valid_items,
        "item_rank": item_rank,
        "suffix_remaining": suffix_remaining,
        "upu_list_1": upu_list_1,
        "metrics_1": lambda spark, sf_dir: _measured(_level(spark, sf_dir, 1)),
        "upu_join_2": upu_join_2,
        "metrics_2": lambda spark, sf_dir: _measured(_level(spark, sf_dir, 2)),
        "metrics_3": lambda spark, sf_dir: _measured(_level(spark, sf_dir, 3)),
        "prune_ep": prune_ep,
        "prune_ptwu": lambda spark, sf_dir: _pruned(spark, sf_dir, "ptwu"),
        "prune_pub": lambda spark, sf_dir: _pruned(spark, sf_dir, "pub"),
        "topk_seed": topk_seed,
        "topk_merge": topk_merge,
        "mine_brand_k500": _mining("brand", 500),
        "mine_part_k2500": _mining("part", 2500),
        "mine_type_all": _mining("type", 100),
        "mine_brand_all": _mining("brand", 20_000),
        "mine_brand_ep_high": _mining("brand", 200, 0.999),
        "mine_positive_only": _mining("brand", 300, positive=True),
        "mine_local": _partitioned("local"),
        "mine_partitioned": _partitioned("static"),
        "mine_local_merge": _partitioned("merge"),
        "mine_waves": _partitioned("waves"),
        "paper_example": paper_example,
        "work_counters": work_counters,
        "speedup_table": speedup_table,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.statements()
