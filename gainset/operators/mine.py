"""Level-wise mining.

The state of a level has one row for each itemset and transaction that holds it.  A
level joins it with the ranked entries of its transactions, extends every itemset by
each later item, and aggregates; partial aggregates combine before the shuffle, so
what moves is one row per candidate and task.  The same join then builds the extensions
that survive, which are dealt to all tasks where they are few (their number is counted),
so that rows don't move by itemset.  After each level the threshold is the k-th utility so far.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gainset.functions import measures
from gainset.operators import topk
from gainset.operators.prepare import Prepared, few, one_item_patterns, prepare
from gainset.schema import EPS, at_least
from gainset.scratch import stored


@dataclass
class MiningResult:
    patterns: DataFrame
    #: For each level: itemsets tried, those probable enough, and those that were extended.
    levels: list[dict[str, int]] = field(default_factory=list)
    #: Milliseconds of preparation, of the one-item patterns and of the search.
    phases: list[int] = field(default_factory=lambda: [0, 0, 0])

    @property
    def tried(self) -> int:
        return sum(x["tried"] for x in self.levels)

    @property
    def extended(self) -> int:
        return sum(x["extended"] for x in self.levels)


def extensions(state: DataFrame, entries: DataFrame) -> DataFrame:
    """Every row of the state joined with the later items of its transaction."""
    later = entries.select("tid", "item", "rank", F.col("util").alias("item_util"), F.col("prob").alias("item_prob"), "rem")
    rows = state.join(later, "tid").filter(F.col("rank") > F.col("last_rank"))
    return rows.select("pid", "item", "rank", "tid", (F.col("util") + F.col("item_util")).alias("util"), (F.col("prob") * F.col("item_prob")).alias("prob"), "rem", "ptu")


def candidates(state: DataFrame, entries: DataFrame) -> DataFrame:
    return extensions(state, entries).groupBy("pid", "item", "rank").agg(*measures.all_measures())


def seeds(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One-item patterns and the state that holds them; pid is the item's rank."""
    patterns = one_item_patterns(entries).select(F.col("rank").cast("long").alias("pid"), F.array("item").alias("itemset"), "rank", "eu", "ep", "ptwu", "pub")
    state = entries.select(F.col("rank").cast("long").alias("pid"), F.col("rank").alias("last_rank"), "tid", "util", "prob", "ptu")
    return patterns, state


def promising(patterns: DataFrame, tau: float, prune: bool) -> DataFrame:
    """Itemsets of which some extension may still be among the top."""
    return patterns.filter(at_least(F.col("ptwu"), tau) & at_least(F.col("pub"), tau)) if prune else patterns


def mine(tx: DataFrame, profits: DataFrame, k: int, min_prob: float, keep_zero_ptwu: bool = False, prune: bool = True, most_candidates: int | None = None) -> MiningResult:
    """The top k itemsets with a probability of at least ``min_prob``, exactly.

    Fewer than k if there are fewer; utilities may be negative.  ``prune=False`` keeps
    only the probability bound.  ``most_candidates`` raises, and never truncates, once
    a level has more: without k itemsets of positive utility the search is exponential.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    began = time.perf_counter()
    prepared = prepare(tx, profits, min_prob, keep_zero_ptwu)
    ready = time.perf_counter()
    result = grow(prepared, k, min_prob, prune, most_candidates)
    result.phases[0] = milliseconds(began, ready)
    return result


def milliseconds(began: float, ended: float) -> int:
    return int((ended - began) * 1000)


def grow(prepared: Prepared, k: int, min_prob: float, prune: bool = True, most_candidates: int | None = None, first: DataFrame | None = None, tau: float = topk.NOTHING) -> MiningResult:
    """The levels of ``mine``; with ``first`` only of itemsets that begin with items of these ranks, from a threshold that is known."""
    began = time.perf_counter()
    entries = stored(prepared.entries, "entries", free=False)
    patterns, state = seeds(entries)
    patterns = stored(patterns, "patterns", free=False)
    n = patterns.count()
    best, reached = topk.kept(topk.top(patterns, k), k)
    tau = max(tau, reached)
    result, seeded = MiningResult(best), time.perf_counter()
    live = promising(patterns, tau, prune)
    if first is not None:
        live = live.join(first.select(F.col("rank").cast("long").alias("pid")), "pid", "left_semi")
    kept = live.count()
    state = state.join(few(live.select("pid"), kept), "pid", "left_semi")
    result.levels.append({"level": 1, "tried": n, "probable": n, "extended": kept})
    while kept:
        # An item whose own bound is below the threshold extends nothing; it still counted for ``rem``.
        useful = entries.filter(at_least(F.col("item_ptwu"), tau)) if prune else entries
        state = stored(state, "state", free=False)
        parents = few(live.select("pid", F.col("itemset").alias("parent")), kept)
        tried = candidates(state, useful).join(parents, "pid")
        tried = tried.withColumn("itemset", F.array_sort(F.array_append("parent", F.col("item")))).withColumn("next", F.monotonically_increasing_id())
        seen = Observation()
        tried = tried.select("pid", "next", "itemset", "rank", "eu", "ep", "ptwu", "pub").observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.col("ep") >= min_prob - EPS).alias("probable"))
        tried = stored(tried, "patterns", free=False)
        count, probable = seen.get["n"], seen.get["probable"]
        if most_candidates is not None and count > most_candidates:
            raise RuntimeError(f"level {len(result.levels) + 1} has {count} candidates; raise k's utility or min_prob")
        if not probable:
            result.levels.append({"level": len(result.levels) + 1, "tried": count, "probable": 0, "extended": 0})
            break
        found = tried.filter(F.col("ep") >= min_prob - EPS)
        best, reached = topk.kept(topk.merge(best, found.filter(at_least(F.col("eu"), tau)), k), k)
        tau = max(tau, reached)
        survivors = promising(found, tau, prune)
        kept = survivors.count()
        result.levels.append({"level": len(result.levels) + 1, "tried": count, "probable": probable, "extended": kept})
        step = few(survivors.select("pid", "rank", "next"), kept)
        state = extensions(state, useful).join(step, ["pid", "rank"]).select(F.col("next").alias("pid"), F.col("rank").alias("last_rank"), "tid", "util", "prob", "ptu")
        live = survivors.select(F.col("next").alias("pid"), "itemset")
    result.patterns = best
    result.phases[1:] = milliseconds(began, seeded), milliseconds(seeded, time.perf_counter())
    return result
