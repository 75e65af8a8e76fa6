"""Depth-first mining of prefixes in parallel: the same answer by other schedules.

A prefix is one item; its database is the part of every transaction from that item
on.  Prefixes whose database fits a task's budget are mined depth-first in Python,
each in its own group; prefixes beyond the budget are grown level by level, so that
no task ever holds an unbounded one.

* ``local``: one task mines all prefixes in turn, with one top k throughout; the base
  that the others are compared with.  It holds one prefix at a time.
* ``static``: prefixes go to ``n`` tasks by their rank, with the seeds' threshold.
* ``merge``: each task starts with nothing and keeps its own top k, which are merged at
  the end; the threshold of others, the seeds' too, doesn't help it.
* ``waves``: prefixes of the highest bounds first; each wave starts with the
  threshold that the waves before it reached.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gainset.operators import topk
from gainset.operators.mine import MiningResult, grow, milliseconds, seeds
from gainset.operators.prepare import prepare
from gainset.schema import EPS, PATTERNS, at_least
from gainset.scratch import stored

#: Rows of a prefix's database that one task may hold.
PREFIX_ROWS = 2_000_000
MODES = ("local", "static", "merge", "waves")
WORK = ("tried", "probable", "extended")


class _Top:
    """The best k so far, and the threshold they give."""

    def __init__(self, k: int, tau: float):
        import heapq

        self.heapq, self.k, self.tau, self.held = heapq, k, tau, []
        #: Extensions tried, those probable enough, and those that were extended.
        self.tried = self.probable = self.extended = 0

    def offer(self, itemset: tuple[int, ...], eu: float, ep: float) -> None:
        entry = (eu, -len(itemset), tuple(-i for i in itemset), ep)
        if len(self.held) < self.k:
            self.heapq.heappush(self.held, entry)
        elif entry > self.held[0]:
            self.heapq.heapreplace(self.held, entry)
        if len(self.held) == self.k:
            self.tau = max(self.tau, self.held[0][0])


def _slack(tau: float) -> float:
    return tau - max(EPS, 1e-12 * abs(tau)) if math.isfinite(tau) else tau


def mine_prefix(rows: pd.DataFrame, best: _Top, min_prob: float) -> None:
    """All itemsets of two items or more that begin with the rows' first item by rank.

    ``rows``: tid, item, rank, util, prob, rem, ptu of one prefix's database.
    """
    rows = rows.sort_values(["rank", "tid"], kind="stable")
    columns = [rows[c].to_numpy() for c in ("tid", "util", "prob", "rem", "ptu")]
    cuts = np.flatnonzero(np.diff(rows["rank"].to_numpy(), prepend=-1))
    bounds = np.append(cuts, len(rows))
    items = rows["item"].to_numpy()[cuts]
    lists = [[c[a:b] for c in columns] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def extend(itemset: tuple[int, ...], held: list[np.ndarray], after: int) -> None:
        for i in range(after, len(lists)):
            best.tried += 1
            tids, left, right = np.intersect1d(held[0], lists[i][0], assume_unique=True, return_indices=True)
            if not len(tids):
                continue
            util, prob = held[1][left] + lists[i][1][right], held[2][left] * lists[i][2][right]
            rem, ptu = lists[i][3][right], held[3][left]
            ep = 1 - np.prod(1 - prob)
            if ep < min_prob - EPS:
                continue
            best.probable += 1
            eu = float((util * prob).sum())
            grown = (*itemset, int(items[i]))
            if eu >= _slack(best.tau):
                best.offer(tuple(sorted(grown)), eu, float(ep))
            total = util + rem
            if ptu.sum() >= _slack(best.tau) and (prob * np.maximum(total, 0)).sum() >= _slack(best.tau):
                best.extended += 1
                extend(grown, [tids, util, prob, ptu], i + 1)

    if lists:
        first = lists[0]
        extend((int(items[0]),), [first[0], first[1], first[2], first[4]], 1)


def _task(k: int, seed: float, min_prob: float):
    """Mines the prefixes of one group, and gives the best k that reach the seed, and a row without itemset that holds its work."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        top = _Top(k, seed)
        for _, own in group.groupby("prefix", sort=True):
            mine_prefix(own, top, min_prob)
        return _found(top)

    return run


def _found(top: _Top) -> pd.DataFrame:
    found = [([-i for i in items], eu, ep, 0, 0, 0) for eu, _, items, ep in top.held]
    return pd.DataFrame([*found, (None, None, None, top.tried, top.probable, top.extended)], columns=["itemset", "eu", "ep", *WORK])


def _in_turn(k: int, seed: float, min_prob: float):
    """As ``_task`` over all rows of one task, which come prefix by prefix; holds those of one prefix."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top, held = _Top(k, seed), []

        def mined() -> None:
            if held:
                mine_prefix(pd.concat(held), top, min_prob)
                held.clear()

        for part in parts:
            for prefix, own in part.groupby("prefix", sort=True):
                if held and held[0]["prefix"].iloc[0] != prefix:
                    mined()
                held.append(own)
        mined()
        yield _found(top)

    return run


def prefix_rows(entries: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The database of each prefix (column ``prefix``, a rank): its transactions from that item on."""
    heads = entries.join(prefixes, entries["rank"] == prefixes["prefix"]).select("tid", "prefix")
    return heads.join(entries, "tid").filter(F.col("rank") >= F.col("prefix"))


def mine_partitioned(tx: DataFrame, profits: DataFrame, k: int, min_prob: float, mode: str = "static", tasks: int = 16, waves: int = 3, prefix_budget: int | None = None) -> MiningResult:
    """As ``mine``, by prefixes; ``mode`` is ``local``, ``static``, ``merge`` or ``waves``.

    Prefixes of more rows than ``prefix_budget``, ``PREFIX_ROWS`` if it isn't given, are grown by level in
    every mode.  With a budget given, ``local`` raises ``ValueError`` where the databases of all prefixes are beyond it.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if k < 1:
        raise ValueError("k must be at least 1")
    began = time.perf_counter()
    prepared = prepare(tx, profits, min_prob)
    ready = time.perf_counter()
    entries = stored(prepared.entries, "entries", free=False)
    patterns, _ = seeds(entries)
    patterns = stored(patterns, "patterns", free=False)
    best = stored(topk.top(patterns, k), "top", free=False)
    tau = topk.threshold(best, k)
    seeded = time.perf_counter()
    sized = _sized(entries, patterns)
    total, most = sized.agg(F.count(F.lit(1)), F.sum("rows")).first()
    if mode == "local" and prefix_budget is not None and (most or 0) > prefix_budget:
        raise ValueError(f"{most} rows are too many for one task")
    prefix_budget = PREFIX_ROWS if prefix_budget is None else prefix_budget
    slices = waves if mode == "waves" else 1
    work = [total, total, 0]
    for wave in range(slices):
        low, high = wave * total // slices, (wave + 1) * total // slices
        known = topk.NOTHING if mode == "merge" else tau
        live = sized.filter((F.col("rank") >= low) & (F.col("rank") < high) & at_least(F.col("ptwu"), known) & at_least(F.col("pub"), known))
        work[2] += live.count()
        small = live.filter(F.col("rows") <= prefix_budget).select(F.col("rank").alias("prefix"))
        rows = prefix_rows(entries, small)
        work_rows = PATTERNS + "".join(f", {w} long" for w in WORK)
        if mode == "local":
            inputs = rows.select("prefix", "tid", "item", "rank", "util", "prob", "rem", "ptu")
            found = inputs.repartition(1).sortWithinPartitions("prefix").mapInPandas(_in_turn(k, known, min_prob), work_rows)
        else:
            # A task mines one prefix at a time when its prefixes are large, else several small ones together.
            bucket = F.col("prefix") if mode == "waves" else F.col("prefix") % tasks
            heavy = prefix_budget // max(1, total // max(1, tasks) + 1)
            grouped = rows.withColumn("bucket", bucket).join(sized.select(F.col("rank").alias("prefix"), "rows"), "prefix")
            grouped = grouped.withColumn("own", F.when(F.col("rows") > heavy, F.col("prefix")).otherwise(F.lit(-1)))
            grouped = grouped.select("bucket", "own", "prefix", "tid", "item", "rank", "util", "prob", "rem", "ptu")
            found = grouped.groupBy("bucket", "own").applyInPandas(_task(k, known, min_prob), work_rows)
        found = stored(found, "found", free=False)
        done = found.filter("itemset is null").agg(*[F.sum(w) for w in WORK]).first()
        work = [a + (b or 0) for a, b in zip(work, done, strict=True)]
        best = stored(topk.merge(best, found.filter("itemset is not null"), k), "top", free=False)
        tau = topk.threshold(best, k)
        large = live.filter(F.col("rows") > prefix_budget).select("rank")
        if large.limit(1).count():
            more = grow(prepared, k, min_prob, first=large, tau=tau)
            both = best.unionByName(more.patterns).groupBy("itemset").agg(F.max("eu").alias("eu"), F.max("ep").alias("ep"))
            best = stored(topk.top(both, k), "top", free=False)
            tau = topk.threshold(best, k)
            work = [a + sum(x[w] for x in more.levels[1:]) for a, w in zip(work, WORK, strict=True)]
    phases = [milliseconds(began, ready), milliseconds(ready, seeded), milliseconds(seeded, time.perf_counter())]
    return MiningResult(best, [{"level": 0, **dict(zip(WORK, work, strict=True))}], phases)


def _sized(entries: DataFrame, patterns: DataFrame) -> DataFrame:
    """Patterns of one item with the rows of their databases."""
    heads = entries.select("tid", F.col("rank").alias("head"))
    per = heads.join(entries.groupBy("tid").agg(F.sort_array(F.collect_list("rank")).alias("ranks")), "tid")
    rows = per.groupBy("head").agg(F.sum(F.size(F.filter("ranks", lambda r: r >= F.col("head")))).alias("rows"))
    return stored(patterns.join(rows, patterns["rank"] == rows["head"]).drop("head"), "sized", free=False)
