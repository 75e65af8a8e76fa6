"""Golden, property and edge tests of the mining engine."""

from itertools import combinations
from math import prod

import numpy as np
import pytest

from gainset.operators import prepare as prep
from gainset.operators import strategies
from gainset.operators.experiment import RUNS, medians, speedups, sweep
from gainset.operators.mine import mine
from gainset.operators.strategies import mine_partitioned
from gainset.operators.synth import merged_sources, read_merged
from gainset.sources import sinks, text

LINES = ["1:1:0.9 2:2:0.8 3:1:1.0", "1:2:0.6 3:3:0.7", "2:1:0.5 3:2:0.9", "1:1:0.8 2:1:1.0"]
PROFITS = {1: 5.0, 2: -3.0, 3: 2.0}
GOLDEN = [((1,), 14.5, 0.992), ((1, 3), 13.02, 0.942), ((3,), 9.8, 1.0), ((1, 2), 0.88, 0.944), ((1, 2, 3), 0.72, 0.72), ((2, 3), -2.75, 0.89), ((2,), -9.3, 1.0)]


def frames(spark, lines, profits):
    tx = text.parse_transactions(spark.createDataFrame(list(enumerate(lines)), "line long, value string"))
    return tx, spark.createDataFrame(list(profits.items()), "item int, profit double")


def rows(result):
    return [(tuple(r.itemset), round(r.eu, 6), round(r.ep, 6)) for r in result.patterns.collect()]


def brute(lines, profits, k, min_prob):
    db = []
    for line in lines:
        parts = [t.split(":") for t in line.split()]
        db.append({int(i): (profits[int(i)] * int(q), float(p)) for i, q, p in parts if int(i) in profits and float(p) > 0})
    ptwu = {i: sum(sum(max(u, 0) for u, _ in t.values()) for t in db if i in t) for i in profits}
    out = []
    items = [i for i in sorted(profits) if ptwu[i] > 0]
    for n in range(1, len(items) + 1):
        for x in combinations(items, n):
            found = [(sum(t[i][0] for i in x), prod(t[i][1] for i in x)) for t in db if all(i in t for i in x)]
            ep = 1 - prod(1 - p for _, p in found)
            if found and ep >= min_prob - 1e-9:
                out.append((x, sum(u * p for u, p in found), ep))
    return sorted(out, key=lambda r: (-r[1], len(r[0]), r[0]))[:k]


@pytest.mark.parametrize("k", [1, 4, 8])
def test_worked_example(spark, k):
    assert rows(mine(*frames(spark, LINES, PROFITS), k, 0.7)) == [(x, pytest.approx(eu), pytest.approx(ep)) for x, eu, ep in GOLDEN[:k]]


def test_probability_bound(spark):
    assert [r[0] for r in rows(mine(*frames(spark, LINES, PROFITS), 8, 0.95))] == [(1,), (3,), (2,)]


def random_db(seed):
    rng = np.random.default_rng(seed)
    lines = [" ".join(f"{i}:{rng.integers(1, 4)}:{rng.choice([0.3, 0.55, 0.8, 1.0])}" for i in sorted(rng.choice(7, rng.integers(1, 6), replace=False))) for _ in range(12)]
    return lines, {i: float(rng.integers(-4, 8)) for i in range(6)}


@pytest.mark.parametrize("seed", [1, 2])
def test_every_schedule_agrees_with_enumeration(spark, seed):
    lines, profits = random_db(seed)
    data, want = frames(spark, lines, profits), brute(lines, profits, 12, 0.6)
    results = [mine(*data, 12, 0.6), mine(*data, 12, 0.6, prune=False), *[mine_partitioned(*data, 12, 0.6, mode=m) for m in ("static", "merge", "waves")]]
    for result in results:
        got = rows(result)
        assert [r[1] for r in got] == [pytest.approx(w[1]) for w in want]
        assert {r[0] for r in got if r[1] > want[-1][1] + 1e-6} == {w[0] for w in want if w[1] > want[-1][1] + 1e-6}


def test_prefixes_beyond_the_budget_are_grown_by_level(spark):
    lines, profits = random_db(3)
    data = frames(spark, lines, profits)
    assert [r[1] for r in rows(mine_partitioned(*data, 9, 0.5, prefix_budget=5))] == [pytest.approx(w[1]) for w in brute(lines, profits, 9, 0.5)]


def test_empty_and_unknown(spark):
    tx, profits = frames(spark, ["9:1:0.5"], {1: 1.0})
    assert rows(mine(tx, profits, 3, 0.5)) == []
    assert rows(mine(tx.limit(0), profits, 3, 0.5)) == []
    assert rows(mine_partitioned(tx, profits, 3, 0.5)) == []


def test_items_without_positive_company(spark):
    data = frames(spark, ["1:1:1.0", "9:1:1.0"], {1: 2.0, 9: -1.0})
    assert [r[0] for r in rows(mine(*data, 5, 0.5))] == [(1,)]
    assert [r[0] for r in rows(mine(*data, 5, 0.5, keep_zero_ptwu=True))] == [(1,), (9,)]
    assert rows(mine(*frames(spark, ["1:1:1.0"], {1: -2.0}), 5, 0.5)) == []


def test_certain_occurrence_and_zero_profit(spark):
    got = rows(mine(*frames(spark, ["1:1:1.0 2:1:0.5", "1:1:0.5 2:1:0.5"], {1: 0.0, 2: 3.0}), 3, 0.6))
    assert ((1,), 0.0, 1.0) in got


def test_ties_prefer_short_then_small(spark):
    got = rows(mine(*frames(spark, ["1:1:1.0", "2:1:1.0", "3:1:1.0 4:1:1.0"], {1: 2.0, 2: 2.0, 3: 1.0, 4: 1.0}), 3, 0.5))
    assert [r[0] for r in got] == [(1,), (2,), (3, 4)]


@pytest.mark.parametrize("k", [0, -1])
def test_k_must_be_positive(spark, k):
    with pytest.raises(ValueError):
        mine(*frames(spark, LINES, PROFITS), k, 0.7)


def test_guard_raises(spark):
    with pytest.raises(RuntimeError):
        mine(*frames(spark, LINES, PROFITS), 8, 0.1, most_candidates=1)


def test_bounds_hold_for_every_extension(spark):
    entries = prep.prepare(*frames(spark, LINES, PROFITS), 0.0).entries
    one = {r["item"]: r for r in prep.one_item_patterns(entries).collect()}
    assert [(i, round(one[i]["ptwu"], 6), round(one[i]["pub"], 6)) for i in (1, 3, 2)] == [(1, 28.0, 19.9), (3, 27.0, 9.8), (2, 16.0, 0.0)]
    for x, eu, ep in brute(LINES, PROFITS, 99, 0):
        first = min(x, key=lambda i: one[i]["rank"])
        assert eu <= one[first]["ptwu"] + 1e-9 and (len(x) == 1 or eu <= one[first]["pub"] + 1e-9)
        assert all(ep <= one[i]["ep"] + 1e-9 for i in x)


def test_malformed_tokens(spark):
    lines = spark.createDataFrame([(1, "1:2 a:2:0.5 1:2:0.5: :1:2 1:2:3:4"), (2, ""), (3, None), (4, "  7:1:1.0\t8:1:2 ")], "line long, value string")
    assert sorted(text.parse_transactions(lines).collect()) == [(1, 1, 2, 0.5), (4, 7, 1, 1.0), (4, 8, 1, 2.0)]


def test_last_profit_counts(spark):
    lines = spark.createDataFrame([(1, "1 2.5"), (2, "x 1"), (3, "1 -3 more"), (4, "2"), (5, "")], "line long, value string")
    assert text.parse_profits(lines).collect() == [(1, -3.0)]


def test_invalid_rows_are_set_apart(spark):
    data = [(1, 1, 1, 0.5), (1, 2, 0, 0.5), (2, 1, 1, float("nan")), (2, 2, 1, 1.5), (2, 3, 1, 0.0), (3, 1, 1, 0.5), (3, 1, 1, 0.5), (4, None, 1, 0.5)]
    good, bad = prep.split_valid(spark.createDataFrame(data, "tid long, item int, qty int, prob double"))
    assert good.collect() == [(1, 1, 1, 0.5)]
    assert sorted(r.reason for r in bad.collect()) == ["null", "probability", "probability", "probability", "quantity", "repeated", "repeated"]


def test_files_round_trip(spark, tmp_path):
    tx, profits = frames(spark, LINES, PROFITS)
    text.write_lines(text.encode_transactions(tx), f"{tmp_path}/db")
    text.write_lines(text.encode_profits(profits), f"{tmp_path}/profit")
    table, results = sweep(spark, {"a": (f"{tmp_path}/db", f"{tmp_path}/profit"), "gone": ("/nowhere/db", "/nowhere/p")}, [5], [0.7], runs=1, strategies=("level",))
    assert table.count() == 1 and [r[0] for r in rows(results["a", "level", 5, 0.7])] == [g[0] for g in GOLDEN[:5]]
    sinks.write_performance(table, f"{tmp_path}/perf")
    assert spark.read.csv(f"{tmp_path}/perf", header=True).columns == list(sinks.PERFORMANCE_COLUMNS)
    sinks.write_patterns(results["a", "level", 5, 0.7].patterns, f"{tmp_path}/patterns", "a")
    assert [r.value for r in spark.read.text(f"{tmp_path}/patterns").collect()][2] == "1\t14.5000\t0.992000\t[1]"


def test_sweep_over_threads_writes_files(spark, tmp_path, capsys):
    tx, profits = frames(spark, LINES, PROFITS)
    text.write_lines(text.encode_transactions(tx), f"{tmp_path}/db")
    text.write_lines(text.encode_profits(profits), f"{tmp_path}/profit")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    table, results = sweep(spark, {"a": (f"{tmp_path}/db", f"{tmp_path}/profit")}, [5], [0.7], runs=1, strategies=("local", "level", "static"), threads=(1, 2), out=f"{tmp_path}/out")
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert "Dataset: a  |  4 transactions" in capsys.readouterr().out
    got = table.collect()
    assert sorted((r.algorithm, r.threads) for r in got) == [("level", 1), ("level", 2), ("local", 1), ("static", 1), ("static", 2)]
    assert all(0 < r.timePhase1_ms + r.timePhase2_ms + r.timePhase3_ms <= r.timeTotal_ms for r in got)
    assert spark.read.csv(f"{tmp_path}/out/a/performance.csv", header=True).count() == 5
    for strategy, threads in (("local", 1), ("level", 2), ("static", 2)):
        lines = [r.value for r in spark.read.text(f"{tmp_path}/out/a/patterns_a_{strategy}_k5_p0.70_t{threads}.txt").collect()]
        assert lines[0] == f"# Dataset=a  Algo={strategy}  k=5  minProb=0.70  threads={threads}" and len(lines) == 7
        assert lines[2] == "1\t14.5000\t0.992000\t[1]"


def test_two_sources_merge(spark):
    utilities = text.parse_utilities(spark.createDataFrame([(0, "1 3 : 9 : 4 5"), (1, "3 : 1 : 1")], "line long, value string"))
    occurrences = text.parse_occurrences(spark.createDataFrame([(0, "1 1:0.6"), (1, "2 3:0.7")], "line long, value string"))
    tx, profits = merged_sources(utilities, occurrences)
    assert sorted(tx.collect()) == [(0, 1, 1, 0.6), (0, 3, 1, 0.1), (1, 3, 1, 0.7)]
    assert sorted(profits.collect()) == [(1, 4.0), (3, 3.0)]
    with pytest.raises(ValueError):
        merged_sources(utilities, occurrences.filter("line = 0"))


def test_lines_by_position(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(map(str, range(50))))
    got = text.by_position(text.numbered_lines(spark, str(tmp_path / "a.txt")).repartition(3).withColumn("line", __import__("pyspark.sql.functions", fromlist=["f"]).monotonically_increasing_id())).collect()
    assert sorted(r.line for r in got) == list(range(50))


def test_upper_median_and_speedup(spark):
    runs = [("d", "level", 5, 0.7, 8, i, t, 0, 0, 0, 5, 1, 4) for i, t in enumerate((9, 12, 10, 8))] + [("d", "static", 5, 0.7, 8, 0, 0, 0, 0, 0, 5, 1, 2)]
    got = {r.algorithm: (r.time_ms, r.speedup, r.work_ratio) for r in speedups(medians(spark.createDataFrame(runs, RUNS))).collect()}
    assert got == {"level": (10, 1.0, 1.0), "static": (0, 0.0, 0.5)}


def test_lines_follow_the_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "part-0").write_text("1 10.0\n2 5.0\n")
    (tmp_path / "in" / "part-1").write_text("".join(f"{i} 1.0\n" for i in range(3, 400)) + "1 99.0\n")
    lines = text.numbered_lines(spark, str(tmp_path / "in"))
    got = {r.line: r.value for r in lines.collect()}
    assert sorted(got) == list(range(400)) and got[0] == "1 10.0" and got[2] == "3 1.0" and got[399] == "1 99.0"
    assert {r.item: r.profit for r in text.read_profits(spark, str(tmp_path / "in")).collect()}[1] == 99.0


def test_invalid_rows_are_not_mined(spark):
    tx, profits = frames(spark, [*LINES, "1:1:NaN 2:1:1.7 3:1:0.0", "3:0:0.5", "1:9:0.5 1:9:0.5"], PROFITS)
    assert rows(mine(tx, profits, 8, 0.7)) == rows(mine(*frames(spark, LINES, PROFITS), 8, 0.7))


def test_merged_files_go_by_position(spark, tmp_path):
    (tmp_path / "u.txt").write_text("1 3 : 9 : 4 5\n3 : 1 : 1\n")
    (tmp_path / "o.txt").write_text("1 1:0.6\n2 3:0.7\n")
    tx, _ = read_merged(spark, str(tmp_path / "u.txt"), str(tmp_path / "o.txt"))
    assert sorted(tx.collect()) == [(0, 1, 1, 0.6), (0, 3, 1, 0.1), (1, 3, 1, 0.7)]


def test_every_schedule_counts_its_work(spark):
    lines, profits = random_db(1)
    data = frames(spark, lines, profits)
    want = brute(lines, profits, 99, 0.6)
    for mode in ("local", "static", "merge", "waves"):
        result = mine_partitioned(*data, 99, 0.6, mode=mode)  # with k this large nothing but the probability prunes
        assert [r[1] for r in rows(result)] == [pytest.approx(w[1]) for w in want]
        assert sum(x["probable"] for x in result.levels) == len(want) and result.tried >= len(want)
    few = {m: mine_partitioned(*data, 2, 0.6, mode=m).tried for m in ("local", "merge")}
    assert few["local"] <= few["merge"]
    with pytest.raises(ValueError):
        mine_partitioned(*data, 9, 0.5, mode="local", prefix_budget=1)


@pytest.mark.parametrize("budget", [5, 40])  # 40: some prefixes are beyond it
def test_one_task_mines_what_is_beyond_a_prefix_budget(spark, monkeypatch, budget):
    monkeypatch.setattr(strategies, "PREFIX_ROWS", budget)
    lines, profits = random_db(3)
    got = rows(mine_partitioned(*frames(spark, lines, profits), 9, 0.5, mode="local", prefix_budget=None))
    assert [r[1] for r in got] == [pytest.approx(w[1]) for w in brute(lines, profits, 9, 0.5)]
