"""SQL for the registered queries: exhaustive, without any of the bounds."""

from __future__ import annotations

_ITEM = {
    "part": "lineitem.l_partkey::INT AS item FROM lineitem",
    "brand": "substr(p_brand, 7)::INT AS item FROM lineitem JOIN part ON l_partkey = p_partkey",
    "type": "dense_rank() OVER (ORDER BY p_type)::INT AS item FROM lineitem JOIN part ON l_partkey = p_partkey",
}


def _base(item: str, positive: bool = False) -> str:
    sign = "abs(profit)" if positive else "profit"
    return f"""
s AS (SELECT l_orderkey AS tid, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, {_ITEM[item]}),
tx AS (SELECT tid, item, sum(quantity)::INT AS qty, 1 / (1 + 10 * max(discount)) AS prob FROM s GROUP BY 1, 2),
av AS (SELECT item, avg(price / quantity) AS average FROM s GROUP BY 1),
pr0 AS (SELECT item, CASE WHEN row_number() OVER (ORDER BY average, item) <= floor(count(*) OVER () * 0.3) THEN -round(average, 2) ELSE round(average, 2) END AS profit FROM av),
pr AS (SELECT item, {sign} AS profit FROM pr0),
kn AS (SELECT tid, item, profit * qty AS util, CASE WHEN profit > 0 THEN profit * qty ELSE 0 END AS pos, prob,
              sum(CASE WHEN profit > 0 THEN profit * qty ELSE 0 END) OVER (PARTITION BY tid) AS ptu FROM tx JOIN pr USING (item)),
ib AS (SELECT item, sum(ptu) AS ptwu, 1 - product(1 - prob) AS ep FROM kn GROUP BY 1)"""


def _entries(item: str, min_prob: float = 0.7, positive: bool = False) -> str:
    return _base(item, positive) + f""",
ok AS (SELECT item, ptwu, row_number() OVER (ORDER BY ptwu DESC, item) - 1 AS rank FROM ib WHERE ep >= {min_prob} - 1e-9 AND ptwu > 0),
e AS (SELECT tid, item, rank, util, prob, ptu, coalesce(sum(pos) OVER (PARTITION BY tid ORDER BY rank ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS rem FROM kn JOIN ok USING (item))"""


def _exhaustive(k: int, item: str = "brand", min_prob: float = 0.7, positive: bool = False) -> str:
    return f"""WITH RECURSIVE {_entries(item, min_prob, positive)},
r AS (SELECT [item] AS x, item AS last, tid, util AS u, prob AS p FROM e
      UNION ALL SELECT list_append(x, e.item), e.item, r.tid, r.u + e.util, r.p * e.prob FROM r JOIN e ON e.tid = r.tid AND e.item > r.last)
SELECT array_to_string(x, ',') AS itemset, round(eu, 2) AS eu, round(ep, 6) AS ep
FROM (SELECT x, sum(u * p) AS eu, 1 - product(1 - p) AS ep FROM r GROUP BY x HAVING 1 - product(1 - p) >= {min_prob} - 1e-9) m
ORDER BY m.eu DESC, len(x), x LIMIT {k}"""


_MEASURES = "sum(util * prob) AS eu, 1 - product(1 - prob) AS ep, sum(ptu) AS ptwu, sum(CASE WHEN util + rem > 0 THEN prob * (util + rem) ELSE 0 END) AS pub"
_ROUNDED = "itemset, round(eu, 2) AS eu, round(ep, 6) AS ep, round(ptwu, 2) AS ptwu, round(pub, 2) AS pub"
_PAIRS = """j2 AS (SELECT a.tid, [least(a.item, b.item), greatest(a.item, b.item)] AS x, a.util + b.util AS util, a.prob * b.prob AS prob, b.rem, b.rank, a.ptu
       FROM e a JOIN e b ON a.tid = b.tid AND a.rank < b.rank)"""
_TRIPLES = """j3 AS (SELECT j2.tid, list_sort(list_append(x, e.item)) AS x, j2.util + e.util AS util, j2.prob * e.prob AS prob, e.rem, j2.ptu
       FROM j2 JOIN e ON j2.tid = e.tid AND j2.rank < e.rank)"""


def _level(n: int) -> str:
    """A WITH clause that ends in ``m``: the measured n-item patterns that are probable enough."""
    source = {1: "(SELECT tid, [item] AS x, util, prob, rem, ptu FROM e)", 2: "j2", 3: "j3"}[n]
    return f"""WITH {_entries("brand")}, {_PAIRS}, {_TRIPLES},
m AS (SELECT x, array_to_string(x, ',') AS itemset, {_MEASURES} FROM {source} GROUP BY x HAVING 1 - product(1 - prob) >= 0.7 - 1e-9)"""


def _top(source: str, k: int) -> str:
    return f"(SELECT x, itemset, eu, ep FROM {source} ORDER BY eu DESC, len(x), x LIMIT {k})"


#: The worked example, recomputed from the definitions by hand.
_PAPER = """SELECT * FROM (VALUES ('1', 14.5, 0.992), ('1,3', 13.02, 0.942), ('3', 9.8, 1.0), ('1,2', 0.88, 0.944),
('1,2,3', 0.72, 0.72), ('2,3', -2.75, 0.89), ('2', -9.3, 1.0)) t(itemset, eu, ep)"""


def statements() -> dict[str, str]:
    tx = "SELECT tid, item, qty, round(prob, 9) AS prob FROM tx"
    brand, entries = f"WITH {_base('brand')}", f"WITH {_entries('brand')}"
    flagship = _exhaustive(500)
    one, two = _level(1), _level(2)
    return {
        "uncertain_tx": f"WITH {_base('part')} {tx}",
        "token_roundtrip": f"{brand} {tx}",
        "valid_tx": f"{brand} SELECT 'valid' AS part, count(*) AS n FROM tx UNION ALL SELECT 'invalid', 0",
        "profit_assign": f"WITH {_base('part')} SELECT item, profit FROM pr",
        "dataset_stats": f"{brand}, l AS (SELECT tid, count(*) AS n FROM tx GROUP BY 1), i AS (SELECT count(DISTINCT item) AS items FROM tx) SELECT count(*) AS transactions, any_value(items) AS items, max(n) AS max_length, round(avg(n), 6) AS avg_length, round(avg(n) / any_value(items), 6) AS density FROM l, i",
        "profit_stats": f"{brand} SELECT count(*) AS items, count(*) FILTER (WHERE profit < 0) AS negative, round(min(profit), 4) AS least, round(max(profit), 4) AS most, round(avg(profit) FILTER (WHERE profit > 0), 4) AS avg_positive, round(avg(profit) FILTER (WHERE profit < 0), 4) AS avg_negative FROM pr",
        "tx_ptu": f"{brand} SELECT tid, round(max(ptu), 2) AS ptu FROM kn GROUP BY 1",
        "item_ptwu_ep": f"{brand} SELECT item, round(ptwu, 2) AS ptwu, round(ep, 6) AS ep FROM ib",
        "valid_items": f"WITH {_base('part')} SELECT item, round(ptwu, 2) AS ptwu FROM ib WHERE ep >= 0.999999 - 1e-9 AND ptwu > 0",
        "item_rank": f"{entries} SELECT item, rank::INT AS rank FROM ok",
        "suffix_remaining": f"{entries} SELECT tid, item, round(rem, 2) AS rem FROM e",
        "upu_list_1": f"{entries} SELECT item, rank::INT AS rank, tid, round(util, 2) AS util, round(prob, 9) AS prob, round(rem, 2) AS rem, round(ptu, 2) AS ptu FROM e",
        "metrics_1": f"{one} SELECT {_ROUNDED} FROM m",
        "upu_join_2": f"{entries}, {_PAIRS} SELECT tid, array_to_string(x, ',') AS itemset, round(util, 2) AS util, round(prob, 9) AS prob, round(rem, 2) AS rem FROM j2",
        "metrics_2": f"{two} SELECT {_ROUNDED} FROM m",
        "metrics_3": f"{_level(3)} SELECT {_ROUNDED} FROM m",
        "prune_ep": f"{two} SELECT {_ROUNDED} FROM m WHERE ep >= 0.999 - 1e-9",
        "prune_ptwu": f"{two} SELECT {_ROUNDED} FROM m, (SELECT quantile_cont(ptwu, 0.5) AS tau FROM m) WHERE ptwu >= tau * (1 - 1e-12)",
        "prune_pub": f"{two} SELECT {_ROUNDED} FROM m, (SELECT quantile_cont(pub, 0.5) AS tau FROM m) WHERE pub >= tau * (1 - 1e-12)",
        "topk_seed": f"{one} SELECT itemset, round(eu, 2) AS eu, round(ep, 6) AS ep FROM {_top('m', 10)}",
        "topk_merge": f"{two}, o AS (SELECT [item] AS x, item::VARCHAR AS itemset, sum(util * prob) AS eu, 1 - product(1 - prob) AS ep FROM e GROUP BY item) SELECT itemset, round(eu, 2) AS eu, round(ep, 6) AS ep FROM {_top(f'(SELECT * FROM {_top("o", 15)} UNION ALL SELECT * FROM {_top("m", 15)})', 15)}",
        "mine_brand_k500": flagship,
        "mine_part_k2500": _exhaustive(2500, "part"),
        "mine_type_all": _exhaustive(100, "type"),
        "mine_brand_all": _exhaustive(20_000),
        "mine_brand_ep_high": _exhaustive(200, min_prob=0.999),
        "mine_positive_only": _exhaustive(300, positive=True),
        "mine_local": flagship,
        "mine_partitioned": flagship,
        "mine_local_merge": flagship,
        "mine_waves": flagship,
        "paper_example": _PAPER,
        "speedup_table": "SELECT * FROM (VALUES ('level', 100, 1.0, 1.0), ('static', 50, 2.0, 1.5), ('merge', 0, 0.0, 0.0)) t(algorithm, time_ms, speedup, work_ratio)",
    }
