"""Dedup operators against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from gainset.llm import op2_exact, op3_minhash, op5_lines, op7_suffix, op9_phrases, recurrence, resolvers
from gainset.llm.components import components
from gainset.llm.resolvers import Automaton, SuffixArray

SCHEMA = "doc_id long, text string, did string, node string, text_sha256 string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)


def corpus(seed, unit, n=40):
    rng = random.Random(seed)
    words = ["a", "b", "cc", "é", "dd.", "A"]
    passage = [rng.choice(words) for _ in range(30)]
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, unit.join(["a"] * 60))]
    for i in range(10, 10 + n):
        body = [rng.choice(words) for _ in range(rng.randint(0, 25))]
        if rng.random() < 0.5:
            low = rng.randint(0, 15)
            at = rng.randint(0, len(body))
            body[at:at] = passage[low : low + rng.randint(5, 15)]
        rows.append((i, unit.join(body)))
    rows += [(90, rows[12][1]), (91, rows[13][1]), rows[14], (None, rows[15][1])]
    rng.shuffle(rows)
    return rows


def covered(rows, split, length, later_only):
    """Per (id, text): units and whether each is removed."""
    docs = sorted({(-(1 << 63) if i is None else i, t or "") for i, t in rows})
    places = defaultdict(list)
    units = {d: split(d[1]) for d in docs}
    for d in docs:
        for i in range(len(units[d]) - length + 1):
            places[tuple(units[d][i : i + length])].append((d, i))
    gone = {d: [False] * len(units[d]) for d in docs}
    for found in places.values():
        for d, i in found[1:] if later_only else found if len(found) > 1 else []:
            gone[d][i : i + length] = [True] * length
    return units, gone


def check(rows, out, split, join, length, later_only):
    units, gone = covered(rows, split, length, later_only)
    want = []
    for i, t in rows:
        d = (-(1 << 63) if i is None else i, t or "")
        g = gone[d]
        spans = sum(1 for k in range(len(g)) if g[k] and (k == 0 or not g[k - 1]))
        want.append((str(i), len(g), sum(g), spans, join([u for u, x in zip(units[d], g, strict=True) if not x])))
    got = [(str(r.doc_id), r.n_units, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect()]
    assert sorted(got) == sorted(want)


OPERATORS = {
    "bytes": (" ", lambda d: op7_suffix.remove_repeated_strings(d, length=9, spread=6, trigger=2), lambda t: list(t.encode()), bytes, 9, False),
    "words": (" ", lambda d: op9_phrases.remove_later_passages(d, length=4, spread=3, gram=2), lambda t: t.encode().split(), b" ".join, 4, True),
    "lines": ("\n", lambda d: op5_lines.remove_later_runs(d, run=3), lambda t: t.encode().split(b"\n"), b"\n".join, 3, True),
}


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("tight", [False, True])
def test_recurring_windows(spark, monkeypatch, name, tight):
    unit, operator, split, join, length, later = OPERATORS[name]
    if tight:  # every path: small blocks, split cores, resolved bit by bit
        monkeypatch.setattr(recurrence, "BLOCK_ANCHORS", 20)
        monkeypatch.setattr(recurrence, "TOGETHER", 2)
        monkeypatch.setattr(recurrence, "RESOLVED_BYTES", 64)
    rows = corpus(7, unit)
    check(rows, operator(docs_of(spark, rows).repartition(3)), split, join, length, later)


def test_long_lines_and_pairs_go_as_well(spark):
    rng = random.Random(4)
    pool = [" ".join(rng.choice("ab") for _ in range(n)) for n in (1, 1, 2, 3, 4, 4, 5, 6, 8) for _ in range(3)]
    rows = [(1, None), (2, ""), (3, pool[-1]), (4, pool[-1]), (5, f"{pool[9]}\n{pool[12]}"), (6, f"{pool[9]}\n{pool[12]}"), (7, "x"), (8, "x")]
    rows += [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 7)))) for i in range(10, 40)] + [(None, pool[-2]), (None, "u v"), (9, pool[-2]), (9, pool[-2])]
    docs = sorted({(-(1 << 63) if i is None else i, t or "") for i, t in rows})
    lines = {d: d[1].split("\n") for d in docs}
    gone, places = {d: [False] * len(lines[d]) for d in docs}, defaultdict(list)
    for d in docs:
        for n in (1, 2, 3):
            for i in range(len(lines[d]) - n + 1):
                window = tuple(lines[d][i : i + n])
                if n == 3 or sum(len(x.split()) for x in window) >= 6:
                    places[window].append((d, i))
    for window, found in places.items():
        for d, i in found[1:]:
            gone[d][i : i + len(window)] = [True] * len(window)
    want = []
    for i, t in rows:
        d = (-(1 << 63) if i is None else i, t or "")
        g = gone[d]
        want.append((str(i), len(g), sum(g), sum(1 for k in range(len(g)) if g[k] and (k == 0 or not g[k - 1])), "\n".join(x for x, out in zip(lines[d], g, strict=True) if not out).encode()))
    got = [(str(r.doc_id), r.n_units, r.n_removed, r.n_spans, bytes(r.kept)) for r in op5_lines.remove_later_passages(docs_of(spark, rows).repartition(3), words=6).collect()]
    assert sorted(got) == sorted(want)
    four = {r.doc_id: r for r in op5_lines.remove_later_passages(docs_of(spark, rows), words=6).collect()}[4]
    assert four.n_removed == 1 and op5_lines.remove_later_passages(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, name):
    assert OPERATORS[name][1](docs_of(spark, [])).count() == 0


def test_shape_must_fit():
    with pytest.raises(ValueError):
        recurrence.Shape("word", 4, 4, 2)


def test_sliding_least():
    x = np.random.default_rng(0).integers(0, 1000, 57).astype(np.uint64)
    assert recurrence.sliding_least(x, 5).tolist() == [x[i : i + 5].min() for i in range(53)]


def test_resolvers_number_equal_windows_alike():
    phrases = [b"a b c d", b"b c d a b c", b"c d a"]
    for resolver, width, cut in ((Automaton(3), 3, lambda p, i: tuple(p.split()[i : i + 3])), (SuffixArray(5), 5, lambda p, i: p[i : i + 5])):
        number = defaultdict(set)
        row, start, n = resolver(phrases)
        for r, s, k in zip(row, start, n, strict=True):
            number[k].add(cut(phrases[r], s))
        assert all(len(x) == 1 for x in number.values()) and len(number) == len({next(iter(x)) for x in number.values()})


def test_exact_groups(spark):
    rows = [(1, "x"), (2, "x"), (3, "X"), (4, None), (5, ""), (None, "x"), (None, "q"), (7, "r"), (7, "r")] + [(i, "hot") for i in range(100, 200)]
    got = {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size, r.kept) for r in op2_exact.exact_groups(docs_of(spark, rows)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1, sha("x")] == (2, 3, False) and got[2, sha("x")] == (2, 3, True) and got[None, sha("x")] == (2, 3, False)
    assert got[3, sha("X")] == (3, 1, True) and got[4, sha("")] == (5, 2, False) and got[5, sha("")] == (5, 2, True)
    assert got[None, sha("q")] == (None, 1, True) and got[7, sha("r")] == (7, 2, True)
    assert got[150, sha("hot")] == (199, 100, False)
    kept = op2_exact.kept_documents(docs_of(spark, rows))
    assert kept.columns == ["doc_id", "text", "did", "node", "text_sha256"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["2", "3", "5", "None", "7", "7", "199"])
    assert op2_exact.exact_groups(docs_of(spark, [])).count() == 0


def test_bloom_filter_passes_every_repeat(spark):
    digests = spark.range(3000).selectExpr("id as doc_id", "sha2(string(id % 2990), 256) as text_sha256")
    tested = op2_exact.possibly_repeated(digests, 3000)
    assert {r.doc_id for r in tested.filter("maybe").collect()} >= {i for i in range(10)} | {2990 + i for i in range(10)}
    assert tested.filter("maybe").count() < 200


def shingles(text, n=3):
    words = (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def test_near_duplicates(spark):
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, "One two"), (4, "one TWO"), (5, "one"), (None, "lone words of no id here"), (9, " ")]
    words = [f"w{i}" for i in range(400)]
    for g in range(6):
        base = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        for j in range(8):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((100 + 10 * g + j, " ".join(own)))
    base = [rng.choice(words) for _ in range(120)]
    for j in range(60):  # a large group around the threshold, most pairs of which aren't links
        own = list(base)
        for _ in range(rng.randint(0, 7)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((300 + j, " ".join(own)))
    rows.append(rows[-1])
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    want = sorted((str(i), len(sets[i]), str(find(i)), i == find(i)) for i, _ in rows)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in op3_minhash.near_duplicates(docs_of(spark, rows)).collect())
    assert got == want
    kept = op3_minhash.kept_documents(docs_of(spark, rows), op3_minhash.Similarity(5, 80))
    assert kept.columns == ["doc_id", "text", "did", "node", "text_sha256"] and kept.count() < len(rows)
    assert op3_minhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_near_stage_tells_texts_of_one_id_apart(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    texts = [[rng.choice(words) for _ in range(60)] for _ in range(7)]
    near = [" ".join([*t[:59], "changed"]) for t in texts]
    a, b, c, d, e, f, g = [" ".join(t) for t in texts]
    rows = [(1, a), (None, near[0]), (None, b), (None, c), (None, near[2]), (5, d), (5, near[3]), (5, e), (8, f), (None, f), (None, g), (None, g), (None, None), (None, None)]
    kept = sorted((str(r.doc_id), str(r.text)) for r in op3_minhash.kept_documents(docs_of(spark, rows), op3_minhash.Similarity(5, 80)).collect())
    assert sum(1 for _, t in kept if t in (c, near[2])) == 1 and sum(1 for _, t in kept if t in (d, near[3])) == 1
    others = sorted(x for x in kept if x[1] not in (c, near[2], d, near[3]))
    assert others == sorted([("1", a), ("None", b), ("5", e), ("8", f), ("None", g), ("None", "None"), ("None", "None")])


def test_odd_sketch_counts_differences():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 62, (1, op3_minhash.SAMPLES), dtype=np.uint64)
    b = a.copy()
    b[0, :10] += np.uint64(1)
    bits = sum(int(x).bit_count() for x in (op3_minhash.odd_sketch(a) ^ op3_minhash.odd_sketch(b))[0])
    assert 10 <= bits <= 20 and not (op3_minhash.odd_sketch(a) ^ op3_minhash.odd_sketch(a)).any()


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {x: find(x) for ab in links if ab[0] != ab[1] for x in ab}
    assert {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()} == want


@pytest.mark.parametrize("name", OPERATORS)
def test_texts_without_repeats(spark, name):
    unit, operator, split, join, length, later = OPERATORS[name]
    rng = random.Random(8)
    unique = lambda n: unit.join(f"{rng.random():.17f}" for _ in range(n))
    for rows in ([(1, unique(40))], [(i, unique(rng.randint(1, 60))) for i in range(12)]):
        for partitions in (1, 4):
            check(rows, operator(docs_of(spark, rows).repartition(partitions)), split, join, length, later)


@pytest.mark.parametrize("name", OPERATORS)
def test_long_texts_go_in_segments(spark, monkeypatch, name):
    unit, operator, split, join, length, later = OPERATORS[name]
    monkeypatch.setattr(recurrence, "SEGMENT", 50)
    rng = random.Random(11)
    long = unit.join(rng.choice(["a", "b", "cc", "d", "é"]) for _ in range(700))
    check([(1, long), (2, unit.join(["a"] * 300)), (3, long[100:500])], operator(docs_of(spark, [(1, long), (2, unit.join(["a"] * 300)), (3, long[100:500])])), split, join, length, later)


def test_places_are_what_the_automaton_finds(monkeypatch):
    import ahocorasick

    class Blind:
        add_word = make_automaton = lambda self, *a: None
        iter = lambda self, text: iter(())

    phrases = [b"a b c d", b"b c d a b c"]
    assert len(set(Automaton(3)(phrases)[2])) == 4
    monkeypatch.setattr(ahocorasick, "Automaton", Blind)
    assert len(set(Automaton(3)(phrases)[2])) == 6


def test_order_of_a_shard_is_that_of_its_suffixes():
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 300))) for _ in range(20)]
    offsets = np.append(0, np.cumsum([len(x) for x in strings]))
    order = SuffixArray(9).order(np.frombuffer(b"".join(strings), np.uint8), offsets, np.arange(offsets[-1]))
    row = np.searchsorted(offsets, order, "right") - 1
    suffixes = [strings[r][p - offsets[r] :] for r, p in zip(row, order, strict=True)]
    assert suffixes == sorted(suffixes)


def test_rounds_of_suffix_ranks_sort_only_what_had_equals(monkeypatch):
    sequences = [[3, 1, 4, 1, 5, 9, 2, 6], [5, 3, 5, 8, 9, 7], [9, 2, 6], [7] * 40]
    symbols = np.array([x for s in sequences for x in [*s, 0]])
    left = np.concatenate([np.arange(len(s) + 1, 0, -1) for s in sequences])
    sizes, sort = [], np.argsort
    monkeypatch.setattr(resolvers.np, "argsort", lambda x, **k: sizes.append(len(x)) or sort(x, **k))
    ranks = resolvers.suffix_ranks(symbols, 1, left)
    suffixes = [symbols[i : i + n].tolist() for i, n in enumerate(left)]
    assert ranks.tolist() == [sum(other < own for other in suffixes) for own in suffixes]
    assert sizes[0] == len(symbols) and all(b < a for a, b in zip(sizes, sizes[1:], strict=False))


def test_one_row_of_equal_rows(spark):
    rows = [(7, "r"), (7, "r"), (None, "q"), (None, "q"), (3, "q"), (None, None), (None, ""), (1, "x")]
    kept = op2_exact.kept_documents(docs_of(spark, rows), one_row=True)
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == [("1", "x"), ("3", "q"), ("7", "r"), ("None", "")]
    assert op2_exact.kept_documents(docs_of(spark, []), one_row=True).count() == 0


def test_filter_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(op2_exact, "MOST_BITS", 1 << 15)
    rows = [(i, f"text {i % 2990}") for i in range(3000)]
    got = op2_exact.exact_groups(docs_of(spark, rows))
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got.collect()) == [(i, 2990 + i % 2990 if i % 2990 < 10 else i, 2 if i % 2990 < 10 else 1) for i in range(3000)]
    assert op2_exact.kept_documents(docs_of(spark, rows), one_row=True).count() == 2990
    assert 1 - (1 - 2.0 ** -op2_exact.filter_bits(10**9)) ** 10**9 < 0.04  # unique rows that shuffle in vain


@pytest.mark.parametrize("direct", [2_048, 8])
def test_large_group_of_copies_with_a_common_change(spark, monkeypatch, direct):
    monkeypatch.setattr(op3_minhash, "DIRECT", direct)  # 8: finer and finer buckets
    rng = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(100)]
    rows = []
    for j in range(400 if direct > 8 else 80):
        own = list(base)
        if j % 3 == 0:
            own[40:44] = ["changed", "alike", "in", "many"]
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(100)] = rng.choice(words)
        rows.append((j, " ".join(own)))
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    pairs, confirmed = [], op3_minhash._confirmed
    monkeypatch.setattr(op3_minhash, "_confirmed", lambda p, *a: (pairs.append(p.count()), confirmed(p, *a))[1])
    got = {r.doc_id: r.component_id for r in op3_minhash.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == {i: find(i) for i in sets}
    assert sum(pairs) < 25 * len(rows)


def _moved(plan):
    """Rows that the exchanges of a plan that was run wrote."""
    kind = plan.getClass().getSimpleName()
    below = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(map(_moved, below))


def test_texts_that_are_not_wanted_stay_where_they_are(spark, monkeypatch):
    """Beyond what is broadcast only wanted texts meet what is known of them in a shuffle, and groups are the same."""
    rng = random.Random(3)
    bodies = [[rng.choice("abcdefghij") for _ in range(40)] for _ in range(60)]
    rows = [(i, " ".join(bodies[i % 60] + ["x"] * (i // 60))) for i in range(120)] + [(None, " ".join(bodies[0])), (7, " ".join(bodies[1] + ["y"]))]
    want = sorted(map(str, op3_minhash.near_duplicates(docs_of(spark, rows)).collect()))
    monkeypatch.setattr(op3_minhash, "MOST_BROADCAST", 0)
    monkeypatch.setattr(op2_exact, "BITS_PER_ROW", 1 << 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(str, op3_minhash.near_duplicates(docs_of(spark, rows)).collect())) == want
        texts = spark.createDataFrame([(i // 2, i % 2, f"t{i}") for i in range(3000)], "did long, dkey long, text string")
        wanted = spark.createDataFrame([(bytes([i]), 50 * i, i % 2) for i in range(30)], "node binary, did long, dkey long")
        out = op3_minhash._texts_of(texts, wanted)
        assert sorted((bytes(r.node), r.text) for r in out.collect()) == [(bytes([i]), f"t{100 * i + i % 2}") for i in range(30)]
        assert _moved(out._jdf.queryExecution().executedPlan()) < 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_group_below_the_threshold_costs_no_square(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(2000)]
    base = [rng.choice(words) for _ in range(1000)]  # so many that sketches say little
    rows = []
    for j in range(150):
        own = list(base)
        for at in rng.sample(range(1, 1000, 3), rng.randint(24, 30)):
            own[at] = rng.choice(words)
        rows.append((j, " ".join(own)))
    pairs, confirmed = [], op3_minhash._confirmed
    monkeypatch.setattr(op3_minhash, "_confirmed", lambda p, *a: (pairs.append(p.count()), confirmed(p, *a))[1])
    assert op3_minhash.near_duplicates(docs_of(spark, rows)).count() == 150
    assert sum(pairs) < 4 * len(rows)


@pytest.mark.parametrize("looks", [1, 500, 1 << 20])
def test_links_of_a_group(monkeypatch, looks):
    monkeypatch.setattr(op3_minhash, "LOOKS", looks)
    like = op3_minhash.Similarity()
    for seed in range(12):
        rng = np.random.default_rng(seed)
        m, base, pool = 10 + 12 * seed, rng.integers(1 << 62, size=60), rng.integers(1 << 62, size=30)
        sets = [(set(base.tolist()) - set(rng.choice(base, rng.integers(0, 12)).tolist())) | set(rng.choice(pool, rng.integers(0, 12)).tolist()) for _ in range(m)]
        links = {(a, b) for a in range(m) for b in range(m) if a != b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
        label, cut = rng.integers(0, m, m) if seed % 2 else np.arange(m), int(rng.integers(1, m))

        def classes(pairs, label=label):
            own = label.copy()
            for a, b in pairs:
                own[own == own[a]] = own[b]
            return [own.tolist().index(x) for x in own]

        parts = [(np.concatenate([list(s) for s in some]), np.array([len(s) for s in some])) for some in (sets[:cut], sets[cut:])]
        got = op3_minhash.group_links(parts, int(rng.integers(m)), label, like)
        assert set(got) <= links and len(got) < m and classes(got) == classes(links)
