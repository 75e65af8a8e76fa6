"""Models, tokens and decontamination."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from zlib import crc32

from gainset.llm import op1_score, op4_language, op6_bpe, op8_quality, op10_decontaminate
from gainset.llm.bpe_fst import Codec, Utf8Stream, parse_ranks

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def plain_log(net, ids, classes, i):
    """Log-probability of the i-th word's class, by the definition."""
    hidden = np.array(net.shift, float)
    for n, o in enumerate((-3, -2, -1, 1, 2, 3)):
        hidden += net.embed[ids[i + 3 + o]].astype(float) * net.scale[n]
    hidden = np.tanh(hidden)
    group, member = divmod(int(classes[i]), op1_score.SIDE)
    outer = hidden @ net.out + net.bias
    inner = hidden @ net.within[group] + net.within_bias[group]
    return outer[group] - np.log(np.exp(outer).sum()) + inner[member] - np.log(np.exp(inner).sum())


def sequence(rng, n=60):
    ids = rng.integers(0, op1_score.EMBEDDINGS, n + 6)
    ids[:3] = ids[-3:] = op1_score.EMBEDDINGS
    classes = rng.integers(0, op1_score.CLASSES, n)
    classes[rng.random(n) < 0.2] = -1
    return ids, classes


def test_scores_are_those_of_a_plain_loop():
    rng = np.random.default_rng(0)
    net = op1_score.Network.start(rng.integers(1, 50, op1_score.CLASSES).astype(float))
    ids, classes = sequence(rng)
    want = [plain_log(net, ids, classes, i) if c >= 0 else 0 for i, c in enumerate(classes)]
    assert np.allclose(net.score(ids, classes), want, atol=1e-4)
    every = np.exp([plain_log(net, ids, np.full(len(classes), c), 5) for c in range(op1_score.CLASSES)])
    assert abs(every.sum() - 1) < 1e-6


def test_gradient_is_that_of_finite_differences():
    rng = np.random.default_rng(1)
    net = op1_score.Network.start(rng.integers(1, 50, op1_score.CLASSES).astype(float))
    for f in op1_score.fields(net):
        setattr(net, f.name, getattr(net, f.name).astype(float))
    ids, classes = sequence(rng)
    loss = lambda: -sum(plain_log(net, ids, classes, i) for i, c in enumerate(classes) if c >= 0)
    for x, g in zip(net.arrays(), net.gradient(ids, classes), strict=True):
        assert x.shape == g.shape
        for at in rng.choice(np.flatnonzero(g), 6):
            was = x.flat[at]
            x.flat[at] = was + 1e-5
            up = loss()
            x.flat[at] = was - 1e-5
            down = loss()
            x.flat[at] = was
            assert abs((up - down) / 2e-5 - g.flat[at]) < 2e-3 * max(1, abs(g.flat[at]))


def test_gradients_of_parts_sum_to_that_of_the_whole():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["stone", "water", "un", "é"]) + rng.choice(["ly", "s"]) for _ in range(n)) for n in (0, 1, 7, 400)]
    net = op1_score.Network.start(np.ones(op1_score.CLASSES))

    def of(some):
        data = np.frombuffer("".join(some).encode(), np.uint8)
        offsets = np.append(0, np.cumsum([len(t.encode()) for t in some]))
        _, codes, first = op1_score.words_of(data, offsets)
        return [sum(x) for x in zip(*(net.gradient(*c) for c in op1_score.contexts(codes, first)), strict=True)]

    parts = [of([t]) for t in texts if t]
    assert all(np.allclose(sum(p[i] for p in parts), whole, atol=1e-3) for i, whole in enumerate(of(texts)))


def test_masked_score(spark):
    rows = [(1, None), (2, ""), (3, "a b c " * 200), (4, "A B C"), (5, "q " * 70_000), (3, "a b c " * 200), (None, " \n"), (6, "x" * 300_000)]
    docs = spark.createDataFrame([(i, t, "mine") for i, t in rows], "doc_id long, text string, n_tokens string")
    counts = op1_score.word_counts(docs)
    net = op1_score.train(docs, op1_score.class_counts(counts))
    out = op1_score.scored(docs, net, counts)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == ["doc_id", "text", "n_tokens", "log_likelihood", "mean_log_likelihood"] and out.count() == len(rows)
    assert got[1].n_tokens == 0 and got[1].mean_log_likelihood is None and got[2].log_likelihood == 0 and got[None].n_tokens == 0
    assert got[3].n_tokens == 600 and got[4].n_tokens == 3 and got[5].n_tokens == 70_000 and got[6].n_tokens == 1
    assert got[3].mean_log_likelihood < 0 and got[5].mean_log_likelihood > -3
    none = docs.limit(0)
    counts = op1_score.word_counts(none)
    assert op1_score.scored(none, op1_score.train(none, op1_score.class_counts(counts)), counts).count() == 0


def test_scores_beat_word_counts_however_the_table_is_partitioned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    sums = []
    for partitions in (1, 8, 64):
        dealt = docs.repartition(partitions)
        counts = op1_score.word_counts(dealt)
        out = op1_score.scored(dealt, op1_score.train(dealt, op1_score.class_counts(counts)), counts, keep_text=False).collect()
        sums.append(sum(r.log_likelihood for r in out) / sum(r.n_tokens for r in out))
    n = np.array([r.n for r in counts.collect()], float)
    assert max(sums) - min(sums) < 1e-4 and min(sums) > (n * np.log(n / n.sum())).sum() / n.sum() + 0.4


@pytest.mark.parametrize("common", [200_000, 50])
def test_probabilities_of_all_words_of_the_corpus_sum_to_one(spark, monkeypatch, common):
    monkeypatch.setattr(op1_score, "COMMON", common)  # 50: most counts are joined
    words = [f"w{i}" for i in range(6000)]
    rows = [(i, w) for i, w in enumerate(words)] + [(10_000 + i, f"{w} {w}") for i, w in enumerate(words[:5000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = op1_score.word_counts(docs)
    assert counts.count() == 6000
    out = op1_score.scored(docs, op1_score.Network.start(op1_score.class_counts(counts)), counts).collect()
    assert len(out) == len(rows) and all(abs(r.mean_log_likelihood * r.n_tokens - r.log_likelihood) < 1e-6 for r in out)
    alone = {r.text: r.log_likelihood for r in out if r.doc_id < 10_000}  # each between the same fillers
    used = {words[i][-2:] for i in range(6000)}
    assert 0.5 < sum(np.exp(x) for x in alone.values()) < 1 + 1e-6 and len(used) <= 110
    twice, once = "w1234", "w5934"  # of one class: three occurrences against one
    assert abs(alone[twice] - alone[once] - np.log(3)) < 1e-6


def test_score_of_a_long_text_is_that_of_its_stretches(monkeypatch):
    text = " ".join(random.Random(1).choice(["ab", "ba", "c"]) for _ in range(5000)).encode()
    net = op1_score.Network.start(np.ones(op1_score.CLASSES))
    _, codes, first = op1_score.words_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    whole = np.concatenate([net.score(*c) for c in op1_score.contexts(codes, first)])
    monkeypatch.setattr(op1_score, "BATCH", 77)
    assert np.allclose(whole, np.concatenate([net.score(*c) for c in op1_score.contexts(codes, first)]), atol=1e-5)


def test_language(spark):
    rng = random.Random(0)
    parts = {"en": ["the", "and", "ing", "wh"], "de": ["sch", "ung", "ß", "ich"]}
    rows = [(i, " ".join(rng.choice(parts[lang]) for _ in range(20)), lang, "x") for i in range(60) for lang in [rng.choice(["en", "de"])]]
    rows += [(100, None, "en", "x"), (101, "123 !?", None, "x"), (102, "", "de", "x"), (None, "the and", None, "x"), (0, rows[0][1], rows[0][2], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = op4_language.predict(docs, op4_language.fit(docs.filter("lang is not null and text is not null").select("text", "lang"))).collect()
    assert all(r.lang_pred == r.lang and 0.5 <= r.score <= 1 for r in out if r.doc_id is not None and r.doc_id < 60)
    assert [(r.lang_pred, r.score) for r in out if r.doc_id in (100, 101, 102)] == [("und", 0.0)] * 3
    nothing = op4_language.fit(docs.limit(0).select("text", "lang"))
    assert {r.lang_pred for r in op4_language.predict(docs, nothing).collect()} == {"und"}
    assert op4_language.predict(docs.limit(0), nothing).count() == 0


def test_language_is_that_of_a_plain_naive_bayes(spark, tmp_path):
    rng = random.Random(5)
    parts = {"en": "the and of ing wh ow", "de": "sch ung ß ich ein ow", "fr": "é eau qu les ow ent"}
    rows = [(i, " ".join(rng.choice(parts[lang].split()) + rng.choice(["", "1", "!"]) for _ in range(rng.randint(1, 9))), lang) for i in range(120) for lang in [rng.choice(list(parts))]]
    rows += [(200, None, "en"), (201, "12 !", "de"), (202, "the", None), (None, "the les", "fr"), (203, "ow", "en"), (203, "ow", "en")]
    spark.createDataFrame([(*r, "s", "c") for r in rows], "doc_id long, text string, lang string, lang_pred string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda i: crc32(("" if i is None else str(i)).encode()) % 5 == 0

    def grams(text):
        chars = [c if c.isalpha() else " " for c in text.lower()]
        return ["".join(chars[i : i + n]) for n in (1, 2, 3) for i in range(len(chars) - n + 1)]

    learned = [(t, lang) for i, t, lang in rows if t is not None and lang is not None and not held(i)]
    counts = {lang: {} for _, lang in learned}
    for t, lang in learned:
        for g in grams(t):
            counts[lang][g] = counts[lang].get(g, 0) + 1
    sizes = {lang: sum(c.values()) + op4_language.SMOOTHING * (1 << op4_language.BUCKET_BITS) for lang, c in counts.items()}
    out = op4_language.op4_language_id(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) and {c for c in out[0].asDict()} == {"doc_id", "held_out", "lang_pred", "score"}
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, t)
    for r in out:
        t = texts[r.doc_id]
        assert r.held_out == held(r.doc_id) and 0 <= r.score <= 1
        if t is None or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        logs = {lang: np.log(sum(x == lang for _, x in learned) / len(learned)) + sum(np.log((c.get(g, 0) + op4_language.SMOOTHING) / sizes[lang]) for g in grams(t)) for lang, c in counts.items()}
        best = max(logs.values())
        share = 1 / sum(np.exp(x - best) for x in logs.values())
        # buckets are few enough to collide now and then
        assert share < 0.9 or logs[r.lang_pred] == best and abs(r.score - share) < 0.1


def test_codec_equals_tiktoken():
    with open(RANKS, "rb") as f:
        ranks = parse_ranks(f.read())
    own, other = Codec(ranks, public_tokenizers.PATTERN, most_pieces=50), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own.fst.most_states = 300
    rng = random.Random(4)
    texts = ["", "a" * 5000, "ab" * 3000, " \n\n x\t", "don't <|endoftext|>", "日本語 🎉🎉 ñandú", "é" * 300]
    texts += ["".join(rng.choice("aeinrst ñé!1\n") for _ in range(80)) for _ in range(300)]
    texts += ["".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(40)) for _ in range(300)]
    for t in texts:
        ids = np.frombuffer(own.encode(t), "<u4").tolist()
        assert ids == other.encode_ordinary(t)
        assert b"".join(own.decode_stream(ids, block=3)) == t.encode()


@pytest.mark.parametrize("most_states", [1, 20, 2000, 10**9])
def test_pieces_beyond_the_states_are_followed(most_states):
    with open(RANKS, "rb") as f:
        ranks = parse_ranks(f.read())
    own, other = Codec(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own.fst.most_states = most_states
    rng = random.Random(most_states)
    texts = ["".join(rng.choice(letters) for _ in range(size)) for letters in ("ab", "aeinrst", "éñaß日本語", "thequickbrownfox") for size in (1, 7, 1023, 1024, 1025, 4000)]
    for t in texts + texts[::-1]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == other.encode_ordinary(t)
    assert len(own.fst.states) <= most_states


def test_layers_are_divided_by_their_sums():
    rng = np.random.default_rng(2)
    z = rng.normal(size=(50, op1_score.SIDE)).astype(np.float32)
    assert (op1_score._largest(z) == z.max(1, keepdims=True)).all()
    net = op1_score.Network.start(rng.integers(1, 9, op1_score.CLASSES))
    classes = rng.integers(0, op1_score.CLASSES, 200)
    ids = rng.integers(0, op1_score.EMBEDDINGS, 200 + 2 * op1_score.REACH)
    each = [net.score(ids, np.full(200, k))[7] for k in range(op1_score.CLASSES)]
    assert abs(np.exp(each).sum() - 1) < 1e-5 and np.isfinite(net.score(ids, classes)).all()


def test_decoding_texts_at_once_equals_decoding_each():
    with open(RANKS, "rb") as f:
        codec = Codec(parse_ranks(f.read()), public_tokenizers.PATTERN)
    texts = ["", "a", "日本語 🎉🎉 ñandú", "", "don't \n\n stop" * 500, ""]
    ids = [codec.encode(t) for t in texts]
    assert codec.decode_texts(ids).to_pylist() == [t.encode() for t in texts]
    assert [b"".join(codec.decode_stream(np.frombuffer(x, "<u4").tolist())) for x in ids] == codec.decode_texts(ids).to_pylist()
    assert codec.decode_texts([]).to_pylist() == [] and codec.decode_texts([b"", b""]).to_pylist() == [b"", b""]


def test_utf8_stream_gives_whole_characters():
    raw = "aé日🎉".encode() * 3
    for size in (1, 2, 3, 5):
        stream = Utf8Stream()
        parts = [stream.feed(raw[i : i + size]) for i in range(0, len(raw), size)]
        assert all(p.decode() is not None for p in parts) and b"".join(parts) + stream.close() == raw
    stream = Utf8Stream()
    assert stream.feed(b"a\xe6\x97") == b"a" and stream.close() == b"\xe6\x97"


def test_encode_documents(spark):
    docs = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "hi there", "k"), (3, "hi there", "k")], "doc_id long, text string, token_ids string")
    out = op6_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, decode=True).collect()
    assert [len(r.token_ids) for r in out][:2] == [0, 0] and {bytes(r.decoded) for r in out} == {b"", b"hi there"}
    ids = {base64.b64encode(bytes(r.token_ids)) for r in out if r.doc_id == 3}
    assert len(ids) == 1 and hashlib.sha256(b"").hexdigest()
    assert op6_bpe.encode_documents(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_labellers_find_the_bad_class():
    rng = np.random.default_rng(1)
    bad = rng.random(4000) < 0.2
    kinds = rng.integers(0, 4, 4000)
    given = np.full((4000, op8_quality.LABELLERS), 2)
    given[np.arange(4000)[bad], kinds[bad]] = 0
    given[:, 4:7] = 1
    patterns, inverse, counts = np.unique(given @ op8_quality._PLACES, return_inverse=True, return_counts=True)
    posterior, _ = op8_quality.estimate(patterns, counts.astype(float))
    assert ((posterior[inverse] < 0.5) == bad).all()


def test_one_kind_of_junk_at_a_third_of_all_rows():
    marks = {"." * 9: 500, "......G..": 60, "....G.G..": 200, "....GGG..": 8000, "B.B.GGG..": 300, "B..BGGG..": 300, ".BB..GG..": 300, "....GGG.B": 200, "....BGG.B": 60}
    patterns = np.array([[("BG.").index(v) for v in m] for m in marks]) @ op8_quality._PLACES
    bad = np.array(["B" in m for m in marks])
    for much in np.flatnonzero(bad):
        counts = np.array(list(marks.values()), float)
        counts[much] = counts.sum() / 2
        for size in (0.1, 1, 100):
            posterior, rates = op8_quality.estimate(patterns, counts * size)
            assert ((posterior < 0.5) == bad).all(), (list(marks)[much], size, posterior)
            share = np.array([counts[[i for i, m in enumerate(marks) if m[j] == "B"]].sum() for j in range(9)]) / counts[bad].sum()
            assert np.abs(rates[0, :, 0] - share).max() < 0.05


def test_labellers_rates_are_recovered():
    rng = np.random.default_rng(4)
    n, kinds = 60_000, op8_quality.LABELLERS
    bad = rng.random(n) < 0.3
    kind = rng.integers(0, kinds, n)
    hit = np.linspace(0.55, 0.95, kinds)  # how often each labeller calls its own kind bad
    given = np.full((n, kinds), 2)
    for j in range(kinds):
        good_rate = (0.2, 0.5, 0.8)[j % 3]
        given[:, j] = np.where(rng.random(n) < good_rate, 1, 2)
        own = bad & (kind == j)
        given[own, j] = np.where(rng.random(own.sum()) < hit[j], 0, 2)
        given[bad & (kind == (j + 1) % kinds), j] = np.where(rng.random((bad & (kind == (j + 1) % kinds)).sum()) < 0.3, 0, 2)
    patterns, counts = np.unique(given @ op8_quality._PLACES, return_counts=True)
    posterior, rates = op8_quality.estimate(patterns, counts.astype(float))
    seen = (given == 0).any(1)  # junk that no labeller calls bad can't be told from good documents
    want = np.array([(given[seen][:, j] == 0).mean() for j in range(kinds)])
    assert np.abs(rates[0, :, 0] - want).max() < 0.04 and want.max() - want.min() > 0.02
    assert rates[1, :, 0].max() < 0.01
    for j in range(kinds):
        assert abs(rates[1, j, 1] - (0.2, 0.5, 0.8)[j % 3]) < 0.04


def test_prose_of_other_scripts_is_kept(spark):
    rng = random.Random(3)
    words = ["the", "and", "of", "reading", "stone", "water", "under", "light"]
    rows = [" ".join(rng.choice(words) for _ in range(60)).capitalize() + ". And so on, it went." for _ in range(150)]
    rows += [" ".join(rng.choice(words) + rng.choice(["###", "$$$"]) for _ in range(60)) for _ in range(30)]
    prose = {"zh": "我们昨天去了市场，买了很多新鲜的蔬菜和水果。天气非常好，孩子们在公园里玩耍。", "ja": "昨日は友達と一緒に映画を見に行きました。とても面白かったので、また行きたいです。", "th": "เมื่อวานนี้เราไปตลาดและซื้อผักผลไม้สดมากมาย อากาศดีมากและเด็กๆเล่นอยู่", "hi": "कल हम बाजार गए और बहुत सारी ताज़ी सब्जियाँ और फल खरीदे। मौसम बहुत अच्छा था।", "ar": "ذهبنا أمس إلى السوق واشترينا الكثير من الخضروات والفواكه الطازجة. كان الطقس جميلا."}
    rows += [p * 3 for p in prose.values()]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    assert {r.doc_id for r in op8_quality.kept_documents(docs, None).collect()} == set(range(150)) | set(range(180, 185))


def test_quality(spark):
    rng = random.Random(3)
    words = ["the", "and", "of", "reading", "stone", "water", "under", "light"]
    clean = [" ".join(rng.choice(words) for _ in range(60)).capitalize() + ". And so on, it went." for _ in range(150)]
    junk = [" ".join(rng.choice(words) + rng.choice(["###", "$$$"]) for _ in range(60)) for _ in range(30)]
    rude = [c.replace("stone", "blockhead") for c in clean[:60] if "stone" in c]
    rows = [(i, t, "p") for i, t in enumerate([*clean, *junk, *rude])] + [(900, None, "p"), (901, " ", "p"), (0, clean[0], "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep string")
    labels = spark.createDataFrame([(i, 1, int(i >= 180)) for i in range(180 + len(rude))] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    kept = op8_quality.kept_documents(docs, labels)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == ["doc_id", "text", "keep"] and ids == set(range(150))
    assert {r.doc_id for r in op8_quality.kept_documents(docs, None).collect()} >= set(range(150))
    assert op8_quality.kept_documents(docs.limit(0), labels).count() == 0


def test_decontamination_tells_texts_of_one_id_apart(spark):
    item = " ".join(f"w{i}" for i in range(20))
    rows = [(None, f"x {item}"), (None, "clean"), (None, None), (4, item), (4, "clean too"), (5, "clean")]
    docs = spark.createDataFrame([(i, t, "v") for i, t in rows], "doc_id long, text string, did string")
    kept = op10_decontaminate.clean_documents(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns
    assert sorted(map(str, [(r.doc_id, r.text) for r in kept.collect()])) == sorted(map(str, [rows[1], rows[2], rows[4], rows[5]]))


def test_items_without_an_id_are_found(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"x {item}"), (2, "clean words only, five of them")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, item), (3, item)], "item_id long, text string")
    found = {r.doc_id: (r.contaminated, r.n_items, r.item_ids) for r in op10_decontaminate.contamination(docs, bench).collect()}
    assert found == {1: (True, 2, [None, 3]), 2: (False, 0, [])}
    assert [r.doc_id for r in op10_decontaminate.clean_documents(docs, bench.filter("item_id is null")).collect()] == [2]


def test_decontamination(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate((4, 5, 9, 12, 20, 35, 35))] + [(50, None), (6, "again " * 8)]
    rows = [(1, None), (2, ""), (3, items[5][1])]
    for i in range(10, 70):
        body = [rng.choice(words) for _ in range(rng.randint(0, 50))]
        source = items[rng.randrange(7)][1].split()
        for _ in range(rng.randint(0, 8)):
            source[rng.randrange(len(source))] = rng.choice([*words, "new"])
        at = rng.randint(0, len(body))
        body[at:at] = source
        rows.append((i, "  ".join(w.upper() for w in body)))
    rows += [rows[-1], (None, items[4][1])]

    def found(text, item):
        w, b = (text or "").lower().split(), (item or "").lower().split()
        if len(b) < 5:
            return False
        length = len(b) if len(b) < 10 else min(20, len(b))
        need = length if len(b) < 10 else -(-length * 4 // 5)
        for shift in range(-len(b), len(w) + 1):
            same = [0 <= shift + i < len(w) and w[shift + i] == b[i] for i in range(len(b))]
            if max(sum(same[i : i + length]) for i in range(len(b) - length + 1)) >= need:
                return True
        return False

    docs = spark.createDataFrame([(i, t, "v") for i, t in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(i), sorted({k for k, b in items if found(t, b)})) for i, t in rows)
    out = op10_decontaminate.contamination(docs, bench).collect()
    assert sorted((str(r.doc_id), r.item_ids) for r in out) == want and all(r.contaminated == bool(r.item_ids) for r in out)
    kept = op10_decontaminate.clean_documents(docs, bench)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(i for i, ids in want if not ids)
    assert op10_decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert op10_decontaminate.contamination(docs.limit(0), bench).count() == 0
