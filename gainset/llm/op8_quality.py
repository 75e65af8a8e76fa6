"""Quality classification from weak labels.

Nine heuristic labellers, most of which know one kind of bad document, vote good,
bad or nothing on every document.  The corpus
is counted by pattern of votes, and expectation-maximisation over the counts finds
each labeller's accuracy without any true label.  The posterior of each pattern is
the label from which a linear scorer over hashed byte trigrams learns.

A second scorer, over hashed words and word beginnings, learns the labelled
toxicity of a sample, as no heuristic can tell it; toxic documents are rejected too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from gainset.llm import arrays
from gainset.llm.tables import table

#: Documents that the linear scorer learns from, and labelled ones that the toxicity
#: scorer learns from: an even share of all, by hash, of about this many at most.
SAMPLE = 3_000
TOXIC_SAMPLE = 8_000
TRIGRAM_BITS = 11
FEW_TRIGRAMS = 600
WORD_BITS = 18
#: Bytes of text looked at in one step; there are many values for each.
STEP = 1 << 18
#: A document stays with at least this quality and at most this toxicity.
LEAST_QUALITY = 0.5
MOST_TOXICITY = 0.6

#: Share of the letters' bytes that aren't ASCII from which a text's script counts as another.
FOREIGN = 0.3

_BAD, _GOOD, _NONE = 0, 1, 2


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _flags("abcdefghijklmnopqrstuvwxyz")
_LETTER[128:] = True
_MARK = _flags("#$%&*@<>{}[]\\^~_=+|")
_STOP = _flags(".,;:!?")
_PUNCTUATION = _MARK | _flags("!?")


def _vote(bad: np.ndarray, good: np.ndarray | bool = False) -> np.ndarray:
    return np.where(bad, _BAD, np.where(good, _GOOD, _NONE)).astype(np.int64)


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per document: what the labellers look at."""

    def per_doc(flags: np.ndarray, at: np.ndarray = offsets) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(flags))[at]).astype(float)

    starts, ends, first = arrays.words(data, offsets)
    words = np.maximum(np.diff(first), 1).astype(float)
    letters = per_doc(_LETTER[data])
    units = np.maximum(words, letters / 12)  # some scripts have no spaces
    twice = np.zeros(len(data), bool)
    twice[1:] = (data[1:] == data[:-1]) & _PUNCTUATION[data[1:]]
    spans = arrays.Spans(arrays.byte_symbols(data))
    word = spans.hash(starts, ends)
    again = np.zeros(len(word), bool)
    again[1:] = word[1:] == word[:-1]
    again[first[:-1][first[:-1] < len(word)]] = False
    line_start, line_end, line_first = arrays.lines(data, offsets)
    line = spans.hash(line_start, line_end)
    lines = np.diff(line_first)
    doc = np.repeat(np.arange(len(lines)), lines)
    order = np.lexsort((line, doc))
    same = np.zeros(len(order), bool)
    same[1:] = (line[order][1:] == line[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.stack(
        [
            per_doc(_MARK[data]) / units,
            per_doc(_UPPER[data]) / np.maximum(letters, 1),
            per_doc(twice) / units,
            per_doc(data == 124) / units,
            per_doc(_STOP[data]) / units,
            np.diff(first).astype(float),
            letters / words,
            np.bincount(doc[order], same, len(lines)) / np.maximum(lines, 1),
            per_doc(again, first) / words,
            per_doc(data >= 128) / np.maximum(letters, 1),
            letters,
        ],
        1,
    )


def votes(measured: np.ndarray) -> np.ndarray:
    """One row per document, one column per labeller.

    Who judges by stops, spaces or the length of words abstains on scripts of which that isn't known.
    """
    marks, upper, doubled, pipes, stops, words, size, repeated, again, foreign, letters = measured.T
    known = foreign < FOREIGN
    return np.stack(
        [
            _vote(marks > 0.2),
            _vote(upper > 0.4),
            _vote(doubled > 0.1),
            _vote(pipes > 0.1),
            _vote((stops < 0.005) & (words >= 40) & known, (stops > 0.02) & (stops < 0.5) & known),
            _vote(words == 0, (words >= 20) | ~known & (letters >= 100)),
            _vote(((size < 2) | (size > 15)) & known, (size > 3) & (size < 10) & known),
            _vote((repeated > 0.5) & (words >= 40)),
            _vote((again > 0.3) & (words >= 10)),
        ],
        1,
    )


LABELLERS = 9
_PLACES = 3 ** np.arange(LABELLERS)


#: Good documents are of two kinds, with all the good votes there are and with fewer, as
#: short texts; bad ones of one kind for each labeller.
GOOD_KINDS = 2
#: What is expected of a labeller before anything is counted, as shares of its votes (bad,
#: good, none): in a good kind, in a bad kind, and in the bad kind that it knows.  Each counts
#: as one document, whatever the corpus.
EXPECTED_GOOD = (0.001, 0.4995, 0.4995)
EXPECTED_BAD = (1 / 3, 1 / 3, 1 / 3)
EXPECTED_KNOWN = (0.98, 0.01, 0.01)
#: A labeller calls at most this share of a good kind bad.  Counts alone can't tell junk that
#: one labeller sees from good documents on which it errs.
MOST_FALSE = 0.002


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over counted patterns of votes.

    Returns the posterior of good for each pattern, and for each labeller the
    probability of each vote in bad and in good documents.  Labellers are taken as
    independent given the kind of document, and no vote is an outcome like others.  It
    starts from documents without a bad vote as good, others as of the kinds of those who gave one.
    """
    given = (patterns[:, None] // _PLACES) % 3
    onehot = (given[:, :, None] == np.arange(3)).astype(float)
    bad, good = given == _BAD, (given == _GOOD).sum(1)
    some = bad.any(1)
    kinds = GOOD_KINDS + LABELLERS
    share = np.zeros((len(patterns), kinds))
    share[:, GOOD_KINDS:] = 0.98 * bad / np.maximum(bad.sum(1, keepdims=True), 1)
    fewer = good < good[~some].max(initial=0)
    share[np.arange(len(patterns)), fewer.astype(int)] = np.where(some, 0.02, 1.0)
    expected = np.empty((kinds, LABELLERS, 3))
    expected[:GOOD_KINDS], expected[GOOD_KINDS:] = EXPECTED_GOOD, EXPECTED_BAD
    expected[GOOD_KINDS + np.arange(LABELLERS), np.arange(LABELLERS)] = EXPECTED_KNOWN
    for _ in range(rounds):
        weight = counts[:, None] * share
        rates = np.einsum("pk,plv->klv", weight, onehot) + expected
        rates /= rates.sum(2, keepdims=True)
        false = np.minimum(rates[:GOOD_KINDS, :, _BAD], MOST_FALSE)
        rates[:GOOD_KINDS, :, _GOOD:] *= ((1 - false) / (1 - rates[:GOOD_KINDS, :, _BAD]))[:, :, None]
        rates[:GOOD_KINDS, :, _BAD] = false
        prior = (weight.sum(0) + 1) / (weight.sum() + kinds)
        logs = np.log(prior) + np.einsum("klv,plv->pk", np.log(rates), onehot)
        before, share = share, np.exp(logs - logs.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        if np.abs(share - before).max(initial=0) < 1e-9:
            break
    posterior = share[:, :GOOD_KINDS].sum(1)
    classes = np.einsum("cp,plv->clv", np.stack([counts * (1 - posterior), counts * posterior]), onehot) + 1 / 3
    return posterior, classes / classes.sum(2, keepdims=True)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the byte trigram at each position, and whether it counts: it lies within one document and is ASCII.

    The scorer learns little of scripts that are rare in its sample, so it leaves them to the labellers.
    """
    n = len(data)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    key = data[:-2].astype(np.uint64) << np.uint64(16) | data[1:-1].astype(np.uint64) << np.uint64(8) | data[2:].astype(np.uint64)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: n - 2]
    return (arrays.mix(key) >> np.uint64(64 - TRIGRAM_BITS)).astype(np.int64), (np.arange(3, n + 1) <= ends) & (data[:-2] < 128) & (data[1:-1] < 128) & (data[2:] < 128)


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each document's lower-cased words and their first four and five bytes; documents, buckets."""
    data = arrays.lower(data)
    starts, ends, first = arrays.words(data, offsets)
    letters = np.append(0, np.cumsum(_LETTER[data]))
    spans = arrays.Spans(arrays.byte_symbols(data))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    keys = []
    for kind, limit in enumerate((4, 5, 1 << 40)):
        cut = np.minimum(ends, starts + limit)
        bare = cut - (limit > 5) * (letters[cut] == letters[np.maximum(cut - 1, 0)])  # a mark after the word
        keys.append(arrays.mix(spans.hash(starts, np.maximum(bare, starts)) + np.uint64(kind)) >> np.uint64(64 - WORD_BITS))
    both = np.unique(np.tile(doc, 3) << WORD_BITS | np.concatenate(keys).astype(np.int64))
    return both >> WORD_BITS, both & (1 << WORD_BITS) - 1


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_dense(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on standardised columns, given back for the columns as they are."""
    if not len(x):
        return np.zeros(x.shape[1]), 0.0
    mean, spread = x.mean(0), x.std(0)
    spread = np.where(spread > 0, spread + 0.1 * spread[spread > 0].mean() if (spread > 0).any() else 1, np.inf)
    z = ((x - mean) / spread).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        e = (_logistic(z @ w + b) - y).astype(np.float32)
        g = z.T @ e / len(y) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= rate * float(e.mean())
    w = w / spread
    return w, b - float(w @ mean)


def fit_sparse(at: np.ndarray, first: np.ndarray, y: np.ndarray, size: int, features: int = 512, least: float = 15.0, rounds: int = 300, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on the sets' features that go most with ``y`` by a chi-square test; others weigh 0."""
    weights = np.zeros(size)
    if not len(y) or not y.any() or y.all():
        return weights, -50.0 if not y.any() else 50.0
    row = np.repeat(np.arange(len(y)), np.diff(first))
    seen, with_y = np.bincount(at, minlength=size), np.bincount(at, y[row], size)
    expected = seen * y.mean()
    chi = np.where(with_y > expected, (with_y - expected) ** 2 / np.maximum(expected, 1e-9), 0)
    chosen = np.argsort(-chi, kind="stable")[:features]
    chosen = chosen[chi[chosen] >= least]
    place = np.full(size, -1)
    place[chosen] = np.arange(len(chosen))
    use = place[at] >= 0
    at, row = place[at[use]], row[use]
    w, b = np.zeros(len(chosen)), float(np.log(y.mean() / (1 - y.mean())))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        e = _logistic(np.bincount(row, w[at], len(y)) + b) - y
        g = np.bincount(at, e[row], len(w)) / len(y) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= rate * e.mean()
    weights[chosen] = w
    return weights, b


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in arrays.steps(batch, "text", STEP):
            found = votes(measures(data, offsets)) @ _PLACES
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32))], names=["pattern"])


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For learning: the pattern, the share of each trigram bucket, and the measures that are shares."""
    for batch in batches:
        for _, data, offsets in arrays.steps(batch, "text", STEP):
            measured = measures(data, offsets)
            n, buckets = len(offsets) - 1, 1 << TRIGRAM_BITS
            at, inside = trigrams(data, offsets)
            doc = np.repeat(np.arange(n), np.diff(offsets))[: len(at)]
            counts = np.bincount((doc * buckets + at)[inside], minlength=n * buckets).reshape(n, buckets)
            shares = np.hstack([counts / np.maximum(counts.sum(1, keepdims=True), 1), _bounded(measured)]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array((votes(measured) @ _PLACES).astype(np.int32)), pa.array([x.tobytes() for x in shares], pa.binary())], names=["pattern", "shares"])


def _bounded(measured: np.ndarray) -> np.ndarray:
    """The measures that don't grow with the text, at most 1."""
    return np.minimum(measured[:, [0, 1, 2, 3, 4, 7, 8]], 1)


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in arrays.steps(batch, "text", STEP):
            doc, at = word_features(data, offsets)
            first = np.searchsorted(doc, np.arange(len(offsets)))
            sets = [at[a:b].astype(np.int32).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(rows.start, len(sets)), pa.array(sets, pa.binary())], names=["toxic", "features"])


def _sampled(rows: DataFrame, column: str, total: int, most: int) -> DataFrame:
    """An even share of the rows by hash, about ``most`` of ``total`` and never over twice that."""
    if total <= most:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.lit(97), column), F.lit(1 << 30)) < int((1 << 30) * most / total)).limit(2 * most)


class Model:
    """What scoring needs; a few MB whatever the corpus."""

    def __init__(self, posterior: dict[int, float], accuracies: np.ndarray, quality: tuple[np.ndarray, float], toxic: tuple[np.ndarray, float]):
        self.posterior, self.accuracies, self.quality, self.toxic = posterior, accuracies, quality, toxic

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weak posterior, quality and toxicity of each document; a text without words has quality 0."""
        n = len(offsets) - 1
        measured = measures(data, offsets)
        weak = np.array([self.posterior.get(int(p), 0.5) for p in votes(measured) @ _PLACES])
        at, inside = trigrams(data, offsets)
        doc = np.repeat(np.arange(n), np.diff(offsets))[: len(at)][inside]
        count = np.maximum(np.bincount(doc, minlength=n), 1)
        weights, trigram_weights = self.quality[0][1 << TRIGRAM_BITS :], self.quality[0][: 1 << TRIGRAM_BITS]
        linear = np.bincount(doc, trigram_weights[at[inside]], n) / count + _bounded(measured) @ weights + self.quality[1]
        # Shares of a short text say little; there the labellers' verdict weighs more.
        prior = np.log((weak + 0.02) / (1.02 - weak))
        # A linear scorer misses kinds of junk that are rare in its sample, so it can only take from that verdict.
        quality = np.minimum(_logistic((count * linear + FEW_TRIGRAMS * prior) / (count + FEW_TRIGRAMS)), weak)
        some = measured[:, 5] > 0
        doc, at = word_features(data, offsets)
        toxic = _logistic(np.bincount(doc, self.toxic[0][at], n) + self.toxic[1])
        return np.where(some, weak, 0), np.where(some, quality, 0), np.where(some, toxic, 0)


def _quality_weights(weak: dict[int, float]):
    """One task learns from the gathered sample, which is bounded, and gives the weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = [], []
        for batch in batches:
            x += [np.frombuffer(raw, np.float32) for raw in batch.column(1).to_pylist()]
            y += [weak.get(p, 0.5) for p in batch.column(0).to_pylist()]
        if x:
            weights, bias = fit_dense(np.stack(x), np.array(y))
            yield _weights(weights, bias)

    return run


def _toxic_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    y, sets = [], []
    for batch in batches:
        y += batch.column(0).to_pylist()
        sets += [np.frombuffer(raw, np.int32) for raw in batch.column(1).to_pylist()]
    if y:
        first = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int64)
        yield _weights(*fit_sparse(np.concatenate(sets), first, np.array(y, float), 1 << WORD_BITS))


def _weights(weights: np.ndarray, bias: float) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()], pa.binary()), pa.array([float(bias)])], names=["weights", "bias"])


def _learned(sample: DataFrame, learn, size: int, bias: float) -> tuple[np.ndarray, float]:
    """Weights from a bounded sample, learned on an executor; zeros from none."""
    rows = sample.repartition(1).mapInArrow(learn, "weights binary, bias double").collect()
    return (np.frombuffer(bytes(rows[0]["weights"]), np.float32), rows[0]["bias"]) if rows else (np.zeros(size, np.float32), bias)


def fit(docs: DataFrame, labels: DataFrame | None) -> Model:
    """Labellers' accuracies from all documents; the scorers from bounded samples."""
    counted = docs.select("text").mapInArrow(_patterns, "pattern int").groupBy("pattern").count().collect()
    patterns, counts = (np.array([r[i] for r in counted], np.int64) for i in (0, 1))
    posterior, accuracies = estimate(patterns, counts.astype(float))
    weak = dict(zip(patterns.tolist(), posterior.tolist(), strict=True))
    sample = _sampled(docs.select("text"), "text", int(counts.sum()), SAMPLE).mapInArrow(_shares, "pattern int, shares binary")
    quality = _learned(sample, _quality_weights(weak), (1 << TRIGRAM_BITS) + 7, 0.0)
    toxic = np.zeros(1 << WORD_BITS, np.float32), -50.0
    if labels is not None:
        known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        some = _sampled(known, "doc_id", known.count(), TOXIC_SAMPLE)
        sets = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "toxic").limit(4 * TOXIC_SAMPLE).mapInArrow(_word_sets, "toxic int, features binary")
        toxic = _learned(sets, _toxic_weights, 1 << WORD_BITS, -50.0)
    return Model(weak, accuracies, quality, toxic)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` with weak_posterior, quality_score, toxic_score and keep, replacing columns of those names.

    Null and empty texts, and texts of white space, score 0 and aren't kept.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["weak_posterior", "quality_score", "toxic_score", "keep"]
    docs = docs.drop(*names)
    schema = StructType([*docs.schema.fields, *[StructField(n, BooleanType() if n == "keep" else DoubleType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for rows, data, offsets in arrays.steps(batch, "text", STEP):
                weak, quality, toxic = model.score(data, offsets)
                keep = (quality >= LEAST_QUALITY) & (toxic <= MOST_TOXICITY)
                own = batch.slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays([*own.columns, *map(pa.array, (weak, quality, toxic, keep))], names=[*own.schema.names, *names])

    return docs.mapInArrow(run, schema)


def kept_documents(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The documents that stay, with the columns they came with, whatever their names."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in arrays.steps(batch, "text", STEP):
                _, quality, toxic = sent.value.score(data, offsets)
                yield batch.slice(rows.start, rows.stop - rows.start).filter(pa.array((quality >= LEAST_QUALITY) & (toxic <= MOST_TOXICITY)))

    return docs.mapInArrow(run, docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scored`` for all documents, without their texts; documents without words aren't kept, ties in the scores stand side by side."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("text")
