"""Masked pseudo-likelihood scoring with a bidirectional window network in numpy.

Each word is predicted from three words on both sides: their embeddings, scaled by
position, are summed and squashed, and two softmax layers give the word's class.  A
class is a hash of the word's last two bytes; within it, words are as likely as their
counts in the corpus say, so that every word of the corpus has a probability of its own.
A document's score is the sum of the log-probabilities of all its words, each given
its surroundings.

All documents teach.  They are dealt into ``ROUNDS`` slices by their hash; in each
round the executors sum the gradient over all words of a slice, and the driver takes one
step.  So the network doesn't depend on how the table is partitioned, but for rounding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from gainset.llm import arrays
from gainset.llm.tables import table
from gainset.scratch import stored

#: Classes of words, ``SIDE`` groups of ``SIDE``, and embeddings, by a hash of a word's last three bytes.
SIDE = 32
CLASSES = SIDE * SIDE
EMBEDDINGS = 4_096
#: Words on each side that a word is predicted from.
REACH = 3
WIDTH = 16
#: Slices of the corpus, one for each step, and the size of a step.
ROUNDS = 32
RATE = 0.1
#: Words predicted at once (few enough that their layers stay in a processor's cache), words of a slice for each task, and the most tasks whose gradients are summed.
BATCH = 1 << 13
TASK_WORDS = 250_000
MOST_TASKS = 4_096
#: Words that a task counts before it hands them on.
COUNTED = 4_000_000
#: Most words whose counts every task holds (2 MB); those of all rarer ones are joined.
COMMON = 1 << 17
_AT = [i for i in range(2 * REACH + 1) if i != REACH]
_PIECE = 8_192
_ONES = np.ones(SIDE, np.float32)


def _largest(z: np.ndarray) -> np.ndarray:
    """The largest of each row of ``SIDE`` values, by halves, as short rows are slow to reduce one by one."""
    while z.shape[1] > 1:
        z = np.maximum(z[:, : z.shape[1] // 2], z[:, z.shape[1] // 2 :])
    return z


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and code of each lower-cased (A-Z) word, and each document's first word; the code holds embedding and class."""
    data = arrays.lower(data)
    starts, ends, first = arrays.words(data, offsets)
    hashes, codes = np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint32)
    for low in range(0, len(starts), 1 << 18):  # a very long document's hashes piece by piece
        high = min(low + (1 << 18), len(starts))
        base = starts[low]
        a, b = starts[low:high] - base, ends[low:high] - base
        spans = arrays.Spans(arrays.byte_symbols(data[base : ends[high - 1]]))
        hashes[low:high] = spans.hash(a, b)
        embedding, kind = (spans.hash(np.maximum(a, b - n), b) for n in (3, 2))
        codes[low:high] = (embedding % np.uint64(EMBEDDINGS)).astype(np.uint32) * np.uint32(CLASSES) + (kind % np.uint64(CLASSES)).astype(np.uint32)
    return hashes, codes, first


def word_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Rows (word, class, n) for every word of all documents; a word is its hash."""

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        word, codes = (np.concatenate(x) for x in zip(*held, strict=True))
        word, first, n = np.unique(word, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array((codes[first] % CLASSES).astype(np.int32)), pa.array(n)], names=["word", "class", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for _, data, offsets in arrays.steps(batch, text_column):
                word, codes, _ = words_of(data, offsets)
                held.append((word, codes))
                count += len(word)
                if count >= COUNTED:
                    yield flush(held)
                    held, count = [], 0
        if count:
            yield flush(held)

    return stored(docs.select(text_column).mapInArrow(run, "word long, class int, n long").groupBy("word").agg(F.first("class").alias("class"), F.sum("n").alias("n")), "words")


def class_counts(counts: DataFrame) -> np.ndarray:
    """How many words of the corpus each class has."""
    out = np.zeros(CLASSES)
    for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect():
        out[r["class"]] = r["n"]
    return out


def common_from(counts: DataFrame) -> tuple[int, bool]:
    """The count from which on a word is among the at most ``COMMON`` most frequent, and whether all are."""
    size = F.floor(F.log2("n") * 16).cast("int")
    found = sorted(((r["size"], r["least"], r["words"]) for r in counts.groupBy(size.alias("size")).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    least, words = 1 << 62, 0
    for _, n, more in found:
        words += more
        if words > COMMON:
            return least, False
        least = n
    return least, True


@dataclass
class Network:
    embed: np.ndarray
    scale: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    within: np.ndarray
    within_bias: np.ndarray

    @classmethod
    def start(cls, seen: np.ndarray) -> Network:
        """Small random embeddings; the biases give each class its share of the corpus."""
        rng = np.random.default_rng(11)
        share = (seen + 0.5).reshape(SIDE, SIDE)
        group = share.sum(1)
        values = [
            rng.normal(0, 0.3, (EMBEDDINGS + 1, WIDTH)),
            np.full((len(_AT), WIDTH), 0.5),
            np.zeros(WIDTH),
            rng.normal(0, 0.1, (WIDTH, SIDE)),
            np.log(group / group.sum()),
            rng.normal(0, 0.1, (SIDE, WIDTH, SIDE)),
            np.log(share / group[:, None]),
        ]
        values[0][EMBEDDINGS] = 0  # what is beyond a document's borders
        return cls(*[x.astype(np.float32) for x in values])

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def _forward(self, ids: np.ndarray, classes: np.ndarray):
        """Of the words with a class (others have -1): place, hidden values and so on, sorted by group, and both layers' shares before they are divided by their sums; ``ids`` reach beyond ``classes`` on both sides."""
        vectors, n = self.embed[ids], len(classes)
        total = np.tile(self.shift, (n, 1))
        for i, scale in enumerate(self.scale):
            total += vectors[_AT[i] : _AT[i] + n] * scale
        real = np.flatnonzero(classes >= 0)
        place = real[np.argsort((classes[real] // SIDE).astype(np.uint8), kind="stable")]
        group, member = classes[place] // SIDE, classes[place] % SIDE
        hidden = np.tanh(total[place])
        cuts = np.searchsorted(group, np.arange(SIDE + 1))
        inner = np.empty((len(place), SIDE), np.float32)
        for g in range(SIDE):
            own = slice(cuts[g], cuts[g + 1])
            np.matmul(hidden[own], self.within[g], out=inner[own])
            inner[own] += self.within_bias[g]
        layers = [hidden @ self.out + self.bias, inner]
        sums = []
        for z in layers:
            z -= _largest(z)
            np.exp(z, out=z)
            sums.append(z @ _ONES)
        return vectors, place, hidden, group, member, cuts, layers, sums

    def score(self, ids: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Log-probability of each class, given the embeddings' numbers around it; 0 where there is none."""
        _, place, _, group, member, _, layers, sums = self._forward(ids, classes)
        row = np.arange(len(place))
        out = np.zeros(len(classes))
        for z, total, own in zip(layers, sums, (group, member), strict=True):
            out[place] += np.log(z[row, own].astype(np.float64)) - np.log(total.astype(np.float64))
        return out

    def gradient(self, ids: np.ndarray, classes: np.ndarray) -> list[np.ndarray]:
        """Of the sum of minus log-probability, for each of ``arrays``."""
        vectors, place, hidden, group, member, cuts, (outer, inner), sums = self._forward(ids, classes)
        for z, total in zip((outer, inner), sums, strict=True):
            z *= (1 / total)[:, None]
        row = np.arange(len(place))
        outer[row, group] -= 1
        inner[row, member] -= 1
        dh = outer @ self.out.T
        within, within_bias = np.zeros(self.within.shape), np.zeros(self.within_bias.shape)
        for g in range(SIDE):
            own = slice(cuts[g], cuts[g + 1])
            dh[own] += inner[own] @ self.within[g].T
            within[g] = hidden[own].T @ inner[own]
            within_bias[g] = inner[own].sum(0)
        dh *= 1 - hidden * hidden
        n = len(classes)
        back, dv = np.zeros((n, WIDTH), np.float32), np.zeros_like(vectors)
        back[place] = dh
        embed, scale = np.empty(self.embed.shape), np.empty(self.scale.shape)
        for i, s in enumerate(self.scale):
            at = slice(_AT[i], _AT[i] + n)
            dv[at] += back * s
            scale[i] = np.einsum("ij,ij->j", back, vectors[at])
        for i, column in enumerate(np.ascontiguousarray(dv.T)):
            embed[:, i] = np.bincount(ids, column, EMBEDDINGS + 1)
        embed[EMBEDDINGS] = 0
        return [embed, scale, back.sum(0, dtype=np.float64), hidden.T @ outer, outer.sum(0, dtype=np.float64), within, within_bias]


def contexts(codes: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of documents in batches, as embeddings' numbers and classes, with fillers around each document."""
    count = np.diff(first)
    at = np.arange(first[-1]) + REACH * (np.repeat(np.arange(len(count)), count) + 1)
    n = int(first[-1]) + REACH * (len(count) + 1)
    ids, classes = np.full(n, EMBEDDINGS), np.full(n, -1)
    ids[at], classes[at] = codes // CLASSES, codes % CLASSES
    for low in range(REACH, n - REACH, BATCH):
        high = min(low + BATCH, n - REACH)
        yield ids[low - REACH : high + REACH], classes[low:high]


def _coded(docs: DataFrame, text_column: str) -> DataFrame:
    """Each document's slice, number of words and codes, in the order of the slices, so that a round reads little else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in arrays.steps(batch, text_column):
                _, codes, first = words_of(data, offsets)
                raw = [codes[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.start, len(raw)), pa.array(np.diff(first)), pa.array(raw, pa.binary())], names=["slice", "n", "codes"])

    number = F.pmod(F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))), F.lit(ROUNDS)).cast("int")
    rows = docs.select(number.alias("slice"), text_column).mapInArrow(run, "slice int, n long, codes binary")
    return stored(rows.sortWithinPartitions("slice"), "codes", options={"parquet.page.size": 1 << 16, "parquet.enable.dictionary": "false"})


def _gradients(sent):
    """One task's sum of gradients, in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, total = sent.value, None
        for batch in batches:
            raw = batch.column(0)
            lengths = pa.compute.binary_length(raw).to_numpy(zero_copy_only=False) // 4
            codes = np.frombuffer(b"".join(raw.to_pylist()), np.uint32)
            for ids, classes in contexts(codes, np.append(0, np.cumsum(lengths))):
                own = net.gradient(ids, classes)
                total = own if total is None else [a + b for a, b in zip(total, own, strict=True)]
        if total is not None:
            flat = np.concatenate([x.ravel() for x in total])
            pieces = [flat[i : i + _PIECE].tobytes() for i in range(0, len(flat), _PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], names=["piece", "sums"])

    return run


def _add(key: tuple, parts: pa.Table) -> pa.Table:
    sums = sum(np.frombuffer(raw) for raw in parts["sums"].to_pylist())
    return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([sums.tobytes()], pa.binary())})


def slice_gradient(codes: DataFrame, net: Network, words: int) -> list[np.ndarray] | None:
    """The gradient summed over all words of rows of ``_coded``; None if they have none."""
    tasks = min(MOST_TASKS, max(1, ceil(words / TASK_WORDS)))
    sent = codes.sparkSession.sparkContext.broadcast(net)
    shape = "piece int, sums binary"
    sums = codes.select("codes").coalesce(tasks).mapInArrow(_gradients(sent), shape)
    if tasks > 64:  # two levels, so that no task meets the gradients of all tasks but about their square root
        width = isqrt(tasks)
        sums = sums.withColumn("share", F.floor(F.spark_partition_id() / width)).groupBy("piece", "share").applyInArrow(_add, shape)
    pieces = sorted((r["piece"], bytes(r["sums"])) for r in sums.groupBy("piece").applyInArrow(_add, shape).collect())
    sent.unpersist()
    if not pieces:
        return None
    flat, at, out = np.concatenate([np.frombuffer(raw) for _, raw in pieces]), 0, []
    for x in net.arrays():
        out.append(flat[at : at + x.size].reshape(x.shape))
        at += x.size
    return out


def train(docs: DataFrame, seen: np.ndarray, text_column: str = "text") -> Network:
    """One pass over all words of all documents, a step of Adam for each slice; ``seen`` are ``class_counts``."""
    net = Network.start(seen)
    codes = _coded(docs, text_column)
    words = {r["slice"]: r["n"] for r in codes.groupBy("slice").agg(F.sum("n").alias("n")).collect()}
    mean, power = ([np.zeros(x.shape) for x in net.arrays()] for _ in range(2))
    step = 0
    for number in range(ROUNDS):
        if not words.get(number):
            continue
        step += 1
        sums = slice_gradient(codes.filter(F.col("slice") == number), net, words[number])
        for x, g, m, v in zip(net.arrays(), sums, mean, power, strict=True):
            g = g / words[number]
            m += 0.1 * (g - m)
            v += 0.1 * (g * g - v)
            x -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.9**step)) + 1e-7)).astype(np.float32)
    return net


def scored(docs: DataFrame, net: Network, counts: DataFrame, text_column: str = "text", keep_text: bool = True) -> DataFrame:
    """The columns of ``docs`` with n_tokens, log_likelihood and mean_log_likelihood, replacing columns of those names.

    A null or empty text and one without words has 0 tokens, a log-likelihood of 0 and a
    null mean.  Equal texts have equal scores, and each row has one.  ``counts`` are the
    ``word_counts`` of the corpus, which must hold the words of ``docs``.  The most
    frequent words' counts go to all tasks, the others are joined; those of a count of
    one need not be, as its logarithm is 0.
    """
    names = ["n_tokens", "log_likelihood", "mean_log_likelihood"]
    docs = docs.drop(*names)
    kept = [f for f in docs.schema.fields if keep_text or f.name != text_column]
    least, every = common_from(counts)
    common = counts.filter(F.col("n") >= least).select("word", "n").toArrow().sort_by("word")
    sent = docs.sparkSession.sparkContext.broadcast((net, common["word"].to_numpy(), np.log(common["n"].to_numpy()), np.log(np.maximum(class_counts(counts), 1))))
    rest = StructType([StructField("word", LongType()), StructField("times", LongType())])
    schema = StructType([*kept, StructField("n_tokens", LongType()), StructField("log_likelihood", DoubleType()), StructField("_rest", ArrayType(rest))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, known, logs, classes = sent.value
        for batch in batches:
            for rows, data, offsets in arrays.steps(batch, text_column):
                hashes, codes, first = words_of(data, offsets)
                count = np.diff(first)
                doc = np.repeat(np.arange(len(count)), count)
                each = -classes[codes % CLASSES]
                if len(codes):
                    each += np.concatenate([net.score(ids, kinds)[kinds >= 0] for ids, kinds in contexts(codes, first)])
                words, where = np.unique(hashes.view(np.int64), return_inverse=True)
                at = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
                found = known[at] == words if len(known) else np.zeros(len(words), bool)
                each += np.where(found, logs[at] if len(known) else 0.0, 0.0)[where]
                pairs, times = np.unique(doc[~found[where]] * len(words) + where[~found[where]], return_counts=True)
                ends = np.searchsorted(pairs, np.arange(len(count) + 1) * len(words)).astype(np.int32)
                joined = pa.StructArray.from_arrays([pa.array(words[pairs % max(len(words), 1)]), pa.array(times)], names=["word", "times"])
                own = batch.slice(rows.start, rows.stop - rows.start)
                columns = [own.column(own.schema.get_field_index(f.name)) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(count), pa.array(np.bincount(doc, each, len(count)).astype(float)), pa.ListArray.from_arrays(pa.array(ends), joined)], names=[f.name for f in schema.fields])

    rows = docs.mapInArrow(run, schema)
    if not every:
        rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "scores")
        others = counts.filter((F.col("n") > 1) & (F.col("n") < least)).select("word", "n")
        joined = rows.select("_row", F.explode("_rest").alias("r")).select("_row", "r.word", "r.times").join(others, "word")
        more = joined.groupBy("_row").agg(F.sum(F.col("times") * F.log("n")).alias("_more"))
        rows = rows.join(more, "_row", "left").withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("_more", F.lit(0.0)))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return rows.withColumn("mean_log_likelihood", mean).select(*[f.name for f in kept], *names)


def op1_masked_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, log_likelihood and mean_log_likelihood of every document, by a network that learned from all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = word_counts(docs)
    return scored(docs, train(docs, class_counts(counts)), counts, keep_text=False)
