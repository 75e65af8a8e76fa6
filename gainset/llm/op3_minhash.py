"""MinHash near-dedup with odd sketches.

Documents of one shingle set form a node.  MinHash samples of a node are folded
into a parity bitmap, its odd sketch, and cut into bands.  Nodes that share a band
are candidates; the bits in which two sketches differ say how many samples differ,
which rules out most; the full sets decide the rest.

A group of copies must not cost its square.  So the nodes of a bucket, at first a band,
are compared with one of them only, its hub, and linked nodes merged.  What is left
between the components of a hub's nodes is compared exactly, group by group of up to
``DIRECT`` nodes, by what their differences from the hub share; a group gives fewer links
than it has nodes, however many of its pairs are close.  Larger groups are dealt into
finer buckets by the shingles in which their nodes differ from the hub, each with a hub
of its own in the next round, until no group holds two components.
No link that could join two components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gainset.llm import arrays, op2_exact
from gainset.llm.components import components
from gainset.llm.tables import MOST_BROADCAST, NO_ID, keyed, keys, table, with_group, without
from gainset.scratch import stored

SAMPLES = 80
SKETCH_WORDS = 4
#: Nodes of a hub's group, and shingles of all of them, that one task compares with each other.
DIRECT = 32_768
DIRECT_SHINGLES = 10_000_000
#: Entries of lists, and pairs, that are counted at once in a group.
LOOKS = 1 << 20
#: Bytes of a row that says which text is wanted, in a broadcast.
WANTED_BYTES = 128

_rng = np.random.default_rng(1729)
_SEEDS = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_FACTORS = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Similarity:
    """Links are pairs with 100 * intersection >= percent * union of their shingle sets."""

    shingle: int = 3
    percent: int = 85

    @property
    def rows(self) -> int:
        """Samples in a band: as many as leave a pair at the threshold a chance below one in a million of sharing none."""
        return next(r for r in (4, 3, 2, 1) if r == 1 or (1 - (self.percent / 100) ** r) ** (SAMPLES // r) < 1e-6)

    @property
    def most_bits(self) -> int:
        """Differing sketch bits that a pair at the threshold exceeds less than once in a million times."""
        p, bits = self.percent / 100, 64 * SKETCH_WORDS
        differ = SAMPLES * (1 - p) + 6 * sqrt(SAMPLES * p * (1 - p))
        return int(bits / 2 * (1 - (1 - 2 / bits) ** (2 * differ)) + sqrt(bits) / 2)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and where each document's begin.

    A document with fewer words than a shingle has its whole sequence as one; one
    without words has none.
    """
    starts, ends, first = arrays.words(data, offsets)
    words = arrays.Spans(arrays.byte_symbols(arrays.lower(data))).hash(starts, ends) | np.uint64(1)
    grams = arrays.Spans(words)
    whole = grams.grams(size)
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < size))
    lengths = np.where(counts >= size, counts - size + 1, counts > 0)
    edges = np.append(0, np.cumsum(lengths))
    out = np.empty(edges[-1], np.uint64)
    out[edges[short]] = grams.hash(first[short], first[short + 1])
    long = np.flatnonzero(counts >= size)
    for low, n, at in zip(first[long].tolist(), lengths[long].tolist(), edges[long].tolist(), strict=True):
        own = out[at : at + n]
        own[:] = whole[low : low + n]
        own.sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[edges[:-1][lengths > 0]] = True
    return out[new], np.append(0, np.cumsum(new))[edges]


def _samples(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash samples of non-empty sets, one row each."""
    out = np.empty((len(first) - 1, SAMPLES), np.uint64)
    for i in range(SAMPLES):
        out[:, i] = np.minimum.reduceat((sets ^ _SEEDS[i]) * _FACTORS[i], first[:-1])
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps: each sample flips one bit, so equal samples cancel in the XOR of two sketches."""
    bits = 64 * SKETCH_WORDS
    at = arrays.mix(samples ^ np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bits)
    flat = np.arange(len(samples), dtype=np.int64)[:, None] * bits + at.astype(np.int64)
    odd = np.bincount(flat.ravel(), minlength=len(samples) * bits).reshape(-1, SKETCH_WORDS, 64) & 1
    return (odd.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(2, dtype=np.uint64)


def parity(sets: np.ndarray, doc: np.ndarray, rows: int) -> np.ndarray:
    """Parity bitmaps of whole sets; the XOR of two has at most as many bits as the sets differ in members."""
    bits = 64 * SKETCH_WORDS
    at = (arrays.mix(sets) % np.uint64(bits)).astype(np.int64)
    odd = np.bincount(doc * bits + at, minlength=rows * bits).reshape(-1, SKETCH_WORDS, 64) & 1
    return (odd.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(2, dtype=np.uint64)


def _sketches(like: Similarity):
    rows = like.rows
    bands = SAMPLES // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in arrays.steps(batch, "text"):
                sets, first = shingle_sets(data, offsets, like.shingle)
                sizes = np.diff(first)
                some = np.flatnonzero(sizes)
                n = len(sizes)
                keys, band, sketch = np.zeros((n, 2), np.uint64), np.zeros((n, bands), np.uint64), np.zeros((n, 2 * SKETCH_WORDS), np.uint64)
                if len(some):
                    starts = np.append(first[some], len(sets))
                    for i in range(2):
                        keys[some, i] = arrays.mix(np.add.reduceat(arrays.mix(sets + np.uint64(i)), starts[:-1]) + sizes[some].astype(np.uint64))
                    samples = _samples(sets, starts)
                    sketch[some, :SKETCH_WORDS] = odd_sketch(samples)
                    sketch[:, SKETCH_WORDS:] = parity(sets, np.repeat(np.arange(n), sizes), n)
                    for b in range(bands):
                        acc = np.full(len(some), b + 1, np.uint64)
                        for r in range(rows):
                            acc = arrays.mix(acc * np.uint64(0x9E3779B97F4A7C15) + samples[:, b * rows + r])
                        band[some, b] = acc
                own = batch.slice(part.start, part.stop - part.start)
                node = pa.array([k if s else None for k, s in zip(map(bytes, keys), sizes.tolist(), strict=True)], pa.binary())
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.view(np.int64).ravel())) for x in (band, sketch)]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(sizes), node, *lists], names=["did", "dkey", "n", "node", "bands", "sketch"])

    return run


def _set_rows(like: Similarity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in arrays.steps(batch, "text"):
                sets, first = shingle_sets(data, offsets, like.shingle)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, part.stop - part.start), lists], names=["node", "shingles"])

    return run


def _close(like: Similarity, a: str, b: str) -> Column:
    """What the sizes and the sketches of a pair allow.

    The samples' sketch misses a link once in a million times, the sets' parity never.
    """
    x, y = F.col(a), F.col(b)
    samples, whole = (sum((F.bit_count(x[f"{p}{i}"].bitwiseXOR(y[f"{p}{i}"])) for i in range(1, SKETCH_WORDS)), F.bit_count(x[f"{p}0"].bitwiseXOR(y[f"{p}0"]))) for p in "sp")
    sizes = F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * like.percent
    return sizes & (whole * (100 + like.percent) <= (x["n"] + y["n"]) * (100 - like.percent)) & (samples <= like.most_bits)


def _confirmed(pairs: DataFrame, sets: DataFrame, like: Similarity) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; a hub's pairs meet in a plain join, which Spark can split."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").filter(both * 100 >= (F.size("sa") + F.size("sb") - both) * like.percent).select("a", "b")


def near_duplicates(docs: DataFrame, like: Similarity = Similarity(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its id, n_shingles, component_id and kept.

    Null and empty texts have no shingles and are linked with nothing; they stay.
    Equal sets are one node, so equal texts cost nothing further.  The component is
    named by its smallest id; null ids count as larger than any other for that.
    """
    id_or_none = F.when(F.col("did") != NO_ID, F.col("did"))
    out = _grouped(docs, like, id_column, text_column)
    out = out.select(id_or_none.alias(id_column), F.col("n").alias("n_shingles"), F.when(F.col("first.did") != NO_ID, F.col("first.did")).alias("component_id"))
    return out.withColumn("kept", F.col(id_column).eqNullSafe(F.col("component_id")))


def _grouped(docs: DataFrame, like: Similarity, id_column: str, text_column: str) -> DataFrame:
    """Rows (did, dkey, n, first) of the rows of ``keyed``: first names the one document that stands for the component."""
    texts = keyed(docs, id_column, text_column)
    rows = stored(texts.mapInArrow(_sketches(like), "did long, dkey long, n long, node binary, bands array<long>, sketch array<long>"), "sketches")
    total = rows.count()
    first = F.struct((F.col("did") == NO_ID).alias("none"), "did", "dkey").alias("first")
    filled = rows.filter(F.col("node").isNotNull())
    nodes = filled.groupBy("node").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("size"), F.min(F.struct("did", "dkey", "n", "bands", "sketch")).alias("one"))
    nodes = stored(nodes.select("node", "first", "size", "one.*"), "nodes")

    banded = nodes.select("node", F.explode("bands").alias("key"))  # most bands aren't shared, so sketches come later
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    slots = total * (SAMPLES // like.rows)
    together = stored(with_group(banded, shared, "key", "members", slots), "bands")
    # A document that others were made from shares more bands with them than they share with each other.
    known = together.groupBy("node").agg(F.sum("members").alias("known"))
    packed = F.struct("node", "n", *[F.col("sketch")[i].alias(f"{'sp'[i // SKETCH_WORDS]}{i % SKETCH_WORDS}") for i in range(2 * SKETCH_WORDS)]).alias("x")
    wanted = stored(nodes.select("node", "did", "dkey", packed).join(known, "node"), "wanted")
    together = together.select("node", "key").join(wanted.select("node", "x", "known"), "node").select("key", "x", "known")
    sets = stored(_texts_of(texts, wanted.select("node", "did", "dkey")).mapInArrow(_set_rows(like), "node binary, shingles array<long>").dropDuplicates(["node"]), "sets")
    roots = _roots(together, sets, slots, like)

    named = nodes.select("node", "first", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first").alias("first"))
    named = named.drop("first").join(least, "root").select("node", "first", "size")
    out = with_group(filled.select("did", "dkey", "n", "node"), named, "node", "size", total).select("did", "dkey", "n", "first")
    return out.unionByName(rows.filter(F.col("node").isNull()).select("did", "dkey", "n", first))


def _texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (node, text) of the ``texts`` that ``wanted`` names; where those are too many to be broadcast, a bitmap of their ids keeps most other texts from moving."""
    n = wanted.count()
    bits = op2_exact.filter_bits(n)
    if n * WANTED_BYTES <= MOST_BROADCAST:
        wanted = F.broadcast(wanted)
    elif 1 << bits <= op2_exact.MOST_BITS:
        hashed = F.xxhash64("did", "dkey").alias("hash")
        texts = op2_exact.marked(texts.select("*", hashed), stored(op2_exact.taken_slots(wanted.select(hashed), bits), "filter"), bits).filter("maybe").drop("maybe")
    return texts.join(wanted, ["did", "dkey"]).select("node", "text")


def _roots(members: DataFrame, sets: DataFrame, total: int, like: Similarity) -> DataFrame:
    """Components, rows (node, root), of the links within buckets (key, x, known) of fewer than ``total`` rows."""
    links = roots = None
    while True:
        hubs = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("known", "x")).alias("hub"))
        seen = with_group(members, hubs, "key", "size", total).select("x", "known", F.col("hub.x").alias("hub"), F.col("hub.known").alias("hub_known"))
        # Buckets of one hub are one group, so that a pair that meets in many of them is looked at once.
        seen = stored(seen.filter("x.node <> hub.node").dropDuplicates(["x", "hub"]), "buckets")
        star = stored(seen.filter(_close(like, "x", "hub")).select(F.col("x.node").alias("a"), F.col("hub.node").alias("b"), "hub_known"), "star")
        if links is None:  # most nodes are linked with the best known of their hubs, which spares the other pairs
            links = stored(_confirmed(star.groupBy("a").agg(F.max(F.struct("hub_known", "b")).alias("top")).select("a", "top.b"), sets, like), "links")
            roots = components(links)
        rows = _rooted(_rooted(seen.withColumns({"_x": F.col("x.node"), "_h": F.col("hub.node")}), roots, "_x", "root"), roots, "_h", "hub_root")
        groups = rows.groupBy("_h").agg(F.count(F.lit(1)).alias("size"), F.sum("x.n").alias("shingles"), F.min("root").alias("low"), F.max("root").alias("high"), F.max("hub_root").alias("own")).filter("low <> high or low <> own")
        large = (F.col("size") > DIRECT) | (F.col("shingles") + F.col("hub.n") > DIRECT_SHINGLES)
        rows = stored(with_group(rows, groups.select("_h", "size", "shingles"), "_h", "size", total).withColumn("large", large).drop("_x", "_h"), "mixed")
        finer = rows.filter("large")
        some = finer.limit(1).count()
        more = _linked(rows.filter("not large"), sets, like)
        if some:
            pairs = finer.filter(_close(like, "x", "hub")).select(F.col("x.node").alias("a"), F.col("hub.node").alias("b"))
            more = more.unionByName(_confirmed(_apart(pairs, roots), sets, like))
        more = stored(more, "links")
        if more.count():
            links = links.unionByName(more)
            roots = components(links)
        if not some:
            return roots
        members = stored(_finer(finer, sets, like), "finer")
        total = members.count()


def _linked(rows: DataFrame, sets: DataFrame, like: Similarity) -> DataFrame:
    """Links (a, b) that join what is linked in each hub's group, from rows (x, hub, root, hub_root); no more than nodes."""
    own = rows.select(F.col("hub.node").alias("node"), F.col("hub.node").alias("hub"), F.col("hub_root").alias("root")).distinct()
    both = rows.select(F.col("x.node").alias("node"), F.col("hub.node").alias("hub"), "root").unionByName(own)
    return both.join(sets, "node").groupBy("hub").applyInArrow(_group_links(like), "a binary, b binary")


def _group_links(like: Similarity):
    def run(group: pa.Table) -> pa.Table:
        nodes, roots = group["node"].to_pylist(), group["root"].to_pylist()
        place = {r: i for i, r in enumerate(dict.fromkeys(roots))}
        parts = [(x.flatten().to_numpy(), x.value_lengths().to_numpy().astype(np.int64)) for x in group["shingles"].chunks]
        found = group_links(parts, nodes.index(group["hub"][0].as_py()), np.array([place[r] for r in roots]), like)
        return pa.table({"a": pa.array([nodes[i] for i, _ in found], pa.binary()), "b": pa.array([nodes[j] for _, j in found], pa.binary())})

    return run


def _differences(parts: list[tuple[np.ndarray, np.ndarray]], base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (set, shingle) of what only one of a set and the base has; a missing shingle of the base goes by its place, others by numbers beyond."""
    who, what, low, new = [], [], 0, []
    for values, sizes in parts:
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        at = np.minimum(np.searchsorted(base, values), len(base) - 1)
        hit = base[at] == values
        held = np.zeros((len(sizes), len(base)), bool)
        held[owner[hit], at[hit]] = True
        lost, lost_at = np.nonzero(~held)
        who += [lost + low, owner[~hit] + low]
        what += [lost_at, values[~hit]]
        new += [np.zeros(len(lost), bool), np.ones(len(who[-1]), bool)]
        low += len(sizes)
    who, what, new = (np.concatenate(x) for x in (who, what, new))
    what[new] = np.unique(what[new], return_inverse=True)[1] + len(base)
    return who, what


def group_links(parts: list[tuple[np.ndarray, np.ndarray]], hub: int, label: np.ndarray, like: Similarity) -> list[tuple[int, int]]:
    """Pairs of one group, by their places, that join the components of all its links and of ``label``.

    Sets (``parts``: members, one set after another, and sizes) are seen as their differences
    from the hub's, which tell exactly by how many shingles two of them differ: both
    differences less twice what they share.  Sets linked with the hub are in its component,
    so only the others are compared with all: bit by bit in shingles of many differences, and
    through lists of the sets that differ in a shingle for the others.
    """
    sizes = np.concatenate([x for _, x in parts])
    m, out, label = len(sizes), [], label.copy()
    most, least = 100 + like.percent, 100 - like.percent

    def join(i: int, others: np.ndarray) -> None:
        kinds, first = np.unique(label[others], return_index=True)
        new = kinds != label[i]
        out.extend((i, int(j)) for j in others[first[new]])
        label[np.isin(label, kinds[new])] = label[i]

    before = 0
    for values, lengths in parts:
        if before <= hub < before + len(lengths):
            base = np.sort(np.split(values, np.cumsum(lengths))[hub - before])
        before += len(lengths)
    who, what = _differences(parts, base)
    differs = np.bincount(who, minlength=m)
    far = differs * most > least * (sizes + sizes[hub])
    join(hub, np.flatnonzero(~far))
    if (label == label[0]).all():
        return out
    # Shingles of one difference aren't shared, and those of no far set aren't looked up.
    lengths = np.bincount(what)
    useful = (lengths > 1) & (np.bincount(what[far[who]], minlength=len(lengths)) > 0)
    common = useful & (lengths > m // 64)
    here = common[what]
    bits = np.zeros((-(-int(common.sum()) // 64), m), np.uint64)
    column = np.cumsum(common)[what[here]] - 1
    np.bitwise_or.at(bits, (column // 64, who[here]), np.uint64(1) << (column % 64).astype(np.uint64))
    here = useful[what] & ~here
    who, what = who[here], what[here]
    lists = who[np.argsort(what, kind="stable")]
    lengths = np.bincount(what, minlength=len(lengths))
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(who, kind="stable")
    who, what = who[order], what[order]
    first = np.searchsorted(who, np.arange(m + 1))
    looks = np.append(0, np.cumsum(lengths[what]))[first]
    rest = np.flatnonzero(far)
    while len(rest) and (label != label[0]).any():
        spent = np.cumsum(looks[rest + 1] - looks[rest] + m)
        now, rest = np.split(rest, [max(1, int(np.searchsorted(spent, LOOKS, "right")))])
        columns = np.concatenate([what[first[i] : first[i + 1]] for i in now])
        line = np.repeat(np.arange(len(now)), first[now + 1] - first[now])
        counts = lengths[columns]
        at = np.repeat(starts[columns] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        shared = np.bincount(np.repeat(line, counts) * m + lists[at], minlength=len(now) * m).reshape(len(now), m)
        for word in bits:
            shared += np.bitwise_count(word[now][:, None] & word)
        linked = (differs[now][:, None] + differs - 2 * shared) * most <= least * (sizes[now][:, None] + sizes)
        for i in np.flatnonzero((linked & (label[now][:, None] != label)).any(1)):
            join(int(now[i]), np.flatnonzero(linked[i]))
    return out


def _finer(rows: DataFrame, sets: DataFrame, like: Similarity) -> DataFrame:
    """Finer buckets (key, x, known), from rows (x, known, root, hub) of nodes that were compared with their hub.

    Each node is seen as its difference from the hub, the shingles that only one of both
    has.  Let D be a difference's size, n a set's, and k = (100 - percent) / (100 +
    percent); a link means that two sets differ in at most k (n1 + n2) shingles, so that
    their differences share at least (D1 + D2 - k (n1 + n2)) / 2.  Of two nodes in
    different components one isn't linked to the hub, so its D is over k (n1 + nh),
    and the shared part is over (D2 + k (nh - n2)) / 2, more than a third of D2 for all
    but low thresholds.  Hence the other node's difference without that many shingles,
    less one, still meets the first one's.  Those that the hub lacks are kept first, as
    they are rarer.  A node is near with the shingles kept, and far with all of them if
    it isn't linked to the hub; a bucket needs both, and two components.
    """
    pairs = rows.select(F.col("x.node").alias("node"), F.col("hub.node").alias("hub"), "x", "known", "root").dropDuplicates(["node", "hub"])
    own = sets.select("node", F.col("shingles").alias("sa"))
    other = sets.select(F.col("node").alias("hub"), F.col("shingles").alias("sb"))
    both, rest = F.lit(100 + like.percent), F.lit(100 - like.percent)
    rows = pairs.join(own, "node").join(other, "hub").withColumn("differs", F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa")))
    size, nh = F.size("differs"), F.size("sb")
    least = F.floor((size * both + rest * (nh - F.col("x.n"))) / (both * 2)) + 1
    far = size * both > rest * (F.col("x.n") + nh)
    placed = F.transform("differs", lambda s, i: F.struct(F.xxhash64("hub", s).alias("key"), (i <= size - least).alias("near")))
    entries = rows.select("x", "known", "root", far.alias("far"), F.explode(placed).alias("p")).filter("far or p.near")
    entries = stored(entries.select("p.key", "p.near", "far", "x", "known", "root"), "entries")
    useful = entries.groupBy("key").agg(F.max("near").alias("near"), F.max("far").alias("far"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high and near and far")
    return entries.select("key", "x", "known").join(stored(useful.select("key"), "keys"), "key")


def _rooted(pairs: DataFrame, roots: DataFrame, column: str, name: str) -> DataFrame:
    own = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    return pairs.join(own, F.col(column) == F.col("_n"), "left").withColumn(name, F.coalesce("_r", F.col(column))).drop("_n", "_r")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    return _rooted(_rooted(pairs, roots, "a", "ra"), roots, "b", "rb").filter("ra <> rb").select("a", "b")


def kept_documents(docs: DataFrame, like: Similarity) -> DataFrame:
    """One document of each component and every document without shingles, with the columns they came with.

    The document with the smallest id stays, one without an id only where none has one;
    of texts with the same id, or without, the one with the smallest hash.  Of rows that
    repeat both id and text one stays.
    """
    rows = stored(_grouped(docs, like, "doc_id", "text"), "groups")
    kept = without(docs, rows.filter((F.col("did") != F.col("first.did")) | (F.col("dkey") != F.col("first.dkey"))))
    again = stored(rows.filter("n > 0").groupBy("did", "dkey").count().filter("count > 1").select("did", "dkey"), "again")
    if not again.count():
        return kept
    did, dkey = keys(kept, "doc_id", "text")
    once = without(kept, again)
    repeated = kept.withColumns({"_d": did, "_k": dkey}).join(again, (F.col("_d") == again["did"]) & (F.col("_k") == again["dkey"]), "left_semi")
    return once.unionByName(repeated.dropDuplicates(["_d", "_k"]).drop("_d", "_k"))


def op3_minhash_neardedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_duplicates`` over all documents, with three-word shingles and 85 %."""
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END) AS h
      FROM d, unnest(range(1, greatest(len(w) - 1, 2))) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(v, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id, d.doc_id = min(c) AS kept
FROM d JOIN r ON r.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
