"""Windows of a fixed number of units (bytes, words, lines) that occur more than once.

Every window has an anchor: the position of the least hashed k-gram among its first
``spread`` positions.  The choice depends on the window alone, so equal windows
have equal anchors at equal offsets, and neighbouring windows mostly share one.
What all windows of an anchor have in common is its core; what they cover together
is its phrase.  Text thus moves through the cluster as one short row per phrase.

* Equal phrases make all their windows recur.  Each block of documents keeps one
  row per phrase, so a phrase that a third of all documents hold still arrives as
  one row per block, and grouping finishes the rest.
* Phrases that share their core but differ are edges of a repeated passage.  Their
  text is fetched and an exact resolver compares single windows.  A block that
  itself sees several phrases of a core sends them to the resolver directly, and
  the resolver splits cores of many edges, so no core gathers in one task.
* Cores that occur once are dropped.

``later_only`` says which windows count: those that also start earlier (smaller
id, or same document and earlier start), or those that also start anywhere else.
Rows that repeat both id and text are one document.  A null id is the smallest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gainset.llm import arrays
from gainset.llm.tables import NO_ID, keyed
from gainset.scratch import stored

#: Anchors that a block gathers before it keeps one row per phrase.
BLOCK_ANCHORS = 150_000
#: Edges of one core that are resolved together; a core with more is split.
TOGETHER = 4_096
#: Split cores that are broadcast (a few MB); with more of them they meet the edges in a shuffle.
MOST_HOT = 100_000
#: Units of a document that are looked at in one step; longer ones go in overlapping steps.
SEGMENT = 1 << 20
#: Bits of an anchor's key that hold its position in the step; the others are of its hash.
_PLACE_BITS = 24
#: Bytes of edge text resolved at once.
RESOLVED_BYTES = 2 << 20

_ROWS = "kind byte, part long, full long, core long, did long, dkey long, a int, b int"
_SINGLE, _EDGE, _MARKER, _FLAGGED = 0, 1, 2, 3

#: Takes phrases as byte strings and gives, for each phrase and window, a number
#: that windows share exactly if they are equal: (phrase index, start, number).
Resolver = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Shape:
    unit: str
    length: int
    spread: int
    gram: int
    #: Words in a window of lines at least; others don't count.
    least_words: int = 0

    def __post_init__(self) -> None:
        if self.least_words and (self.unit != "line" or self.spread > 1):
            raise ValueError("only single windows of lines are chosen by their words")
        if self.length < 1 or self.spread < 1 or self.gram < 1 or self.spread + self.gram - 1 > self.length:
            raise ValueError("a window must hold all the k-grams that choose its anchor")


def units(data: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the units in the bytes, and each document's first unit."""
    if unit == "byte":
        starts = np.arange(len(data))
        return starts, starts + 1, offsets
    return arrays.words(data, offsets) if unit == "word" else arrays.lines(data, offsets)


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    if width == 1 or len(keys) < width:
        return keys[: max(0, len(keys) - width + 1)]
    n = len(keys)
    padded = np.concatenate([keys, np.full(-n % width, np.iinfo(keys.dtype).max, keys.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(symbols: np.ndarray, offsets: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """Document, first and last window, core hash and phrase hash of every anchor.

    Of equal hashes the first counts, in every step alike.
    """
    n, length = len(symbols), shape.length
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    if n >> _PLACE_BITS:
        raise ValueError("a step has more units than an anchor's key can tell apart")
    spans = arrays.Spans(symbols)
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    keys = spans.grams(shape.gram)
    keys = (keys & ~mask) | np.arange(len(keys), dtype=np.uint64)
    at = (sliding_least(keys, shape.spread)[: n - length + 1] & mask).astype(np.int64)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: n - length + 1]
    starts = np.flatnonzero(np.arange(length, n + 1) <= ends)
    if not len(starts):
        return starts, starts, starts, starts.view(np.uint64), starts.view(np.uint64)
    at = at[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    a, b, t = starts[first], starts[np.append(first[1:], len(starts)) - 1], at[first]
    doc = np.searchsorted(offsets, a, "right") - 1
    return doc, a - offsets[doc], b - offsets[doc], spans.hash(t, t + length - shape.spread + 1), spans.hash(a, b + length)


def _anchored(data: np.ndarray, starts: np.ndarray | None, ends: np.ndarray | None, first: np.ndarray, shape: Shape) -> Iterator[tuple[np.ndarray, ...]]:
    """``anchors`` of a step; one very long document goes segment by segment.

    Segments overlap by all but one unit of a window, so each window is in one of them.
    A phrase that a cut parts is an edge like others.
    """

    def symbols(low: int, high: int) -> np.ndarray:
        if shape.unit == "byte":
            return arrays.byte_symbols(data[low:high])
        if high <= low:
            return np.zeros(0, np.uint64)
        base = starts[low]
        own = arrays.byte_symbols(data[base : ends[high - 1]])
        return arrays.Spans(own).hash(starts[low:high] - base, ends[low:high] - base) | np.uint64(1)

    n = int(first[-1])
    if n <= 2 * SEGMENT or len(first) > 2:
        yield anchors(symbols(0, n), first, shape)
        return
    for low in range(0, n - shape.length + 1, SEGMENT):
        high = min(n, low + SEGMENT + shape.length - 1)
        doc, a, b, core, full = anchors(symbols(low, high), np.array([0, high - low]), shape)
        yield doc, a + low, b + low, core, full


def _changes(*columns: np.ndarray) -> np.ndarray:
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _collapsed(did, dkey, a, b, core, full, later_only: bool) -> pa.RecordBatch:
    """One block's rows with each phrase once, and what the block already decides."""
    order = np.argsort(core)
    sorted_core = core[order]
    fresh = _changes(sorted_core)
    alone = fresh & np.append(fresh[1:], True)
    lone, rest = order[alone], order[~alone]
    rest = rest[np.lexsort((a[rest], dkey[rest], did[rest], full[rest], core[rest]))]
    new_core = _changes(core[rest])
    new_phrase = new_core | _changes(full[rest])
    place = np.cumsum(new_phrase | _changes(did[rest], dkey[rest], a[rest]))
    phrase_at = np.flatnonzero(new_phrase)
    phrase_of = np.cumsum(new_phrase) - 1
    core_of = np.cumsum(new_core) - 1
    if later_only:
        flagged = place != place[phrase_at][phrase_of]
    else:
        last = np.append(phrase_at[1:], len(rest))[: len(phrase_at)] - 1
        flagged = (place[last] != place[phrase_at])[phrase_of]
    phrases = np.bincount(core_of[phrase_at], minlength=1) if len(rest) else np.zeros(1, int)
    many = phrases[core_of[phrase_at]] > 1 if len(rest) else np.zeros(0, bool)
    reps, core_first = rest[phrase_at], new_core[phrase_at] if len(rest) else np.zeros(0, bool)
    rows = [(_SINGLE, lone), (_SINGLE, reps[~many]), (_EDGE, reps[many]), (_MARKER, reps[many & core_first]), (_FLAGGED, rest[flagged])]
    index = np.concatenate([x for _, x in rows])
    kind = np.repeat(np.array([k for k, _ in rows], np.int8), [len(x) for _, x in rows])
    moving = (kind == _SINGLE) | (kind == _MARKER)
    spread = arrays.mix(full[index] ^ did[index].view(np.uint64) ^ (a[index].astype(np.uint64) << np.uint64(33)) ^ kind.astype(np.uint64))
    columns = [
        kind,
        np.where(moving, core[index], spread).view(np.int64),
        np.where(moving, full[index], 0).astype(np.uint64).view(np.int64),
        np.where(kind == _EDGE, core[index], 0).astype(np.uint64).view(np.int64),
        did[index],
        dkey[index],
        a[index].astype(np.int32),
        b[index].astype(np.int32),
    ]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["kind", "part", "full", "core", "did", "dkey", "a", "b"])


def _phrases(shape: Shape, later_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for rows, data, offsets in arrays.steps(batch, "text"):
                starts, ends, first = (None, None, offsets) if shape.unit == "byte" else units(data, offsets, shape.unit)
                for doc, a, b, core, full in _anchored(data, starts, ends, first, shape):
                    if shape.least_words:
                        begin = arrays.words(data, offsets)[0]
                        low = first[doc] + a
                        many = np.searchsorted(begin, ends[low + shape.length - 1]) - np.searchsorted(begin, starts[low]) >= shape.least_words
                        doc, a, b, core, full = (x[many] for x in (doc, a, b, core, full))
                    held.append((ids[0][rows][doc], ids[1][rows][doc], a, b, core, full))
                    count += len(a)
                    if count >= BLOCK_ANCHORS:
                        yield _collapsed(*map(np.concatenate, zip(*held, strict=True)), later_only)
                        held, count = [], 0
        if count:
            yield _collapsed(*map(np.concatenate, zip(*held, strict=True)), later_only)

    return run


def _lists(column: pa.Array, names: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and values of a column of lists of structs; a null list is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.array(pa.compute.fill_null(pa.compute.list_value_length(column), 0), np.int64)
    flat = column.flatten()
    return np.concatenate([[0], np.cumsum(lengths)]), [flat.field(names.index(x)).to_numpy(zero_copy_only=False) for x in names]


def _fetch(shape: Shape) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Text of the edges' phrases; units are joined as they are compared."""
    glue = {"byte": b"", "word": b" ", "line": b"\n"}[shape.unit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, dkey = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            at, (a, b, core, salt) = _lists(batch.column(3), ["a", "b", "core", "salt"])
            for rows, data, offsets in arrays.steps(batch, "text"):
                starts, ends, first = units(data, offsets, shape.unit)
                raw, docs, picked, spans = data.tobytes(), [], [], []
                for i, row in enumerate(range(rows.start, rows.stop)):
                    for x in range(at[row], at[row + 1]):
                        low, high = first[i] + a[x], first[i] + b[x] + shape.length
                        spans.append(raw[low:high] if shape.unit == "byte" else glue.join(raw[starts[u] : ends[u]] for u in range(low, high)))
                        docs.append(row)
                        picked.append(x)
                columns = [core[picked], salt[picked], did[docs], dkey[docs], a[picked]] if spans else [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(spans, pa.binary())], names=["core", "salt", "did", "dkey", "a", "phrase"])

    return run


def _resolve(resolver: Resolver, later_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Windows of the edges that recur among the edges resolved together.

    Windows of a split core that nothing here decides go on with their content hash.
    """
    names = ["open", "did", "dkey", "a", "b", "key1", "key2"]

    def solved(core, salt, did, dkey, a, phrases: list[bytes]) -> pa.RecordBatch:
        row, start, number = resolver(phrases)
        pos = a[row].astype(np.int64) + start
        # Where later ones count, the first goes on; else any, as all of them are flagged.
        order = np.lexsort((pos, dkey[row], did[row], number)) if later_only else np.argsort(number)
        new = _changes(number[order])
        again, still = np.zeros(len(row), bool), np.zeros(len(row), bool)
        again[order] = ~new if later_only else (np.diff(np.append(np.flatnonzero(new), len(row))) > 1)[np.cumsum(new) - 1]
        still[order] = new
        still &= salt[row] >= 0
        # Neighbouring windows of a phrase go out as one run.
        flagged = np.flatnonzero(again)
        opens = np.ones(len(flagged), bool)
        opens[1:] = (flagged[1:] != flagged[:-1] + 1) | (row[flagged[1:]] != row[flagged[:-1]])
        low = flagged[opens]
        high = flagged[np.append(np.flatnonzero(opens)[1:], len(flagged)) - 1] if len(flagged) else low
        left = np.flatnonzero(still)
        keys = np.array([(0, 0)] * len(low) + [window_key(phrases[row[x]], int(start[x])) for x in left], np.int64).reshape(-1, 2)
        index, last = np.concatenate([low, left]), np.concatenate([high, left])
        columns = [np.repeat([False, True], [len(low), len(left)]), did[row][index], dkey[row][index], pos[index].astype(np.int32), pos[last].astype(np.int32), keys[:, 0], keys[:, 1]]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=names)

    window_key = resolver.window_key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            core, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lengths = pa.compute.binary_length(batch.column(5)).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(_changes(core, salt))
            if held:
                last = held[-1]
                if last.column(0)[-1].as_py() == core[0] and last.column(1)[-1].as_py() == salt[0]:
                    cuts = cuts[1:]
            low, upto = 0, np.append(0, np.cumsum(lengths))
            for cut in cuts:
                if size + upto[cut] - upto[low] >= RESOLVED_BYTES:
                    held.append(batch.slice(low, cut - low))
                    yield solved(*_columns(held))
                    held, size, low = [], 0, int(cut)
            held.append(batch.slice(low))
            size += int(upto[-1] - upto[low])
        if held:
            yield solved(*_columns(held))

    return run


def _columns(held: list[pa.RecordBatch]) -> tuple:
    whole = pa.Table.from_batches([x for x in held if x.num_rows])
    columns = [whole.column(i).to_numpy() for i in range(5)]
    fresh = _changes(*columns)  # a row read twice, as its document is
    return *(c[fresh] for c in columns), whole.column(5).filter(pa.array(fresh)).to_pylist()


def recurring(texts: DataFrame, shape: Shape, resolver: Resolver | None, later_only: bool) -> DataFrame:
    """First and last window of runs that recur in the rows of ``keyed``, as rows (did, dkey, a, b).

    With a spread of one each window is a phrase of its own, so that nothing is left to resolve.
    """
    rows = texts.mapInArrow(_phrases(shape, later_only), _ROWS)
    of_core, place = Window.partitionBy("part"), F.struct("did", "dkey", "a")
    of_phrase = Window.partitionBy("part", "full").orderBy("did", "dkey", "a")
    # By core first: rows dealt by core are together by phrase as well, so they move once.
    rows = rows.withColumn("many", (F.min("full").over(of_core) != F.max("full").over(of_core)) | (F.max(F.col("kind") == _MARKER).over(of_core)))
    rows = rows.withColumn("first", F.first(place).over(of_phrase))
    if later_only:
        again = place != F.col("first")
    else:
        rows = rows.withColumn("last", F.last(place).over(of_phrase.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        again = F.col("first") != F.col("last")
    flagged = (F.col("kind") == _FLAGGED) | (F.col("kind").isin(_SINGLE, _MARKER) & again)
    edge = (F.col("kind") == _EDGE) | ((F.col("kind") == _SINGLE) & F.col("many") & (place == F.col("first")))
    core = F.when(F.col("kind") == _EDGE, F.col("core")).otherwise(F.col("part"))
    marks = stored(rows.select(flagged.alias("flagged"), edge.alias("edge"), core.alias("core"), "did", "dkey", "a", "b").filter("flagged or edge"), "marks")
    if shape.spread == 1:
        return marks.filter("flagged").select("did", "dkey", "a", "b")

    edges = marks.filter("edge")
    hot = stored(edges.groupBy("core").count().filter(F.col("count") > TOGETHER).select("core", F.ceil(F.col("count") / TOGETHER).cast("int").alias("parts")), "hot")
    salted = edges.join(F.broadcast(hot) if hot.count() <= MOST_HOT else hot, "core", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("did", "dkey"), F.col("parts")).cast("int"), F.lit(-1)))
    # Texts and what is known of them meet in the same way at every size.
    wanted = salted.groupBy("did", "dkey").agg(F.collect_set(F.struct("a", "b", "core", "salt")).alias("edges"))
    fetched = texts.join(wanted.hint("merge"), ["did", "dkey"]).select("did", "dkey", "text", "edges").mapInArrow(_fetch(shape), "core long, salt int, did long, dkey long, a int, phrase binary")
    parts = fetched.repartition("core", "salt").sortWithinPartitions("core", "salt", "did", "dkey", "a")
    solved = stored(parts.mapInArrow(_resolve(resolver, later_only), "open boolean, did long, dkey long, a int, b int, key1 long, key2 long"), "windows")
    by_window = Window.partitionBy("key1", "key2").orderBy("did", "dkey", "a")
    opened = solved.filter("open").withColumn("first", F.first(place).over(by_window)).withColumn("last", F.last(place).over(by_window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    opened = opened.filter(place != F.col("first") if later_only else F.col("first") != F.col("last"))
    spans = ["did", "dkey", "a", "b"]
    return marks.filter("flagged").select(spans).unionByName(solved.filter("not open").select(spans)).unionByName(opened.select(spans))


def without_recurring(docs: DataFrame, shape: Shape, resolver: Resolver, later_only: bool, id_column: str = "doc_id", text_column: str = "text", also: tuple[Shape, ...] = ()) -> DataFrame:
    """One row per document: its id, n_units, n_removed, n_spans and ``kept``.

    Removes every unit that a recurring window covers, of ``shape`` or of a shape of
    ``also``, which have a spread of one.  ``kept`` is binary: the remaining bytes,
    words joined by one space, or lines joined by line feeds.
    """
    texts = keyed(docs, id_column, text_column)
    runs = recurring(texts, shape, resolver, later_only)
    for other in also:  # as windows of the first shape's length, or short of it by the difference
        runs = runs.unionByName(recurring(texts, other, None, later_only).withColumn("b", F.col("b") + (other.length - shape.length)))
    per_doc = runs.groupBy("did", "dkey").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("runs"))
    merged = per_doc.mapInArrow(_merge, "did long, dkey long, runs array<struct<a: int, b: int>>")
    out = texts.join(stored(merged, "runs").hint("merge"), ["did", "dkey"], "left").select("did", "text", "runs").mapInArrow(_remove(shape), "did long, n_units long, n_removed long, n_spans long, kept binary")
    return out.select(F.when(F.col("did") != NO_ID, F.col("did")).alias(id_column), "n_units", "n_removed", "n_spans", "kept")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows, sorted by their first, as few as say the same."""
    for batch in batches:
        at, (a, b) = _lists(batch.column(2), ["a", "b"])
        row = np.repeat(np.arange(batch.num_rows), np.diff(at))
        far = b + row * (1 << 33)
        reach = np.maximum.accumulate(far)
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (a[1:] + row[1:] * (1 << 33) > reach[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(row)) - 1
        ends = (reach[last] - row[first] * (1 << 33)).astype(np.int32)
        offsets = np.append(0, np.cumsum(np.bincount(row[first], minlength=batch.num_rows))).astype(np.int32)
        runs = pa.StructArray.from_arrays([pa.array(a[first]), pa.array(ends)], names=["a", "b"])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), runs)], names=["did", "dkey", "runs"])


def _remove(shape: Shape) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    glue = {"byte": b"", "word": b" ", "line": b"\n"}[shape.unit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, (a, b) = _lists(batch.column(2), ["a", "b"])
            for rows, data, offsets in arrays.steps(batch, "text"):
                if shape.unit == "byte":
                    starts = ends = None
                    first = offsets
                else:
                    starts, ends, first = units(data, offsets, shape.unit)
                base = np.repeat(first[:-1], np.diff(at[rows.start : rows.stop + 1]))
                own = slice(at[rows.start], at[rows.stop])
                steps = np.bincount(base + a[own], minlength=first[-1] + 1).astype(np.int64)
                steps -= np.bincount(np.minimum(base + b[own] + shape.length, first[-1]), minlength=first[-1] + 1)
                gone = np.cumsum(steps)[:-1] > 0
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                edges = first[:-1][first[:-1] < len(gone)]
                opens[edges] = gone[edges]
                sums = [np.concatenate([[0], np.cumsum(x)])[first] for x in (gone, opens)]
                kept, raw = [], data.tobytes()
                for i in range(len(offsets) - 1):
                    low, high = first[i], first[i + 1]
                    some = sums[0][i + 1] > sums[0][i]
                    if shape.unit == "byte":
                        kept.append(data[low:high][~gone[low:high]].tobytes() if some else raw[low:high])
                    elif shape.unit == "line":
                        kept.append(glue.join(raw[starts[u] : ends[u]] for u in range(low, high) if not gone[u]) if some else raw[offsets[i] : offsets[i + 1]])
                    else:
                        words = raw[offsets[i] : offsets[i + 1]].split()
                        kept.append(glue.join([w for w, out in zip(words, gone[low:high].tolist(), strict=True) if not out] if some else words))
                columns = [batch.column(0).slice(rows.start, rows.stop - rows.start), *(pa.array(np.diff(x).astype(np.int64)) for x in (first, *sums)), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["did", "n_units", "n_removed", "n_spans", "kept"])

    return run
