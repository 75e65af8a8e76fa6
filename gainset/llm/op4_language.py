"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gainset.llm.arrays import mix
from gainset.llm.tables import table
from gainset.scratch import stored

#: Buckets that n-grams of one to three characters are hashed to; a fixed size of the model.
BUCKET_BITS = 15
ORDERS = (1, 2, 3)
#: Added to each bucket's count.
SMOOTHING = 0.5
#: Most languages; the matrix that is broadcast is then 256 MB at most.
MOST_LANGUAGES = 1_000
_STEP = 1 << 18
_BUCKETS = 1 << BUCKET_BITS


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)], bool)


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, the first of each text, and whether the text has a letter.

    Letters count in lower case and everything else as a space; n-grams may take in
    such spaces but never cross texts.
    """
    points = [np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    lengths = np.array([len(p) for p in points])
    chars = np.concatenate(points) if points else np.zeros(0, np.uint32)
    letter = _letters()[chars]
    chars = np.where(letter, chars, 32).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    doc_end = np.repeat(starts + lengths, lengths)
    has = np.bincount(np.repeat(np.arange(len(texts)), lengths), letter, len(texts)) > 0
    key = np.zeros(len(chars), np.uint64)
    out = np.full((len(chars), len(ORDERS)), -1, np.int32)
    for i, n in enumerate(ORDERS):
        whole = len(chars) - n + 1
        if whole <= 0:
            break
        key = key[:whole] * np.uint64(0x110000) + chars[n - 1 :] + np.uint64(1)
        buckets = (mix(key) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
        inside = np.arange(n, len(chars) + 1) <= doc_end[:whole]
        out[:whole, i] = np.where(inside, buckets, -1)
    return out, starts, has


def _batches(texts: list[str | None], languages: int = 4) -> Iterator[slice]:
    first, size, most = 0, 0, _STEP * 4 // max(4, languages)
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield slice(first, i + 1)
            first, size = i + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


def gram_counts(labelled: DataFrame) -> DataFrame:
    """Rows (lang, bucket, n) over all of ``labelled`` (text, lang); bucket -1 counts documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, n in counts.items():
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some.astype(np.int32) - 1), pa.array(n[some])], names=["lang", "bucket", "n"])
            counts.clear()

        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in _batches(texts):
                grams, starts, _ = _grams(texts[part])
                ends = [*starts[1:], len(grams)]
                for lang in set(langs[part]):
                    own = [grams[a:b].ravel() for a, b, x in zip(starts, ends, langs[part], strict=True) if x == lang]
                    n = np.bincount(np.concatenate(own) + 1, minlength=_BUCKETS + 1)
                    n[0] = len(own)
                    counts[lang] = counts[lang] + n if lang in counts else n
            if len(counts) > 64:
                yield from flush()
        yield from flush()

    return labelled.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, log-probabilities (bucket, language) and log-priors, from all labelled rows."""
    counts = stored(gram_counts(labelled), "grams")
    names = sorted(r[0] for r in counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    sums = counts.toArrow()
    matrix = np.zeros((_BUCKETS + 1, len(names)))
    matrix[sums["bucket"].to_numpy() + 1, np.searchsorted(names, sums["lang"].to_numpy())] = sums["n"].to_numpy()
    documents, matrix = matrix[0], matrix[1:] + SMOOTHING
    return names, np.log(matrix) - np.log(matrix.sum(0)), np.log(np.maximum(documents, 1e-9)) - np.log(max(documents.sum(), 1e-9))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text_column: str = "text") -> DataFrame:
    """The columns of ``docs`` with lang_pred and score (the posterior); columns of those names are replaced.

    ``und`` with score 0 where the text is null, has no letter, or nothing was learned.
    """
    names, logs, priors = model
    sent = docs.sparkSession.sparkContext.broadcast((np.vstack([logs, np.zeros(len(names))]), priors))
    docs = docs.drop("lang_pred", "score")
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, priors = sent.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_column)).to_pylist()
            for part in _batches(texts, len(names)):
                grams, starts, has = _grams(texts[part])
                total = np.tile(priors, (len(starts), 1))
                some = np.flatnonzero(has) if len(names) else np.zeros(0, int)
                if len(some):  # empty texts lie between; a text with a letter isn't empty
                    sums = logs[grams[:, 0]]
                    for i in range(1, len(ORDERS)):
                        sums += logs[grams[:, i]]
                    filled = np.flatnonzero(np.diff(np.append(starts, len(grams))) > 0)
                    total[filled] += np.add.reduceat(sums, starts[filled], 0)
                best = total.argmax(1) if len(names) else np.zeros(len(starts), int)
                score = np.zeros(len(starts))
                if len(some):
                    score[some] = 1 / np.exp(total[some] - total[some].max(1, keepdims=True)).sum(1)
                pred = [names[b] if h and names else "und" for b, h in zip(best, has, strict=True)]
                own = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(pred, pa.string()), pa.array(score)], names=[*own.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id counts as the empty text when rows are held out."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang"))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")
