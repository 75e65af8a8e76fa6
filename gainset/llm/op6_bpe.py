"""Byte-level BPE encoding and decoding of documents."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from gainset.llm.arrays import STEP_BYTES
from gainset.llm.bpe_fst import Codec, parse_ranks
from gainset.llm.tables import table


def _codec(sent: Broadcast, pattern: str) -> Codec:
    """One codec in each worker process, kept with the ranks' broadcast: its states outlast a task, but not the operator."""
    if not hasattr(sent, "codec"):
        sent.codec = Codec(parse_ranks(sent.value), pattern)
    return sent.codec


def encode_documents(docs: DataFrame, ranks_file: str, pattern: str, text_column: str = "text", decode: bool = False) -> DataFrame:
    """The columns of ``docs`` with ``token_ids``, and with ``decoded`` if asked for.

    ``token_ids`` is binary: little-endian unsigned 32-bit integers, as training
    files hold them.  ``decoded`` is the binary that decoding the ids gives.  Null
    and empty texts have no ids.  Columns of those names in ``docs`` are replaced.
    The ranks (under 1 MB, a fixed file) go to the executors with the code.
    """
    raw = docs.sparkSession.sparkContext.broadcast(Path(ranks_file).read_bytes())
    added = ["token_ids", *["decoded"] * decode]
    docs = docs.drop(*added)
    schema = StructType([*docs.schema.fields, *[StructField(name, BinaryType()) for name in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(raw, pattern)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_column))
            first, ids, size = 0, [], 0
            for row, text in enumerate(texts):
                text = text.as_py() or ""
                ids.append(codec.encode(text))
                size += len(text)
                if size >= STEP_BYTES or row == len(texts) - 1:
                    own = batch.slice(first, row + 1 - first)
                    arrays = [*own.columns, pa.array(ids, pa.binary()), *([codec.decode_texts(ids)] if decode else [])]
                    yield pa.RecordBatch.from_arrays(arrays, names=[*own.schema.names, *added])
                    first, ids, size = row + 1, [], 0

    return docs.mapInArrow(run, schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every whole text."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decode=True)
    return out.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
