"""Reading the tables and joins that stay even when a key holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gainset.scratch import stored

#: A key with more than one row in so many is hot; at most so many keys can be.
HOT_SHARE = 20_000
#: What is known of each document comes to the texts by broadcast up to this many bytes;
#: beyond, texts and it meet in a shuffle.
MOST_BROADCAST = 32 << 20
#: Stands for a null id, and is smaller than any other.
NO_ID = -(1 << 63)
#: Rows that go to Python at once; documents are long, and both sides hold a batch.
ARROW_ROWS = "500"

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get(_ROWS) == "10000":  # unless someone set it
        spark.conf.set(_ROWS, ARROW_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_group(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """Join each row with its group's one row, splitting off hot groups.

    Groups of more than ``total / HOT_SHARE`` rows (at least 64) number fewer than
    ``HOT_SHARE``, whatever the data, so they are broadcast and their rows never
    move; the rows of the other groups meet in a plain join.
    """
    most = max(64, total // HOT_SHARE)
    hot = groups.filter(F.col(size) > most)
    marked = rows.join(F.broadcast(hot.select(F.col(key).alias("_hot"))), rows[key] == F.col("_hot"), "left")
    hot_rows = marked.filter(F.col("_hot").isNotNull()).drop("_hot").join(F.broadcast(hot), key, "inner")
    others = marked.filter(F.col("_hot").isNull()).drop("_hot").join(groups.filter(F.col(size) <= most), key, how)
    return hot_rows.unionByName(others)


def keys(docs: DataFrame, id_column: str, text_column: str) -> tuple[Column, Column]:
    """did and dkey of ``docs``; dkey tells texts of one id apart and is 0 where every id has one row."""
    did = F.coalesce(docs[id_column].cast("long"), F.lit(NO_ID))
    unique = not docs.select(did.alias("did")).groupBy("did").count().filter("count > 1").limit(1).count()
    return did, F.lit(0).cast("long") if unique else F.xxhash64(F.coalesce(docs[text_column], F.lit("")))


def keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Rows (did, dkey, text) of ``docs``, by ``keys``."""
    did, dkey = keys(docs, id_column, text_column)
    return docs.select(did.alias("did"), dkey.alias("dkey"), F.coalesce(docs[text_column], F.lit("")).alias("text"))


def sized(rows: DataFrame, row_bytes: int) -> DataFrame:
    """A written table, to be broadcast if it is small enough for that; else it is joined as any other."""
    return F.broadcast(rows) if rows.count() * row_bytes <= MOST_BROADCAST else rows


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't in ``dropped``, rows (did, dkey) of the same documents' ``keyed``."""
    did, dkey = keys(docs, "doc_id", "text")
    dropped = sized(stored(dropped.select(F.col("did").alias("_did"), F.col("dkey").alias("_dkey")).distinct(), "dropped"), 64)
    return docs.join(dropped, (did == F.col("_did")) & (dkey == F.col("_dkey")), "left_anti")


def with_texts(texts: DataFrame, known: DataFrame, items: str, item_bytes: int, how: str) -> DataFrame:
    """Documents with what is known of each of them, one row per document in ``known``."""
    known = stored(known, "known")
    size = known.agg(F.sum(F.size(items) * item_bytes + 64)).first()[0] or 0
    return texts.join(F.broadcast(known) if size <= MOST_BROADCAST else known, ["did", "dkey"], how)
