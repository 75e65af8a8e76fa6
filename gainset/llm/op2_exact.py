"""Exact dedup: two-pass Bloom filtering, then grouping of the possibly repeated rows only.

Pass one counts the filter's slots that the rows' hashes fall on and keeps a bitmap
of the slots hit twice or more.  Pass two tests every row against that bitmap: a row
whose slot nothing else hit is unique and passes straight through; only the rest
shuffle by their digest.  DataFrame functions only.

The filter grows with the rows, so that about one unique row in ``BITS_PER_ROW`` is
shuffled in vain at any size.  Of a filter beyond ``MOST_BITS`` one range of slots after
the other is broadcast; digests are stored in the order of their hashes, so that each
round reads its own range only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gainset.llm.tables import MOST_BROADCAST, table, with_group
from gainset.scratch import stored

#: Bits of filter for each row, and the most bits that are broadcast at once.
BITS_PER_ROW = 32
MOST_BITS = MOST_BROADCAST * 8
#: Bits in one bitmap row of Spark's bitmap functions, as a power of two.
_BITMAP = 15
_SHA = "text_sha256"


def _hash(digest: str = _SHA) -> Column:
    return F.xxhash64(digest)


def _slot(hashed: Column, bits: int) -> Column:
    """The first ``bits`` bits of the hash, taken as unsigned in the order of the signed values."""
    return F.call_function("shiftrightunsigned", hashed.bitwiseXOR(F.lit(-(1 << 63))), F.lit(64 - bits))


def _bit(bitmap: Column, slot: Column) -> Column:
    """Whether the slot's bit is set in its bitmap row."""
    at = slot.bitwiseAND(F.lit((1 << _BITMAP) - 1))
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, F.pmod(at, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1


def filter_bits(total: int) -> int:
    """Slots of the filter for so many rows, as a power of two."""
    return max(_BITMAP, (BITS_PER_ROW * max(total, 1) - 1).bit_length())


def repeated_slots(hashes: DataFrame, bits: int) -> DataFrame:
    """Bitmap rows (bucket, bitmap) of the slots that two rows or more fall on; equal slots are counted before they move."""
    return _bitmaps(hashes.select(_slot(F.col("hash"), bits).alias("slot")).groupBy("slot").agg((F.count(F.lit(1)) > 1).alias("twice")).filter("twice"))


def taken_slots(hashes: DataFrame, bits: int) -> DataFrame:
    """Bitmap rows (bucket, bitmap) of the slots that any row falls on."""
    return _bitmaps(hashes.select(_slot(F.col("hash"), bits).alias("slot")))


def _bitmaps(slots: DataFrame) -> DataFrame:
    position = F.col("slot").bitwiseAND(F.lit((1 << _BITMAP) - 1))
    return slots.groupBy(F.shiftright("slot", _BITMAP).alias("bucket")).agg(F.bitmap_construct_agg(position).alias("bitmap"))


def marked(rows: DataFrame, filters: DataFrame, bits: int) -> DataFrame:
    """Rows with a column ``maybe``: false only where the slot of the hash (column ``hash``, which goes) isn't in ``filters``, so that no other row has it."""
    slot = _slot(F.col("hash"), bits)
    out = rows.join(F.broadcast(filters), F.shiftright(slot, _BITMAP) == F.col("bucket"), "left")
    return out.withColumn("maybe", F.coalesce(_bit(F.col("bitmap"), slot), F.lit(False))).drop("bucket", "bitmap", "hash")


def possibly_repeated(digests: DataFrame, total: int) -> DataFrame:
    """``marked`` for all rows of a table of digests, one range of the filter after the other.

    Reading a range is cheap where the table has its hashes, in their order; they are computed where it doesn't.
    """
    if "hash" not in digests.columns:
        digests = digests.withColumn("hash", _hash())
    bits = filter_bits(total)
    rounds = max(1, (1 << bits) // MOST_BITS)
    width = (1 << 64) // rounds
    parts = []
    for r in range(rounds):
        low = r * width - (1 << 63)
        own = digests.filter(F.col("hash").between(low, low + width - 1)) if rounds > 1 else digests
        parts.append(stored(marked(own, repeated_slots(own, bits), bits), "tested"))
    return reduce(DataFrame.unionByName, parts)


def _digests(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    rows = docs.select(F.col(id_column).alias("doc_id"), F.sha2(F.coalesce(F.col(text_column), F.lit("")), 256).alias(_SHA))
    return stored(rows.withColumn("hash", _hash()).sortWithinPartitions("hash"), "digests")


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document with its group of equal texts.

    Null counts as the empty text.  Of equal texts the row with the largest id
    stays; a null id is smaller than any other.  Rows that share both text and id
    are copies as well: each gets a row, all with the same ``keep_id``, and all of
    those with the largest id count as kept.  An empty table gives no rows.
    """
    digests = _digests(docs, id_column, text_column)
    total = digests.count()
    tested = possibly_repeated(digests, total)
    unique = tested.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), _SHA)
    candidates = tested.filter("maybe").drop("maybe")
    groups = candidates.groupBy(_SHA).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    grouped = with_group(candidates, groups, _SHA, "group_size", total)
    return unique.unionByName(grouped.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), _SHA))


def kept_documents(docs: DataFrame, one_row: bool = False) -> DataFrame:
    """The documents that stay, with the columns they came with, whatever their names.

    Of equal texts the one with the largest id stays; of rows that repeat both id and
    text all do, or with ``one_row`` just one.
    While one broadcast holds the filter, unique texts don't move; beyond, all meet what is known of them in a shuffle.
    """
    digests = _digests(docs, "doc_id", "text")
    total = digests.count()
    bits = filter_bits(total)
    names = docs.columns
    own = docs.select(F.struct(*names).alias("doc"), docs["doc_id"].alias("doc_id"), F.sha2(F.coalesce(docs["text"], F.lit("")), 256).alias(_SHA)).withColumn("hash", _hash())
    if 1 << bits <= MOST_BITS:
        filters = stored(repeated_slots(digests, bits), "filter")
        tested = marked(own, filters, bits)
        candidates = marked(digests, filters, bits).filter("maybe")
    else:
        known = possibly_repeated(digests, total)
        candidates = known.filter("maybe")
        tested = own.join(candidates.select(_SHA).distinct().withColumn("some", F.lit(True)), _SHA, "left").withColumn("maybe", F.col("some").isNotNull()).drop("some", "hash")
    rows = candidates.groupBy(_SHA, "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    groups = rows.groupBy(_SHA).agg(F.max(F.struct("doc_id", "rows")).alias("keep"), F.sum("rows").alias("size"))
    groups = stored(groups, "groups")
    stay = with_group(tested.filter("maybe").drop("maybe"), groups, _SHA, "size", total).filter(F.col("doc_id").eqNullSafe(F.col("keep.doc_id")))
    if one_row:
        stay = stay.filter("keep.rows = 1").unionByName(stay.filter("keep.rows > 1").dropDuplicates([_SHA]))
    return tested.filter(~F.col("maybe")).select("doc.*").unionByName(stay.select("doc.*"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``exact_groups`` over all documents."""
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
