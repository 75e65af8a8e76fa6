"""Suffix-array dedup by prefix-free parsing.

Two parses, one in the other.  Over the corpus, rolling hashes of 16 bytes trigger at the
least value of each stretch and cut every document into overlapping phrases of bounded
length, with all 200-byte strings that the trigger stands for.  A dictionary of distinct
phrases, dealt out by the text after the trigger, settles those that recur whole.  What
differs in a shard is parsed again at finer triggers: its dictionary and its parse get
suffix arrays, which combine into the order of all the shard's suffixes, and neighbours
in that order are compared over 200 bytes.  Equal strings are always in one shard, so
the orders of the shards aren't merged.

A document is looked at in segments of ``recurrence.SEGMENT`` bytes; removing takes some
40 bytes of memory for each byte of the longest document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gainset.llm.recurrence import Shape, without_recurring
from gainset.llm.resolvers import SuffixArray
from gainset.llm.tables import table


def remove_repeated_strings(docs: DataFrame, length: int = 200, spread: int = 150, trigger: int = 16) -> DataFrame:
    """Documents without the bytes that a ``length``-byte string covers which also starts anywhere else.

    Null and empty texts have no strings, as have texts shorter than ``length``.
    Copies inside one document count, overlapping ones too.  Rows of the same id and
    text are one document.  Columns: doc_id, n_units (bytes), n_removed, n_spans, kept.
    """
    return without_recurring(docs, Shape("byte", length, min(spread, length - trigger + 1), trigger), SuffixArray(length), later_only=False)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_strings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, h, len(h) // 2 AS n FROM d),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS s FROM b, unnest(range(0, n - 199)) t(i)),
r AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY s) > 1),
o AS (SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS gap FROM r),
g AS (SELECT doc_id, i, sum(CASE WHEN gap > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS e FROM g GROUP BY 1, 2),
x AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_at FROM s),
k AS (SELECT doc_id, sum(e - a) AS n_removed, count(*) AS n_spans, max(e) AS last,
             string_agg(substr(h, 2 * from_at + 1, 2 * (a - from_at)), '' ORDER BY a) AS head
      FROM x JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM b LEFT JOIN k USING (doc_id)
"""
