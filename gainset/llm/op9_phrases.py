"""Substring dedup by repeated-phrase automata.

Phrases of bounded length around rolling fingerprints meet by their core; equal ones
recur as a whole.  Where phrases around the same core differ, the shard of the core
confirms by counts which 20-word passages recur, compiles them into an Aho-Corasick
automaton and streams every stretch of text that holds the core through it.  There the
automaton alone says where passages are.  The first place stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gainset.llm.recurrence import Shape, without_recurring
from gainset.llm.resolvers import Automaton
from gainset.llm.tables import table


def remove_later_passages(docs: DataFrame, length: int = 20, spread: int = 15, gram: int = 3) -> DataFrame:
    """Documents without the words that a ``length``-word window covers which also starts earlier.

    Null and empty texts have no words.  Earlier means a smaller doc_id (null is the
    smallest), or the same document and an earlier start; rows of the same id and
    text are one document.  Columns: doc_id, n_units (words), n_removed, n_spans, kept.
    """
    gram = min(gram, length)
    return without_recurring(docs, Shape("word", length, min(spread, length - gram + 1), gram), Automaton(length), later_only=True)


def op9_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_later_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS s FROM d, unnest(range(1, len(w) - 18)) t(i)),
r AS (SELECT doc_id, i FROM n QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM r, range(0, 20) t(j)),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY p) FILTER (WHERE c.p IS NULL) AS kept, count(c.p) AS n_removed
      FROM u LEFT JOIN c USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
