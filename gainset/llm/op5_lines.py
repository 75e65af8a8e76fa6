"""Line dedup by winnowing.

Lines are hashed, and the least hash of each three neighbouring lines is a
fingerprint, so that any run of three lines or more that documents share holds a
fingerprint of both.  Around each fingerprint lies the phrase of all runs that it
stands for, which is the match extended to both sides as far as the fingerprint
reaches; phrases meet by fingerprint, equal ones recur as a whole, and in others the
runs are compared line by line.  Of a repeated run the later ones go.

``op5_line_dedup`` does that, as its SQL says.  ``op5_passage_dedup`` also takes
shorter runs, single lines and pairs, of ten words or more, so that a passage is found by
the length of its text too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gainset.llm.recurrence import Shape, without_recurring
from gainset.llm.resolvers import Lines
from gainset.llm.tables import table

#: Lines in the shortest run that is removed, which is also the winnowing window.
RUN = 3
#: Words in the shortest run of fewer lines that ``op5_passage_dedup`` removes.
WORDS = 10


def remove_later_runs(docs: DataFrame, run: int = RUN) -> DataFrame:
    """Documents without the lines of a run of ``run`` lines or more that also starts earlier.

    Lines are what line feeds separate, empty ones too, unchanged; null and empty
    texts have one empty line.  Earlier means a smaller doc_id (null is the
    smallest), or the same document and an earlier start; rows of the same id and
    text are one document.  Columns: doc_id, n_units (lines), n_removed, n_spans
    (removed runs), kept.
    """
    return without_recurring(docs, Shape("line", run, run, 1), Lines(run), later_only=True)


def remove_later_passages(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """As ``remove_later_runs``, and also without the lines of shorter runs of ``words`` words or more that start earlier."""
    also = tuple(Shape("line", n, 1, n, least_words=words) for n in range(1, run))
    return without_recurring(docs, Shape("line", run, run, 1), Lines(run), later_only=True, also=also)


def _summed(out: DataFrame) -> DataFrame:
    return out.select("doc_id", F.col("n_units").alias("n_lines"), "n_removed", F.col("n_spans").alias("n_runs"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summed(remove_later_runs(table(spark, sf_dir, "documents")))


def op5_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summed(remove_later_passages(table(spark, sf_dir, "documents")))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
n AS (SELECT doc_id, i, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS s FROM d, unnest(range(1, len(l) - 1)) t(i)),
r AS (SELECT doc_id, i FROM n QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM r, range(0, 3) t(j)),
u AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS p FROM d),
m AS (SELECT u.doc_id, u.p, line, c.p IS NOT NULL AS gone FROM u LEFT JOIN c USING (doc_id, p)),
o AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM m)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_runs,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM o GROUP BY doc_id
"""
