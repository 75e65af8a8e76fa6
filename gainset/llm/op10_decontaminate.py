"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

A seed hashes four words at fixed offsets and ignores the words between.  Seeds of
the benchmark are joined with seeds at every position of every document; around
each hit the document is laid against the whole item, and the item counts as found
if a stretch of it agrees in at least 80 % of its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gainset.llm.tables import NO_ID, keyed, table, with_texts, without

#: Offsets of the words that each seed keeps.  Together they hit every stretch of 10
#: to 20 words with at most 20 % of the words replaced, and every run of four words.
MASKS = ((0, 1, 2, 4), (0, 1, 2, 3))
#: Words of an item's stretch; a shorter item counts as a whole, and under 10 words only unchanged.
STRETCH = 20
SHORT = 10
#: Benchmark seeds up to this many are broadcast (about 64 MB); beyond, the join shuffles.
MOST_BROADCAST = 2_000_000


def _word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words; null and empty texts have none."""
    bare = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\f\r"))
    words = F.when(F.length(bare) > 0, F.split(bare, "[ \\t-\\r]+"))
    return F.coalesce(F.transform(words, lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"))


def _seeded(rows: DataFrame, words: str, at: str, seed: str) -> DataFrame:
    """A row for each seed, without the words: null seeds, where the text ends before, go."""
    least = len(MASKS[-1])
    rows = rows.filter(F.size(words) >= least).withColumn("_n", F.size(words) - (least - 1))
    starts = F.sequence(F.lit(0), F.col("_n") - 1)

    def of(number: int, mask: tuple[int, ...]) -> Column:
        def one(i: Column) -> Column:
            hashed = F.xxhash64(F.lit(number), *[F.get(F.col(words), i + o) for o in mask])
            return hashed if mask[-1] < least else F.when(i + mask[-1] < F.size(words), hashed)

        return F.transform(starts, one)

    every = F.concat(*[of(i, mask) for i, mask in enumerate(MASKS)])
    rest = [c for c in rows.columns if c not in (words, "_n")]
    rows = rows.select(*rest, "_n", F.posexplode(every).alias(at, seed)).filter(F.col(seed).isNotNull())
    return rows.withColumn(at, F.col(at) % F.col("_n")).drop("_n")


def _same() -> Column:
    """For each word of the item, 1 where the document has it at the hit's alignment."""
    return F.transform("item_words", lambda w, i: F.coalesce(F.when(F.col("shift") + i >= 0, F.get(F.col("words"), F.col("shift") + i)) == w, F.lit(False)).cast("int"))


def _best() -> Column:
    """The most ones of ``same`` in any stretch, by a running sum."""
    length = F.least(F.size("same"), F.lit(STRETCH))

    def step(acc: Column, x: Column) -> Column:
        now = acc["now"] + x - F.coalesce(F.when(acc["i"] >= length, F.get(F.col("same"), acc["i"] - length)), F.lit(0))
        return F.struct((acc["i"] + 1).alias("i"), now.alias("now"), F.greatest(acc["best"], now).alias("best"))

    zero = F.lit(0)
    return F.aggregate("same", F.struct(zero.alias("i"), zero.alias("now"), zero.alias("best")), step, lambda acc: acc["best"])


def found_items(texts: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (did, dkey, item_id, agree, needed) of items found in the rows of ``keyed``, each pair once.

    A null text has no words, a null id is an id like others; that of an item comes out as ``NO_ID``.  Items of under five
    words are too short to be found; repeated items each count.
    """
    items = items.select(F.coalesce(F.col("item_id"), F.lit(NO_ID)).alias("item_id"), _word_hashes(F.col("text")).alias("item_words")).filter(F.size("item_words") >= 5).withColumn("item_size", F.size("item_words"))
    seeds = _seeded(items, "item_words", "item_at", "seed")
    few = seeds.count() <= MOST_BROADCAST
    docs = texts.select("did", "dkey", _word_hashes(F.col("text")).alias("words"))
    hits = _seeded(docs, "words", "at", "doc_seed").join(F.broadcast(seeds) if few else seeds, F.col("doc_seed") == F.col("seed"))
    laid = hits.select("did", "dkey", "item_id", "item_size", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    per_doc = laid.groupBy("did", "dkey").agg(F.collect_list(F.struct("item_id", "item_size", "shift")).alias("laid"))
    docs = with_texts(texts, per_doc, "laid", 24, "inner").select("did", "dkey", _word_hashes(F.col("text")).alias("words"), "laid")
    # Of the document only what the item covers at that alignment goes on.
    shift = lambda x: F.greatest(x["shift"], F.lit(0))
    around = F.transform("laid", lambda x: F.struct(x["item_id"].alias("item_id"), x["item_size"].alias("item_size"), F.least(x["shift"], F.lit(0)).alias("shift"), F.slice("words", shift(x) + 1, x["item_size"]).alias("words")))
    hits = docs.select("did", "dkey", F.explode(around).alias("hit")).select("did", "dkey", "hit.*")
    hits = hits.join(F.broadcast(items) if few else items, ["item_id", "item_size"])
    size = F.size("item_words")
    needed = F.when(size < SHORT, size).otherwise(F.ceil(F.least(size, F.lit(STRETCH)) * 4 / 5)).cast("int")
    checked = hits.select("did", "dkey", "item_id", _same().alias("same"), needed.alias("needed")).select("did", "dkey", "item_id", _best().alias("agree"), "needed")
    return checked.filter("agree >= needed").groupBy("did", "dkey", "item_id").agg(F.max("agree").alias("agree"), F.max("needed").alias("needed"))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items and item_ids, ascending."""
    texts = keyed(docs, "doc_id", "text")
    per_doc = found_items(texts, items).groupBy("did", "dkey").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    out = texts.select("did", "dkey").join(per_doc, ["did", "dkey"], "left")
    ids = F.coalesce("item_ids", F.array().cast("array<bigint>"))
    ids = F.transform(ids, lambda i: F.when(i != NO_ID, i))
    return out.select(F.when(F.col("did") != NO_ID, F.col("did")).alias("doc_id"), (F.size(ids) > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"))


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item, with the columns they came with; others of the same id or without one stay."""
    return without(docs, found_items(keyed(docs, "doc_id", "text"), items))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``contamination`` of all documents by the benchmark; item ids are joined by commas."""
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "contaminated", "n_items", F.array_join(F.col("item_ids").cast("array<string>"), ",", "null").alias("item_ids"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
bw AS (SELECT item_id, len(w) AS m, unnest(w) AS word, unnest(range(len(w))) AS q FROM b WHERE len(w) >= 5),
s AS (SELECT doc_id, item_id, m, p - q AS diag, q FROM dw JOIN bw USING (word)),
t AS (SELECT doc_id, item_id, m,
             CASE WHEN m < 10 THEN count(*) OVER (PARTITION BY doc_id, item_id, diag)
                  ELSE count(*) OVER (PARTITION BY doc_id, item_id, diag ORDER BY q RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING) END AS agree
      FROM s),
f AS (SELECT DISTINCT doc_id, item_id FROM t WHERE agree >= CASE WHEN m < 10 THEN m ELSE (least(m, 20) * 4 + 4) // 5 END),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS item_ids FROM f GROUP BY 1)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(item_ids, '') AS item_ids
FROM d LEFT JOIN g USING (doc_id)
"""
