"""Connected components of a table of links, kept in tables throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gainset.llm.tables import with_group
from gainset.scratch import stored


def _fingerprint(edges: DataFrame) -> tuple:
    """Count and two sums of hashes, equal for equal sets of links and for others once in 2**64 times."""
    one, other = F.xxhash64("u", "v"), F.xxhash64("v", "u", F.lit(1))
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(one.cast("decimal(20,0)")), F.bit_xor(other)).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root) for every node that has a link; root is the least node reachable.

    Large-star and small-star steps alternate: each hangs nodes on the least of
    their neighbours, which keeps the number of links from growing and ends after
    about the logarithm of the longest way.  Each round is a written table, and nodes
    of very many links are split off, so that no task gathers those of one.
    """
    edges = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "links")
    mark = _fingerprint(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("links")).select("u", F.least("u", "m").alias("m"), "links")
        large = with_group(both.filter("v > u"), least, "u", "links", 2 * mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        following = stored(small, "links")
        edges, before, mark = following, mark, _fingerprint(following)
        if mark == before:
            break
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
