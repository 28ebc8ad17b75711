"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from exposura.session import discard, materialize


def _with_least(pairs: DataFrame) -> DataFrame:
    """``(node, other, least)``: least is the smallest of a node and its partners. Combined before the shuffle."""
    least = pairs.groupBy("node").agg(F.min("other").alias("least"))
    return pairs.join(least, "node").withColumn("least", F.least("least", "node"))


def _summary(links: DataFrame) -> tuple:
    name = F.xxhash64("node", "other")
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(name), F.bit_xor(F.xxhash64(name))).first())


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every end of ``links(a, b)``: the smallest id that can be reached.

    Each round sends every node's larger partners to its smallest partner, then every node and its smaller
    partners likewise; it ends when a round changes nothing. The number of rounds grows with the logarithm
    of the longest path. Each round is written to the shared folder, so a lost executor costs one round; the round
    before it is deleted then.
    Links with a null end and links of a node with itself are left out; no links give no rows.
    """
    links = materialize(
        links.where("a < b or a > b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other")).distinct()
    )
    before = _summary(links)
    while True:
        both = links.unionByName(links.select(F.col("other").alias("node"), F.col("node").alias("other")))
        large = _with_least(both).where("other > node").select(F.col("other").alias("node"), F.col("least").alias("other")).distinct()
        seen = _with_least(large)
        small = (
            seen.where("other != least").select(F.col("other").alias("node"), F.col("least").alias("other"))
            .unionByName(seen.select("node", F.col("least").alias("other")))
            .where("node != other").distinct()
        )
        following = materialize(small)
        now = _summary(following)
        discard(links)
        links = following
        if now == before:
            break
        before = now
    roots = links.select(F.col("other").alias("id")).distinct()
    return links.select(F.col("node").alias("id"), F.col("other").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component"))
    )
