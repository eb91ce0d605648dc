"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on the node, so no neighbourhood is ever collected and a hub
is split by adaptive execution like any other skewed key. Links are written to the checkpoint folder
after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplework.session import checkpointed


def _mark(links: DataFrame) -> tuple:
    """Order-free digest of a link table."""
    h = F.xxhash64("a", "b")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(h.bitwiseAND(0xFFFFFFFF)), F.bit_xor(h)).first())


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)``; ``root`` is the smallest node it is joined to.

    Null ends and links of a node to itself are left out; an empty table gives an empty result.
    """
    links = checkpointed(
        links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = _mark(links)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter(F.col("a") != F.col("b")).distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a")
        nearer = small.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = checkpointed(nearer.unionAll(small_least.select("a", F.col("m").alias("b"))).distinct())
        was, mark = mark, _mark(links)
        if mark == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # stars now: every node other than a root has one link, to its root
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
