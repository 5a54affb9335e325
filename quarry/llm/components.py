"""Connected components by alternating large and small stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (columns a, b); the component is its smallest id.

    A round links each id's neighbours to their smallest one. The neighbours of an id are never gathered: the minimum
    is aggregated before the shuffle and joined back from a written table, so an id with a great many links is split.
    Rounds end when all links are stars, after about the logarithm of the longest path.
    """
    links = materialize(edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).filter("u > v").distinct(), "links")
    for _ in range(MAX_ROUNDS):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        large = materialize(large, "large")
        lowest = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        small = large.join(lowest, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u > v").distinct()
        old, links = links, materialize(small, "links")
        # Stars: every id has one link, to an id that has none of its own.
        done = not lowest.filter("n > 1").limit(1).count() and not links.join(links.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count()
        discard(old, least, large, lowest)
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
