"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskshift.llm.common import materialize


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step over links (a > b)."""
    both = links.union(links.select("b", "a"))
    low = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = (both.join(low, both["a"] == low["u"]).where(F.col("b") > F.col("a"))
             .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
    large = materialize(large, "large-star")
    least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    hung = large.join(least, large["a"] == least["u"]).where(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over ``links`` (a, b), for every id with a link.

    Steps repeat until all links are stars around their smallest id (a
    logarithmic number for chains). Each is a plain aggregate and join, so a vertex
    with very many links is combined before the shuffle and split by AQE.
    """
    links = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    # done when every link leads straight to a root: no end is a start, no start has two ends
    while not links.join(links.select(F.col("a").alias("b")), "b", "left_semi").isEmpty() or links.count() > links.select("a").distinct().count():
        links = materialize(_stars(links), "stars")
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
