"""Connected components of a graph of links, by stars that shrink in a few rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsloom.session import materialise


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of its neighbourhood."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _mark(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("s")).first()
    return row["n"], row["s"] or 0


def components(links: DataFrame) -> DataFrame:
    """node, root: for every node of the links (a, b), the least node of its component.

    Each round is written to the shared checkpoint folder, so a lost executor
    costs at most one round; the driver sees a count and a sum per round.
    """
    links = links.where(F.col("a") != F.col("b")).distinct()
    links = materialise(links)
    mark = _mark(links)
    while mark[0]:
        links = materialise(_small_star(_large_star(links).where(F.col("a") != F.col("b")).distinct()).distinct())
        last, mark = mark, _mark(links)
        if mark == last:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
