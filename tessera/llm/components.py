"""Connected components of a link table by alternating stars, each round settled in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import join_by_key, settle


def _least(pairs: DataFrame) -> DataFrame:
    """a's least neighbour or a itself, and how many pairs a has. Partial aggregation keeps hubs cheap."""
    return pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))


def _large(pairs: DataFrame, rows: int) -> DataFrame:
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return join_by_key(both, _least(both), "a", 2 * rows).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small(pairs: DataFrame, rows: int) -> DataFrame:
    least = pairs.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    joined = join_by_key(pairs, least, "a", rows)
    return joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a long, b long) that isn't its own root; root is the component's least node.

    Each round maps the links to stars around smaller nodes; it ends when a round changes nothing, which it does after
    some log2 of the longest path, squared. Repeated and reversed links, and a = b, do no harm; null ends are dropped.
    Never collected. Jobs run while the plan is made.
    """
    down = lambda d: d.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = settle(down(links.filter("a <> b")).distinct(), "links")
    # A number of the link set that doesn't depend on order; sums of hashes could cancel in theory, so the count goes with it.
    sign = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    last = sign(now)
    while last[0]:
        now = settle(_small(down(_large(now, last[0])), last[0]), "links")
        if (new := sign(now)) == last:
            break
        last = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
