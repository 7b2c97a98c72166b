"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sizing import written


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest neighbour."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _ordered(links: DataFrame) -> DataFrame:
    return (links.where(F.col("u") != F.col("v"))
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))


def _nodes(links: DataFrame) -> DataFrame:
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node that is not the smallest of its component.

    ``links`` has the columns u and v.  Each round halves the depth of the
    trees; both steps are aggregates with map-side partials and equi-joins,
    so a node with very many links is split like any skewed join key.  Every
    round is written to the shared folder.
    """
    now, state = _ordered(links), None
    while True:
        now = written(_small_star(_large_star(now)), "links")
        new = _state(now)
        if not new[0] or new == state:
            return _nodes(now)
        state = new


def partial_components(links: DataFrame) -> DataFrame:
    """(node, root) after one round: groups inside the true components, one
    root for every node.  Enough to skip pairs that are linked already."""
    once = _small_star(_large_star(_ordered(links)))
    return written(_nodes(once.groupBy("u").agg(F.min("v").alias("v"))), "groups")
