"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fitted, salted_join

#: Parts in which a hub's links are joined.
SALTS = 8
#: Rows of two longs that are broadcast at most.
MAX_BROADCAST = 200_000


def looked_up(big: DataFrame, small: DataFrame, on: str, rows: int) -> DataFrame:
    """Inner join with a table of at most ``rows`` rows: without a shuffle within the bound, a hub's rows in parts beyond it."""
    return big.join(F.broadcast(small), on) if rows <= MAX_BROADCAST else salted_join(big, small, [on], SALTS)


def nearest(edges: DataFrame, k: int, rows: int) -> DataFrame:
    """``(node, to)``: the node of the smallest hash (of round ``k``) within two steps of each node of the ``rows`` edges."""

    def least(c: str) -> Column:
        return F.min_by(c, F.xxhash64(F.col(c), F.lit(k))).alias("to")

    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")), F.struct("a", F.col("a").alias("b")), F.struct(F.col("b").alias("a"), "b")))
    both = edges.select(ends.alias("x")).select("x.a", "x.b")
    one = both.groupBy("a").agg(least("b")).select(F.col("a").alias("b"), F.col("to").alias("near"))
    # As many nodes as ends of links, at most.
    return looked_up(both, one, "b", 2 * rows).groupBy("a").agg(least("near")).select(F.col("a").alias("node"), "to")


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the links ``(a, b)``; a component is named by one of its nodes.

    Each round sends every node to the node of the smallest hash within two steps, and contracts the
    links to those. Two steps fold any star in one round, and hashes that differ from round to round
    fold chains as fast. Nothing is collected; minima are aggregated before the shuffle, and nodes' targets are
    broadcast within ``MAX_BROADCAST``, else a hub's links are joined in ``SALTS`` parts.
    """
    steps: list[DataFrame] = []
    edges, rows = fitted(links.select("a", "b").filter("a <> b"))
    while rows or not steps:
        to, nodes = fitted(nearest(edges, len(steps), rows))
        steps.append(to)
        ends = looked_up(edges, to.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a", nodes)
        ends = looked_up(ends, to.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b", nodes)
        edges, rows = fitted(ends.filter("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    found = steps[-1].withColumnRenamed("to", "component")
    for to in reversed(steps[:-1]):
        found = to.join(found.select(F.col("node").alias("to"), F.col("component").alias("later")), "to", "left").select("node", F.coalesce("later", "to").alias("component"))
    return found if len(steps) == 1 else fitted(found)[0]
