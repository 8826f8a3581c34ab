"""Pyramids of rasters: each level half as large, and what a level's enlargement leaves to add.

A level halves by the taps 1, 2, 1 around even places and doubles by means of neighbours, rows first; both drop fractions after each
direction. Levels are made for all rasters of a table at once, by windows along rows and columns.

Defined cases: a side of n becomes (n + 1) div 2, and its double loses the surplus; a side of 1 stays 1; samples are not negative;
an empty table stays empty; other columns are left out.
"""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import KEYS


def _along(c: str) -> Window:
    return Window.partitionBy(*KEYS, "y" if c == "x" else "x").orderBy(c)


def halved(df: DataFrame, v: str = "v") -> DataFrame:
    """``doc_id, item_index, w, h, x, y, v`` at half the size."""
    got = df.select(*KEYS, "w", "h", "x", "y", F.col(v).cast("int").alias("__v"))
    for c, n in (("x", "w"), ("y", "h")):
        w = _along(c)
        taps = F.coalesce(F.lag("__v").over(w), F.col("__v")) + 2 * F.col("__v") + F.coalesce(F.lead("__v").over(w), F.col("__v"))
        got = got.withColumn("__t", taps).filter(f"{c} % 2 = 0").withColumn("__v", F.expr("cast(__t div 4 as int)")).drop("__t")
        got = got.withColumn(c, F.expr(f"cast({c} div 2 as int)")).withColumn(n, F.expr(f"cast(({n} + 1) div 2 as int)"))
    return got.withColumnRenamed("__v", v)


def doubled(df: DataFrame, v: str = "v") -> DataFrame:
    """``doc_id, item_index, w, h, x, y, v`` at twice the size: places between two are their mean, the last repeats."""
    got = df.select(*KEYS, "w", "h", "x", "y", F.col(v).cast("int").alias("__v"))
    for c, n in (("x", "w"), ("y", "h")):
        mean = F.expr("cast((__v + __n) div 2 as int)")
        got = got.withColumn("__n", F.coalesce(F.lead("__v").over(_along(c)), F.col("__v")))
        got = got.withColumn("__o", F.explode(F.array(F.struct(F.lit(0).alias("d"), F.col("__v").alias("v")), F.struct(F.lit(1).alias("d"), mean.alias("v")))))
        got = got.withColumn(c, F.expr(f"cast({c} * 2 + __o.d as int)")).withColumn("__v", F.col("__o.v")).withColumn(n, F.expr(f"cast({n} * 2 as int)")).drop("__n", "__o")
    return got.withColumnRenamed("__v", v)


def _added(level: DataFrame, smaller: DataFrame, v: str, sign: int) -> DataFrame:
    near = doubled(smaller, v).select(*KEYS, "x", "y", F.col(v).alias("__near"))
    return level.join(near, [*KEYS, "x", "y"]).select(*KEYS, "w", "h", "x", "y", (F.col(v) + sign * F.col("__near")).cast("int").alias(v))


def pyramid(df: DataFrame, levels: int, v: str = "v") -> DataFrame:
    """``doc_id, item_index, level, w, h, x, y, v``: the smallest raster as it is (level ``levels``), of the others the difference to the double of the next."""
    rasters = [df.select(*KEYS, "w", "h", "x", "y", F.col(v).cast("int").alias(v))]
    for _ in range(levels):
        rasters.append(halved(rasters[-1], v))
    left = [_added(big, small, v, -1) for big, small in zip(rasters, rasters[1:])] + [rasters[-1]]
    return fold(DataFrame.unionByName, (x.withColumn("level", F.lit(k)) for k, x in enumerate(left))).select(*KEYS, "level", "w", "h", "x", "y", v)


def rebuilt(parts: DataFrame, levels: int, v: str = "v", at: int = 0) -> DataFrame:
    """The rasters of level ``at`` from a pyramid of ``levels``."""
    of = lambda k: parts.filter(F.col("level") == k).drop("level")
    return fold(lambda small, k: _added(of(k), small, v, 1), range(levels - 1, at - 1, -1), of(levels))
