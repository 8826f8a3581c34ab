"""Resizing as equi joins with small tables of taps.

A tap table has a row for each pair of a source and a target coordinate of one axis and the weight of
the pair in units of 2^-22. It is built from the distinct sizes there are and broadcast if its size was
checked to be small. Filters are separable: one join and sum along x, rounded to samples, then
one along y. Sums are of integers, so they do not depend on the order in which the cluster adds.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KEYS, MAX, RGBA

SUPPORT = {"BOX": 0.5, "TRIANGLE": 1.0, "CATMULL_ROM": 2.0, "LANCZOS3": 3.0}
ONE = 1 << 22
#: Rows of taps to broadcast, and distinct sizes that the driver looks at to count them.
MAX_BROADCAST_ROWS, MAX_SIZES = 4_000_000, 10_000


def _kernel(filter: str, x: str) -> str:
    if filter == "BOX":
        return f"if({x} > -0.5D and {x} <= 0.5D, 1.0D, 0.0D)"
    if filter == "TRIANGLE":
        return f"greatest(0.0D, 1.0D - abs({x}))"
    if filter == "CATMULL_ROM":
        t = f"abs({x})"
        return f"case when {t} < 1.0D then (1.5D * {t} - 2.5D) * {t} * {t} + 1.0D when {t} < 2.0D then ((({t} - 5.0D) * {t} + 8.0D) * {t} - 4.0D) * -0.5D else 0.0D end"
    if filter == "LANCZOS3":
        sinc = lambda e: f"if({e} = 0.0D, 1.0D, sin({e} * pi()) / ({e} * pi()))"
        return f"if({x} >= -3.0D and {x} < 3.0D, ({sinc(x)}) * ({sinc(f'({x} / 3.0D)')}), 0.0D)"
    raise ValueError(filter)


def taps(sizes: DataFrame, size: str, out: int, filter: str) -> DataFrame:
    """``size, o, s, weight`` for the distinct values of ``sizes[size]``."""
    grid = sizes.select(F.col(size).alias("size")).distinct().select("size", F.explode(F.sequence(F.lit(0), F.lit(out - 1))).alias("o"))
    scaled = grid.withColumn("scale", F.expr(f"cast(size as double) / {float(out)!r}D")).withColumn("c", F.expr("(o + 0.5D) * scale"))
    if filter == "NEAREST":
        return scaled.select("size", "o", F.expr("cast(least(size - 1, floor(c)) as int) as s"), F.lit(ONE).cast("long").alias("weight"))
    reach = scaled.withColumn("fs", F.expr("greatest(1.0D, scale)")).withColumn("sup", F.expr(f"{SUPPORT[filter]!r}D * fs"))
    edge = lambda e: f"cast(floor(greatest(0.0D, least(cast(size as double), {e}))) as int)"
    bounds = reach.selectExpr("size", "o", "c", "fs", f"{edge('c - sup + 0.5D')} as lo", f"{edge('c + sup + 0.5D')} as hi")
    bounds = bounds.selectExpr("size", "o", "c", "fs", "if(hi > lo, lo, least(size - 1, cast(floor(c) as int))) as lo", "if(hi > lo, hi - lo, 1) as n")
    one = bounds.select("size", "o", "c", "fs", F.expr("explode(sequence(lo, lo + n - 1)) as s")).withColumn("arg", F.expr("(s - c + 0.5D) * (1.0D / fs)"))
    one = one.withColumn("k", F.expr(_kernel(filter, "arg")))
    # Summed in order of the taps, as one list an output coordinate.
    total = one.groupBy("size", "o").agg(F.expr("aggregate(transform(array_sort(collect_list(struct(s, k))), t -> t.k), 0.0D, (a, k) -> a + k)").alias("total"), F.collect_list(F.struct("s", "k")).alias("t"))
    each = total.select("size", "o", "total", F.explode("t").alias("t")).withColumn("w", F.expr(f"if(total <> 0.0D, t.k / total, 0.0D) * {float(ONE)!r}D"))
    return each.select("size", "o", F.col("t.s").alias("s"), F.expr("cast(if(w >= 0.0D, floor(w + 0.5D), ceil(w - 0.5D)) as bigint) as weight"))


def _taps(df: DataFrame, width: int, height: int, filter: str) -> tuple[DataFrame, DataFrame]:
    """The tables of taps of both axes, broadcast if the sizes there are make few enough rows."""
    known = df.select("w", "h").distinct().limit(MAX_SIZES + 1).collect()
    spark = df.sparkSession
    out = []
    for size, at, new in (("w", 0, width), ("h", 1, height)):
        if len(known) > MAX_SIZES:
            out.append(taps(df, size, new, filter))
            continue
        values = sorted({r[at] for r in known})
        table = taps(spark.createDataFrame([(v,) for v in values], f"{size} int"), size, new, filter)
        rows = sum(new * (2 * SUPPORT.get(filter, 0.5) * max(1.0, v / new) + 2) for v in values)
        out.append(F.broadcast(table) if rows <= MAX_BROADCAST_ROWS else table)
    return out[0], out[1]


def resize(df: DataFrame, width: int, height: int, filter: str = "CATMULL_ROM", channels: list[str] = RGBA, bits: int = 8) -> DataFrame:
    """Every raster of ``df`` in the new size. With an alpha channel ``a`` colours are weighted by it.

    AUTO is CATMULL_ROM. NEAREST copies samples.
    """
    filter = "CATMULL_ROM" if filter == "AUTO" else filter
    top = MAX[bits]
    if width <= 0 or height <= 0:
        raise ValueError("INTERNAL: empty size")
    tx, ty = _taps(df, width, height, filter)
    ax = tx.select(F.col("size").alias("w"), F.col("s").alias("x"), F.col("o").alias("ox"), F.col("weight").alias("wx"))
    ay = ty.select(F.col("size").alias("h"), F.col("s").alias("y"), F.col("o").alias("oy"), F.col("weight").alias("wy"))
    if filter == "NEAREST":
        out = df.join(ax, ["w", "x"]).join(ay, ["h", "y"])
        new = {"x": F.col("ox"), "y": F.col("oy"), "w": F.lit(width), "h": F.lit(height)}
        return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])
    alpha = "a" in channels
    colours = [c for c in channels if c != "a"]
    put = lambda s: f"cast(least({top}, greatest(0, shiftright({s} + {ONE // 2}, 22))) as int)"
    read = {c: f"(cast({c} as bigint) * a + {top // 2}) div {top}" if alpha and c in colours else f"cast({c} as bigint)" for c in channels}
    across = df.join(ax, ["w", "x"]).groupBy(*KEYS, "h", "y", "ox").agg(*[F.expr(f"sum(({e}) * wx)").alias(c) for c, e in read.items()])
    across = across.selectExpr(*KEYS, "h", "y", "ox", *[f"{put(c)} as {c}" for c in channels])
    down = across.join(ay, ["h", "y"]).groupBy(*KEYS, "ox", "oy").agg(*[F.expr(f"sum({c} * wy)").alias(c) for c in channels])
    down = down.selectExpr(*KEYS, f"{width} as w", f"{height} as h", "ox as x", "oy as y", *[f"{put(c)} as {c}" for c in channels])
    if alpha:
        back = {c: f"cast(if(a = 0, 0, least({top}, (cast({c} as bigint) * {top} + a div 2) div greatest(a, 1))) as int) as {c}" for c in colours}
        down = down.selectExpr(*[back.get(c, c) for c in down.columns])
    return down


def srgb(c: float) -> float:
    """The sRGB curve of a value in 0..1."""
    return c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4


def linear_tables(top: int, decode: Callable[[float], float] = srgb) -> tuple[list[int], list[int]]:
    """16-bit linear light of every sample, and the sample that each linear value is nearest to."""
    there = [int(min(65535.0, max(0.0, decode(v / top) * 65535.0 + 0.5))) for v in range(top + 1)]
    halves = [there[v - 1] + there[v] for v in range(1, top + 1)]
    return there, [bisect_right(halves, 2 * light) for light in range(65536)]


def resize_linear(df: DataFrame, width: int, height: int, filter: str = "CATMULL_ROM", channels: list[str] = RGBA, bits: int = 8, decode: Callable[[float], float] = srgb) -> DataFrame:
    """``resize`` with colours in linear light, 16 bits wide on the way; alpha is scaled, not curved.

    The two tables of the curve have at most 65,536 rows and are broadcast.
    """
    top = MAX[bits]
    there, back = linear_tables(top, decode)
    spark = df.sparkSession
    colours = [c for c in channels if c != "a"]

    def mapped(rows: DataFrame, values: list[int]) -> DataFrame:
        table = spark.createDataFrame(list(enumerate(values)), "__from int, __to int")
        for c in colours:
            rows = rows.join(F.broadcast(table), F.col(c) == F.col("__from")).withColumn(c, F.col("__to")).drop("__from", "__to")
        return rows

    wide = mapped(df, there)
    if "a" in channels:
        wide = wide.withColumn("a", F.expr(f"cast((cast(a as bigint) * 65535 + {top // 2}) div {top} as int)"))
    out = mapped(resize(wide, width, height, filter, channels, 16), back)
    if "a" in channels:
        out = out.withColumn("a", F.expr(f"cast((cast(a as bigint) * {top} + 32767) div 65535 as int)"))
    return out
