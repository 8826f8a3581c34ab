"""Steps of codecs that are relational: prefix sums, lags, scatters and bit fields, for whole tables of rasters.

The same steps run vectorised inside ``sources.codecs`` when files are read; here they are operators
over pixel relations, for analysis of encoded data at scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import KEYS

# The seven passes of Adam7 as (x offset, y offset, x step, y step), GIF's four as (y offset, y step).
ADAM7 = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
GIF_PASSES = [(0, 8), (4, 8), (2, 4), (1, 2)]


def _row(lag: int = 1) -> Window:
    return Window.partitionBy(*KEYS, "y").orderBy("x")


def _column() -> Window:
    return Window.partitionBy(*KEYS, "x").orderBy("y")


def unfilter_sub(df: DataFrame, v: str = "v", bits: int = 8) -> DataFrame:
    """Samples from differences to the left: a running sum along the row, modulo the sample's range."""
    w = _row().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(v, F.pmod(F.sum(F.col(v).cast("long")).over(w), F.lit(1 << bits)).cast("int"))


def unfilter_up(df: DataFrame, v: str = "v") -> DataFrame:
    w = _column().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(v, F.pmod(F.sum(F.col(v).cast("long")).over(w), F.lit(256)).cast("int"))


def neighbours(df: DataFrame, v: str = "v") -> DataFrame:
    """``df`` with the samples left, above and above left; 0 outside."""
    up = df.withColumn("up", F.coalesce(F.lag(v).over(_column()), F.lit(0)))
    return up.withColumn("lf", F.coalesce(F.lag(v).over(_row()), F.lit(0))).withColumn("ul", F.coalesce(F.lag("up").over(_row()), F.lit(0)))


def paeth(lf: str = "lf", up: str = "up", ul: str = "ul") -> str:
    """The Paeth predictor as SQL: of the three, the one nearest to left + above - above left."""
    p = f"({lf} + {up} - {ul})"
    a, b, c = f"abs({p} - {lf})", f"abs({p} - {up})", f"abs({p} - {ul})"
    return f"case when {a} <= {b} and {a} <= {c} then {lf} when {b} <= {c} then {up} else {ul} end"


def png_residuals(df: DataFrame, v: str = "v") -> DataFrame:
    """The residual byte of each sample under each of the five filters, as ``f0`` to ``f4``."""
    n = neighbours(df, v)
    predictions = ["0", "lf", "up", "(lf + up) div 2", paeth()]
    return n.select(*df.columns, *[F.expr(f"cast(pmod({v} - ({p}), 256) as int)").alias(f"f{i}") for i, p in enumerate(predictions)])


def choose_filter(df: DataFrame, v: str = "v") -> DataFrame:
    """``filter, cost`` of each row: the smallest sum of residuals taken as signed, the lowest number on ties."""
    cost = lambda i: F.sum(F.expr(f"if(f{i} < 128, f{i}, 256 - f{i})")).alias(f"c{i}")
    rows = png_residuals(df, v).groupBy(*KEYS, "y").agg(*[cost(i) for i in range(5)])
    best = F.least(*[F.struct(F.col(f"c{i}").alias("cost"), F.lit(i).alias("filter")) for i in range(5)])
    return rows.select(*KEYS, "y", best["filter"].alias("filter"), best["cost"].alias("cost"))


def jpeg_residual(df: DataFrame, predictor: int, bits: int = 8, v: str = "v") -> DataFrame:
    """``residual`` of lossless coding with predictor 1 to 7; the first row predicts from the left, the first column from above."""
    n = neighbours(df, v)
    body = {1: "lf", 2: "up", 3: "ul", 4: "lf + up - ul", 5: "lf + shiftright(up - ul, 1)", 6: "up + shiftright(lf - ul, 1)", 7: "shiftright(lf + up, 1)"}[predictor]
    p = f"case when x = 0 and y = 0 then {1 << (bits - 1)} when y = 0 then lf when x = 0 then up else {body} end"
    return n.select(*df.columns, F.expr(f"cast({v} - ({p}) as int)").alias("residual"))


def adam7(df: DataFrame) -> DataFrame:
    """``df`` with the pass of each pixel and its place inside the pass."""
    which = "case " + " ".join(f"when x % {dx} = {x0 % dx} and y % {dy} = {y0 % dy} then {i}" for i, (x0, y0, dx, dy) in enumerate(ADAM7)) + " end"
    px = "case pass " + " ".join(f"when {i} then (x - {x0}) div {dx}" for i, (x0, _, dx, _) in enumerate(ADAM7)) + " end"
    py = "case pass " + " ".join(f"when {i} then (y - {y0}) div {dy}" for i, (_, y0, _, dy) in enumerate(ADAM7)) + " end"
    return df.withColumn("pass", F.expr(which)).withColumn("px", F.expr(f"cast({px} as int)")).withColumn("py", F.expr(f"cast({py} as int)"))


def gif_row(h: str = "h", n: str = "n") -> Column:
    """The picture row of the ``n``-th row of an interlaced file of height ``h``."""
    counts = [f"greatest(0, ({h} - {y0} + {dy - 1}) div {dy})" for y0, dy in GIF_PASSES]
    sql, before = "case", "0"
    for (y0, dy), c in zip(GIF_PASSES, counts):
        sql += f" when {n} < {before} + {c} then {y0} + ({n} - ({before})) * {dy}"
        before = f"{before} + {c}"
    return F.expr(f"cast({sql} end as int)")


def upsample_h2v1(df: DataFrame, v: str = "v") -> DataFrame:
    """Twice as wide by the triangle filter; edges are copied."""
    w = _row()
    n = df.withColumn("prev", F.lag(v).over(w)).withColumn("next", F.lead(v).over(w))
    left = F.expr(f"coalesce(shiftright(3 * {v} + prev + 1, 2), {v})")
    right = F.expr(f"coalesce(shiftright(3 * {v} + next + 2, 2), {v})")
    both = n.withColumn("o", F.explode(F.array(F.struct(F.lit(0).alias("d"), left.alias("v")), F.struct(F.lit(1).alias("d"), right.alias("v")))))
    new = {"x": F.expr("cast(x * 2 + o.d as int)"), v: F.col("o.v").cast("int"), "w": F.expr("cast(w * 2 as int)")}
    return both.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def _doubled_rows(df: DataFrame, v: str, values: str) -> DataFrame:
    """Two rows out of each: ``values`` is SQL of a sample and its ``other`` row, above for the first and below for the second."""
    w = _column()
    n = df.withColumn("above", F.coalesce(F.lag(v).over(w), F.col(v))).withColumn("below", F.coalesce(F.lead(v).over(w), F.col(v)))
    row = lambda d, other: F.struct(F.lit(d).alias("d"), F.expr(values.format(v=v, other=other, bias=d + 1)).alias("v"))
    both = n.withColumn("o", F.explode(F.array(row(0, "above"), row(1, "below"))))
    new = {"y": F.expr("cast(y * 2 + o.d as int)"), v: F.col("o.v").cast("int"), "h": F.expr("cast(h * 2 as int)")}
    return both.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def upsample_h1v2(df: DataFrame, v: str = "v") -> DataFrame:
    """Twice as high by the triangle filter."""
    return _doubled_rows(df, v, "shiftright(3 * {v} + {other} + {bias}, 2)")


def upsample_h2v2(df: DataFrame, v: str = "v") -> DataFrame:
    """Twice as wide and high: sums of two rows, then the triangle filter along the row."""
    sums = _doubled_rows(df, v, "3 * {v} + {other}")
    w = _row()
    n = sums.withColumn("prev", F.lag(v).over(w)).withColumn("next", F.lead(v).over(w))
    left = F.expr(f"if(prev is null, shiftright(4 * {v} + 8, 4), shiftright(3 * {v} + prev + 8, 4))")
    right = F.expr(f"if(next is null, shiftright(4 * {v} + 7, 4), shiftright(3 * {v} + next + 7, 4))")
    both = n.withColumn("o", F.explode(F.array(F.struct(F.lit(0).alias("d"), left.alias("v")), F.struct(F.lit(1).alias("d"), right.alias("v")))))
    new = {"x": F.expr("cast(x * 2 + o.d as int)"), v: F.col("o.v").cast("int"), "w": F.expr("cast(w * 2 as int)")}
    return both.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def read_be(content: str, offset: int, size: int) -> Column:
    """An unsigned big-endian number of ``size`` bytes at a 0-based offset; null past the end."""
    return F.expr(f"if(length({content}) >= {offset + size}, cast(conv(hex(substring({content}, {offset + 1}, {size})), 16, 10) as bigint), null)")


def read_le(content: str, offset: int, size: int) -> Column:
    bytes_ = ", ".join(f"hex(substring({content}, {offset + 1 + i}, 1))" for i in reversed(range(size)))
    return F.expr(f"if(length({content}) >= {offset + size}, cast(conv(concat({bytes_}), 16, 10) as bigint), null)")


def png_header(files: DataFrame, content: str = "content") -> DataFrame:
    """``width, height, bit_depth, color_type, interlaced`` of PNG files, from the bytes, in built-in functions."""
    return files.select(
        *files.columns, read_be(content, 16, 4).alias("width"), read_be(content, 20, 4).alias("height"),
        read_be(content, 24, 1).alias("bit_depth"), read_be(content, 25, 1).alias("color_type"), (read_be(content, 28, 1) == 1).alias("interlaced"),
    )
