"""Blocks of 8x8 samples and their cosine transform in integers.

A block is a row: ``doc_id, item_index, w, h, bx, by`` and ``s``, eight arrays of eight longs. One pass of the transform is a product with a matrix of
13-bit fixed-point numbers and one rounding shift, so that a whole block is two projections over arrays, without a shuffle;
only making blocks from pixels shuffles, once.

Defined cases: a raster whose sides are no multiples of 8 repeats its last column and row; a null sample makes its whole block's
coefficients null where it counts; an empty table stays empty; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KEYS

# Weights of samples 0 to 3 in frequencies 0 to 7, 13 fractional bits. Samples 4 to 7 mirror them, negated in odd frequencies.
HALVES = [
    (8192, 8192, 8192, 8192),
    (11363, 9633, 6437, 2260),
    (10703, 4433, -4433, -10703),
    (9633, -2259, -11362, -6436),
    (8192, -8192, -8192, 8192),
    (6437, -11362, 2261, 9633),
    (4433, -10704, 10704, -4433),
    (2260, -6436, 9633, -11363),
]
MATRIX = [[*half, *(c * (-1) ** u for c in reversed(half))] for u, half in enumerate(HALVES)]
INVERSE = [list(column) for column in zip(*MATRIX)]
#: Bits to which the first pass is kept beyond the samples'.
KEPT = 2
PLACE = [*KEYS, "w", "h", "bx", "by"]


def _pass(rows: str, matrix: Sequence[Sequence[int]], shift: int) -> str:
    """Every row times the matrix, rounded by ``shift`` bits."""
    terms = (" + ".join(f"{c}L * r[{i}]" for i, c in enumerate(line)) for line in matrix)
    return f"transform({rows}, r -> array({', '.join(f'shiftright({t} + {1 << (shift - 1)}L, {shift})' for t in terms)}))"


def _turned(rows: str) -> str:
    """Columns as rows. The rows are bound once, by the outer function, else each column would evaluate them again."""
    return f"transform(array({rows}), t -> transform(array(0, 1, 2, 3, 4, 5, 6, 7), j -> transform(t, q -> q[j])))[0]"


def blocks(df: DataFrame, v: str = "v") -> DataFrame:
    """The blocks of whole rasters ``doc_id, item_index, w, h, x, y, v``."""
    beyond = lambda c, n: f"explode(if({c} = {n} - 1, sequence({c}, cast(({n} + 7) div 8 * 8 - 1 as int)), array({c})))"
    px = df.select(*KEYS, *[F.col(c).cast("int").alias(c) for c in ("w", "h", "x", "y")], F.col(v).cast("long").alias("__v"))
    px = px.selectExpr(*KEYS, "w", "h", "y", "__v", f"{beyond('x', 'w')} as x").selectExpr(*KEYS, "w", "h", "x", "__v", f"{beyond('y', 'h')} as y")
    placed = px.selectExpr(*KEYS, "w", "h", "cast(x div 8 as int) as bx", "cast(y div 8 as int) as by", "struct(y % 8 as j, x % 8 as i, __v as v) as p")
    flat = placed.groupBy(*PLACE).agg(F.array_sort(F.collect_list("p")).alias("p"))
    return flat.select(*PLACE, F.expr("transform(array(0, 1, 2, 3, 4, 5, 6, 7), j -> transform(slice(p, j * 8 + 1, 8), q -> q.v))").alias("s"))


def samples(df: DataFrame, v: str = "v") -> DataFrame:
    """Blocks as pixels again, those beyond the raster left out."""
    rows = df.select(*PLACE, F.posexplode("s").alias("j", "r"))
    px = rows.select(*PLACE, "j", F.posexplode("r").alias("i", "__v"))
    px = px.selectExpr(*KEYS, "w", "h", "cast(bx * 8 + i as int) as x", "cast(by * 8 + j as int) as y", f"cast(__v as int) as `{v}`")
    return px.filter("x < w and y < h")


def forward(df: DataFrame, bits: int = 8) -> DataFrame:
    """Coefficients of samples of ``bits`` bits, eight times their size: ``s`` by vertical and horizontal frequency."""
    level = f"transform(s, r -> transform(r, q -> q - {1 << (bits - 1)}L))"
    across = df.withColumn("s", F.expr(_turned(_pass(level, MATRIX, 13 - KEPT))))
    return across.withColumn("s", F.expr(_turned(_pass("s", MATRIX, 13 + KEPT))))


def inverse(df: DataFrame, bits: int = 8) -> DataFrame:
    """Samples of dequantized coefficients, cut to the range of ``bits`` bits. Samples of 12 bits keep one bit less between the passes."""
    kept = KEPT if bits == 8 else 1
    down = df.withColumn("s", F.expr(_turned(_pass(_turned("s"), INVERSE, 13 - kept))))
    return down.withColumn("s", F.expr(f"transform({_pass('s', INVERSE, 13 + kept + 3)}, r -> transform(r, q -> least({(1 << bits) - 1}L, greatest(0L, q + {1 << (bits - 1)}L))))"))


def _table(table: Sequence[int]) -> str:
    if len(table) != 64 or min(table) < 1:
        raise ValueError("a quantization table has 64 steps of at least 1, row by row")
    return "array(" + ", ".join("array(" + ", ".join(f"{q}L" for q in table[j : j + 8]) + ")" for j in range(0, 64, 8)) + ")"


def quantize(df: DataFrame, table: Sequence[int]) -> DataFrame:
    """What ``forward`` gives, in steps of the table (row by row), halves away from zero."""
    step = "zip_with(a, b, (c, q) -> cast(sign(c) as bigint) * ((abs(c) + 4 * q) div (8 * q)))"
    return df.withColumn("s", F.expr(f"zip_with(s, {_table(table)}, (a, b) -> {step})"))


def dequantize(df: DataFrame, table: Sequence[int]) -> DataFrame:
    return df.withColumn("s", F.expr(f"zip_with(s, {_table(table)}, (a, b) -> zip_with(a, b, (c, q) -> c * q))"))
