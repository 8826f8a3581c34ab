"""Projections over the pixel relation: geometry, depth, alpha, colour models. None of them shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import CMYK, MAX, ImageError


def _with(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` with columns from SQL expressions that all see the old values."""
    return df.selectExpr(*[f"cast({columns[c]} as int) as {c}" if c in columns else c for c in df.columns], *[f"cast({e} as int) as {c}" for c, e in columns.items() if c not in df.columns])


def crop(df: DataFrame, x: int, y: int, width: int, height: int, strict: bool = False) -> DataFrame:
    """The rectangle, moved to the origin. Rasters that do not hold all of it give no rows or, if ``strict``, fail with INTERNAL."""
    inside = f"{x} >= 0 and {y} >= 0 and {width} > 0 and {height} > 0 and {x} + {width} <= w and {y} + {height} <= h"
    if strict:
        inside = f"if({inside}, true, raise_error('INTERNAL: the rectangle is not inside'))"
    kept = df.filter(inside).filter(f"x between {x} and {x + width - 1} and y between {y} and {y + height - 1}")
    return _with(kept, x=f"x - {x}", y=f"y - {y}", w=str(width), h=str(height))


def flip_h(df: DataFrame) -> DataFrame:
    return _with(df, x="w - 1 - x")


def flip_v(df: DataFrame) -> DataFrame:
    return _with(df, y="h - 1 - y")


def rotate_180(df: DataFrame) -> DataFrame:
    return _with(df, x="w - 1 - x", y="h - 1 - y")


def rotate_90_cw(df: DataFrame) -> DataFrame:
    return _with(df, x="h - 1 - y", y="x", w="h", h="w")


def rotate_90_ccw(df: DataFrame) -> DataFrame:
    return _with(df, x="y", y="w - 1 - x", w="h", h="w")


def transpose(df: DataFrame) -> DataFrame:
    return _with(df, x="y", y="x", w="h", h="w")


def transverse(df: DataFrame) -> DataFrame:
    return _with(df, x="h - 1 - y", y="w - 1 - x", w="h", h="w")


def orient(df: DataFrame, orientation: str = "orientation") -> DataFrame:
    """Undo the Exif orientation in the column ``orientation`` (0 to 8, 0 and 1 and null: as it is)."""
    o = f"coalesce({orientation}, 0)"
    turned = f"{o} between 5 and 8"
    return _with(
        df,
        x=f"case {o} when 2 then w - 1 - x when 3 then w - 1 - x when 5 then y when 6 then h - 1 - y when 7 then h - 1 - y when 8 then y else x end",
        y=f"case {o} when 3 then h - 1 - y when 4 then h - 1 - y when 5 then x when 6 then x when 7 then w - 1 - x when 8 then w - 1 - x else y end",
        w=f"case when {turned} then h else w end", h=f"case when {turned} then w else h end",
    )


def gray_to_rgba(df: DataFrame, bits: int = 8) -> DataFrame:
    return _with(df, r="v", g="v", b="v", a=str(MAX[bits])).drop("v")


def cmyk_to_rgba(df: DataFrame, bits: int = 8, polarity: str = "INK") -> DataFrame:
    """The naive product. ``polarity`` is INK (0 is no ink) or REFLECTION (0 is full ink)."""
    if polarity not in ("INK", "REFLECTION"):
        raise ValueError("UNSUPPORTED: the polarity must be known")
    top = MAX[bits]
    light = lambda c: f"least({c}, {top})" if polarity == "REFLECTION" else f"({top} - least({c}, {top}))"
    product = lambda c: f"(cast({light(c)} as bigint) * {light('k')} + {top // 2}) div {top}"
    return _with(df, r=product("c"), g=product("m"), b=product("ye"), a=str(top)).drop(*CMYK)


def sample_depth(v: str, src: int, dst: int) -> str:
    """SQL of one sample of ``src`` bits in ``dst`` bits: widening repeats bits, narrowing rounds."""
    v = f"least({v}, 4095)" if src == 12 else v
    if src == dst:
        return v
    if src < dst:
        up = dst - src
        return f"(shiftleft({v}, {up}) | shiftright({v}, {src - up}))" if (src, dst) != (8, 16) else f"(shiftleft({v}, 8) | {v})"
    return f"(cast({v} as bigint) * {MAX[dst]} + {MAX[src] // 2}) div {MAX[src]}"


def convert_depth(df: DataFrame, channels: list[str], src: int, dst: int) -> DataFrame:
    return _with(df, **{c: sample_depth(c, src, dst) for c in channels})


def premultiply(df: DataFrame, alpha_form: str = "STRAIGHT") -> DataFrame:
    """8-bit colour times alpha, rounded down; colour that is premultiplied already is refused."""
    _of_form(alpha_form, "STRAIGHT")
    return _with(df, **{c: f"({c} * a) div 255" for c in "rgb"})


def _of_form(alpha_form: str, wanted: str) -> None:
    if alpha_form != wanted:
        raise ImageError("UNSUPPORTED", f"alpha is {alpha_form}, not {wanted}")


def unpremultiply(df: DataFrame, alpha_form: str = "PREMULTIPLIED") -> DataFrame:
    """The inverse, modulo 256 for values out of gamut; clear pixels stay as they are, straight colour is refused."""
    _of_form(alpha_form, "PREMULTIPLIED")
    return _with(df, **{c: f"case when a = 0 then {c} else pmod(({c} * 255) div greatest(a, 1), 256) end" for c in "rgb"})


def unassociate(df: DataFrame, bits: int = 8) -> DataFrame:
    """Divide by associated alpha as files with such alpha ask for: to the nearest, saturated."""
    top = MAX[bits]
    return _with(df, **{c: f"case when a = 0 then 0 else least({top}, (cast({c} as bigint) * {top} + a div 2) div greatest(a, 1)) end" for c in "rgb"})


def ycbcr_to_rgb(df: DataFrame) -> DataFrame:
    """8-bit full range ``yy, cb, cr`` to ``r, g, b`` in 16.16 fixed point."""
    clamp = lambda e: f"least(255, greatest(0, {e}))"
    return _with(
        df,
        r=clamp("yy + shiftright(91881 * (cr - 128) + 32768, 16)"),
        g=clamp("yy + shiftright(-22554 * (cb - 128) - 46802 * (cr - 128) + 32768, 16)"),
        b=clamp("yy + shiftright(116130 * (cb - 128) + 32768, 16)"),
    ).drop("yy", "cb", "cr")


def rgb_to_ycbcr(df: DataFrame) -> DataFrame:
    clamp = lambda e: f"least(255, greatest(0, {e}))"
    centre = 128 << 16
    return _with(
        df,
        yy=clamp("shiftright(19595 * r + 38470 * g + 7471 * b + 32768, 16)"),
        cb=clamp(f"shiftright(-11059 * r - 21709 * g + 32768 * b + {centre} + 32767, 16)"),
        cr=clamp(f"shiftright(32768 * r - 27439 * g - 5331 * b + {centre} + 32767, 16)"),
    )


def masked(df: DataFrame, value: str, masks: dict[str, int]) -> DataFrame:
    """Channels out of packed pixels by bit masks, expanded to 8 bits; a mask of 0 gives 0."""
    out = {}
    for c, mask in masks.items():
        shift = (mask & -mask).bit_length() - 1 if mask else 0
        top = mask >> shift
        out[c] = f"(shiftright({value} & {mask}, {shift}) * 255 + {top // 2}) div {top}" if mask else "0"
    return _with(df, **out)


def colour_matrix(df: DataFrame, matrix: list[list[float]], decode: float, encode: float, bits: int = 8) -> DataFrame:
    """Matrix and gamma transform: decode to linear light, multiply, clamp, encode, round half up."""
    top = MAX[bits]
    linear = [f"power({c} / {float(top)!r}D, {decode!r}D)" for c in "rgb"]
    out = {}
    for c, row in zip("rgb", matrix):
        mixed = " + ".join(f"{k!r}D * {e}" for k, e in zip(row, linear))
        out[c] = f"floor(power(least(1D, greatest(0D, {mixed})), {1 / encode!r}D) * {float(top)!r}D + 0.5D)"
    return _with(df, **out)


def srgb_decode(v: Column) -> Column:
    """The sRGB curve of a value in 0..1."""
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def dpi_to_ppm(dpi: str) -> str:
    """Dots an inch to pixels a metre."""
    return f"(cast({dpi} as bigint) * 5000 + 63) div 127"


def ppm_to_dpi(ppm: str) -> str:
    return f"(cast({ppm} as bigint) * 127 + 2500) div 5000"


def over_pixel_cap(df: DataFrame, cap: int | None) -> DataFrame:
    """``df`` with ``error_code``: LIMIT where ``w * h`` is over the cap, INTERNAL for an empty size."""
    cap_sql = "false" if cap is None else f"cast(w as bigint) * h > {cap}"
    return df.withColumn("error_code", F.expr(f"case when w <= 0 or h <= 0 then 'INTERNAL' when {cap_sql} then 'LIMIT' else 'OK' end"))


def decode_budget(items: DataFrame, pixels: int | None, memory: int | None, frames: int | None, bytes_per_pixel: int = 4) -> DataFrame:
    """``items (doc_id, item_index, w, h)`` with ``held``, the bytes of all items up to this one, and ``error_code``.

    Items are decoded in order and stay in memory. From the first one on that is empty (INTERNAL), or one too many, over the pixel cap or
    over what is left of the memory (LIMIT), a document's items are refused with that code. None lifts a cap.
    """
    size = F.greatest(F.col("w").cast("long"), F.lit(0)) * F.greatest(F.col("h"), F.lit(0))
    so_far = Window.partitionBy("doc_id").orderBy("item_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = items.withColumn("held", F.sum(size * bytes_per_pixel).over(so_far)).withColumn("__nth", F.count("*").over(so_far))
    over = [c for cap, c in ((frames, F.col("__nth") > frames if frames is not None else None), (pixels, size > pixels if pixels is not None else None), (memory, F.col("held") > memory if memory is not None else None)) if cap is not None]
    code = F.when((F.col("w") <= 0) | (F.col("h") <= 0), "INTERNAL")
    for c in over:
        code = code.when(c, "LIMIT")
    return counted.withColumn("error_code", F.coalesce(F.first(code, ignorenulls=True).over(so_far), F.lit("OK"))).drop("__nth")
