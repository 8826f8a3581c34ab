"""Operations that relate two rasters: compositing, comparison, palettes, roles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KEYS, MAX, PLACE, RGBA


def _shifted(src: DataFrame, dx: int, dy: int) -> DataFrame:
    return src.select(*KEYS, (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), *[F.col(c).alias(f"s{c}") for c in RGBA])


def composite(dst: DataFrame, src: DataFrame, dx: int, dy: int, op: str = "OVER", bits: int = 8) -> DataFrame:
    """``src`` on ``dst`` at a signed offset, clipped to ``dst``; SOURCE replaces, OVER blends to the nearest.

    One equi join on the pixel's place; an empty overlap leaves ``dst`` as it is.
    """
    joined = dst.join(_shifted(src, dx, dy), [*KEYS, *PLACE], "left")
    if op == "SOURCE":
        new = {c: F.coalesce(f"s{c}", c) for c in RGBA}
    elif op == "OVER":
        m = MAX[bits]
        keep = f"({m} - cast(sa as bigint))"
        alpha = f"(sa + (a * {keep} + {m // 2}) div {m})"
        den = f"({alpha} * {m})"
        new = {}
        for c in "rgb":
            blend = f"case when {alpha} = 0 then 0 else least({m}, (cast(s{c} as bigint) * sa * {m} + cast({c} as bigint) * a * {keep} + {den} div 2) div greatest({den}, 1)) end"
            new[c] = F.expr(f"cast(case when sa is null then {c} when sa = {m} then s{c} when sa = 0 and a <> 0 then {c} else {blend} end as int)")
        new["a"] = F.expr(f"cast(case when sa is null then a when sa = {m} then {m} when sa = 0 and a <> 0 then a else {alpha} end as int)")
    else:
        raise ValueError(op)
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in dst.columns])


def raster_equal(a: DataFrame, b: DataFrame, channels: list[str] = RGBA) -> DataFrame:
    """``doc_id, item_index, equal``: same size, places and samples."""
    rows = lambda d, n: d.select(*KEYS, *PLACE, F.struct("w", "h", *channels).alias(n))
    both = rows(a, "p").join(rows(b, "q"), [*KEYS, *PLACE], "full")
    return both.groupBy(*KEYS).agg((F.count(F.when(~F.col("p").eqNullSafe(F.col("q")), 1)) == 0).alias("equal"))


def pixels_not_in(a: DataFrame, b: DataFrame, channels: list[str] = RGBA, both: bool = False) -> DataFrame:
    """Places and samples of ``a`` that ``b`` does not have, and if ``both`` those of ``b`` that ``a`` does not; ``side`` says whose."""
    rows = lambda d: d.select("doc_id", *PLACE, *channels)
    left = rows(a).exceptAll(rows(b)).withColumn("side", F.lit("a"))
    return left.unionByName(rows(b).exceptAll(rows(a)).withColumn("side", F.lit("b"))) if both else left


def bounded(palette: DataFrame) -> DataFrame:
    """``palette``; more than 256 entries fail the job with UNSUPPORTED instead of being left out."""
    rows = palette.orderBy("idx").limit(257).agg(F.collect_list(F.struct("idx", *RGBA)).alias("e"))
    checked = F.when(F.size("e") > 256, F.raise_error(F.lit("UNSUPPORTED: a palette has 256 entries at most"))).otherwise(F.col("e"))
    return rows.select(F.explode(checked).alias("e")).select("e.*")


def palette_apply(df: DataFrame, palette: DataFrame) -> DataFrame:
    """``df`` with ``idx`` and the colours of the nearest entry of ``palette (idx, r, g, b, a)``.

    A palette has at most 256 entries and is broadcast whole; every distinct colour is looked up once, and
    ties go to the lowest index. Clear pixels look up the one clear colour.
    """
    colour = lambda c: F.when(F.col("a") == 0, 0).otherwise(F.col(c))
    keyed = df.select("*", *[colour(c).alias(f"k{c}") for c in RGBA])
    entries = F.broadcast(bounded(palette).agg(F.array_sort(F.collect_list(F.struct("idx", *RGBA))).alias("entries")))
    distance = lambda e: reduce(lambda s, c: s + (F.col(f"k{c}") - e[c]) * (F.col(f"k{c}") - e[c]), RGBA, F.lit(0).cast("long"))
    found = keyed.select(*[f"k{c}" for c in RGBA]).distinct().crossJoin(entries)
    found = found.withColumn("best", F.array_min(F.transform("entries", lambda e: F.struct(distance(e).alias("d"), *[e[c].alias(c) for c in ("idx", *RGBA)]))))
    found = found.select(*[F.col(f"k{c}").alias(f"q{c}") for c in RGBA], F.col("best.idx").alias("idx"), *[F.col(f"best.{c}").alias(f"n{c}") for c in RGBA])
    joined = keyed.join(found, reduce(lambda a, b: a & b, [F.col(f"k{c}") == F.col(f"q{c}") for c in RGBA]))
    return joined.select(*[F.col(f"n{c}").alias(c) if c in RGBA else F.col(c) for c in df.columns], "idx")


def from_palette(df: DataFrame, palette: DataFrame, transparent: int | None = None) -> DataFrame:
    """Indexed pixels ``v`` to colours; an index past the table, or the transparent one, draws nothing."""
    entries = bounded(palette).select(F.col("idx").alias("v"), *RGBA)
    joined = df.join(F.broadcast(entries), "v", "left")
    drawn = F.col("r").isNotNull() & (F.lit(True) if transparent is None else F.col("v") != transparent)
    return joined.select(*[c for c in df.columns if c != "v"], *[F.when(drawn, F.col(c)).otherwise(0).alias(c) for c in RGBA])


def with_subject(items: DataFrame, columns: list[str]) -> DataFrame:
    """``items`` with the columns of the item that each is of, as ``subject_<column>``."""
    subject = items.select("doc_id", F.col("item_index").alias("role_subject"), *[F.col(c).alias(f"subject_{c}") for c in columns])
    return items.join(subject, ["doc_id", "role_subject"], "left")


def metadata_loss(held: DataFrame, carried: DataFrame, removed: DataFrame) -> DataFrame:
    """Kinds a document holds that the target format does not carry and the policy did not remove.

    ``held (doc_id, format, policy, kind)``, ``carried (format, kind)``, ``removed (policy, kind)``; the two small
    tables are fixed by the formats and policies there are.
    """
    left = held.join(F.broadcast(carried), ["format", "kind"], "left_anti").join(F.broadcast(removed), ["policy", "kind"], "left_anti")
    return left.select("doc_id", "format", "policy", "kind", F.lit("WARNING").alias("severity"))


def and_mask(df: DataFrame, mask: DataFrame) -> DataFrame:
    """Icon pixels with a 1-bit mask ``(doc_id, item_index, x, y, m)``: masked pixels are clear, others opaque.

    Only for rasters without alpha of their own, that is with alpha 0 throughout.
    """
    own = df.groupBy(*KEYS).agg((F.max("a") > 0).alias("__own"))
    joined = df.join(mask, [*KEYS, *PLACE], "left").join(own, KEYS)
    alpha = F.when(F.col("__own"), F.col("a")).when(F.coalesce("m", F.lit(0)) == 1, 0).otherwise(255)
    return joined.select(*[alpha.alias(c) if c == "a" else F.col(c) for c in df.columns])


def with_profile(documents: DataFrame, profiles: DataFrame) -> DataFrame:
    """Documents whose profile is only named, with the bytes a caller has for that name; unknown names stay null."""
    return documents.join(profiles.select(F.col("path").alias("icc_linked_path"), F.col("bytes").alias("icc")), "icc_linked_path", "left")
