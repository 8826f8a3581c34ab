"""Documents and items: summaries, metadata policies and inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(items: DataFrame) -> DataFrame:
    """Items of each document: how many, of which roles, and their delay in all."""
    return items.groupBy("doc_id").agg(
        F.count("*").alias("item_count"), F.count(F.when(F.col("role") == "FRAME", 1)).alias("frames"), F.count(F.when(F.col("role") == "THUMBNAIL", 1)).alias("thumbnails"),
        F.sum(F.expr("(cast(delay_num as bigint) * 1000) div if(delay_den = 0, 100, delay_den)")).alias("delay_ms"),
    )


def apply_policy(blocks: DataFrame, policy: str) -> DataFrame:
    """The metadata blocks ``(doc_id, kind, is_raw, ...)`` that a policy keeps."""
    keep = {
        "PRESERVE_ALL": "true", "DROP_ALL": "false", "STRIP_GPS": "kind <> 'GPS'", "NORMALIZE_EXIF": "kind <> 'EXIF_ORIENTATION'",
        "KEEP_RAW_ONLY": "is_raw", "KEEP_COMMON_ONLY": "not is_raw",
    }[policy]
    return blocks.filter(keep)


def inventory(blocks: DataFrame) -> DataFrame:
    """Which kinds of metadata each document has, and how much."""
    kinds = ["EXIF", "XMP", "ICC", "GPS", "TEXT"]
    return blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum("size").alias("bytes"), *[F.max((F.col("kind") == k).cast("int")).alias(f"has_{k.lower()}") for k in kinds])


def with_role(items: DataFrame, role: str, subject: str) -> DataFrame:
    """Set the role of every item; images and frames are of themselves, whatever subject is named."""
    own = "item_index" if role in ("IMAGE", "FRAME") else subject
    return items.withColumn("role", F.lit(role)).withColumn("role_subject", F.expr(f"cast({own} as int)"))


def copied(documents: DataFrame) -> DataFrame:
    """Documents as new ones: everything but how they were loaded."""
    return documents.drop("loaded_by", "error_code", "error")


def with_aspect(documents: DataFrame, num: str, den: str) -> DataFrame:
    """Set the pixel aspect from two expressions; where a term is zero, negative or null it stays as it was."""
    stated = F.expr(f"coalesce({num} > 0 and {den} > 0, false)")
    old = {c: F.col(c) if c in documents.columns else F.lit(None).cast("int") for c in ("aspect_num", "aspect_den")}
    new = {"aspect_num": F.expr(f"cast({num} as int)"), "aspect_den": F.expr(f"cast({den} as int)")}
    return documents.withColumns({c: F.when(stated, new[c]).otherwise(old[c]) for c in old})


def gif_aspect(byte: str) -> str:
    """SQL of the pixel aspect that a GIF's byte states, (byte + 15) / 64; 0 states none."""
    return f"case when {byte} > 0 then ({byte} + 15) / 64D end"


def gif_aspect_byte(aspect: str) -> str:
    """SQL of the byte that states an aspect nearest, 0 where none does."""
    return f"case when {aspect} is null or round({aspect} * 64D) - 15 not between 1 and 255 then 0 else cast(round({aspect} * 64D) - 15 as int) end"


def with_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Documents with the number of their items; one without any has an ``error_code`` of INVALID, since a document has at least one."""
    counted = items.groupBy("doc_id").agg(F.count("*").cast("int").alias("item_count"))
    joined = documents.join(counted, "doc_id", "left").withColumn("item_count", F.coalesce("item_count", F.lit(0)))
    return joined.withColumn("error_code", F.when(F.col("item_count") > 0, "OK").otherwise("INVALID"))


def displayed_size(documents: DataFrame) -> DataFrame:
    """Width and height after the orientation is undone, and the pixel aspect where both terms are stated."""
    turned = F.col("orientation").between(5, 8)
    return documents.withColumn("shown_w", F.when(turned, F.col("h")).otherwise(F.col("w"))).withColumn("shown_h", F.when(turned, F.col("w")).otherwise(F.col("h")))


def psnr(a: DataFrame, b: DataFrame, channels: list[str], bits: int = 8) -> DataFrame:
    """``mse`` and ``psnr`` (null for equal rasters) of each raster."""
    other = b.select("doc_id", "item_index", "x", "y", *[F.col(c).alias(f"o{c}") for c in channels])
    error = sum(((F.col(c) - F.col(f"o{c}")).cast("long") * (F.col(c) - F.col(f"o{c}")) for c in channels), F.lit(0).cast("long"))
    sums = a.join(other, ["doc_id", "item_index", "x", "y"]).groupBy("doc_id", "item_index").agg(F.sum(error).alias("e"), F.count("*").alias("n"))
    mse = F.col("e") / (F.col("n") * len(channels))
    top = float((1 << bits) - 1)
    return sums.select("doc_id", "item_index", mse.alias("mse"), F.when(F.col("e") > 0, 10 * F.log10(top * top / mse)).alias("psnr"))
