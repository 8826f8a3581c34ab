"""Recognising formats from the first bytes, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The leading bytes of each format in hexadecimal, in the order in which they are tried.
MAGICS = {
    "png": ["89504E470D0A1A0A"], "jpeg": ["FFD8FF"], "gif": ["474946383761", "474946383961"], "bmp": ["424D", "4241"],
    "tiff": ["49492A00", "4D4D002A", "49492B00", "4D4D002B"],
}


def format_of(content: Column) -> Column:
    """The format's name, null if none fits. Icons and WebP also need a second look behind their magic."""
    head = F.hex(F.substring(content, 1, 32))
    found = [F.when(head.startswith(m), F.lit(name)) for name, magics in MAGICS.items() for m in magics]
    entries = F.conv(F.concat(F.substring(head, 11, 2), F.substring(head, 9, 2)), 16, 10).cast("int")
    icon = (F.length(content) >= 22) & entries.between(1, 64) & (F.substring(head, 19, 2) == "00")
    found += [F.when(head.startswith(m) & icon, F.lit(name)) for name, m in (("ico", "00000100"), ("cur", "00000200"))]
    found.append(F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), F.lit("webp")))
    return F.coalesce(*found)


def probe(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with ``format`` and ``confidence`` (100, or 0 if unknown)."""
    name = format_of(F.col(content))
    return files.withColumn("format", name).withColumn("confidence", F.when(name.isNull(), 0).otherwise(100))
