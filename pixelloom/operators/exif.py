"""Exif blocks: reading tags, leaving out positions, making the orientation normal, in their own bytes.

Kernels of bytes, and the same over a column with Arrow batches; a block that cannot be read comes back unchanged with CORRUPT.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..model import ImageError

# Tags of the directories and of the orientation, and bytes of each value type.
ORIENTATION, EXIF_IFD, GPS_IFD, THUMBNAIL, THUMBNAIL_SIZE = 0x0112, 0x8769, 0x8825, 0x0201, 0x0202
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


def directory(data: bytes, at: int, order: str) -> tuple[list[tuple[int, int, int, int]], int]:
    """``(tag, type, count, place of the value)`` of a directory, and the offset of the next."""
    try:
        (n,) = struct.unpack_from(order + "H", data, at)
        out = []
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            place = at + 10 + 12 * k
            if SIZES.get(kind, 1) * count > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            if place + SIZES.get(kind, 1) * count > len(data):
                raise ImageError("CORRUPT", "a value is past the end")
            out.append((tag, kind, count, place))
        (after,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    except struct.error as e:
        raise ImageError("CORRUPT", str(e)) from e
    return out, after


def start(data: bytes) -> tuple[str, int]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ImageError("CORRUPT", "no header")
    return order, struct.unpack_from(order + "I", data, 4)[0]


def tags(data: bytes) -> dict[int, tuple]:
    """Numeric values of the first directory."""
    order, at = start(data)
    forms = {1: "B", 3: "H", 4: "I", 9: "i"}
    return {t: struct.unpack_from(f"{order}{n}{forms[k]}", data, p) for t, k, n, p in directory(data, at, order)[0] if k in forms}


def strip_gps(data: bytes) -> bytes:
    """Without positions: the pointer leaves the directory and the bytes it led to are zero."""
    order, at = start(data)
    entries, _ = directory(data, at, order)
    found = [(i, p) for i, (t, _, _, p) in enumerate(entries) if t == GPS_IFD]
    out = bytearray(data)
    for i, place in reversed(found):
        (gps,) = struct.unpack_from(order + "I", data, place)
        inner, _ = directory(data, gps, order)
        for _, kind, count, p in inner:
            size = SIZES.get(kind, 1) * count
            out[p : p + size] = b"\0" * size
        out[gps : gps + 2 + 12 * len(inner) + 4] = b"\0" * (2 + 12 * len(inner) + 4)
        n = struct.unpack_from(order + "H", out, at)[0]
        end = at + 2 + 12 * n + 4
        tail = bytes(out[at + 2 + 12 * (i + 1) : end])
        out[at + 2 + 12 * i : at + 2 + 12 * i + len(tail)] = tail
        out[end - 12 : end] = b"\0" * 12
        struct.pack_into(order + "H", out, at, n - 1)
    return bytes(out)


def normalize(data: bytes) -> bytes:
    """With the orientation 1, as fits pixels that were turned already."""
    order, at = start(data)
    out = bytearray(data)
    for tag, kind, count, place in directory(data, at, order)[0]:
        if tag == ORIENTATION and kind == 3 and count == 1:
            struct.pack_into(order + "H", out, place, 1)
    return bytes(out)


def thumbnail(data: bytes) -> bytes | None:
    """The embedded preview of the second directory."""
    order, at = start(data)
    _, after = directory(data, at, order)
    if not after:
        return None
    where = {t: struct.unpack_from(order + "I", data, p)[0] for t, k, n, p in directory(data, after, order)[0] if k == 4 and n == 1}
    if THUMBNAIL not in where or THUMBNAIL_SIZE not in where or where[THUMBNAIL] + where[THUMBNAIL_SIZE] > len(data):
        return None
    return data[where[THUMBNAIL] : where[THUMBNAIL] + where[THUMBNAIL_SIZE]]


def edited(df: DataFrame, column: str, edit: str) -> DataFrame:
    """``df`` with the Exif bytes of ``column`` edited (STRIP_GPS or NORMALIZE_EXIF) and ``error_code``."""
    change = {"STRIP_GPS": strip_gps, "NORMALIZE_EXIF": normalize}[edit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, codes = [], []
            for v in batch.column(batch.schema.get_field_index(column)).to_pylist():
                try:
                    values.append(None if v is None else change(bytes(v)))
                    codes.append("OK")
                except ImageError as e:
                    values.append(v)
                    codes.append(e.code)
            cols = [pa.array(values, pa.binary()) if n == column else c for n, c in zip(batch.schema.names, batch.columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(codes, pa.string())], [*batch.schema.names, "error_code"])

    return df.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", error_code string")
