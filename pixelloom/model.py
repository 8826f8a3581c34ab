"""Data model: pixel formats, enumerations, limits and the relations that hold rasters.

A raster is a *pixel relation*, one row a pixel: ``doc_id, item_index`` name the raster, ``w, h`` repeat
its size, ``x, y`` place the pixel, and the channels (``r, g, b, a``; ``v``; ``c, m, ye, k``) are INT samples.
Carrying the size in each row makes every geometric operation a projection, without a join.
Codecs use the blob form instead: one row a raster with its samples in one BINARY, row-major and
interleaved, little-endian, without padding.
"""

from __future__ import annotations

from dataclasses import dataclass

KEYS = ["doc_id", "item_index"]
SIZE = ["w", "h"]
PLACE = ["x", "y"]
RGBA = ["r", "g", "b", "a"]
GRAY = ["v"]
CMYK = ["c", "m", "ye", "k"]

#: Largest sample of each integer depth.
MAX = {8: 255, 12: 4095, 16: 65535}

# Result codes, item roles, disposal and blend operations, metadata policies.
RESULTS = ("OK", "IO", "FORMAT", "UNSUPPORTED", "LIMIT", "CORRUPT", "OOM", "INTERNAL", "INVALID")
ROLES = ("IMAGE", "FRAME", "THUMBNAIL", "LEVEL", "ALTERNATE")
DISPOSE = ("NONE", "BACKGROUND", "PREVIOUS")
BLEND = ("SOURCE", "OVER")
POLICIES = ("PRESERVE_ALL", "DROP_ALL", "STRIP_GPS", "NORMALIZE_EXIF", "KEEP_RAW_ONLY", "KEEP_COMMON_ONLY")


@dataclass(frozen=True)
class Format:
    """A pixel format: channel model, sample type, number of channels and bits of each."""

    name: str
    model: str
    sample: str
    channels: int
    bits: int

    @property
    def bytes_per_pixel(self) -> int:
        return self.channels * (1 if self.bits == 8 else 4 if self.bits == 32 else 2)


FORMATS = {
    f.name: f
    for f in [
        *[Format(f"RGBA{b}", "RGBA", "UNORM", 4, b) for b in (8, 12, 16)], Format("RGBAF32", "RGBA", "FLOAT", 4, 32),
        *[Format(f"GRAY{b}", "GRAY", "UNORM", 1, b) for b in (8, 12, 16)], Format("GRAYF32", "GRAY", "FLOAT", 1, 32),
        *[Format(f"CMYK{b}", "CMYK", "UNORM", 4, b) for b in (8, 12, 16)],
    ]
}


@dataclass(frozen=True)
class Limits:
    """Caps on decoding; None lifts one."""

    max_decoded_pixels: int | None = 1 << 28
    max_memory: int | None = 1 << 31
    max_metadata_size: int | None = 4 << 20
    max_frame_count: int | None = 65536
    max_chunk_size: int | None = 1 << 30


class ImageError(Exception):
    """A data error with a result code; kernels turn it into a column and never let it fail a job."""

    def __init__(self, code: str, why: str = "") -> None:
        super().__init__(f"{code}: {why}" if why else code)
        self.code = code
