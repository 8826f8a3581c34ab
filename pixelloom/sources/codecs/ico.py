"""Icons and cursors with DIB and PNG payloads."""

from __future__ import annotations

import struct

import numpy as np

from ...model import ImageError, Limits
from . import bmp, png
from .base import Document, Item, Raster, packed, unpacked

MOST = 64


def matches(content: bytes) -> bool:
    if len(content) < 22:
        return False
    reserved, kind, count = struct.unpack_from("<HHH", content)
    size, offset = struct.unpack_from("<II", content, 14)
    return reserved == 0 and kind in (1, 2) and 1 <= count <= MOST and size > 0 and offset >= 6 + 16 * count


def load(content: bytes, limits: Limits) -> Document:
    _, kind, count = struct.unpack_from("<HHH", content)
    doc = Document([], "ico" if kind == 1 else "cur")
    for k in range(count):
        w, h, _, _, a, b, size, offset = struct.unpack_from("<BBBBHHII", content, 6 + 16 * k)
        body = content[offset : offset + size]
        if len(body) < size or size < 12:
            raise ImageError("CORRUPT", "an entry is past the end")
        if png.matches(body):
            samples = png.load(body, limits).items[0].raster.rgba8()
        else:
            samples, _, end = bmp.dib(body, 0, None, limits, icon=True)
            height, width, _ = samples.shape
            stride = (width + 31) // 32 * 4
            bpp = struct.unpack_from("<H", body, 14)[0] if len(body) >= 16 else 0
            mask = np.frombuffer(body, np.uint8, min(stride * height, max(0, len(body) - end)), end) if end < len(body) else np.zeros(0, np.uint8)
            if len(mask) == stride * height:
                clear = unpacked(mask.reshape(height, stride), width, 1)[::-1] == 1
                if bpp < 32 or not samples[..., 3].any():
                    samples[..., 3] = 255
                    samples[clear, 3] = 0
        doc.items.append(Item(Raster(samples), "ALTERNATE" if k else "IMAGE", 0, hotspot=(a, b) if kind == 2 else (0, 0)))
    return doc


def save(doc: Document, payload: str = "AUTO", cursor: bool = False) -> bytes:
    """``payload`` is PNG, DIB, or AUTO: PNG from 256 pixels on."""
    if len(doc.items) > MOST:
        raise ImageError("LIMIT", "too many entries")
    bodies, entries = [], []
    offset = 6 + 16 * len(doc.items)
    for item in doc.items:
        rgba = item.raster.rgba8()
        h, w, _ = rgba.shape
        if w > 256 or h > 256:
            raise ImageError("UNSUPPORTED", "larger than 256 pixels")
        if payload == "PNG" or payload == "AUTO" and max(w, h) >= 256:
            body = png.save(Document([Item(Raster(rgba))]), palette="NEVER")
        else:
            mask = np.pad(packed((rgba[..., 3] == 0).astype(np.uint8), 1), ((0, 0), (0, -((w + 7) // 8) % 4)))
            body = struct.pack("<IiiHHIIiiII", 40, w, 2 * h, 1, 32, 0, 0, 0, 0, 0, 0) + rgba[::-1, :, [2, 1, 0, 3]].tobytes() + mask[::-1].tobytes()
        x, y = item.hotspot if cursor else (1, 32)
        entries.append(struct.pack("<BBBBHHII", w % 256, h % 256, 0, 0, x, y, len(body), offset))
        bodies.append(body)
        offset += len(body)
    return struct.pack("<HHH", 0, 2 if cursor else 1, len(doc.items)) + b"".join(entries) + b"".join(bodies)
