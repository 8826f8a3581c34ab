"""BMP: 1 to 32 bits a pixel, bit fields, run lengths, top-down, and payloads in PNG or JPEG."""

from __future__ import annotations

import struct

import numpy as np

from ...model import ImageError, Limits
from .base import Document, Item, Raster, guard, indexed, packed, unpacked

RGB, RLE8, RLE4, FIELDS, JPEG, PNG, ALPHA_FIELDS = range(7)


def matches(content: bytes) -> bool:
    return content[:2] == b"BM" and len(content) >= 18


def runs(data: bytes, width: int, height: int, half: bool) -> np.ndarray:
    """RLE8 or RLE4 to indices, rows from the bottom; places that deltas skip are 0."""
    out = np.zeros((height, width), np.uint8)
    x = y = at = 0

    def put(values: list[int]) -> None:
        nonlocal x
        for v in values:
            if x < width and y < height:
                out[y, x] = v
            x += 1

    nibbles = lambda b, n: [v for c in b for v in (c >> 4, c & 15)][:n]
    while at + 1 < len(data):
        n, v = data[at], data[at + 1]
        at += 2
        if n:
            put([(v >> 4, v & 15)[i & 1] for i in range(n)] if half else [v] * n)
        elif v == 0:
            x, y = 0, y + 1
        elif v == 1:
            break
        elif v == 2:
            if at + 2 > len(data):
                raise ImageError("CORRUPT", "a delta ends early")
            x, y = x + data[at], y + data[at + 1]
            at += 2
        else:
            size = (v + 1) // 2 if half else v
            body = data[at : at + size]
            put(nibbles(body, v) if half else list(body))
            at += size + (size & 1)
    return out


def channel(values: np.ndarray, mask: int) -> np.ndarray:
    if not mask:
        return np.zeros(values.shape, np.uint8)
    shift = (mask & -mask).bit_length() - 1
    top = mask >> shift
    v = (values & mask).astype(np.uint64) >> np.uint64(shift)
    return ((v * 255 + top // 2) // top).astype(np.uint8)


def dib(content: bytes, at: int, pixels: int | None, limits: Limits, icon: bool = False) -> tuple[np.ndarray, Document, int]:
    """The RGBA samples of a DIB whose header is at ``at``, facts about it, and where its pixels end."""
    (size,) = struct.unpack_from("<I", content, at)
    doc = Document([], "bmp")
    if size == 12:
        width, height, planes, bpp = struct.unpack_from("<HHHH", content, at + 4)
        compression = used = 0
        entry = 3
    elif size >= 40:
        width, height, planes, bpp, compression, _, xppm, yppm, used, _ = struct.unpack_from("<iiHHIIiiII", content, at + 4)
        if xppm > 0 and yppm > 0:
            doc.dpi = ((xppm * 127 + 2500) // 5000, (yppm * 127 + 2500) // 5000)
        entry = 4
    else:
        raise ImageError("UNSUPPORTED", "unknown header")
    down = height < 0
    height = abs(height)
    if icon:
        height //= 2
    guard(width, height, limits)
    table = at + size
    masks = (0x7C00, 0x3E0, 0x1F, 0) if bpp == 16 else (0xFF0000, 0xFF00, 0xFF, 0xFF000000 if icon else 0)
    if compression in (FIELDS, ALPHA_FIELDS):
        if size >= 52:
            masks = struct.unpack_from("<III", content, at + 40) + (struct.unpack_from("<I", content, at + 52) if size >= 56 else (0,))
        else:
            n = 4 if compression == ALPHA_FIELDS else 3
            masks = (struct.unpack_from(f"<{n}I", content, table) + (0,))[:4]
            table += 4 * n
    colours = None
    if bpp <= 8 and compression not in (JPEG, PNG):
        n = used or 1 << bpp
        n = min(n, 256)
        raw = np.frombuffer(content, np.uint8, n * entry, table).reshape(n, entry)
        colours = np.full((256, 4), (0, 0, 0, 255), np.uint8)
        colours[:n, :3] = raw[:, 2::-1]
        table += n * entry
    start = pixels if pixels is not None else table
    if compression in (JPEG, PNG):
        from . import jpeg, png

        inner = (png if compression == PNG else jpeg).load(content[start:], limits)
        return inner.items[0].raster.rgba8(), doc, len(content)
    if compression in (RLE8, RLE4):
        index = runs(content[start:], width, height, compression == RLE4)
        out, end = colours[index], len(content)
    else:
        stride = (width * bpp + 31) // 32 * 4
        end = start + stride * height
        if end > len(content):
            raise ImageError("CORRUPT", "the pixels end early")
        rows = np.frombuffer(content, np.uint8, stride * height, start).reshape(height, stride)
        if bpp in (1, 2, 4):
            out = colours[unpacked(rows, width, bpp)]
        elif bpp == 8:
            out = colours[rows[:, :width]]
        elif bpp == 24:
            bgr = rows[:, : width * 3].reshape(height, width, 3)
            out = np.concatenate((bgr[..., ::-1], np.full((height, width, 1), 255, np.uint8)), 2)
        elif bpp in (16, 32):
            values = np.ascontiguousarray(rows[:, : width * bpp // 8]).view(f"<u{bpp // 8}").astype(np.uint32)
            alpha = channel(values, masks[3]) if masks[3] else np.full(values.shape, 255, np.uint8)
            out = np.stack([channel(values, m) for m in masks[:3]] + [alpha], 2)
        else:
            raise ImageError("UNSUPPORTED", f"{bpp} bits a pixel")
    return np.ascontiguousarray(out if down else out[::-1]), doc, end


def load(content: bytes, limits: Limits) -> Document:
    (pixels,) = struct.unpack_from("<I", content, 10)
    samples, doc, _ = dib(content, 14, pixels, limits)
    doc.items.append(Item(Raster(samples)))
    return doc


def rle8(index: np.ndarray) -> bytes:
    """Run lengths of rows from the bottom."""
    out = bytearray()
    for row in index[::-1]:
        edges = np.flatnonzero(np.diff(row)) + 1
        starts = np.concatenate(([0], edges))
        for a, n in zip(starts.tolist(), np.diff(np.concatenate((starts, [len(row)]))).tolist()):
            while n:
                out += bytes((min(n, 255), row[a]))
                n -= min(n, 255)
        out += b"\0\0"
    out[-2:] = b"\0\1"
    return bytes(out)


def save(doc: Document, palette: str = "AUTO", rle: bool = False, top_down: bool = False) -> bytes:
    """32-bit with alpha, 24-bit without, or indexed where the colours fit and all are opaque; run lengths only where smaller."""
    rgba = doc.items[0].raster.rgba8()
    h, w, _ = rgba.shape
    opaque = (rgba[..., 3] == 255).all()
    table = indexed(rgba) if palette == "AUTO" and opaque else None
    compression, colours, masks = RGB, b"", b""
    if table is not None:
        entries, index = table
        bpp = 1 if len(entries) <= 2 else 4 if len(entries) <= 16 else 8
        rows = packed(index.astype(np.uint8), bpp) if bpp < 8 else index.astype(np.uint8)
        colours = np.hstack((entries[:, 2::-1], np.zeros((len(entries), 1), np.uint8))).tobytes()
    elif opaque:
        bpp, rows = 24, rgba[..., 2::-1].reshape(h, w * 3)
    else:
        bpp, rows = 32, rgba[..., [2, 1, 0, 3]].reshape(h, w * 4)
        compression, masks = FIELDS, struct.pack("<IIII", 0xFF0000, 0xFF00, 0xFF, 0xFF000000)
    rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4)))
    body = (rows if top_down else rows[::-1]).tobytes()
    if rle and bpp == 8 and not top_down and len(coded := rle8(index.astype(np.uint8))) < len(body):
        body, compression = coded, RLE8
    size = 108 if compression == FIELDS else 40
    ppm = [(d * 5000 + 63) // 127 for d in doc.dpi]
    header = struct.pack("<IiiHHIIiiII", size, w, -h if top_down else h, 1, bpp, compression, len(body), *ppm, len(colours) // 4, 0)
    header += (masks + b"BGRs" + b"\0" * 48) if size == 108 else b""
    start = 14 + size + len(colours)
    return b"BM" + struct.pack("<IHHI", start + len(body), 0, 0, start) + header + colours + body
