"""GIF 87a and 89a, stills and animations."""

from __future__ import annotations

import struct

import numpy as np

from ...model import ImageError, Limits
from .base import Document, Item, Raster, Reader, guard, indexed, lzw_bits, lzw_pack

PASSES = [(0, 8), (4, 8), (2, 4), (1, 2)]


def matches(content: bytes) -> bool:
    return content[:6] in (b"GIF87a", b"GIF89a")


def order(height: int) -> np.ndarray:
    """Picture rows in the order of an interlaced file."""
    return np.concatenate([np.arange(y0, height, dy) for y0, dy in PASSES])


def blocks(r: Reader) -> bytes:
    out = bytearray()
    while n := r.one("B"):
        out += r.take(n)
    return bytes(out)


def load(content: bytes, limits: Limits) -> Document:
    r = Reader(content)
    r.take(6)
    width, height, flags, back, _ = r.read("HHBBB")
    guard(width, height, limits)
    colours = lambda f: np.frombuffer(r.take(3 << ((f & 7) + 1)), np.uint8).reshape(-1, 3)
    shared = colours(flags) if flags & 0x80 else None
    doc = Document([], "gif")
    if shared is not None and back < len(shared):
        doc.background = (*map(int, shared[back]), 255)
    canvas = np.zeros((height, width, 4), np.uint8)
    control = (0, 0, None)
    while True:
        try:
            kind = r.one("B")
            if kind == 0x3B:
                break
            if kind == 0x21:
                label = r.one("B")
                body = blocks(r)
                if label == 0xF9 and len(body) >= 4:
                    control = (body[0] >> 2 & 7, struct.unpack_from("<H", body, 1)[0], body[3] if body[0] & 1 else None)
                elif label == 0xFF and body[:11] == b"NETSCAPE2.0" and len(body) >= 14:
                    doc.loop_count = struct.unpack_from("<H", body, 12)[0]
                elif label == 0xFE:
                    doc.description = doc.description or body.decode("latin-1")
                continue
            if kind != 0x2C:
                raise ImageError("CORRUPT", "unknown block")
            left, top, w, h, f = r.read("HHHHB")
            table = colours(f) if f & 0x80 else shared
            start = r.one("B")
            data = blocks(r)
        except ImageError:
            if doc.items:  # what was read before the end stays
                break
            raise
        if limits.max_frame_count is not None and len(doc.items) >= limits.max_frame_count:
            raise ImageError("LIMIT", "too many frames")
        if not 2 <= start <= 8 or table is None or w == 0 or h == 0:
            raise ImageError("CORRUPT", "unusable frame")
        guard(w, h, limits)
        index = np.frombuffer(lzw_bits(data, start, False, 0), np.uint8)
        if len(index) < w * h:
            raise ImageError("CORRUPT", "not enough pixels")
        index = index[: w * h].reshape(h, w)
        if f & 0x40:
            rows = np.empty_like(index)
            rows[order(h)] = index
            index = rows
        disposal, delay, clear = control
        before = canvas.copy() if disposal == 3 else None
        y1, x1 = min(height, top + h), min(width, left + w)
        if y1 > top and x1 > left:
            part = index[: y1 - top, : x1 - left]
            draws = part < len(table)
            if clear is not None:
                draws &= part != clear
            rgba = np.concatenate((table[np.minimum(part, len(table) - 1)], np.full(part.shape + (1,), 255, np.uint8)), 2)
            box = canvas[top:y1, left:x1]
            box[draws] = rgba[draws]
        doc.items.append(Item(Raster(canvas.copy()), "FRAME" if doc.items else "IMAGE", len(doc.items), (delay, 100), {2: 1, 3: 2}.get(disposal, 0), 1))
        if disposal == 2:
            canvas[top:y1, left:x1] = 0
        elif disposal == 3:
            canvas = before
        control = (0, 0, None)
    if not doc.items:
        raise ImageError("CORRUPT", "no frame")
    if len(doc.items) > 1:
        doc.items[0].role = "FRAME"
    return doc


def plan(canvases: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
    """``(left, top, width, height, disposal)`` of each frame: what has to be drawn on what is there before.

    A frame that makes visible pixels clear needs an empty canvas, so the one before it is drawn whole and
    cleared after (2); every other is the box of what changed, and stays (1). No change is one pixel.
    """
    h, w, _ = canvases[0].shape
    seen = [c[..., 3] > 0 for c in canvases]
    erases = [False] + [bool((a & ~b).any()) for a, b in zip(seen, seen[1:])] + [False]
    out = []
    base = np.zeros_like(canvases[0])
    for k, c in enumerate(canvases):
        if erases[k + 1]:
            out.append((0, 0, w, h, 2))
            base = np.zeros_like(c)
            continue
        y, x = np.nonzero((c != base).any(2))
        box = (int(x.min()), int(y.min()), int(x.max() - x.min()) + 1, int(y.max() - y.min()) + 1) if len(x) else (0, 0, 1, 1)
        out.append((*box, 1 if len(canvases) > 1 else 0))
        base = c
    return out


def save(doc: Document, interlace: bool = False, alpha_threshold: int = 128, loop_count: int | None = None) -> bytes:
    """Frames cut to what changes, each with its own table; more than 256 colours in one are refused."""
    canvases = []
    for item in doc.items:
        rgba = item.raster.rgba8().copy()
        if canvases and rgba.shape != canvases[0].shape:
            raise ImageError("UNSUPPORTED", "frames of different sizes")
        seen = rgba[..., 3] >= alpha_threshold
        rgba[~seen] = 0
        rgba[seen, 3] = 255
        canvases.append(rgba)
    h, w, _ = canvases[0].shape
    out = b"GIF89a" + struct.pack("<HHBBB", w, h, 0, 0, 0)
    loops = doc.loop_count if loop_count is None else loop_count
    if len(canvases) > 1 and loops is not None:
        out += b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", loops) + b"\0"
    if doc.description:
        text = doc.description.encode("latin-1", "replace")
        out += b"\x21\xfe" + b"".join(bytes([len(text[a : a + 255])]) + text[a : a + 255] for a in range(0, len(text), 255)) + b"\0"
    boxes = plan(canvases) if len(canvases) > 1 else [(0, 0, w, h, 0)]
    for item, canvas, (left, top, bw, bh, disposal) in zip(doc.items, canvases, boxes):
        table = indexed(canvas[top : top + bh, left : left + bw])
        if table is None:
            raise ImageError("UNSUPPORTED", "more than 256 colours; quantize first")
        colours, index = table
        bits = max(1, (len(colours) - 1).bit_length())
        clear = np.flatnonzero(colours[:, 3] == 0)
        num, den = item.delay
        out += b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (1 if len(clear) else 0), min(65535, num * 100 // (den or 100)), int(clear[0]) if len(clear) else 0) + b"\0"
        out += b"\x2c" + struct.pack("<HHHHB", left, top, bw, bh, 0x80 | (0x40 if interlace else 0) | (bits - 1))
        out += np.pad(colours[:, :3], ((0, (1 << bits) - len(colours)), (0, 0))).tobytes()
        rows = index[order(bh)] if interlace else index
        start = max(2, bits)
        data = lzw_pack(rows.astype(np.uint8).tobytes(), start, False, 0)
        out += bytes([start]) + b"".join(bytes([len(data[a : a + 255])]) + data[a : a + 255] for a in range(0, len(data), 255)) + b"\0"
    return out + b"\x3b"
