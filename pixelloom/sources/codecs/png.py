"""PNG and APNG."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from ...model import ImageError, Limits
from .base import Document, Item, Raster, exif_orientation, guard, indexed, packed, unpacked

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def matches(content: bytes) -> bool:
    return content.startswith(SIGNATURE)


def chunks(content: bytes, limits: Limits) -> list[tuple[bytes, bytes]]:
    at, out = len(SIGNATURE), []
    while at + 12 <= len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        if limits.max_chunk_size is not None and size > limits.max_chunk_size:
            raise ImageError("LIMIT", "chunk too large")
        body = content[at + 8 : at + 8 + size]
        if len(body) < size or at + 12 + size > len(content):
            raise ImageError("CORRUPT", "a chunk ends early")
        if zlib.crc32(kind + body) != struct.unpack_from(">I", content, at + 8 + size)[0]:
            raise ImageError("CORRUPT", f"bad CRC in {kind!r}")
        out.append((kind, body))
        at += 12 + size
        if kind == b"IEND":
            return out
    raise ImageError("CORRUPT", "no IEND")


def unfilter(raw: bytes, height: int, stride: int, lag: int) -> np.ndarray:
    """Rows of bytes from filtered ones."""
    if len(raw) < height * (stride + 1):
        raise ImageError("CORRUPT", "not enough pixel data")
    rows = np.frombuffer(raw, np.uint8, height * (stride + 1)).reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    pad = -stride % lag
    for y in range(height):
        kind, row = rows[y, 0], rows[y, 1:]
        if kind == 0:
            out[y] = row
        elif kind == 1:
            lanes = np.pad(row, (0, pad)).reshape(-1, lag)
            out[y] = np.cumsum(lanes, 0, dtype=np.uint8).reshape(-1)[:stride]
        elif kind == 2:
            out[y] = row + above
        elif kind in (3, 4):
            left = [0] * lag
            corner = [0] * lag
            line = []
            for i, (v, b) in enumerate(zip(row.tolist(), above.tolist())):
                k = i % lag
                a, c = left[k], corner[k]
                if kind == 3:
                    p = (a + b) >> 1
                else:
                    e = a + b - c
                    pa, pb, pc = abs(e - a), abs(e - b), abs(e - c)
                    p = a if pa <= pb and pa <= pc else b if pb <= pc else c
                v = (v + p) & 255
                left[k], corner[k] = v, b
                line.append(v)
            out[y] = line
        else:
            raise ImageError("CORRUPT", "unknown filter")
        above = out[y]
    return out


def samples(rows: np.ndarray, width: int, depth: int, channels: int) -> np.ndarray:
    if depth < 8:
        return unpacked(rows, width * channels, depth).reshape(len(rows), width, channels)
    if depth == 8:
        return rows.reshape(len(rows), width, channels)
    return rows.reshape(len(rows), width, channels, 2).copy().view(">u2")[..., 0].astype(np.uint16)


def raster(data: bytes, width: int, height: int, depth: int, color: int, interlaced: bool, palette: np.ndarray | None, clear: bytes | None) -> Raster:
    n = CHANNELS[color]
    lag = max(1, n * depth // 8)
    full = np.zeros((height, width, n), np.uint16 if depth == 16 else np.uint8)
    at = 0
    for x0, y0, dx, dy in PASSES if interlaced else [(0, 0, 1, 1)]:
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w <= 0 or h <= 0:
            continue
        stride = (w * n * depth + 7) // 8
        full[y0::dy, x0::dx] = samples(unfilter(data[at:], h, stride, lag), w, depth, n)
        at += h * (stride + 1)
    top = 65535 if depth == 16 else 255
    if color == 3:
        if palette is None:
            raise ImageError("CORRUPT", "no palette")
        if full.max(initial=0) >= len(palette):
            raise ImageError("CORRUPT", "an index is past the palette")
        return Raster(palette[full[..., 0]])
    key = np.array(struct.unpack(f">{n}H", clear[: 2 * n]), np.uint16) if clear and color in (0, 2) else None
    alpha = np.where((full == key).all(2), 0, top) if key is not None else None
    if depth < 8:
        full = (full.astype(np.uint32) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    if color == 0 and key is None:
        return Raster(full, "GRAY")
    if color == 6:
        return Raster(full)
    gray = color in (0, 4)
    rgb = np.repeat(full[..., :1], 3, 2) if gray else full[..., :3]
    a = full[..., 1] if color == 4 else alpha if alpha is not None else np.full(full.shape[:2], top)
    return Raster(np.concatenate((rgb, a[..., None].astype(full.dtype)), 2))


def over(canvas: np.ndarray, patch: np.ndarray) -> np.ndarray:
    """APNG OVER, rounded down."""
    top = 65535 if canvas.dtype == np.uint16 else 255
    s, d = patch.astype(np.uint64), canvas.astype(np.uint64)
    sa, da = s[..., 3:], d[..., 3:]
    ao = sa * top + da * (top - sa)
    c = (s[..., :3] * sa * top + d[..., :3] * da * (top - sa)) // np.maximum(ao, 1)
    out = np.concatenate((c, ao // top), 2)
    return np.where(sa == top, s, np.where(sa == 0, d, out)).astype(canvas.dtype)


def load(content: bytes, limits: Limits) -> Document:
    found = chunks(content, limits)
    if found[0][0] != b"IHDR" or len(found[0][1]) != 13:
        raise ImageError("CORRUPT", "no IHDR")
    width, height, depth, color, compression, method, interlace = struct.unpack(">IIBBBBB", found[0][1])
    if color not in CHANNELS or depth not in DEPTHS[color] or compression or method or interlace > 1:
        raise ImageError("CORRUPT", "unknown header values")
    guard(width, height, limits, 4, 2 if depth == 16 else 1)
    palette = clear = None
    doc = Document([], "png")
    first: list[bytes] = []
    frames: list[dict] = []
    current = None
    for kind, body in found[1:]:
        if kind == b"PLTE":
            palette = np.concatenate((np.frombuffer(body, np.uint8).reshape(-1, 3), np.full((len(body) // 3, 1), 255, np.uint8)), 1)
        elif kind == b"tRNS":
            clear = body
            if color == 3 and palette is not None:
                palette = palette.copy()
                palette[: len(body), 3] = np.frombuffer(body, np.uint8)[: len(palette)]
        elif kind == b"acTL":
            doc.loop_count = struct.unpack(">II", body)[1]
        elif kind == b"fcTL":
            _, w, h, x, y, num, den, dispose, blend = struct.unpack(">IIIIIHHBB", body)
            if w == 0 or h == 0 or x + w > width or y + h > height or dispose > 2 or blend > 1:
                raise ImageError("CORRUPT", "a frame is not inside the canvas")
            current = {"w": w, "h": h, "x": x, "y": y, "delay": (num, den), "dispose": dispose, "blend": blend, "data": []}
            frames.append(current)
            if limits.max_frame_count is not None and len(frames) > limits.max_frame_count:
                raise ImageError("LIMIT", "too many frames")
        elif kind == b"IDAT":
            first.append(body)
            if current is not None:
                current["data"].append(body)
        elif kind == b"fdAT" and current is not None:
            current["data"].append(body[4:])
        elif kind == b"pHYs":
            px, py, unit = struct.unpack(">IIB", body)
            if unit == 1:
                doc.dpi = ((px * 127 + 2500) // 5000, (py * 127 + 2500) // 5000)
        elif kind == b"iCCP":
            name, _, rest = body.partition(b"\0")
            doc.icc = zlib.decompress(rest[1:])
        elif kind == b"eXIf":
            doc.metadata.append(("png", "eXIf", body))
            doc.orientation = exif_orientation(body)
        elif kind == b"tEXt":
            key, _, text = body.partition(b"\0")
            doc.metadata.append(("png", "tEXt", body))
            if key == b"Description":
                doc.description = text.decode("latin-1")
        elif kind not in (b"IEND",):
            doc.metadata.append(("png", kind.decode("latin-1"), body))

    def decode(parts: list[bytes], w: int, h: int) -> Raster:
        try:
            data = zlib.decompressobj().decompress(b"".join(parts), (h + 8) * (w * 8 + 9) + 64)
        except zlib.error as e:
            raise ImageError("CORRUPT", str(e)) from e
        return raster(data, w, h, depth, color, bool(interlace), palette, clear)

    if not first:
        raise ImageError("CORRUPT", "no pixels")
    if not frames:
        doc.items.append(Item(decode(first, width, height)))
        return doc
    canvas = None
    last = None
    for f in frames:
        if not f["data"]:
            raise ImageError("CORRUPT", "a frame without pixels")
        own = decode(f["data"], f["w"], f["h"])
        patch = own.samples if own.model == "RGBA" else np.concatenate((np.repeat(own.samples, 3, 2), np.full_like(own.samples, 65535 if own.bits == 16 else 255)), 2)
        if canvas is None:
            canvas = np.zeros((height, width, 4), patch.dtype)
            if f["dispose"] == 2:
                f["dispose"] = 1
        elif last is not None:
            box = np.s_[last["y"] : last["y"] + last["h"], last["x"] : last["x"] + last["w"]]
            if last["dispose"] == 1:
                canvas[box] = 0
            elif last["dispose"] == 2:
                canvas[box] = last["saved"]
        box = np.s_[f["y"] : f["y"] + f["h"], f["x"] : f["x"] + f["w"]]
        f["saved"] = canvas[box].copy()
        canvas[box] = over(canvas[box], patch) if f["blend"] else patch
        doc.items.append(Item(Raster(canvas.copy()), "FRAME", len(doc.items), f["delay"], f["dispose"], f["blend"]))
        last = f
    return doc


def filtered(rows: np.ndarray, lag: int, choice: str = "ADAPTIVE") -> bytes:
    """Filtered rows, each by the filter of the least sum of signed residuals, or all by one."""
    h, n = rows.shape
    v = rows.astype(np.int16)
    up = np.vstack((np.zeros((1, n), np.int16), v[:-1]))
    left = np.hstack((np.zeros((h, lag), np.int16), v[:, :-lag])) if n > lag else np.zeros_like(v)
    corner = np.hstack((np.zeros((h, lag), np.int16), up[:, :-lag])) if n > lag else np.zeros_like(v)
    e = left + up - corner
    pa, pb, pc = abs(e - left), abs(e - up), abs(e - corner)
    paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))
    tried = np.stack([(v - p).astype(np.uint8) for p in (np.zeros_like(v), left, up, (left + up) >> 1, paeth)])
    kinds = {"NONE": 0, "SUB": 1, "UP": 2, "AVERAGE": 3, "PAETH": 4}
    if choice in kinds:
        best = np.full(h, kinds[choice])
    else:
        best = np.where(tried < 128, tried, 256 - tried.astype(np.int32)).sum(2).argmin(0)
    return np.hstack((best[:, None].astype(np.uint8), tried[best, np.arange(h)])).tobytes()


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def rows_of(s: np.ndarray, depth: int) -> np.ndarray:
    h, w, n = s.shape
    if depth < 8:
        return packed(s.reshape(h, w * n), depth)
    if depth == 16:
        return s.astype(">u2").view(np.uint8).reshape(h, w * n * 2)
    return s.reshape(h, w * n)


def compressed(s: np.ndarray, depth: int, interlaced: bool, choice: str, level: int) -> bytes:
    n = s.shape[2]
    lag = max(1, n * depth // 8)
    parts = []
    for x0, y0, dx, dy in PASSES if interlaced else [(0, 0, 1, 1)]:
        part = s[y0::dy, x0::dx]
        if part.size:
            parts.append(filtered(rows_of(part, depth), lag, choice))
    return zlib.compress(b"".join(parts), level)


def save(doc: Document, interlaced: bool = False, filter: str = "ADAPTIVE", palette: str = "AUTO", level: int = 6) -> bytes:
    """A PNG, or an APNG of several items of one size. ``palette`` is AUTO (if 8-bit colours fit, and it is a still), or NEVER."""
    first = doc.items[0].raster
    same = all(i.raster.samples.shape == first.samples.shape and i.raster.model == first.model for i in doc.items)
    frames = doc.items if len(doc.items) > 1 and same and all(i.role == "FRAME" for i in doc.items) else doc.items[:1]
    if first.model == "CMYK":
        first = Raster(first.rgba8())
    depth, extra = first.bits, b""
    table = indexed(first.samples) if first.model == "RGBA" and depth == 8 and palette == "AUTO" and len(frames) == 1 else None
    if table is not None:
        colours, index = table
        depth = 1 if len(colours) <= 2 else 2 if len(colours) <= 4 else 4 if len(colours) <= 16 else 8
        color = 3
        extra = chunk(b"PLTE", colours[:, :3].tobytes())
        if (colours[:, 3] < 255).any():
            extra += chunk(b"tRNS", colours[:, 3].tobytes())
        stills = [index[..., None].astype(np.uint8)]
    else:
        color = 0 if first.model == "GRAY" else 6
        stills = [f.raster.samples if f.raster.model != "CMYK" else f.raster.rgba8() for f in frames]
    out = SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", first.width, first.height, depth, color, 0, 0, int(interlaced)))
    if len(frames) > 1:
        out += chunk(b"acTL", struct.pack(">II", len(frames), doc.loop_count or 0))
    if doc.icc:
        out += chunk(b"iCCP", b"icc\0\0" + zlib.compress(doc.icc))
    if doc.dpi != (0, 0):
        out += chunk(b"pHYs", struct.pack(">IIB", *[(d * 5000 + 63) // 127 for d in doc.dpi], 1))
    if doc.description is not None:
        out += chunk(b"tEXt", b"Description\0" + doc.description.encode("latin-1", "replace"))
    out += extra
    number = 0
    for k, (f, s) in enumerate(zip(frames, stills)):
        data = compressed(s, depth, interlaced, filter, level)
        if len(frames) > 1:
            out += chunk(b"fcTL", struct.pack(">IIIIIHHBB", number, first.width, first.height, 0, 0, *f.delay, 0, 0))
            number += 1
        if k == 0:
            out += chunk(b"IDAT", data)
        else:
            out += chunk(b"fdAT", struct.pack(">I", number) + data)
            number += 1
    return out + chunk(b"IEND", b"")
