"""TIFF and BigTIFF: strips and tiles, gray, RGB, palette, CMYK and YCbCr, pages and reduced levels."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from ...model import ImageError, Limits
from .base import Document, Item, Raster, guard, lzw_bits, lzw_pack, pack_packbits, packbits, unpacked

SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
FORMS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
MAGICS = (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+")
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946


def matches(content: bytes) -> bool:
    return content[:4] in MAGICS


class Directory(dict):
    """Tags to tuples of values."""

    def one(self, tag: int, default: int | None = None) -> int:
        if tag in self and len(self[tag]):
            return self[tag][0]
        if default is None:
            raise ImageError("CORRUPT", f"tag {tag} is missing")
        return default


def directories(content: bytes, limits: Limits) -> tuple[str, list[Directory]]:
    order = "<" if content[:2] == b"II" else ">"
    big = content[2:4] in (b"+\0", b"\0+")
    n_form, entry, inline, p = ("Q", 20, 8, "Q") if big else ("H", 12, 4, "I")
    (at,) = struct.unpack_from(order + p, content, 8 if big else 4)
    out, seen = [], set()
    while at:
        if at in seen or at + struct.calcsize(order + n_form) > len(content):
            raise ImageError("CORRUPT", "bad directory chain")
        seen.add(at)
        (n,) = struct.unpack_from(order + n_form, content, at)
        at += struct.calcsize(order + n_form)
        found = Directory()
        for k in range(n):
            tag, kind = struct.unpack_from(order + "HH", content, at + k * entry)
            (count,) = struct.unpack_from(order + p, content, at + k * entry + 4)
            size = SIZES.get(kind, 1) * count
            place = at + k * entry + 4 + struct.calcsize(p)
            if size > inline:
                (place,) = struct.unpack_from(order + p, content, place)
            if place + size > len(content):
                raise ImageError("CORRUPT", "a value is past the end")
            if kind in FORMS:
                found[tag] = struct.unpack_from(f"{order}{count}{FORMS[kind]}", content, place)
            elif kind in (5, 10):
                v = struct.unpack_from(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", content, place)
                found[tag] = tuple(zip(v[::2], v[1::2]))
            else:
                found[tag] = (content[place : place + size],)
        out.append(found)
        if limits.max_frame_count is not None and len(out) > limits.max_frame_count:
            raise ImageError("LIMIT", "too many directories")
        (at,) = struct.unpack_from(order + p, content, at + n * entry)
    return order, out


def inflate(data: bytes, compression: int, need: int) -> bytes:
    if compression == NONE:
        return data
    if compression == LZW:
        return lzw_bits(data, 8, True, 1)
    if compression == PACKBITS:
        return packbits(data)
    if compression in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, need)
        except zlib.error as e:
            raise ImageError("CORRUPT", str(e)) from e
    raise ImageError("UNSUPPORTED", f"compression {compression}")


def block(data: bytes, w: int, h: int, n: int, bits: int, order: str, predictor: int, compression: int) -> np.ndarray:
    """Samples ``(h, w, n)`` of one strip or tile."""
    stride = (w * n * bits + 7) // 8
    raw = inflate(data, compression, stride * h)
    if len(raw) < stride * h:
        raise ImageError("CORRUPT", "not enough pixel data")
    rows = np.frombuffer(raw, np.uint8, stride * h).reshape(h, stride)
    if bits < 8:
        s = unpacked(rows, w * n, bits).reshape(h, w, n)
    elif bits == 8:
        s = rows.reshape(h, w, n)
    else:
        s = rows.reshape(-1).view(order + f"u{bits // 8}").reshape(h, w, n).astype(f"u{bits // 8}")
    if predictor == 2:
        s = np.cumsum(s, 1, dtype=s.dtype)
    return s


def page(content: bytes, order: str, d: Directory, limits: Limits) -> Raster:
    width, height = d.one(256), d.one(257)
    bits, n = d.one(258, 1), d.one(277, 1)
    photo, compression, predictor = d.one(262, 1), d.one(259, 1), d.one(317, 1)
    guard(width, height, limits, max(4, n), 2 if bits > 8 else 1)
    if bits not in (1, 2, 4, 8, 16, 32) or d.one(339, 1) != 1 or predictor not in (1, 2):
        raise ImageError("UNSUPPORTED", "sample format")
    planar = d.one(284, 1) == 2
    out = np.zeros((height, width, n), np.uint8 if bits <= 8 else f"u{bits // 8}")
    if 322 in d:
        tw, th = d.one(322), d.one(323)
        places, sizes = d[324], d[325]
        spots = [(x, y) for y in range(0, height, th) for x in range(0, width, tw)]
    else:
        tw, th = width, min(height, d.one(278, height))
        places, sizes = d[273], d.get(279, (len(content),))
        spots = [(0, y) for y in range(0, height, th)]
    guard(tw, th, limits, max(4, n), 2 if bits > 8 else 1)
    for plane in range(n if planar else 1):
        for k, (x, y) in enumerate(spots):
            i = plane * len(spots) + k
            if i >= len(places) or i >= len(sizes):
                raise ImageError("CORRUPT", "blocks are missing")
            h = th if 322 in d else min(th, height - y)
            s = block(content[places[i] : places[i] + sizes[i]], tw, h, 1 if planar else n, bits, order, predictor, compression)
            s = s[: height - y, : width - x]
            if planar:
                out[y : y + s.shape[0], x : x + s.shape[1], plane] = s[..., 0]
            else:
                out[y : y + s.shape[0], x : x + s.shape[1]] = s
    top = (1 << bits) - 1
    if photo == 3:
        table = np.array(d[320], np.uint32).reshape(3, -1).T
        rgb = (table[out[..., 0]] >> 8).astype(np.uint8)
        return Raster(np.concatenate((rgb, np.full(rgb.shape[:2] + (1,), 255, np.uint8)), 2))
    if bits < 8:
        out = (out.astype(np.uint32) * 255 // top).astype(np.uint8)
    elif bits == 32:
        out = (out >> 16).astype(np.uint16)
    most = 255 if out.dtype == np.uint8 else 65535
    extra = d.get(338, ())
    if photo in (0, 1):
        gray = out[..., :1] if photo == 1 else most - out[..., :1]
        if n == 1:
            return Raster(np.ascontiguousarray(gray), "GRAY")
        out, n = np.concatenate((np.repeat(gray, 3, 2), out[..., 1:]), 2), n + 2
    elif photo == 5:
        return Raster(np.ascontiguousarray(out[..., :4]), "CMYK")
    elif photo == 6:
        if d.get(530, (2, 2)) != (1, 1) and compression != 7:
            raise ImageError("UNSUPPORTED", "subsampled YCbCr")
        y, cb, cr = (out[..., k].astype(np.int64) - (128 if k else 0) for k in range(3))
        rgb = [y + ((91881 * cr + 32768) >> 16), y + ((-22554 * cb - 46802 * cr + 32768) >> 16), y + ((116130 * cb + 32768) >> 16)]
        out = np.stack([np.clip(c, 0, 255) for c in rgb], 2).astype(np.uint8)
        n = 3
    elif photo != 2:
        raise ImageError("UNSUPPORTED", f"photometric {photo}")
    alpha = out[..., 3:4] if n >= 4 and extra else np.full(out.shape[:2] + (1,), most, out.dtype)
    rgb = out[..., :3]
    if n >= 4 and extra and extra[0] == 1:  # associated: divide it out
        a = alpha.astype(np.uint64)
        rgb = np.where(a == 0, 0, np.minimum(most, (rgb.astype(np.uint64) * most + a // 2) // np.maximum(a, 1))).astype(out.dtype)
    return Raster(np.concatenate((rgb, alpha), 2))


def load(content: bytes, limits: Limits) -> Document:
    order, found = directories(content, limits)
    if not found:
        raise ImageError("CORRUPT", "no directory")
    doc = Document([], "tiff")
    main = 0
    for k, d in enumerate(found):
        role = "LEVEL" if d.one(254, 0) & 1 else "IMAGE"
        if role == "IMAGE":
            main = k
        try:
            doc.items.append(Item(page(content, order, d, limits), role, main if role == "LEVEL" else k))
        except ImageError:
            if not doc.items:
                raise
            break  # pages before a damaged one stay
    d = found[0]
    doc.orientation = d.one(274, 1)
    if d.one(296, 2) == 2 and 282 in d and 283 in d:
        doc.dpi = tuple(a // b if b else 0 for a, b in (d[282][0], d[283][0]))
    if 270 in d:
        doc.description = d[270][0].split(b"\0")[0].decode("utf-8", "replace")
    if 34675 in d:
        doc.icc = bytes(d[34675]) if isinstance(d[34675][0], int) else d[34675][0]
    return doc


def save(doc: Document, compression: str = "DEFLATE", predictor: bool = True, big_endian: bool = False, bigtiff: bool = False, rows_per_strip: int | None = None) -> bytes:
    """One directory an item; gray, RGBA (unassociated) or CMYK in 8 or 16 bits."""
    order = ">" if big_endian else "<"
    pack = {"NONE": lambda b: b, "LZW": lambda b: lzw_pack(b, 8, True, 1), "DEFLATE": zlib.compress, "PACKBITS": pack_packbits}[compression]
    code = {"NONE": NONE, "LZW": LZW, "DEFLATE": DEFLATE, "PACKBITS": PACKBITS}[compression]
    predict = predictor and compression in ("LZW", "DEFLATE")
    p, head = ("Q", 16) if bigtiff else ("I", 8)
    out = bytearray(b"MM" if big_endian else b"II")
    out += struct.pack(order + "HHHQ", 43, 8, 0, head) if bigtiff else struct.pack(order + "HI", 42, head)
    link = len(out) - struct.calcsize(p)
    for item in doc.items:
        s = item.raster.samples
        h, w, n = s.shape
        if predict:
            s = np.concatenate((s[:, :1], s[:, 1:] - s[:, :-1]), 1)
        rows = rows_per_strip or max(1, (1 << 16) // (w * n * s.dtype.itemsize))
        strips = [pack(s[y : y + rows].astype(s.dtype.newbyteorder(order)).tobytes()) for y in range(0, h, rows)]
        places = []
        for x in strips:
            out += b"\0" * (len(out) & 1)
            places.append(len(out))
            out += x
        model = item.raster.model
        long = 16 if bigtiff else 4
        tags = [
            (254, 4, [1 if item.role == "LEVEL" else 0]), (256, 4, [w]), (257, 4, [h]), (258, 3, [item.raster.bits] * n), (259, 3, [code]),
            (262, 3, [{"GRAY": 1, "RGBA": 2, "CMYK": 5}[model]]), (273, long, places), (277, 3, [n]), (278, 4, [rows]), (279, long, [len(x) for x in strips]), (284, 3, [1]),
        ]
        if doc.dpi != (0, 0):
            tags += [(282, 5, [doc.dpi[0], 1]), (283, 5, [doc.dpi[1], 1]), (296, 3, [2])]
        if doc.description is not None and item is doc.items[0]:
            tags.append((270, 2, doc.description.encode() + b"\0"))
        if predict:
            tags.append((317, 3, [2]))
        if model == "RGBA":
            tags.append((338, 3, [2]))
        if doc.icc and item is doc.items[0]:
            tags.append((34675, 7, doc.icc))
        entries = []
        for tag, kind, values in sorted(tags, key=lambda t: t[0]):
            count = len(values) // 2 if kind == 5 else len(values)
            raw = bytes(values) if kind in (2, 7) else struct.pack(order + f"{len(values)}{'I' if kind == 5 else FORMS[kind]}", *values)
            if len(raw) > struct.calcsize(p):
                out += b"\0" * (len(out) & 1)
                place = len(out)
                out += raw
                raw = struct.pack(order + p, place)
            entries.append(struct.pack(order + "HH" + p, tag, kind, count) + raw.ljust(struct.calcsize(p), b"\0"))
        out += b"\0" * (-len(out) % 8)
        struct.pack_into(order + p, out, link, len(out))
        out += struct.pack(order + ("Q" if bigtiff else "H"), len(entries)) + b"".join(entries)
        link = len(out)
        out += struct.pack(order + p, 0)
    return bytes(out)
