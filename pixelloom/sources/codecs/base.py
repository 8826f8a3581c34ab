"""Rasters, items and documents in memory, and helpers of the codecs."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from ...model import ImageError, Limits


@dataclass
class Raster:
    """Samples ``(h, w, channels)`` in uint8 or uint16; ``model`` is GRAY, RGBA or CMYK."""

    samples: np.ndarray
    model: str = "RGBA"

    @property
    def height(self) -> int:
        return self.samples.shape[0]

    @property
    def width(self) -> int:
        return self.samples.shape[1]

    @property
    def bits(self) -> int:
        return 8 * self.samples.dtype.itemsize

    def rgba8(self) -> np.ndarray:
        """The samples as 8-bit RGBA."""
        s = self.samples
        if s.dtype != np.uint8:
            s = ((s.astype(np.uint32) * 255 + 32767) // 65535).astype(np.uint8)
        if self.model == "GRAY":
            return np.concatenate((np.repeat(s, 3, 2), np.full_like(s, 255)), 2)
        if self.model == "CMYK":
            light = 255 - s.astype(np.uint32)
            rgb = (light[:, :, :3] * light[:, :, 3:] + 127) // 255
            return np.concatenate((rgb, np.full(rgb.shape[:2] + (1,), 255)), 2).astype(np.uint8)
        return s


@dataclass
class Item:
    raster: Raster
    role: str = "IMAGE"
    subject: int = 0
    delay: tuple[int, int] = (0, 100)
    dispose: int = 0
    blend: int = 0
    hotspot: tuple[int, int] = (0, 0)


@dataclass
class Document:
    items: list[Item]
    format: str = ""
    orientation: int = 1
    dpi: tuple[int, int] = (0, 0)
    description: str | None = None
    loop_count: int | None = None
    background: tuple[int, int, int, int] | None = None
    #: (format, tag, data) in the order of the file.
    metadata: list[tuple[str, str, bytes]] = field(default_factory=list)
    icc: bytes | None = None


class Reader:
    """Numbers from bytes, with a check of the end."""

    def __init__(self, data: bytes, order: str = "<") -> None:
        self.data, self.order, self.at = data, order, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ImageError("CORRUPT", "the file ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def read(self, form: str) -> tuple:
        return struct.unpack(self.order + form, self.take(struct.calcsize(self.order + form)))

    def one(self, form: str) -> int:
        return self.read(form)[0]


def guard(width: int, height: int, limits: Limits, channels: int = 4, depth: int = 1) -> None:
    """Refuse sizes that are empty or over the caps, before anything is allocated."""
    if width <= 0 or height <= 0:
        raise ImageError("CORRUPT", "empty size")
    if limits.max_decoded_pixels is not None and width * height > limits.max_decoded_pixels:
        raise ImageError("LIMIT", "too many pixels")
    if limits.max_memory is not None and width * height * channels * depth > limits.max_memory:
        raise ImageError("LIMIT", "too much memory")


def oriented(raster: Raster, orientation: int) -> Raster:
    """Undo an Exif orientation."""
    turn = {
        2: lambda s: s[:, ::-1], 3: lambda s: s[::-1, ::-1], 4: lambda s: s[::-1], 5: lambda s: s.transpose(1, 0, 2),
        6: lambda s: s.transpose(1, 0, 2)[:, ::-1], 7: lambda s: s.transpose(1, 0, 2)[::-1, ::-1], 8: lambda s: s.transpose(1, 0, 2)[::-1],
    }.get(orientation)
    return Raster(np.ascontiguousarray(turn(raster.samples)), raster.model) if turn else raster


def unpacked(data: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Samples of 1, 2 or 4 bits, most significant first, of rows of bytes."""
    per = 8 // bits
    shifts = np.arange(8 - bits, -1, -bits)
    values = (data[:, :, None] >> shifts) & ((1 << bits) - 1)
    return values.reshape(len(data), data.shape[1] * per)[:, :width].astype(np.uint8)


def packed(values: np.ndarray, bits: int) -> np.ndarray:
    """The reverse, rows padded to whole bytes."""
    per = 8 // bits
    pad = -values.shape[1] % per
    v = np.pad(values, ((0, 0), (0, pad))).reshape(len(values), -1, per).astype(np.uint16)
    return (v << np.arange(8 - bits, -1, -bits)).sum(2).astype(np.uint8)


def indexed(rgba: np.ndarray, most: int = 256) -> tuple[np.ndarray, np.ndarray] | None:
    """``(palette, indices)`` in order of first appearance, every clear pixel one colour; None for more than ``most``."""
    flat = rgba.reshape(-1, 4).copy()
    flat[flat[:, 3] == 0] = 0
    key = flat.view(np.uint32)[:, 0]
    values, first, index = np.unique(key, return_index=True, return_inverse=True)
    if len(values) > most:
        return None
    order = np.argsort(first)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return flat[first[order]], rank[index].reshape(rgba.shape[:2])


def lzw_bits(data: bytes, start: int, msb: bool, early: int) -> bytes:
    """LZW decoding of GIF (least significant bit first) and TIFF (most significant first, one code early).

    ``start`` is the bits of a root code; ends at the end code or where the data does.
    """
    clear, end = 1 << start, (1 << start) + 1
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, width = list(roots), start + 1
    out: list[bytes] = []
    held, bits, last = 0, 0, None
    for byte in data:
        if msb:
            held = (held << 8 | byte) & 0xFFFFFF
        else:
            held |= byte << bits
        bits += 8
        while bits >= width:
            if msb:
                code = held >> (bits - width) & ((1 << width) - 1)
            else:
                code = held & ((1 << width) - 1)
                held >>= width
            bits -= width
            if code == clear:
                table, width, last = list(roots), start + 1, None
                continue
            if code == end:
                return b"".join(out)
            if last is None:
                if code >= clear:
                    raise ImageError("CORRUPT", "LZW starts with an unknown code")
                entry = table[code]
            elif code < len(table):
                entry = table[code]
                if len(table) < 4096:
                    table.append(last + entry[:1])
            elif code == len(table) and code < 4096:
                entry = last + last[:1]
                table.append(entry)
            else:
                raise ImageError("CORRUPT", "unknown LZW code")
            out.append(entry)
            last = entry
            if len(table) + early >= 1 << width and width < 12:
                width += 1
    return b"".join(out)


def lzw_pack(data: bytes, start: int, msb: bool, early: int) -> bytes:
    """LZW encoding, the reverse of ``lzw_bits``."""
    clear, end = 1 << start, (1 << start) + 1
    out = bytearray()
    held = bits = 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        if msb:
            held = held << width | code
            bits += width
            while bits >= 8:
                out.append(held >> (bits - 8) & 255)
                bits -= 8
            held &= (1 << bits) - 1
        else:
            held |= code << bits
            bits += width
            while bits >= 8:
                out.append(held & 255)
                held >>= 8
                bits -= 8

    width, table, used = start + 1, {}, end + 1
    put(clear, width)
    prefix = -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        known = table.get((prefix, byte))
        if known is not None:
            prefix = known
            continue
        put(prefix, width)
        table[prefix, byte] = used
        used += 1
        # A decoder's table is one entry behind.
        if used - 1 + early >= 1 << width and width < 12:
            width += 1
        if used >= 4095:
            put(clear, width)
            width, table, used = start + 1, {}, end + 1
        prefix = byte
    if prefix >= 0:
        put(prefix, width)
        used += 1
        if used - 1 + early >= 1 << width and width < 12:
            width += 1
    put(end, width)
    if bits:
        out.append((held << (8 - bits) if msb else held) & 255)
    return bytes(out)


def packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            if at >= len(data):
                raise ImageError("CORRUPT", "PackBits ends early")
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def pack_packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        run = 1
        while run < 128 and at + run < len(data) and data[at + run] == data[at]:
            run += 1
        if run > 1:
            out += bytes([257 - run]) + data[at : at + 1]
            at += run
            continue
        end = at + 1
        while end < len(data) and end - at < 128 and not (end + 1 < len(data) and data[end] == data[end + 1]):
            end += 1
        out += bytes([end - at - 1]) + data[at:end]
        at = end
    return bytes(out)


def exif_orientation(data: bytes) -> int:
    """The orientation in a TIFF-structured Exif block; 1 if there is none or it cannot be read."""
    try:
        order = {b"II": "<", b"MM": ">"}[data[:2]]
        magic, offset = struct.unpack_from(order + "HI", data, 2)
        (count,) = struct.unpack_from(order + "H", data, offset)
        for k in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, offset + 2 + 12 * k)
            if tag == 0x0112 and kind == 3 and n == 1:
                (value,) = struct.unpack_from(order + "H", data, offset + 10 + 12 * k)
                return value if 1 <= value <= 8 else 1
    except (struct.error, KeyError):
        pass
    return 1
