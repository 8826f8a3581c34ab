"""WebP: lossless stills and animations; lossy payloads are recognised and refused."""

from __future__ import annotations

import struct

import numpy as np

from ...model import ImageError, Limits
from .base import Document, Item, Raster, exif_orientation, guard

# Fixed values of the format: the order of code length codes, and the near places of short distances.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]


def matches(content: bytes) -> bool:
    return content[:4] == b"RIFF" and content[8:12] == b"WEBP"


class Bits:
    """Bits from the least significant on."""

    def __init__(self, data: bytes) -> None:
        self.value, self.left = int.from_bytes(data[:8], "little"), min(64, len(data) * 8)
        self.data, self.at = data, 8

    def get(self, n: int) -> int:
        if self.left < n:
            more = self.data[self.at : self.at + 512]
            self.value |= int.from_bytes(more, "little") << self.left
            self.left += len(more) * 8
            self.at += 512
            if self.left < n:
                raise ImageError("CORRUPT", "the bit stream ends early")
        v = self.value & ((1 << n) - 1)
        self.value >>= n
        self.left -= n
        return v


class Prefix:
    """A prefix code from code lengths; codes are read most significant bit first."""

    def __init__(self, lengths: list[int]) -> None:
        used = [s for s, n in enumerate(lengths) if n]
        self.only = used[0] if len(used) == 1 else 0 if not used else None
        self.look: dict[tuple[int, int], int] = {}
        code = 0
        for length in range(1, 16):
            for s in used:
                if lengths[s] == length:
                    self.look[length, code] = s
                    code += 1
            code <<= 1

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        code = 0
        for length in range(1, 16):
            code = code << 1 | bits.get(1)
            s = self.look.get((length, code))
            if s is not None:
                return s
        raise ImageError("CORRUPT", "unknown prefix code")


def read_prefix(bits: Bits, alphabet: int) -> Prefix:
    lengths = [0] * alphabet
    if bits.get(1):
        two = bits.get(1)
        symbols = [bits.get(8 if bits.get(1) else 1)] + ([bits.get(8)] if two else [])
        for s in symbols:
            if s >= alphabet:
                raise ImageError("CORRUPT", "a symbol is past the alphabet")
            lengths[s] = 1
        return Prefix(lengths)
    first = [0] * 19
    for i in range(4 + bits.get(4)):
        first[LENGTH_ORDER[i]] = bits.get(3)
    code = Prefix(first)
    most = 2 + bits.get(2 + 2 * bits.get(3)) if bits.get(1) else alphabet
    k, last = 0, 8
    while k < alphabet and most:
        most -= 1
        s = code.read(bits)
        if s < 16:
            lengths[k] = s
            k += 1
            last = s or last
            continue
        n, v = (3 + bits.get(2), last) if s == 16 else (3 + bits.get(3), 0) if s == 17 else (11 + bits.get(7), 0)
        if k + n > alphabet:
            raise ImageError("CORRUPT", "code lengths are past the alphabet")
        lengths[k : k + n] = [v] * n
        k += n
    return Prefix(lengths)


def extra(bits: Bits, s: int) -> int:
    if s < 4:
        return s + 1
    n = (s - 2) >> 1
    return ((2 + (s & 1)) << n) + bits.get(n) + 1


def image(bits: Bits, width: int, height: int, main: bool) -> list[int]:
    """ARGB pixels of an entropy-coded image."""
    cache_bits = bits.get(4) if bits.get(1) else 0
    if cache_bits > 11:
        raise ImageError("CORRUPT", "colour cache")
    block, groups, which = 0, 1, None
    if main and bits.get(1):
        block = bits.get(3) + 2
        w = -(-width // (1 << block))
        which = [p >> 8 & 0xFFFF for p in image(bits, w, -(-height // (1 << block)), False)]
        groups = max(which) + 1
    codes = [[read_prefix(bits, n) for n in (256 + 24 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)] for _ in range(groups)]
    cache = [0] * (1 << cache_bits)
    shift = 32 - cache_bits
    out: list[int] = []
    total = width * height
    across = -(-width // (1 << block)) if block else 0
    group = codes[0]
    done = 0  # pixels that are in the cache

    def remember(upto: int) -> None:
        nonlocal done
        for p in out[done:upto]:
            cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> shift] = p
        done = upto

    while len(out) < total:
        if which is not None:
            y, x = divmod(len(out), width)
            group = codes[which[(y >> block) * across + (x >> block)]]
        s = group[0].read(bits)
        if s < 256:
            r, b, a = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            out.append(a << 24 | r << 16 | s << 8 | b)
        elif s < 280:
            n = extra(bits, s - 256)
            d = extra(bits, group[4].read(bits))
            if d > 120:
                d -= 120
            else:
                dx, dy = NEAR[d - 1]
                d = max(1, dy * width + dx)
            if d > len(out) or len(out) + n > total:
                raise ImageError("CORRUPT", "a copy is past the image")
            for _ in range(n):
                out.append(out[-d])
        else:
            if cache_bits:
                remember(len(out))
            out.append(cache[s - 280])
    return out


def add(a: int, b: int) -> int:
    return (a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00 | (a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF


def average(a: int, b: int) -> int:
    return (a & b) + (((a ^ b) & 0xFEFEFEFE) >> 1)


def lanes(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def clamped(parts) -> int:
    v = 0
    for p in parts:
        v = v << 8 | (0 if p < 0 else 255 if p > 255 else p)
    return v


def predict(mode: int, left: int, top: int, corner: int, right: int) -> int:
    if mode in (0, 14, 15):
        return 0xFF000000
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return average(average(left, right), top)
    if mode < 11:
        a, b = ((left, corner), (left, top), (corner, top), (top, right))[mode - 6] if mode < 10 else (0, 0)
        return average(a, b) if mode < 10 else average(average(left, corner), average(top, right))
    if mode == 11:
        dl = sum(abs(t - c) for t, c in zip(lanes(top), lanes(corner)))
        dt = sum(abs(v - c) for v, c in zip(lanes(left), lanes(corner)))
        return left if dl < dt else top
    if mode == 12:
        return clamped(a + b - c for a, b, c in zip(lanes(left), lanes(top), lanes(corner)))
    half = average(left, top)
    return clamped(a + int((a - c) / 2) for a, c in zip(lanes(half), lanes(corner)))


def vp8l(data: bytes, limits: Limits) -> np.ndarray:
    """RGBA samples of a lossless payload."""
    if len(data) < 5 or data[0] != 0x2F:
        raise ImageError("CORRUPT", "not a lossless payload")
    bits = Bits(data[1:])
    width, height = bits.get(14) + 1, bits.get(14) + 1
    has_alpha = bits.get(1)
    if bits.get(3):
        raise ImageError("UNSUPPORTED", "version")
    guard(width, height, limits)
    steps, w = [], width
    seen = set()
    while bits.get(1):
        kind = bits.get(2)
        if kind in seen:
            raise ImageError("CORRUPT", "a transform comes twice")
        seen.add(kind)
        if kind == 2:
            steps.append((kind, 0, None, w))
        elif kind == 3:
            n = bits.get(8) + 1
            table = image(bits, n, 1, False)
            for i in range(1, n):
                table[i] = add(table[i], table[i - 1])
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            steps.append((kind, pack, table, w))
            w = -(-w // (1 << pack))
        else:
            size = bits.get(3) + 2
            steps.append((kind, size, image(bits, -(-w // (1 << size)), -(-height // (1 << size)), False), w))
    out = image(bits, w, height, True)
    for kind, size, table, w in reversed(steps):
        if kind == 0:
            across = -(-w // (1 << size))
            for i, p in enumerate(out):
                y, x = divmod(i, w)
                if y == 0:
                    q = 0xFF000000 if x == 0 else out[i - 1]
                elif x == 0:
                    q = out[i - w]
                else:
                    q = predict(table[(y >> size) * across + (x >> size)] >> 8 & 15, out[i - 1], out[i - w], out[i - w - 1], out[i - w + 1])
                out[i] = add(p, q)
        elif kind == 1:
            across = -(-w // (1 << size))
            signed = lambda v: v - 256 if v > 127 else v
            for i, p in enumerate(out):
                y, x = divmod(i, w)
                e = table[(y >> size) * across + (x >> size)]
                a, r, g, b = lanes(p)
                gr, gb, rb = signed(e & 255), signed(e >> 8 & 255), signed(e >> 16 & 255)
                r = (r + (gr * signed(g) >> 5)) & 255
                b = (b + (gb * signed(g) >> 5) + (rb * signed(r) >> 5)) & 255
                out[i] = a << 24 | r << 16 | g << 8 | b
        elif kind == 2:
            for i, p in enumerate(out):
                g = p >> 8 & 255
                out[i] = p & 0xFF00FF00 | ((p >> 16) + g & 255) << 16 | (p + g) & 255
        else:
            per, depth = 1 << size, 8 >> size
            short = -(-w // per)
            look = table + [0] * (256 - len(table))
            out = [look[out[y * short + (x >> size)] >> 8 >> (x & per - 1) * depth & (1 << depth) - 1] for y in range(height) for x in range(w)]
    argb = np.array(out, np.uint32).reshape(height, width)
    rgba = np.stack([argb >> 16 & 255, argb >> 8 & 255, argb & 255, argb >> 24], 2).astype(np.uint8)
    if not has_alpha:
        rgba[..., 3] = 255
    return rgba


def riff(content: bytes) -> list[tuple[bytes, bytes]]:
    at, out = 0, []
    while at + 8 <= len(content):
        kind, size = struct.unpack_from("<4sI", content, at)
        body = content[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ImageError("CORRUPT", "a chunk ends early")
        out.append((kind, body))
        at += 8 + size + (size & 1)
    return out


def still(found: list[tuple[bytes, bytes]], limits: Limits) -> np.ndarray:
    for kind, body in found:
        if kind == b"VP8L":
            return vp8l(body, limits)
        if kind == b"VP8 ":
            raise ImageError("UNSUPPORTED", "lossy payload")
    raise ImageError("CORRUPT", "no image")


def blend(s: np.ndarray, d: np.ndarray) -> np.ndarray:
    """OVER in the format's own fixed point."""
    s, d = s.astype(np.uint64), d.astype(np.uint64)
    sa, da = s[..., 3:], d[..., 3:]
    f = da * (256 - sa) >> np.uint64(8)
    ba = sa + f & np.uint64(255)
    c = ((s[..., :3] * sa + d[..., :3] * f) * ((1 << 24) // np.maximum(ba, 1)) & np.uint64(0xFFFFFFFF)) >> np.uint64(24)
    out = np.where(ba == 0, 0, np.concatenate((c, ba), 2))
    return np.where(sa == 0, d, np.where(sa == 255, s, out)).astype(np.uint8)


def load(content: bytes, limits: Limits) -> Document:
    found = riff(content[12:])
    doc = Document([], "webp")
    for kind, body in found:
        if kind == b"ANIM":
            b, g, r, a, doc.loop_count = struct.unpack_from("<BBBBH", body)
            doc.background = (r, g, b, a)
        elif kind == b"ICCP":
            doc.icc = body
        elif kind == b"EXIF":
            doc.metadata.append(("webp", "EXIF", body))
            doc.orientation = exif_orientation(body.removeprefix(b"Exif\0\0"))
        elif kind == b"XMP ":
            doc.metadata.append(("webp", "XMP", body))
    frames = [body for kind, body in found if kind == b"ANMF"]
    if not frames:
        doc.items.append(Item(Raster(still(found, limits))))
        return doc
    if limits.max_frame_count is not None and len(frames) > limits.max_frame_count:
        raise ImageError("LIMIT", "too many frames")
    head = next(body for kind, body in found if kind == b"VP8X")
    three = lambda b, at: int.from_bytes(b[at : at + 3], "little")
    width, height = three(head, 4) + 1, three(head, 7) + 1
    guard(width, height, limits)
    canvas = np.zeros((height, width, 4), np.uint8)
    last = None
    for body in frames:
        x, y, w, h = three(body, 0) * 2, three(body, 3) * 2, three(body, 6) + 1, three(body, 9) + 1
        delay, flags = three(body, 12), body[15]
        if x + w > width or y + h > height:
            raise ImageError("CORRUPT", "a frame is not inside the canvas")
        patch = still(riff(body[16:]), limits)
        if patch.shape[:2] != (h, w):
            raise ImageError("CORRUPT", "a frame of another size")
        if last is not None:
            canvas[last] = 0
        box = np.s_[y : y + h, x : x + w]
        source = bool(flags & 2)
        canvas[box] = patch if source else blend(patch, canvas[box])
        last = box if flags & 1 else None
        doc.items.append(Item(Raster(canvas.copy()), "FRAME", len(doc.items), (delay, 1000), flags & 1, 0 if source else 1))
    return doc


class Out:
    def __init__(self) -> None:
        self.value = self.n = 0
        self.done = bytearray()

    def put(self, v: int, n: int) -> None:
        self.value |= v << self.n
        self.n += n
        if self.n > 4096:
            self.done += (self.value & (1 << (self.n & ~7)) - 1).to_bytes(self.n // 8, "little")
            self.value >>= self.n & ~7
            self.n &= 7

    def bytes(self) -> bytes:
        return bytes(self.done) + self.value.to_bytes((self.n + 7) // 8, "little")


def write_prefix(out: Out, counts: np.ndarray) -> dict[int, tuple[int, int]]:
    """Write a code for the symbols that occur; codes come with their bits reversed."""
    used = np.flatnonzero(counts)
    if len(used) <= 1 and (not len(used) or used[0] < 256):
        out.put(1, 1)
        out.put(0, 1)
        s = int(used[0]) if len(used) else 0
        out.put(int(s > 1), 1)
        out.put(s, 8 if s > 1 else 1)
        return {s: (0, 0)}
    by_length, symbols = lengths_of({int(s): int(counts[s]) for s in used}, 15)
    lengths = [0] * len(counts)
    k = 0
    for n, c in enumerate(by_length, 1):
        for s in symbols[k : k + c]:
            lengths[s] = n
        k += c
    out.put(0, 1)
    # Code lengths are written plainly: each of 0 to 15 has a code of four bits.
    out.put(19 - 4, 4)
    for s in LENGTH_ORDER:
        out.put(4 if s < 16 else 0, 3)
    out.put(0, 1)
    flip = lambda code, n: int(f"{code:0{n}b}"[::-1], 2)
    for n in lengths:
        out.put(flip(n, 4), 4)
    return {s: (flip(code, n), n) for (n, code), s in Prefix(lengths).look.items()}


def lengths_of(counts: dict[int, int], most: int) -> tuple[list[int], list[int]]:
    """Complete code lengths: numbers by length, and symbols in order."""
    leaves = sorted((n, (s,)) for s, n in counts.items())
    level: list[tuple[int, tuple]] = []
    for _ in range(most):
        pairs = [(level[i][0] + level[i + 1][0], level[i][1] + level[i + 1][1]) for i in range(0, len(level) - 1, 2)]
        level = sorted(leaves + pairs, key=lambda x: x[0])
    length = dict.fromkeys(counts, 0)
    for _, symbols in level[: 2 * len(leaves) - 2]:
        for s in symbols:
            length[s] += 1
    by_length = [0] * most
    ordered = sorted(counts, key=lambda s: (length[s], s))
    for s in ordered:
        by_length[length[s] - 1] += 1
    return by_length, ordered


def vp8l_pack(rgba: np.ndarray) -> bytes:
    """A lossless payload: green subtracted, then prefix codes over literals."""
    h, w, _ = rgba.shape
    out = Out()
    out.put(w - 1, 14)
    out.put(h - 1, 14)
    out.put(int((rgba[..., 3] < 255).any()), 1)
    out.put(0, 3)
    out.put(1, 1)
    out.put(2, 2)
    out.put(0, 1)
    out.put(0, 1)  # no colour cache
    out.put(0, 1)  # one group of codes
    flat = rgba.reshape(-1, 4)
    g = flat[:, 1]
    planes = [(g, 280), (flat[:, 0] - g, 256), (flat[:, 2] - g, 256), (flat[:, 3], 256)]
    codes = [write_prefix(out, np.bincount(p, minlength=n)) for p, n in planes]
    write_prefix(out, np.zeros(40, np.int64))
    for pixel in zip(*[p.tolist() for p, _ in planes]):
        for code, v in zip(codes, pixel):
            out.put(*code[v])
    return b"\x2f" + out.bytes()


def chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def save(doc: Document) -> bytes:
    """A lossless still, or an animation of frames that replace the canvas."""
    rasters = [i.raster.rgba8() for i in doc.items]
    h, w, _ = rasters[0].shape
    if len(rasters) == 1 or any(r.shape != rasters[0].shape for r in rasters):
        body = chunk(b"VP8L", vp8l_pack(rasters[0]))
    else:
        three = lambda v: v.to_bytes(3, "little")
        body = chunk(b"VP8X", bytes((0x12, 0, 0, 0)) + three(w - 1) + three(h - 1)) + chunk(b"ANIM", b"\0\0\0\0" + struct.pack("<H", doc.loop_count or 0))
        for item, r in zip(doc.items, rasters):
            num, den = item.delay
            body += chunk(b"ANMF", three(0) + three(0) + three(w - 1) + three(h - 1) + three(min((1 << 24) - 1, num * 1000 // (den or 100))) + b"\x02" + chunk(b"VP8L", vp8l_pack(r)))
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


__all__ = ["load", "matches", "save"]
