"""JPEG: baseline, progressive and lossless Huffman decoding, baseline and lossless encoding."""

from __future__ import annotations

import struct

import numpy as np

from ...model import ImageError, Limits
from .base import Document, Item, Raster, exif_orientation, guard

# Fixed values of the standard: the zigzag order, the example quantization and Huffman tables.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
LUMA = np.array([
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
])
CHROMA = np.array([
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
])


#: Table H.1: a sample from those left, above, and above left.
PREDICT = {
    1: lambda a, b, c: a, 2: lambda a, b, c: b, 3: lambda a, b, c: c, 4: lambda a, b, c: a + b - c, 5: lambda a, b, c: a + ((b - c) >> 1), 6: lambda a, b, c: b + ((a - c) >> 1), 7: lambda a, b, c: (a + b) >> 1,
}


def matches(content: bytes) -> bool:
    return content[:3] == b"\xff\xd8\xff"


class Huffman:
    """A table of codes; ``look[length, code]`` is a symbol."""

    def __init__(self, counts: bytes, symbols: bytes) -> None:
        self.look: dict[tuple[int, int], int] = {}
        code = k = 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                if k >= len(symbols) or code >= 1 << length:
                    raise ImageError("CORRUPT", "bad Huffman table")
                self.look[length, code] = symbols[k]
                code += 1
                k += 1
            code <<= 1


class Bits:
    """Bits of an entropy-coded segment, stuffing taken out; zeros after its end."""

    def __init__(self, data: bytes) -> None:
        self.data = data.replace(b"\xff\x00", b"\xff")
        self.at = self.held = self.n = 0

    def get(self, n: int) -> int:
        while self.n < n:
            byte = self.data[self.at] if self.at < len(self.data) else 0
            self.at += 1
            if self.at > len(self.data) + 64:
                raise ImageError("CORRUPT", "the scan ends early")
            self.held = self.held << 8 | byte
            self.n += 8
        self.n -= n
        v = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return v

    def symbol(self, table: Huffman | None) -> int:
        if table is None:
            raise ImageError("CORRUPT", "a scan names a missing table")
        code, look = 0, table.look
        for length in range(1, 17):
            code = code << 1 | self.get(1)
            s = look.get((length, code))
            if s is not None:
                return s
        raise ImageError("CORRUPT", "unknown Huffman code")

    def signed(self, n: int) -> int:
        if n == 0:
            return 0
        v = self.get(n)
        return v if v >> (n - 1) else v - (1 << n) + 1


def basis() -> np.ndarray:
    k = np.arange(8)
    m = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    m[0] /= np.sqrt(2)
    return m


DCT = basis()


def idct(blocks: np.ndarray) -> np.ndarray:
    """Samples 0..255 of dequantized blocks ``(..., 8, 8)``."""
    return np.clip(np.rint(DCT.T @ blocks @ DCT) + 128, 0, 255).astype(np.uint8)


class Component:
    def __init__(self, ident: int, h: int, v: int, table: int) -> None:
        self.ident, self.h, self.v, self.table = ident, h, v, table
        self.coefficients = np.zeros((0, 0, 64), np.int32)
        self.before = 0
        self.lossless: np.ndarray | None = None


def scan(frame: dict, parts: list[Component], tables: dict, span: tuple[int, int, int, int], segments: list[bytes], restart: int) -> None:
    start, end, high, low = span
    progressive = frame["progressive"]
    single = len(parts) == 1
    if single:
        c, _, _ = parts[0]
        across = -(-(-(-frame["width"] * c.h // frame["hmax"])) // 8)
        down = -(-(-(-frame["height"] * c.v // frame["vmax"])) // 8)
        units = [[(c, y, x)] for y in range(down) for x in range(across)]
    else:
        units = [
            [(c, my * c.v + y, mx * c.h + x) for c, _, _ in parts for y in range(c.v) for x in range(c.h)] for my in range(frame["mcu_down"]) for mx in range(frame["mcu_across"])
        ]
    dc = {id(c): tables.get((0, t)) for c, t, _ in parts}
    ac = {id(c): tables.get((1, t)) for c, _, t in parts}
    bits, part = Bits(segments[0]), 0
    skip = 0
    for c, _, _ in parts:
        c.before = 0
    for i, unit in enumerate(units):
        if restart and i and i % restart == 0:
            part += 1
            bits = Bits(segments[part] if part < len(segments) else b"")
            skip = 0
            for c, _, _ in parts:
                c.before = 0
        for c, y, x in unit:
            out = c.coefficients[y, x]
            k = start
            if k == 0:
                if high == 0:
                    c.before += bits.signed(bits.symbol(dc[id(c)]))
                    out[0] = c.before << low
                elif bits.get(1):
                    out[0] |= 1 << low
                k = 1
                if progressive:
                    continue
            table = ac[id(c)]
            if high == 0:
                if skip:
                    skip -= 1
                    continue
                while k <= end:
                    s = bits.symbol(table)
                    run, size = s >> 4, s & 15
                    if size == 0:
                        if run < 15:
                            if progressive:
                                skip = (1 << run) + (bits.get(run) if run else 0) - 1
                            break
                        k += 16
                        continue
                    k += run
                    if k > 63:
                        raise ImageError("CORRUPT", "a run is past the block")
                    out[ZIGZAG[k]] = bits.signed(size) * (1 << low)
                    k += 1
                continue
            one = 1 << low

            def refine(place: int) -> None:
                if bits.get(1) and not abs(out[place]) & one:
                    out[place] += one if out[place] > 0 else -one

            if skip == 0:
                while k <= end:
                    s = bits.symbol(table)
                    run, size = s >> 4, s & 15
                    value = 0
                    if size == 0:
                        if run < 15:
                            skip = (1 << run) + (bits.get(run) if run else 0)
                            break
                    else:
                        value = one if bits.get(1) else -one
                    while k <= end:
                        place = ZIGZAG[k]
                        if out[place]:
                            refine(place)
                        elif run == 0:
                            if value:
                                out[place] = value
                            k += 1
                            break
                        else:
                            run -= 1
                        k += 1
            if skip:
                while k <= end:
                    if out[ZIGZAG[k]]:
                        refine(ZIGZAG[k])
                    k += 1
                skip -= 1


def lossless_scan(frame: dict, parts: list[tuple], tables: dict, predictor: int, shift: int, data: bytes) -> None:
    """Samples of components that are predicted from their neighbours (all of one sampling)."""
    if not 1 <= predictor <= 7 or any((c.h, c.v) != (1, 1) for c, _, _ in parts):
        raise ImageError("UNSUPPORTED", "predictor or sampling")
    bits = Bits(data)
    width, height, precision = frame["width"], frame["height"], frame["bits"]
    rows = {id(c): np.zeros((height, width), np.int64) for c, _, _ in parts}
    above: dict[int, list[int]] = {}
    for y in range(height):
        lines: dict[int, list[int]] = {id(c): [] for c, _, _ in parts}
        for x in range(width):
            for c, t, _ in parts:
                line, up = lines[id(c)], above.get(id(c))
                if up is None:
                    p = line[x - 1] if x else 1 << (precision - shift - 1)
                elif x == 0:
                    p = up[0]
                else:
                    p = PREDICT[predictor](line[x - 1], up[x], up[x - 1])
                n = bits.symbol(tables.get((0, t)))
                line.append((p + (32768 if n == 16 else bits.signed(n))) & 0xFFFF)
        for c, _, _ in parts:
            above[id(c)] = lines[id(c)]
            rows[id(c)][y] = lines[id(c)]
    for c, _, _ in parts:
        c.lossless = rows[id(c)] << shift


def fancy(s: np.ndarray) -> np.ndarray:
    """Twice as wide by the triangle filter."""
    v = s.astype(np.int32)
    out = np.empty((s.shape[0], s.shape[1] * 2), np.uint8)
    left = np.concatenate((v[:, :1], v[:, :-1]), 1)
    right = np.concatenate((v[:, 1:], v[:, -1:]), 1)
    out[:, ::2] = (3 * v + left + 1) >> 2
    out[:, 1::2] = (3 * v + right + 2) >> 2
    out[:, 0], out[:, -1] = s[:, 0], s[:, -1]
    return out


def load(content: bytes, limits: Limits) -> Document:
    doc = Document([], "jpeg")
    quant: dict[int, np.ndarray] = {}
    tables: dict[tuple[int, int], Huffman] = {}
    frame: dict = {}
    restart, adobe, icc = 0, None, []
    at = 2
    while at + 4 <= len(content):
        if content[at] != 0xFF:
            at += 1
            continue
        marker = content[at + 1]
        if marker in (0xFF, 0x00) or 0xD0 <= marker <= 0xD8:
            at += 1 if marker == 0xFF else 2
            continue
        if marker == 0xD9:
            break
        (size,) = struct.unpack_from(">H", content, at + 2)
        body = content[at + 4 : at + 2 + size]
        if len(body) < size - 2:
            raise ImageError("CORRUPT", "a segment ends early")
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                q = np.zeros(64, np.int32)
                q[ZIGZAG] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8)
                quant[k], body = q, body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = Huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1, 0xC2, 0xC3):
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 and not (marker == 0xC3 and 2 <= bits <= 16):
                raise ImageError("UNSUPPORTED", f"{bits} bits a sample")
            guard(width, height, limits)
            parts = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            if not parts or any(not 1 <= v <= 4 for c in parts for v in (c.h, c.v)):
                raise ImageError("CORRUPT", "bad sampling")
            hmax, vmax = max(c.h for c in parts), max(c.v for c in parts)
            frame = {"width": width, "height": height, "parts": parts, "hmax": hmax, "vmax": vmax, "progressive": marker == 0xC2, "lossless": marker == 0xC3, "bits": bits}
            frame["mcu_across"], frame["mcu_down"] = -(-width // (8 * hmax)), -(-height // (8 * vmax))
            for c in parts:
                c.coefficients = np.zeros((0, 0, 64), np.int32) if frame["lossless"] else np.zeros((frame["mcu_down"] * c.v, frame["mcu_across"] * c.h, 64), np.int32)
        elif 0xC5 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ImageError("UNSUPPORTED", f"coding process {marker:#x}")
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xE0 and body[:5] == b"JFIF\0":
            unit, x, y = struct.unpack_from(">BHH", body, 7)
            doc.dpi = (x, y) if unit == 1 else ((x * 254 + 50) // 100, (y * 254 + 50) // 100) if unit == 2 else (0, 0)
        elif marker == 0xE1 and body[:6] == b"Exif\0\0":
            doc.metadata.append(("jpeg", "Exif", body[6:]))
            doc.orientation = exif_orientation(body[6:])
        elif marker == 0xE2 and body[:12] == b"ICC_PROFILE\0":
            icc.append(body[14:])
        elif marker == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif marker == 0xFE:
            doc.description = body.decode("utf-8", "replace")
        elif marker == 0xDA:
            if not frame:
                raise ImageError("CORRUPT", "a scan before its frame")
            n = body[0]
            by_id = {c.ident: c for c in frame["parts"]}
            chosen = [(by_id[body[1 + 2 * k]], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(n)]
            start, end, approx = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n]
            segments, begin = [], at
            while at < len(content):
                at = content.find(b"\xff", at)
                if at < 0 or at + 1 >= len(content):
                    at = len(content)
                    break
                if content[at + 1] == 0:
                    at += 2
                elif 0xD0 <= content[at + 1] <= 0xD7:
                    segments.append(content[begin:at])
                    at += 2
                    begin = at
                else:
                    break
            segments.append(content[begin:at])
            if frame["lossless"]:
                if restart:
                    raise ImageError("UNSUPPORTED", "restarts in lossless scans")
                lossless_scan(frame, chosen, tables, start, approx & 15, segments[0])
                continue
            span = (start, end, approx >> 4, approx & 15) if frame["progressive"] else (0, 63, 0, 0)
            scan(frame, chosen, tables, span, segments, restart)
    if not frame:
        raise ImageError("CORRUPT", "no frame")
    if frame["lossless"]:
        if any(c.lossless is None for c in frame["parts"]):
            raise ImageError("CORRUPT", "a component is missing")
        s = np.stack([c.lossless for c in frame["parts"]], 2)
        top = (1 << frame["bits"]) - 1
        s = s.astype(np.uint8) if frame["bits"] == 8 else (np.minimum(s, top) * 65535 // top).astype(np.uint16)
        if s.shape[2] == 1:
            doc.items.append(Item(Raster(s, "GRAY")))
        elif s.shape[2] == 3:
            s = to_rgb(s) if adobe == 1 and frame["bits"] == 8 else s
            doc.items.append(Item(Raster(np.concatenate((s, np.full(s.shape[:2] + (1,), np.iinfo(s.dtype).max, s.dtype)), 2))))
        else:
            raise ImageError("UNSUPPORTED", f"{s.shape[2]} components")
        return doc
    planes = []
    for c in frame["parts"]:
        if c.table not in quant:
            raise ImageError("CORRUPT", "no quantization table")
        down, across, _ = c.coefficients.shape
        s = idct((c.coefficients * quant[c.table]).reshape(down, across, 8, 8)).transpose(0, 2, 1, 3).reshape(down * 8, across * 8)
        own_w, own_h = -(-frame["width"] * c.h // frame["hmax"]), -(-frame["height"] * c.v // frame["vmax"])
        s = s[:own_h, :own_w]
        fx, fy = frame["hmax"] // c.h, frame["vmax"] // c.v
        s = fancy(s) if fx == 2 and own_w > 2 else np.repeat(s, fx, 1)
        planes.append(np.repeat(s, fy, 0)[: frame["height"], : frame["width"]])
    s = np.stack(planes, 2)
    doc.icc = b"".join(icc) or None
    if s.shape[2] == 1:
        doc.items.append(Item(Raster(s, "GRAY")))
    elif s.shape[2] == 3:
        rgb = to_rgb(s) if adobe != 0 else s
        doc.items.append(Item(Raster(np.concatenate((rgb, np.full(rgb.shape[:2] + (1,), 255, np.uint8)), 2))))
    elif s.shape[2] == 4:
        cmyk = np.concatenate((to_rgb(s[..., :3]), s[..., 3:]), 2) if adobe == 2 else s
        doc.items.append(Item(Raster(255 - cmyk if adobe is not None else cmyk, "CMYK")))
    else:
        raise ImageError("UNSUPPORTED", f"{s.shape[2]} components")
    return doc


def to_rgb(s: np.ndarray) -> np.ndarray:
    y, cb, cr = s[..., 0].astype(np.int64), s[..., 1].astype(np.int64) - 128, s[..., 2].astype(np.int64) - 128
    parts = [y + ((91881 * cr + 32768) >> 16), y + ((-22554 * cb - 46802 * cr + 32768) >> 16), y + ((116130 * cb + 32768) >> 16)]
    return np.stack([np.clip(p, 0, 255) for p in parts], 2).astype(np.uint8)


def to_ycbcr(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[..., k].astype(np.int64) for k in range(3))
    centre = (128 << 16) + 32767
    parts = [(19595 * r + 38470 * g + 7471 * b + 32768) >> 16, (-11059 * r - 21709 * g + 32768 * b + centre) >> 16, (32768 * r - 27439 * g - 5331 * b + centre) >> 16]
    return np.stack([np.clip(p, 0, 255) for p in parts], 2).astype(np.uint8)


def code_lengths(counts: dict[int, int], most: int = 16) -> tuple[bytes, bytes]:
    """Huffman code lengths of at most ``most`` bits for symbol counts: numbers by length, and symbols in order.

    Package-merge; a pseudo symbol keeps the code of ones free.
    """
    leaves = sorted([(n, (s,)) for s, n in counts.items()] + [(0, (-1,))])
    level: list[tuple[int, tuple]] = []
    for _ in range(most):
        pairs = [(level[i][0] + level[i + 1][0], level[i][1] + level[i + 1][1]) for i in range(0, len(level) - 1, 2)]
        level = sorted(leaves + pairs, key=lambda x: x[0])
    length = dict.fromkeys([*counts, -1], 0)
    for _, symbols in level[: 2 * len(leaves) - 2]:
        for s in symbols:
            length[s] += 1
    # The pseudo symbol takes one of the longest codes.
    longest = max(length.values())
    length[-1] = longest
    by_length = [0] * most
    ordered = sorted(counts, key=lambda s: (length[s], s))
    for s in ordered:
        by_length[length[s] - 1] += 1
    return bytes(by_length), bytes(ordered)


def codes(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    return {s: (code, length) for (length, code), s in Huffman(counts, symbols).look.items()}


def entropy(blocks: np.ndarray) -> list[tuple[int, int, int, int]]:
    """``(class, symbol, value, bits)`` of zigzag blocks of one component, in order, one list a block."""
    out = []
    before = 0
    for block in blocks.tolist():
        one = []
        d = block[0] - before
        before = block[0]
        n = abs(d).bit_length()
        one.append((0, n, d if d >= 0 else d + (1 << n) - 1, n))
        run = 0
        last = max((k for k in range(1, 64) if block[k]), default=0)
        for k in range(1, last + 1):
            v = block[k]
            if v == 0:
                run += 1
                continue
            while run > 15:
                one.append((1, 0xF0, 0, 0))
                run -= 16
            n = abs(v).bit_length()
            one.append((1, run << 4 | n, v if v >= 0 else v + (1 << n) - 1, n))
            run = 0
        if last < 63:
            one.append((1, 0, 0, 0))
        out.append(one)
    return out


def segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + struct.pack(">H", len(body) + 2) + body


def save_lossless(raster: Raster, predictor: int) -> bytes:
    """Gray or RGB in 8 or 16 bits, one scan, one optimal table."""
    s = raster.samples[..., : 1 if raster.model == "GRAY" else 3].astype(np.int64)
    height, width, n = s.shape
    left = np.concatenate((s[:, :1], s[:, :-1]), 1)
    up = np.concatenate((s[:1], s[:-1]), 0)
    corner = np.concatenate((up[:, :1], up[:, :-1]), 1)
    p = PREDICT[predictor](left, up, corner)
    p[:, 0], p[0] = up[:, 0], left[0]
    p[0, 0] = 1 << (raster.bits - 1)
    d = (s - p + 32768) % 65536 - 32768
    d[d == -32768] = 32768
    flat = d.reshape(-1).tolist()
    sizes = [abs(v).bit_length() for v in flat]
    counts: dict[int, int] = {}
    for v in sizes:
        counts[v] = counts.get(v, 0) + 1
    spec = code_lengths(counts)
    words = codes(*spec)
    out = b"\xff\xd8" + segment(0xC3, struct.pack(">BHHB", raster.bits, height, width, n) + b"".join(bytes((k + 1, 0x11, 0)) for k in range(n)))
    out += segment(0xC4, b"\0" + spec[0] + spec[1]) + segment(0xDA, bytes([n]) + b"".join(bytes((k + 1, 0)) for k in range(n)) + bytes((predictor, 0, 0)))
    text = []
    for v, size in zip(flat, sizes):
        code, length = words[size]
        text.append(f"{code:0{length}b}")
        if 0 < size < 16:
            text.append(f"{v if v > 0 else v + (1 << size) - 1:0{size}b}")
    bits = "".join(text)
    bits += "1" * (-len(bits) % 8)
    body = int(bits or "0", 2).to_bytes(len(bits) // 8, "big")
    return out + body.replace(b"\xff", b"\xff\0") + b"\xff\xd9"


def save(doc: Document, quality: int = 85, subsampling: str = "420", lossless_predictor: int = 0) -> bytes:
    """Baseline with optimal tables: gray, or YCbCr in 4:4:4, 4:2:2 or 4:2:0; or lossless. Alpha is dropped."""
    if lossless_predictor:
        return save_lossless(doc.items[0].raster, lossless_predictor)
    raster = doc.items[0].raster
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    tables = [np.clip((t * scale + 50) // 100, 1, 255) for t in (LUMA, CHROMA)]
    if raster.model == "GRAY":
        planes, shape = [raster.rgba8()[..., 0]], [(1, 1)]
    else:
        ycc = to_ycbcr(raster.rgba8()[..., :3])
        h, v = {"444": (1, 1), "422": (2, 1), "420": (2, 2)}[subsampling]
        planes, shape = [ycc[..., 0]], [(h, v), (1, 1), (1, 1)]
        for k in (1, 2):
            c = np.pad(ycc[..., k], ((0, -ycc.shape[0] % v), (0, -ycc.shape[1] % h)), "edge").astype(np.int32)
            planes.append(((c.reshape(c.shape[0] // v, v, c.shape[1] // h, h).sum((1, 3)) + h * v // 2) // (h * v)).astype(np.uint8))
    height, width = planes[0].shape
    hmax, vmax = shape[0]
    down, across = -(-height // (8 * vmax)), -(-width // (8 * hmax))
    coded = []
    for k, (s, (h, v)) in enumerate(zip(planes, shape)):
        s = np.pad(s, ((0, down * 8 * v - s.shape[0]), (0, across * 8 * h - s.shape[1])), "edge").astype(np.float64) - 128
        blocks = s.reshape(down * v, 8, across * h, 8).transpose(0, 2, 1, 3)
        q = np.rint((DCT @ blocks @ DCT.T).reshape(down * v, across * h, 64) / tables[k > 0]).astype(np.int64)[..., ZIGZAG]
        # In the order of the scan: MCU by MCU.
        q = q.reshape(down, v, across, h, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
        coded.append(entropy(q))
    counts: dict[tuple[int, int], dict[int, int]] = {}
    for k, c in enumerate(coded):
        for block in c:
            for kind, symbol, _, _ in block:
                d = counts.setdefault((kind, int(k > 0)), {})
                d[symbol] = d.get(symbol, 0) + 1
    specs = {key: code_lengths(d) for key, d in counts.items()}
    words = {key: codes(*spec) for key, spec in specs.items()}
    dpi = doc.dpi if doc.dpi != (0, 0) else (1, 1)
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1" + struct.pack(">BHHBB", int(doc.dpi != (0, 0)), *dpi, 0, 0))
    if doc.icc:
        parts = [doc.icc[a : a + 65519] for a in range(0, len(doc.icc), 65519)]
        out += b"".join(segment(0xE2, b"ICC_PROFILE\0" + bytes((i + 1, len(parts))) + p) for i, p in enumerate(parts))
    if doc.description is not None:
        out += segment(0xFE, doc.description.encode())
    n = len(planes)
    for k in range(min(2, n)):
        out += segment(0xDB, bytes([k]) + bytes(tables[k][ZIGZAG].astype(np.uint8)))
    out += segment(0xC0, struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes((k + 1, h << 4 | v, int(k > 0))) for k, (h, v) in enumerate(shape)))
    for (kind, k), (lengths, symbols) in sorted(specs.items()):
        out += segment(0xC4, bytes([kind << 4 | k]) + lengths + symbols)
    out += segment(0xDA, bytes([n]) + b"".join(bytes((k + 1, 0x11 * int(k > 0))) for k in range(n)) + b"\0\x3f\0")
    held = bits = 0
    body = bytearray()
    at = [0] * n
    for _ in range(down * across):
        for k, (h, v) in enumerate(shape):
            for block in coded[k][at[k] : at[k] + h * v]:
                for kind, symbol, value, size in block:
                    code, length = words[kind, int(k > 0)][symbol]
                    held = (held << length | code) << size | value
                    bits += length + size
                    while bits >= 8:
                        byte = held >> (bits - 8) & 255
                        body.append(byte)
                        if byte == 255:
                            body.append(0)
                        bits -= 8
                        held &= (1 << bits) - 1
            at[k] += h * v
    if bits:
        byte = (held << (8 - bits) | (1 << (8 - bits)) - 1) & 255
        body.append(byte)
        if byte == 255:
            body.append(0)
    return out + bytes(body) + b"\xff\xd9"
