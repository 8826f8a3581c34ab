"""What files are made of: their chunks, segments, blocks and directory entries as rows, and their metadata.

``segments`` is a table function over files ``(path, content)``: one row for each chunk of PNG, segment of JPEG, block of
GIF, chunk of WebP and entry of a TIFF directory. ``metadata`` are those rows that describe the picture and do not make it, by
kind, with their bytes. Walks follow lengths only and never decode pixels, so headers of large files are cheap.

Defined cases: null or empty content and unknown formats give no rows; a file that ends early gives the rows up to there and
one named ``CORRUPT``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import POLICIES
from ..operators import exif
from . import codecs

SEGMENTS = "path string, format string, seq int, name string, offset bigint, length bigint"
METADATA = "path string, format string, seq int, kind string, payload binary"
# Signatures of metadata inside segments, and tags of metadata in TIFF.
EXIF, XMP, ICC = b"Exif\0\0", b"http://ns.adobe.com/xap/1.0/\0", b"ICC_PROFILE\0"
XMP_KEYWORD = b"XML:com.adobe.xmp"
TIFF_KINDS = {270: "TEXT", 315: "TEXT", 700: "XMP", 33432: "TEXT", 33723: "IPTC", 34665: "EXIF", 34675: "ICC"}
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}

Walk = Iterator[tuple[str, int, int]]


def _png(data: bytes) -> Walk:
    at = 8
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        if at + 12 + n > len(data):
            raise struct.error
        yield data[at + 4 : at + 8].decode("latin-1"), at + 8, n
        at += 12 + n


def _jpeg(data: bytes) -> Walk:
    at = 0
    while at < len(data):
        if data[at] != 0xFF:
            raise struct.error
        while data[at + 1] == 0xFF:
            at += 1
        mark = data[at + 1]
        at += 2
        if mark in (0x01, 0xD8, 0xD9) or 0xD0 <= mark <= 0xD7:
            yield f"FF{mark:02X}", at, 0
            continue
        (n,) = struct.unpack_from(">H", data, at)
        if n < 2 or at + n > len(data):
            raise struct.error
        yield f"FF{mark:02X}", at + 2, n - 2
        at += n
        if mark == 0xDA:  # coded data up to the next mark that is not stuffed or a restart
            first = at
            while (at := data.index(b"\xff", at)) + 1 < len(data) and (data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7):
                at += 2
            yield "DATA", first, at - first


def _gif(data: bytes) -> Walk:
    def blocks(at: int) -> int:
        while data[at]:
            at += data[at] + 1
        return at + 1

    flags = data[10]
    yield "HEADER", 0, 13
    at = 13
    if flags & 0x80:
        size = 3 << ((flags & 7) + 1)
        yield "GLOBAL_TABLE", at, size
        at += size
    while data[at] != 0x3B:
        if data[at] == 0x21:
            end = blocks(at + 2)
            yield f"EXTENSION_{data[at + 1]:02X}", at + 2, end - at - 2
        elif data[at] == 0x2C:
            table = 3 << ((data[at + 9] & 7) + 1) if data[at + 9] & 0x80 else 0
            end = blocks(at + 10 + table + 1)
            yield "IMAGE", at + 1, end - at - 1
        else:
            raise struct.error
        at = end
    yield "TRAILER", at, 1


def _webp(data: bytes) -> Walk:
    at = 12
    while at + 8 <= len(data):
        (n,) = struct.unpack_from("<I", data, at + 4)
        if at + 8 + n > len(data):
            raise struct.error
        yield data[at : at + 4].decode("latin-1"), at + 8, n
        at += 8 + n + (n & 1)


def _tiff(data: bytes) -> Walk:
    order = "<" if data[:2] == b"II" else ">"
    big = struct.unpack_from(order + "H", data, 2)[0] == 43
    count, entry, one, inline = ("Q", "HHQ", "Q", 8) if big else ("H", "HHI", "I", 4)
    (at,) = struct.unpack_from(order + one, data, 8 if big else 4)
    seen: set[int] = set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + count, data, at)
        at += struct.calcsize(count)
        for _ in range(n):
            tag, kind, many = struct.unpack_from(order + entry, data, at)
            size = TYPE_BYTES.get(kind, 1) * many
            place = at + struct.calcsize(order + entry)
            if size > inline:
                (place,) = struct.unpack_from(order + one, data, place)
            if place + size > len(data):
                raise struct.error
            yield f"TAG_{tag}", place, size
            at += struct.calcsize(order + entry) + inline
        (at,) = struct.unpack_from(order + one, data, at)


WALKS = {"png": _png, "jpeg": _jpeg, "gif": _gif, "webp": _webp, "tiff": _tiff}


def walk(content: bytes) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The format, and ``(name, offset, length)`` of every part."""
    name = codecs.name_of(content)
    parts: list[tuple[str, int, int]] = []
    if name in WALKS:
        try:
            parts.extend(WALKS[name](content))
        except (struct.error, IndexError, ValueError):
            parts.append(("CORRUPT", len(content), 0))
    return name, parts


def head(content: bytes) -> tuple:
    """``format, error_code, w, h, bits, frames`` from headers alone; null where the format does not say."""
    form, parts = walk(content)
    if form is None:
        return None, "FORMAT", None, None, None, None
    at = {}
    for name, place, n in parts:
        at.setdefault(name, (place, n))
    names = [p[0] for p in parts]
    w = h = bits = None
    frames = 1
    try:
        if form == "png":
            w, h, bits = struct.unpack_from(">IIB", content, at["IHDR"][0])
            frames = struct.unpack_from(">I", content, at["acTL"][0])[0] if "acTL" in at else 1
        elif form == "jpeg":
            sof = next(n for n in names if n[:3] == "FFC" and n not in ("FFC4", "FFC8", "FFCC"))
            bits, h, w = struct.unpack_from(">BHH", content, at[sof][0])
        elif form == "gif":
            w, h = struct.unpack_from("<HH", content, 6)
            bits, frames = (content[10] & 7) + 1, names.count("IMAGE")
        elif form == "webp":
            bits, frames = 8, max(1, names.count("ANMF"))
            if "VP8X" in at:
                w, h = (int.from_bytes(content[at["VP8X"][0] + k : at["VP8X"][0] + k + 3], "little") + 1 for k in (4, 7))
            elif "VP8L" in at:
                packed = struct.unpack_from("<I", content, at["VP8L"][0] + 1)[0]
                w, h = (packed & 0x3FFF) + 1, (packed >> 14 & 0x3FFF) + 1
            else:
                w, h = (v & 0x3FFF for v in struct.unpack_from("<HH", content, at["VP8 "][0] + 6))
        elif form == "tiff":
            order = "little" if content[:2] == b"II" else "big"
            value = lambda tag: int.from_bytes(content[at[f"TAG_{tag}"][0] : sum(at[f"TAG_{tag}"])][:4], order)
            w, h = value(256), value(257)
            bits = int.from_bytes(content[at["TAG_258"][0] : at["TAG_258"][0] + 2], order) if "TAG_258" in at else 1
            frames = names.count("TAG_256")
        elif form == "bmp":
            w, h = struct.unpack_from("<ii", content, 18)
            h, bits = abs(h), struct.unpack_from("<H", content, 28)[0]
        elif form == "ico":
            frames = struct.unpack_from("<H", content, 4)[0]
            w, h = (v or 256 for v in content[6:8])
            bits = struct.unpack_from("<H", content, 12)[0]
    except (struct.error, KeyError, IndexError, StopIteration):
        return form, "CORRUPT", None, None, None, None
    return form, "CORRUPT" if "CORRUPT" in at else "OK", w, h, bits, frames


def headers(files: DataFrame) -> DataFrame:
    """One row per file: format, size, bits a sample and frames, without decoding a pixel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, *head(content.as_py() or b"")) for path, content in zip(batch.column(0).to_pylist(), batch.column(1))]
            cols = list(zip(*rows)) or [[]] * 7
            types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["path", "format", "error_code", "w", "h", "bits", "frames"])

    return files.select("path", "content").mapInArrow(run, "path string, format string, error_code string, w bigint, h bigint, bits int, frames int")


def segments(files: DataFrame) -> DataFrame:
    """One row per part of each file, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                form, parts = walk(content.as_py() or b"")
                rows += [(path, form, k, *p) for k, p in enumerate(parts)]
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["path", "format", "seq", "name", "offset", "length"])

    return files.select("path", "content").mapInArrow(run, SEGMENTS)


#: Bytes that a compressed text, and a compressed profile, may unfold to.
MAX_TEXT, MAX_PROFILE = 1 << 20, 16 << 20


def inflated(body: bytes, most: int) -> bytes:
    """The unfolded bytes; zlib.error if they are more than ``most``, found out after as many."""
    stream = zlib.decompressobj()
    out = stream.decompress(body, most + 1)
    if len(out) > most or not stream.eof:
        raise zlib.error("too long or cut off")
    return out


def _png_text(name: str, body: bytes) -> bytes:
    keyword, _, rest = body.partition(b"\0")
    if name == "zTXt":
        rest = inflated(rest[1:], MAX_TEXT)
    elif name == "iTXt":
        packed, rest = rest[0], rest[2:].split(b"\0", 2)[2]
        rest = inflated(rest, MAX_TEXT) if packed else rest
    if len(rest) > MAX_TEXT:
        raise zlib.error("too long")
    return rest if keyword == XMP_KEYWORD else keyword + b": " + rest


def _chained(body: bytes) -> bytes:
    """The bytes of length-prefixed blocks."""
    out, at = b"", 0
    while at < len(body) and body[at]:
        out += body[at + 1 : at + 1 + body[at]]
        at += body[at] + 1
    return out


def blocks_of(content: bytes) -> tuple[str | None, list[tuple[int, str, bytes]]]:
    """The format and ``(seq, kind, payload)`` of the metadata of a file; profiles in several segments are one."""
    form, parts = walk(content)
    out: list[tuple[int, str, bytes]] = []
    for seq, (name, at, n) in enumerate(parts):
        body = content[at : at + n]
        try:
            if form == "png" and name in ("tEXt", "zTXt", "iTXt"):
                out.append((seq, "XMP" if body.startswith(XMP_KEYWORD + b"\0") else "TEXT", _png_text(name, body)))
            elif form == "png" and name == "iCCP":
                out.append((seq, "ICC", inflated(body.partition(b"\0")[2][1:], MAX_PROFILE)))
            elif form == "png" and name in ("eXIf", "pHYs", "bKGD"):
                out.append((seq, {"eXIf": "EXIF", "pHYs": "RESOLUTION", "bKGD": "BACKGROUND"}[name], body))
            elif form == "png" and name in ("gAMA", "cHRM", "sRGB", "cICP", "mDCV", "cLLI"):
                out.append((seq, "COLOUR", body))
            elif form == "jpeg" and name == "FFE1" and body.startswith(EXIF):
                out.append((seq, "EXIF", body[len(EXIF) :]))
            elif form == "jpeg" and name == "FFE1" and body.startswith(XMP):
                out.append((seq, "XMP", body[len(XMP) :]))
            elif form == "jpeg" and name == "FFE2" and body.startswith(ICC):
                before = next((k for k, (_, kind, _) in enumerate(out) if kind == "ICC"), None)
                if before is None:
                    out.append((seq, "ICC", body[len(ICC) + 2 :]))
                else:
                    out[before] = (out[before][0], "ICC", out[before][2] + body[len(ICC) + 2 :])
            elif form == "jpeg" and name in ("FFED", "FFFE"):
                out.append((seq, "IPTC" if name == "FFED" else "TEXT", body))
            elif form == "webp" and name in ("EXIF", "XMP ", "ICCP"):
                out.append((seq, {"EXIF": "EXIF", "XMP ": "XMP", "ICCP": "ICC"}[name], body))
            elif form == "gif" and name == "EXTENSION_FE":
                out.append((seq, "TEXT", _chained(body)))
            elif form == "gif" and name == "EXTENSION_FF":
                kind = {b"XMP DataXMP": "XMP", b"ICCRGBG1012": "ICC"}.get(body[1:12])
                if kind:
                    out.append((seq, kind, body[12:-258] if kind == "XMP" else _chained(body[12:])))
            elif form == "tiff" and name.startswith("TAG_") and int(name[4:]) in TIFF_KINDS:
                out.append((seq, TIFF_KINDS[int(name[4:])], body))
        except (zlib.error, IndexError):
            out.append((seq, "CORRUPT", b""))
    return form, out


def metadata(files: DataFrame) -> DataFrame:
    """One row per metadata block of each file ``(path, content)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                form, found = blocks_of(content.as_py() or b"")
                rows += [(path, form, *b) for b in found]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.string(), pa.binary()))], ["path", "format", "seq", "kind", "payload"])

    return files.select("path", "content").mapInArrow(run, METADATA)


#: Kinds that ``attached`` writes into files of a format; what else a document holds is reported as lost.
CARRIED = {"png": ("EXIF", "XMP", "ICC", "TEXT"), "jpeg": ("EXIF", "XMP", "ICC", "TEXT")}


#: Kinds that are fields of their own in a format; all others are raw blocks.
COMMON = ("RESOLUTION", "BACKGROUND", "COLOUR", "TEXT")


def written(content: bytes, form: str, blocks: list[tuple[str, bytes]]) -> tuple[bytes, list[str]]:
    """The file with the blocks put behind its header, and the kinds of those that it cannot hold, by kind or by size."""
    lost: list[str] = []
    out: list[bytes] = []

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    def segment(mark: int, body: bytes) -> bytes | None:
        return bytes((0xFF, mark)) + struct.pack(">H", len(body) + 2) + body if len(body) <= 65533 else None

    def icc(b: bytes) -> bytes | None:
        size = 65533 - len(ICC) - 2
        parts = [b[k : k + size] for k in range(0, len(b), size)]
        if len(parts) > 255:  # they are numbered by a byte
            return None
        return b"".join(segment(0xE2, ICC + bytes((k + 1, len(parts))) + p) for k, p in enumerate(parts))

    made = {
        "png": {
            "EXIF": lambda b: chunk(b"eXIf", b), "ICC": lambda b: chunk(b"iCCP", b"profile\0\0" + zlib.compress(b)), "XMP": lambda b: chunk(b"iTXt", XMP_KEYWORD + b"\0\0\0\0\0" + b),
            "TEXT": lambda b: chunk(b"tEXt", b"Comment\0" + b),
        },
        "jpeg": {"EXIF": lambda b: segment(0xE1, EXIF + b), "XMP": lambda b: segment(0xE1, XMP + b), "ICC": icc, "TEXT": lambda b: segment(0xFE, b)},
    }.get(form, {})
    for kind, block in blocks:
        body = made[kind](block) if kind in CARRIED.get(form, ()) else None
        if body is None:
            lost.append(kind)
        else:
            out.append(body)
    at = {"png": 33, "jpeg": 2}.get(form, len(content))
    return content[:at] + b"".join(out) + content[at:], sorted(set(lost))


def attach(content: bytes, form: str, blocks: list[tuple[str, bytes]]) -> bytes:
    """The file with the blocks that it can hold put behind its header."""
    return written(content, form, blocks)[0]


def kept(blocks: DataFrame, policy: str) -> DataFrame:
    """Metadata blocks ``(path, kind, payload)`` after a policy.

    PRESERVE_ALL keeps all and DROP_ALL none, KEEP_COMMON_ONLY the fields (``COMMON``) and KEEP_RAW_ONLY the other blocks.
    STRIP_GPS and NORMALIZE_EXIF edit Exif bytes; a block that cannot be read is kept as it is by NORMALIZE_EXIF and left out by
    STRIP_GPS, which also leaves out XMP and raw profiles in texts, since they can hold a place.
    """
    if policy not in POLICIES:
        raise ValueError(f"no policy {policy}")
    if policy == "PRESERVE_ALL":
        return blocks
    if policy == "DROP_ALL":
        return blocks.filter("false")
    if policy.startswith("KEEP_"):
        common = F.col("kind").isin(*COMMON)
        return blocks.filter(common if policy == "KEEP_COMMON_ONLY" else ~common)
    edited = exif.edited(blocks.filter("kind = 'EXIF'"), "payload", policy)
    rest = blocks.filter("kind <> 'EXIF'")
    if policy == "STRIP_GPS":
        edited = edited.filter("error_code = 'OK'")
        rest = rest.filter(~((F.col("kind") == "XMP") | (F.col("kind") == "TEXT") & F.coalesce(F.col("payload").substr(1, 11) == F.lit(b"Raw profile"), F.lit(False))))
    return rest.unionByName(edited.drop("error_code"))


def attached(encoded: DataFrame, blocks: DataFrame) -> DataFrame:
    """Encoded files ``(path, format, error_code, content)`` with the blocks ``(path, seq, kind, payload)`` of their paths, and ``lost``.

    ``lost`` names the kinds of blocks that the file does not hold, be it for the format or for their size, in order. The blocks of one path meet in one row, as its bytes do.
    """
    lists = blocks.groupBy(F.col("path").alias("__path")).agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "payload"))).alias("__blocks"))
    joined = encoded.join(lists, F.col("path") == F.col("__path"), "left").drop("__path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, lost = [], []
            for form, content, found in zip(batch.column("format").to_pylist(), batch.column("content"), batch.column("__blocks").to_pylist()):
                pairs = [(b["kind"], b["payload"]) for b in found or []]
                made, left = (None, sorted({k for k, _ in pairs})) if content.as_py() is None else written(content.as_py(), form, pairs)
                out.append(made)
                lost.append(left)
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("format"), batch.column("error_code"), pa.array(out, pa.binary()), pa.array(lost, pa.list_(pa.string()))], ["path", "format", "error_code", "content", "lost"])

    return joined.mapInArrow(run, "path string, format string, error_code string, content binary, lost array<string>")


def transcode(files: DataFrame, form: str, policy: str = "PRESERVE_ALL", **options) -> DataFrame:
    """``path, format, error_code, content, lost``: every file in another format, its metadata carried over by ``policy``."""
    from . import files as io

    return attached(io.encode(io.items(files), form, **options), kept(metadata(files), policy).select("path", "seq", "kind", "payload"))


__all__ = ["CARRIED", "attach", "attached", "blocks_of", "head", "headers", "inflated", "kept", "metadata", "segments", "transcode", "walk", "written"]
