"""Parts and metadata of files, and metadata carried over to another format."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.operators import animation, join, palette
from pixelloom.sources import codecs, structure
from pixelloom.sources.codecs import Document, Item, Raster


def exif_block():
    """A little-endian directory with an orientation and positions."""
    head = b"II*\0" + struct.pack("<I", 8)
    ifd = struct.pack("<H", 2) + struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0) + struct.pack("<HHII", 0x8825, 4, 1, 38) + struct.pack("<I", 0)
    gps = struct.pack("<H", 1) + struct.pack("<HHI4s", 1, 2, 2, b"N\0\0\0") + struct.pack("<I", 0)
    return head + ifd + gps


def picture(form, **options):
    y, x = np.mgrid[0:12, 0:20]
    samples = np.stack((x * 12, y * 20, x + y, np.full_like(x, 255)), 2).astype(np.uint8)
    return codecs.save(Document([Item(Raster(samples, "RGBA"))], form), form, **options)


ICC = bytes(range(256)) * 300  # more than one segment holds
BLOCKS = [("EXIF", exif_block()), ("XMP", b"<x:xmpmeta/>"), ("ICC", ICC)]


@pytest.mark.parametrize("form", ["png", "jpeg"])
def test_blocks_come_back(form):
    content = structure.attach(picture(form), form, BLOCKS)
    assert [(k, b) for _, k, b in structure.blocks_of(content)[1] if k in ("EXIF", "XMP", "ICC")] == BLOCKS
    assert codecs.load(content).items[0].raster.samples.shape[2] in (1, 3, 4)


@pytest.mark.parametrize("form", ["png", "jpeg", "gif", "tiff", "webp"])
def test_parts_cover_the_file(form):
    content = picture(form)
    name, parts = structure.walk(content)
    assert name == form and parts and all(at + n <= len(content) for _, at, n in parts)
    whole = {"png": ["IHDR", "IEND"], "jpeg": ["FFD8", "FFC0", "FFDA", "DATA", "FFD9"], "gif": ["HEADER", "IMAGE", "TRAILER"], "tiff": ["TAG_256", "TAG_273"], "webp": ["VP8L"]}
    assert set(whole[form]) <= {p[0] for p in parts}
    assert structure.walk(content[:-7])[1] != parts
    assert structure.walk(b"") == (None, [])


def test_text_of_all_three_kinds():
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    png = picture("png")
    made = png[:33] + chunk(b"tEXt", b"A\0one") + chunk(b"zTXt", b"B\0\0" + zlib.compress(b"two")) + chunk(b"iTXt", b"C\0\1\0en\0\0" + zlib.compress("drei ü".encode())) + chunk(b"zTXt", b"D\0\0bad") + chunk(b"bKGD", b"\0\1\0\2\0\3") + png[33:]
    assert [(k, b) for _, k, b in structure.blocks_of(made)[1]] == [("TEXT", b"A: one"), ("TEXT", b"B: two"), ("TEXT", "C: drei ü".encode()), ("CORRUPT", b""), ("BACKGROUND", b"\0\1\0\2\0\3")]


def test_tables_and_transcoding(spark):
    content = structure.attach(picture("png"), "png", BLOCKS)
    rows = [("a", content), ("b", picture("png")), ("c", None), ("d", b"not a picture"), ("a2", content)]
    df = spark.createDataFrame(rows, "path string, content binary").withColumn("seq", F.lit("clash"))
    parts = structure.segments(df).collect()
    assert {r.path for r in parts} == {"a", "a2", "b"} and [r.name for r in parts if r.path == "b"][0] == "IHDR"
    for r in parts:
        assert r.name == "CORRUPT" or r.offset + r.length <= len(dict(rows)[r.path])
    kinds = structure.metadata(df).groupBy("path").agg(F.array_sort(F.collect_set("kind")).alias("k")).collect()
    assert {r.path: set(r.k) for r in kinds}["a"] == {"EXIF", "XMP", "ICC"}
    out = {r.path: r for r in structure.transcode(df, "jpeg", quality=90).collect()}
    assert set(out) == {"a", "b", "a2"} and out["a"].lost == []
    assert [(k, b) for _, k, b in structure.blocks_of(bytes(out["a"].content))[1]] == BLOCKS and not structure.blocks_of(bytes(out["b"].content))[1]
    plain = {r.path: r for r in structure.transcode(df, "jpeg", "DROP_ALL").collect()}
    assert not structure.blocks_of(bytes(plain["a"].content))[1]
    stripped = {r.path: r for r in structure.transcode(df, "png", "STRIP_GPS").collect()}
    found = dict((k, b) for _, k, b in structure.blocks_of(bytes(stripped["a"].content))[1])
    assert found["ICC"] == ICC and b"N\0\0\0" not in found["EXIF"] and struct.unpack_from("<H", found["EXIF"], 8)[0] == 1
    bmp = {r.path: r for r in structure.transcode(df, "bmp").collect()}
    assert bmp["a"].lost == ["EXIF", "ICC", "XMP"] and bmp["b"].lost == []


def test_palettes_of_more_than_256_entries_are_refused(spark):
    entries = spark.range(257).selectExpr("cast(id as int) as idx", "cast(id % 256 as int) as r", "0 as g", "0 as b", "255 as a")
    px = spark.range(4).selectExpr("0 as doc_id", "0 as item_index", "4 as w", "1 as h", "cast(id as int) as x", "0 as y", "cast(id as int) as r", "0 as g", "0 as b", "255 as a")
    assert join.palette_apply(px, entries.filter("idx < 256")).count() == 4
    for use in (lambda: join.palette_apply(px, entries), lambda: join.from_palette(px.withColumnRenamed("r", "v").drop("g", "b", "a"), entries), lambda: palette.dither(px, entries)):
        with pytest.raises(Exception, match="UNSUPPORTED"):
            use().collect()


def test_canvases_of_a_sequence(spark):
    frames = [(0, 0, 0, 0, 2, 1, 0, 1, 0), (0, 1, 0, 0, 1, 1, 2, 1, 0), (0, 2, 1, 0, 1, 1, 1, 0, 0), (0, 3, 0, 0, 1, 1, 0, 1, 0)]  # dispose, blend
    f = spark.createDataFrame(frames, "doc_id int, item_index int, lft int, top int, width int, height int, dispose int, blend int, z int")
    px = spark.createDataFrame([(0, 0, 0, 0, 10, 0, 0, 255), (0, 0, 1, 0, 20, 0, 0, 255), (0, 1, 0, 0, 30, 0, 0, 255), (0, 2, 1, 0, 40, 0, 0, 128), (0, 3, 0, 0, 99, 0, 0, 0)], "doc_id int, item_index int, x int, y int, r int, g int, b int, a int")
    got = {(r.item_index, r.x): (r.r, r.a) for r in animation.canvases_blending(f, px).collect()}
    # Frame 1 goes back to what was before, frame 2 replaces and is cleared, frame 3 draws nothing.
    assert got == {(0, 0): (10, 255), (0, 1): (20, 255), (1, 0): (30, 255), (1, 1): (20, 255), (2, 0): (10, 255), (2, 1): (40, 128), (3, 0): (10, 255), (3, 1): (0, 0)}
    last = {r.x: (r.r, r.a) for r in animation.canvas_blending(f, px).collect()}
    assert last == {0: (10, 255), 1: (0, 0)}


@pytest.mark.parametrize("form", ["png", "jpeg", "gif", "tiff", "webp", "bmp", "ico"])
def test_headers_without_decoding(spark, form):
    content = picture(form)
    df = spark.createDataFrame([("a", content), ("b", content[: len(content) // 2]), ("c", None), ("d", b"??"), ("e", content[:5])], "path string, content binary")
    got = {r.path: r for r in structure.headers(df).collect()}
    assert (got["a"].format, got["a"].error_code, got["a"].w, got["a"].h, got["a"].frames) == (form, "OK", 20, 12, 1)
    assert got["c"].error_code == got["d"].error_code == "FORMAT" and got["e"].error_code in ("FORMAT", "CORRUPT")


def test_refusals_of_rectangles_and_alpha(spark):
    from pixelloom.model import ImageError
    from pixelloom.operators import pixel

    px = spark.createDataFrame([(0, 0, 2, 1, x, 0, 10, 20, 30, 128) for x in (0, 1)], "doc_id int, item_index int, w int, h int, x int, y int, r int, g int, b int, a int")
    assert pixel.crop(px, 1, 0, 1, 1, strict=True).count() == 1 and pixel.crop(px, 1, 0, 2, 1).count() == 0
    with pytest.raises(Exception, match="INTERNAL"):
        pixel.crop(px, 1, 0, 2, 1, strict=True).collect()
    with pytest.raises(ImageError, match="UNSUPPORTED"):
        pixel.premultiply(px, "PREMULTIPLIED")
    with pytest.raises(ImageError, match="UNSUPPORTED"):
        pixel.unpremultiply(px, "STRAIGHT")
    other = px.withColumn("r", F.when(F.col("x") == 1, 11).otherwise(F.col("r")))
    assert {(r.side, r.x, r.r) for r in join.pixels_not_in(px, other, both=True).collect()} == {("a", 1, 10), ("b", 1, 11)}


def test_codecs_can_be_added():
    from types import SimpleNamespace

    from pixelloom.model import ImageError

    raw = SimpleNamespace(matches=lambda c: c[:4] == b"RAW0", load=lambda c, limits: Document([Item(Raster(np.full((1, 1, 4), c[4], np.uint8), "RGBA"))], "raw"))
    codecs.register("raw", raw)
    try:
        assert codecs.name_of(b"RAW0\x07") == "raw" and codecs.load(b"RAW0\x07").items[0].raster.samples[0, 0, 0] == 7
        with pytest.raises(ImageError, match="INVALID"):
            codecs.register("raw", raw)
        with pytest.raises(ImageError, match="UNSUPPORTED"):
            codecs.save(Document([], "raw"), "raw")
    finally:
        del codecs.REGISTRY["raw"]


def test_documents_that_stay_incomplete(spark, tmp_path):
    from pixelloom.streaming import frames

    schema = "ts timestamp, doc_id long, item_index int, item_count int"
    rows = [("2024-01-01 00:00:00", 1, 0, 2), ("2024-01-01 00:01:00", 1, 1, 2), ("2024-01-01 00:00:30", 2, 0, 3), ("2024-01-01 00:02:00", 2, 0, 3)]
    make = lambda x: spark.createDataFrame(x, "ts string, doc_id long, item_index int, item_count int").selectExpr("cast(ts as timestamp) as ts", "doc_id", "item_index", "item_count")
    assert {(r.doc_id, r.frames, r.complete) for r in frames.arrived(make(rows)).collect()} == {(1, 2, True), (2, 1, False)}
    make(rows).coalesce(1).write.parquet(f"{tmp_path}/in")
    make([("2024-01-01 05:00:00", 9, 0, 1)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = frames.arrived(stream).writeStream.format("memory").outputMode("append").queryName("arrived").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    # The document of the last hour may still get items; the others are over, one of them incomplete.
    assert {(r.doc_id, r.frames, r.complete) for r in spark.table("arrived").collect()} == {(1, 2, True), (2, 1, False)}


def test_files_are_written_whole(spark, tmp_path):
    from pixelloom.sources import datasource, files

    datasource.register(spark)
    df = spark.createDataFrame([("in/a", picture("png")), ("../b", picture("png")), ("c", b"??")], "path string, content binary")
    encoded = files.encode(files.items(df), "bmp").unionByName(spark.createDataFrame([("d", "bmp", "UNSUPPORTED", None)], "path string, format string, error_code string, content binary"))
    out = tmp_path / "out"
    for _ in range(2):  # a second time puts the same bytes there
        encoded.write.format("pixelloom").mode("append").option("path", str(out)).save()
    assert sorted(str(p.relative_to(out)) for p in out.rglob("*") if p.is_file()) == ["_SUCCESS", "b.bmp", "in/a.bmp"]
    back = spark.read.format("pixelloom").option("path", str(out)).load()
    assert {(r.format, r.error_code, r.w, r.h) for r in back.collect()} == {("bmp", "OK", 20, 12)} and back.count() == 2
    with pytest.raises(Exception, match="files already"):
        encoded.write.format("pixelloom").mode("overwrite").option("path", str(out)).save()


def block_rows(spark):
    exif_block, big = b"II*\0\x08\0\0\0\0\0\0\0\0\0", b"<x:xmpmeta/>" + b" " * 70_000
    rows = [("p", 0, "EXIF", exif_block), ("p", 1, "XMP", big), ("p", 2, "TEXT", b"Comment: hello"), ("p", 3, "RESOLUTION", b"123456789"), ("p", 4, "ICC", b"i" * 70_000), ("p", 5, "TEXT", b"Raw profile type exif: 00"), ("p", 6, "CORRUPT", b""), ("p", 7, "IPTC", b"x")]
    return spark.createDataFrame([(p, k, kind, bytearray(b)) for p, k, kind, b in rows], "path string, seq int, kind string, payload binary")


@pytest.mark.parametrize("policy, kinds", [
    ("PRESERVE_ALL", "EXIF XMP TEXT RESOLUTION ICC TEXT CORRUPT IPTC"), ("DROP_ALL", ""), ("KEEP_RAW_ONLY", "EXIF XMP ICC CORRUPT IPTC"),
    ("KEEP_COMMON_ONLY", "TEXT RESOLUTION TEXT"), ("STRIP_GPS", "EXIF TEXT RESOLUTION ICC CORRUPT IPTC"), ("NORMALIZE_EXIF", "EXIF XMP TEXT RESOLUTION ICC TEXT CORRUPT IPTC"),
])
def test_policies(spark, policy, kinds):
    assert sorted(r.kind for r in structure.kept(block_rows(spark), policy).collect()) == sorted(kinds.split())
    with pytest.raises(ValueError):
        structure.kept(block_rows(spark), "KEEP")


def test_what_a_file_cannot_hold_is_reported(spark):
    encoded = spark.createDataFrame([("p", "jpeg", "OK", bytearray(picture("jpeg")))], "path string, format string, error_code string, content binary")
    got = structure.attached(encoded, block_rows(spark)).first()
    assert got.lost == ["CORRUPT", "IPTC", "RESOLUTION", "XMP"]  # XMP for its size
    held = structure.blocks_of(bytes(got.content))[1]
    assert sorted(k for _, k, _ in held if k in ("EXIF", "ICC", "TEXT", "XMP")) == ["EXIF", "ICC", "TEXT", "TEXT"] and len(next(b for _, k, b in held if k == "ICC")) == 70_000
    assert structure.written(picture("jpeg"), "jpeg", [("ICC", b"x" * (256 * 65519))]) == (picture("jpeg"), ["ICC"])
    assert structure.written(picture("png"), "png", [("XMP", b"x" * 70_000)])[1] == []


def test_texts_that_unfold_without_end_are_corrupt():
    bomb = zlib.compress(b"\0" * (structure.MAX_TEXT + 1))
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    png = picture("png")
    for body in (chunk(b"zTXt", b"k\0\0" + bomb), chunk(b"iTXt", b"k\0\1\0\0\0" + bomb), chunk(b"zTXt", b"k\0\0" + zlib.compress(b"abc")[:-2]), chunk(b"tEXt", b"k\0" + b"a" * (structure.MAX_TEXT + 1))):
        assert ("CORRUPT", b"") in [b[1:] for b in structure.blocks_of(png[:33] + body + png[33:])[1]]
    good = chunk(b"zTXt", b"k\0\0" + zlib.compress(b"a" * structure.MAX_TEXT))
    assert structure.blocks_of(png[:33] + good + png[33:])[1][0][2] == b"k: " + b"a" * structure.MAX_TEXT
