"""Round trips of every writer, hostile bytes, and files as DataFrames."""

import numpy as np
import pytest

from pixelloom.model import ImageError, Limits
from pixelloom.sources import codecs as C
from pixelloom.sources import files

RNG = np.random.default_rng(3)
SIZES = [(1, 1), (7, 5), (13, 33)]


def noise(h, w, n=4, dtype=np.uint8, few=False):
    s = RNG.integers(0, 256 if dtype == np.uint8 else 65536, (h, w, n)).astype(dtype)
    if few:
        s = (s // 64 * 64).astype(dtype)
        s[..., 3:] = 255
    elif n == 4:
        s[..., 3] = np.maximum(s[..., 3], 1)
    return s


def trip(name, rasters, **options):
    doc = C.Document([C.Item(r, "FRAME" if len(rasters) > 1 else "IMAGE", i, (5, 100)) for i, r in enumerate(rasters)], dpi=(72, 72), loop_count=3)
    content = C.save(doc, name, **options)
    assert C.name_of(content) == name
    return C.load(content)


def same(doc, rasters):
    return len(doc.items) == len(rasters) and all(np.array_equal(i.raster.samples, r.samples) for i, r in zip(doc.items, rasters))


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("dtype", [np.uint8, np.uint16])
@pytest.mark.parametrize("model", ["GRAY", "RGBA"])
def test_png_and_tiff(size, dtype, model):
    r = C.Raster(noise(*size, 1 if model == "GRAY" else 4, dtype), model)
    for interlaced in (False, True):
        assert same(trip("png", [r], interlaced=interlaced), [r])
    for filter in ("NONE", "SUB", "UP", "AVERAGE", "PAETH"):
        assert same(trip("png", [r], filter=filter), [r])
    for compression in ("NONE", "LZW", "DEFLATE", "PACKBITS"):
        for big_endian in (False, True):
            assert same(trip("tiff", [r], compression=compression, big_endian=big_endian, bigtiff=not big_endian, rows_per_strip=3), [r])


@pytest.mark.parametrize("size", SIZES)
def test_lossless_8_bit(size):
    few, full = C.Raster(noise(*size, few=True)), C.Raster(noise(*size))
    for options in ({}, {"rle": True}, {"top_down": True}, {"palette": "NEVER"}):
        assert same(trip("bmp", [few], **options), [few])
    assert same(trip("bmp", [full]), [full])
    for payload in ("PNG", "DIB"):
        assert same(trip("ico", [full], payload=payload), [full])
    assert same(trip("webp", [full]), [full])
    for interlace in (False, True):
        assert same(trip("gif", [few], interlace=interlace), [few])


def test_animations_and_pages():
    a, b = C.Raster(noise(9, 8, few=True)), C.Raster(noise(9, 8, few=True))
    for name in ("gif", "png", "webp"):
        doc = trip(name, [a, b, a])
        assert same(doc, [a, b, a]) and doc.loop_count == 3 and doc.items[1].role == "FRAME"
    assert same(trip("tiff", [a, b]), [a, b])


def test_gif_frames_are_cut_to_what_changes():
    base = noise(30, 40, few=True)
    frames = []
    for k in range(6):
        f = base.copy()
        f[3 + k : 6 + k, 5 + k : 9 + k, :3] = 17
        if k == 3:
            f[10:15, 10:15] = 0
        frames.append(f)
    frames.insert(2, frames[1].copy())
    rasters = [C.Raster(f) for f in frames]
    assert same(trip("gif", rasters), rasters)
    boxes = C.gif.plan(frames)
    assert boxes[2][2:4] == (1, 1) and boxes[1][2] < 10 and boxes[3][4] == 2 and boxes[4][2:4] == (40, 30)
    small = C.save(C.Document([C.Item(r) for r in rasters]), "gif")
    assert len(small) < 7 * len(C.save(C.Document([C.Item(rasters[0])]), "gif")) * 0.8


@pytest.mark.parametrize("subsampling", ["444", "422", "420"])
def test_jpeg_is_close(subsampling):
    y, x = np.mgrid[:37, :45]
    s = np.stack([x * 5, y * 6, (x + y) * 3, 0 * x + 255], 2).astype(np.uint8)
    got = trip("jpeg", [C.Raster(s)], quality=92, subsampling=subsampling).items[0].raster.samples
    assert np.abs(got.astype(int) - s).mean() < 4
    gray = trip("jpeg", [C.Raster(s[..., :1].copy(), "GRAY")], quality=92).items[0].raster
    assert gray.model == "GRAY" and np.abs(gray.samples.astype(int) - s[..., :1]).mean() < 2


@pytest.mark.parametrize("predictor", range(1, 8))
def test_lossless_jpeg(predictor):
    for model, n in (("GRAY", 1), ("RGBA", 4)):
        for dtype in (np.uint8, np.uint16):
            s = noise(9, 7, n, dtype)
            if n == 4:
                s[..., 3] = np.iinfo(dtype).max
            assert same(trip("jpeg", [C.Raster(s, model)], lossless_predictor=predictor), [C.Raster(s)])


def test_orientation_is_undone():
    r = C.Raster(noise(3, 5))
    for o, turned in ((6, np.rot90(r.samples, -1)), (3, np.rot90(r.samples, 2)), (8, np.rot90(r.samples)), (2, r.samples[:, ::-1])):
        assert np.array_equal(C.base.oriented(r, o).samples, turned)


@pytest.mark.parametrize("name", ["png", "bmp", "gif", "tiff", "jpeg", "webp", "ico"])
def test_hostile_bytes_only_raise_image_errors(name):
    content = C.save(C.Document([C.Item(C.Raster(noise(12, 11, few=True)))]), name)
    for k in range(0, len(content), max(1, len(content) // 60)):
        try:
            C.load(content[:k])
        except ImageError:
            pass
    for _ in range(150):
        damaged = bytearray(content)
        damaged[RNG.integers(len(content))] = RNG.integers(256)
        try:
            C.load(bytes(damaged))
        except ImageError:
            pass


def test_limits_and_refusals():
    content = C.save(C.Document([C.Item(C.Raster(noise(20, 20)))]), "png")
    with pytest.raises(ImageError) as e:
        C.load(content, Limits(max_decoded_pixels=399))
    assert e.value.code == "LIMIT"
    with pytest.raises(ImageError) as e:
        C.save(C.Document([C.Item(C.Raster(noise(40, 40)))]), "gif")
    assert e.value.code == "UNSUPPORTED"
    with pytest.raises(ImageError) as e:
        C.load(b"hello")
    assert e.value.code == "FORMAT"


def test_files(spark, tmp_path):
    for i, name in enumerate(("png", "bmp", "gif", "tiff", "webp", "ico", "jpeg")):
        (tmp_path / f"a{i}.{name}").write_bytes(C.save(C.Document([C.Item(C.Raster(noise(9, 11, few=True)))]), name))
    (tmp_path / "bad.png").write_bytes(b"\x89PNG\r\n\x1a\nxx")
    (tmp_path / "none.txt").write_bytes(b"hello")
    found = files.read_files(spark, str(tmp_path))
    codes = {(r.format, r.error_code) for r in files.documents(found).collect()}
    assert ("png", "CORRUPT") in codes and (None, "FORMAT") in codes and ("webp", "OK") in codes
    items = files.items(found)
    assert files.pixels(items).count() == 7 * 99
    back = files.items(files.encode(items, "png")).alias("b")
    assert items.alias("a").join(back, "path").filter("a.model = b.model and a.samples <> b.samples").count() == 0
    # The JVM's own decoder reads what we write.
    assert spark.read.format("image").option("dropInvalid", True).load(str(tmp_path)).count() >= 4


def test_streams(spark, tmp_path):
    from pixelloom.streaming import frames

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(C.save(C.Document([C.Item(C.Raster(noise(3, 3)))]), "png"))
    q = files.stream_files(spark, str(tmp_path / "in")).select("path", "format").writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.format for r in spark.table("arrived").collect()] == ["png"]
    rows = spark.createDataFrame([(1, 0, 0, 0, 5), (1, 2, 0, 0, 7), (1, 1, 0, 0, 6)], "doc_id bigint, item_index int, x int, y int, v int")
    rows.coalesce(1).write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "p"))
    q = frames.latest_canvas(stream).writeStream.format("memory").outputMode("update").queryName("canvas").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.item_index, r.v) for r in spark.table("canvas").collect()] == [(2, 7)]
