import struct

import numpy as np
import pytest

from pixelloom.model import ImageError
from pixelloom.operators import exif
from pixelloom.sources import codecs as C
from pixelloom.sources import datasource


def block(order, orientation=6):
    o = {"<": b"II", ">": b"MM"}[order]
    head = o + struct.pack(order + "HI", 42, 8)
    first = struct.pack(order + "H", 3) + struct.pack(order + "HHIHH", 0x0112, 3, 1, orientation, 0) + struct.pack(order + "HHII", 0x8825, 4, 1, 50) + struct.pack(order + "HHII", 0xA000, 4, 1, 77) + struct.pack(order + "I", 0)
    gps = struct.pack(order + "H", 1) + struct.pack(order + "HHII", 2, 5, 1, 68) + struct.pack(order + "I", 0)
    return head + first + gps + struct.pack(order + "II", 4812, 100)


@pytest.mark.parametrize("order", ["<", ">"])
def test_edits(order):
    data = block(order)
    assert exif.tags(data)[0x0112] == (6,) and 0x8825 in exif.tags(data)
    out = exif.strip_gps(data)
    assert len(out) == len(data) and 0x8825 not in exif.tags(out) and exif.tags(out)[0xA000] == (77,) and struct.pack(order + "I", 4812) not in out
    assert exif.tags(exif.normalize(data))[0x0112] == (1,)
    assert exif.thumbnail(data) is None and C.base.exif_orientation(data) == 6


def test_damaged_blocks(spark):
    for k in range(len(block("<"))):
        for f in (exif.strip_gps, exif.normalize, exif.tags):
            try:
                f(block("<")[:k])
            except ImageError:
                pass
    df = spark.createDataFrame([(1, bytearray(block("<"))), (2, bytearray(b"xx")), (3, None)], "k int, data binary")
    got = {r.k: r.error_code for r in exif.edited(df, "data", "STRIP_GPS").collect()}
    assert got == {1: "OK", 2: "CORRUPT", 3: "OK"}


def test_data_source(spark, tmp_path):
    s = np.random.default_rng(1).integers(0, 256, (5, 6, 4)).astype(np.uint8)
    s[..., 3] = 255
    (tmp_path / "a.png").write_bytes(C.save(C.Document([C.Item(C.Raster(s))]), "png"))
    (tmp_path / "b.bmp").write_bytes(b"BM" + b"\0" * 30)
    datasource.register(spark)
    rows = {r.format: r for r in spark.read.format("pixelloom").option("path", str(tmp_path)).load().collect()}
    assert bytes(rows["png"].samples) == s.tobytes() and rows["bmp"].error_code != "OK"
    small = spark.read.format("pixelloom").option("path", str(tmp_path)).option("maxDecodedPixels", "10").load()
    assert small.filter("format = 'png'").first().error_code == "LIMIT"
