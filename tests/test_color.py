"""Profiles, curves and look-up tables against plain arithmetic."""

import random
import struct

import numpy as np
import pytest

from pixelloom.model import ImageError
from pixelloom.operators import color


def profile(model, tags):
    at = 132 + 12 * len(tags)
    table, body = b"", b""
    for name, data in tags.items():
        table += struct.pack(">4sII", name, at + len(body), len(data))
        body += data
    return b"\0" * 16 + model + b"\0" * 108 + struct.pack(">I", len(tags)) + table + body


def xyz(column):
    return b"XYZ \0\0\0\0" + struct.pack(">3i", *[round(v * 65536) for v in column])


def para(kind, *values):
    return b"para\0\0\0\0" + struct.pack(">HH", kind, 0) + struct.pack(f">{len(values)}i", *[round(v * 65536) for v in values])


SRGB_PARA = para(3, 2.4, 1 / 1.055, 0.055 / 1.055, 1 / 12.92, 0.04045)


def srgb(v):
    return np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)


def back(v):
    return np.where(v <= 0.0031308, v * 12.92, 1.055 * np.maximum(v, 0) ** (1 / 2.4) - 0.055)


def pixels(spark, n=300):
    rng = random.Random(1)
    rows = [(i, 0, *[rng.randrange(256) for _ in range(4)]) for i in range(n)]
    return rows, spark.createDataFrame([*rows, (n, 0, None, 1, 2, 3)], "x int, y int, r int, g int, b int, a int")


def test_matrix_profile(spark):
    m = color.to_xyz(color.PRIMARIES["P3"])
    found = color.from_icc(profile(b"RGB ", {b"rXYZ": xyz(m[:, 0]), b"gXYZ": xyz(m[:, 1]), b"bXYZ": xyz(m[:, 2]), b"rTRC": SRGB_PARA, b"gTRC": SRGB_PARA, b"bTRC": SRGB_PARA}))
    assert np.allclose(found.matrix, m, atol=1e-4) and np.allclose(m.sum(1), color.D50_XYZ, atol=1e-3)
    rows, df = pixels(spark)
    got = {r.x: (r.r, r.g, r.b, r.a) for r in color.transform(df, found).collect()}
    assert got[300] == (None, None, None, 3) or got[300][3] == 3
    rgb = np.array([r[2:5] for r in rows]) / 255
    want = np.clip(back(np.clip(srgb(rgb) @ np.linalg.solve(np.array(color.SRGB.matrix), m).T, 0, 1)), 0, 1) * 255
    assert max(np.abs(np.array(got[i][:3]) - w).max() for i, w in enumerate(want)) < 0.6 and all(got[r[0]][3] == r[5] for r in rows)


def test_curves_of_a_profile(spark):
    values = [round(65535 * (i / 63) ** 1.7) for i in range(64)]
    curv = b"curv\0\0\0\0" + struct.pack(">I64H", 64, *values)
    gray = color.from_icc(profile(b"GRAY", {b"kTRC": curv}))
    df = spark.createDataFrame([(v, v) for v in range(256)], "x int, v int")
    got = {r.x: r.r for r in color.transform(df, gray, color.Space((color.Curve("LINEAR"),) * 3, color.SRGB.matrix)).collect()}
    want = np.interp(np.arange(256) / 255, np.linspace(0, 1, 64), np.array(values) / 65535) * 255
    assert all(abs(got[v] - want[v]) <= 0.51 for v in range(256))
    round_trip = color.Space((color.Curve("SAMPLED", tuple(v / 65535 for v in values)),) * 3, color.SRGB.matrix)
    rows, px = pixels(spark)
    same = {r.x: (r.r, r.g, r.b) for r in color.transform(px.filter("r is not null"), round_trip, round_trip).collect()}
    assert all(max(abs(p - q) for p, q in zip(same[r[0]], r[2:5])) <= 1 for r in rows)
    for kind, values in ((0, [2.2]), (1, [2.2, 0.9, 0.1]), (2, [2.2, 0.9, 0.05, 0.05]), (3, [2.4, 0.95, 0.05, 0.077, 0.04]), (4, [2.4, 0.9, 0.05, 0.08, 0.04, 0.01, 0.01])):
        c = color._curve(para(kind, *values))
        both = spark.range(1, 101).selectExpr("id / 100D as v").selectExpr("v", f"{c.decode('v')} as l").selectExpr("v", f"{c.encode('l')} as again").collect()
        assert all(abs(r.v - r.again) < 0.01 for r in both if kind not in (1, 2) or r.v > 0.1), kind


def test_refusals():
    with pytest.raises(ImageError, match="UNSUPPORTED"):
        color.from_icc(profile(b"CMYK", {b"A2B0": b"mft2"}))
    with pytest.raises(ImageError, match="CORRUPT"):
        color.from_icc(b"short")
    with pytest.raises(ImageError, match="UNSUPPORTED"):
        color.transform(None, color.SRGB, premultiplied=True)
    with pytest.raises(ImageError, match="UNSUPPORTED"):
        color.space("NTSC", "SRGB")


def test_look_up_table(spark):
    rng = np.random.default_rng(3)
    size = 5
    grid = rng.random((size, size, size, 3))
    rows, df = pixels(spark, 200)
    got = {r.x: (r.r, r.g, r.b) for r in color.lut_transform(df.filter("r is not null"), [tuple(map(float, p)) for p in grid.reshape(-1, 3)], size).collect()}
    for x, _, *rgba in rows:
        at = np.array(rgba[:3]) / 255 * (size - 1)
        lo = np.minimum(np.floor(at).astype(int), size - 2)
        f = at - lo
        want = sum(np.prod([f[i] if k >> i & 1 else 1 - f[i] for i in range(3)]) * grid[tuple(lo + [k >> i & 1 for i in range(3)])] for k in range(8)) * 255
        assert np.abs(np.array(got[x]) - want).max() <= 0.51
