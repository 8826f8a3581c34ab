"""Properties of raster operators, and kernels against a plain reading of their rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.operators import animation, join, palette, pixel, resample

RNG = np.random.default_rng(5)


def relation(spark, samples, doc_id=0):
    h, w, n = samples.shape
    names = ["r", "g", "b", "a"] if n == 4 else ["v"]
    rows = [(doc_id, 0, w, h, x, y, *map(int, samples[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "doc_id int, item_index int, w int, h int, x int, y int, " + ", ".join(f"{c} int" for c in names))


def raster(df, channels):
    rows = df.collect()
    out = np.zeros((rows[0].h, rows[0].w, len(channels)), np.int64)
    for r in rows:
        out[r.y, r.x] = [r[c] for c in channels]
    return out


def test_turns_are_inverse(spark):
    s = RNG.integers(0, 256, (3, 5, 4))
    df = relation(spark, s)
    for there, back in ((pixel.flip_h, pixel.flip_h), (pixel.rotate_90_cw, pixel.rotate_90_ccw), (pixel.transpose, pixel.transpose), (pixel.transverse, pixel.transverse)):
        assert np.array_equal(raster(back(there(df)), "rgba"), s)
    assert np.array_equal(raster(pixel.rotate_90_cw(df), "rgba"), np.rot90(s, -1))


def test_crop_outside_gives_nothing(spark):
    df = relation(spark, RNG.integers(0, 256, (3, 5, 4)))
    assert pixel.crop(df, 3, 0, 3, 2).count() == 0
    assert pixel.crop(df, 2, 1, 3, 2).count() == 6


@pytest.mark.parametrize("filter", ["BOX", "TRIANGLE", "CATMULL_ROM", "LANCZOS3", "NEAREST"])
def test_constant_stays_constant_and_same_size_is_identity(spark, filter):
    flat = np.full((6, 7, 1), 93)
    assert (raster(resample.resize(relation(spark, flat), 4, 9, filter, ["v"]), "v") == 93).all()
    s = RNG.integers(0, 256, (5, 6, 1))
    assert np.array_equal(raster(resample.resize(relation(spark, s), 6, 5, filter, ["v"]), "v"), s)


def test_halving_is_the_mean_of_four(spark):
    s = RNG.integers(0, 256, (4, 6, 1))
    got = raster(resample.resize(relation(spark, s), 3, 2, "BOX", ["v"]), "v")[..., 0]
    mean = s[..., 0].reshape(2, 2, 3, 2).mean((1, 3))
    assert np.abs(got - mean).max() <= 1


def test_clear_pixels_do_not_tint(spark):
    s = np.zeros((2, 4, 4), int)
    s[:, :2] = (200, 10, 10, 255)
    s[:, 2:] = (0, 255, 0, 0)
    got = raster(resample.resize(relation(spark, s), 2, 1, "TRIANGLE"), "rgba")
    assert (got[..., 1][got[..., 3] > 0] <= 10).all()


def test_opaque_source_replaces_and_offsets_clip(spark):
    dst, src = RNG.integers(0, 256, (4, 4, 4)), RNG.integers(0, 256, (3, 3, 4))
    src[..., 3] = 255
    got = raster(join.composite(relation(spark, dst), relation(spark, src), -1, 2), "rgba")
    want = dst.copy()
    want[2:4, 0:2] = src[0:2, 1:3]
    assert np.array_equal(got, want)


def test_median_cut_keeps_few_colours_and_bounds_error():
    colours = np.unique(RNG.integers(0, 256, (400, 4)), axis=0)
    pixels = RNG.integers(1, 50, len(colours))
    assert len(palette.cut_boxes(colours, pixels, 16)) == 16
    every = palette.cut_boxes(colours, pixels, len(colours) + 5)
    assert sorted(map(tuple, every)) == sorted(map(tuple, colours))


def test_dither_by_the_rule(spark):
    s = RNG.integers(0, 256, (6, 7, 4))
    s[0, 0, 3] = 0
    table = np.array([(0, 0, 0, 255), (255, 255, 255, 255), (200, 30, 30, 255)])
    got = palette.diffuse(s, table)
    error = {}
    div = lambda a, b: int(a / b)
    for y in range(6):
        for x in range(7) if y % 2 == 0 else range(6, -1, -1):
            c = s[y, x].tolist()
            want = c if c[3] == 0 else [min(255, max(0, v + error.get((y, x, k), 0))) for k, v in enumerate(c)]
            dist = [sum((a - b) ** 2 for a, b in zip(want, e)) for e in table.tolist()]
            i = dist.index(min(dist))
            assert got[y, x] == i
            if c[3] == 0:
                continue
            ahead = 1 if y % 2 == 0 else -1
            for k in range(4):
                d = want[k] - int(table[i][k])
                for yy, xx, part in ((y, x + ahead, 7), (y + 1, x - ahead, 3), (y + 1, x, 5), (y + 1, x + ahead, 1)):
                    error[yy, xx, k] = error.get((yy, xx, k), 0) + div(d * part, 16)
    pal = spark.createDataFrame([(i, *map(int, e)) for i, e in enumerate(table)], "idx int, r int, g int, b int, a int")
    df = palette.dither(relation(spark, s), pal)
    assert {(r.y, r.x): r.idx for r in df.collect()} == {(y, x): int(got[y, x]) for y in range(6) for x in range(7)}


def test_quantize_within_budget_is_exact(spark):
    s = RNG.integers(0, 4, (8, 8, 4)) * 60
    s[..., 3] = 255
    df = relation(spark, s)
    assert np.array_equal(raster(palette.quantize(df, 256), "rgba"), s)
    assert palette.quantize(df, 5).select("r", "g", "b").distinct().count() <= 5


def test_gif_fold_against_a_loop(spark):
    frames, patches = [], []
    canvas_at = {}
    canvas = np.zeros((6, 6, 4), int)
    for i in range(12):
        lft, top, w, h = (int(v) for v in (*RNG.integers(0, 3, 2), *RNG.integers(1, 4, 2)))
        disposal = int(RNG.integers(0, 4))
        frames.append((0, i, lft, top, w, h, disposal))
        before = canvas.copy()
        for y in range(top, top + h):
            for x in range(lft, lft + w):
                if RNG.random() < 0.6:
                    c = [int(v) for v in RNG.integers(0, 256, 3)] + [255]
                    patches.append((0, i, x, y, *c))
                    canvas[y, x] = c
        canvas_at[i] = canvas.copy()
        if disposal == 2:
            canvas[top : top + h, lft : lft + w] = 0
        elif disposal == 3:
            canvas = before
    f = spark.createDataFrame(frames, "doc_id int, item_index int, lft int, top int, width int, height int, disposal int")
    p = spark.createDataFrame(patches, "doc_id int, item_index int, x int, y int, r int, g int, b int, a int")
    for r in animation.canvases_replacing(f, p).collect():
        assert tuple(canvas_at[r.item_index][r.y, r.x]) == (r.r, r.g, r.b, r.a)


def test_equal_rasters(spark):
    df = relation(spark, RNG.integers(0, 256, (3, 3, 4)))
    assert join.raster_equal(df, df).first().equal
    assert not join.raster_equal(df, df.withColumn("r", F.col("r") + 1)).first().equal
    assert not join.raster_equal(df, df.filter("x > 0")).first().equal
