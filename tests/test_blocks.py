import numpy as np

from pixelloom.operators import blocks, pyramid

SIZES = [(1, 1), (8, 8), (13, 9), (16, 3), (5, 17)]
KIND = "doc_id int, item_index int, w int, h int, x int, y int, v int, extra string"


def rasters():
    rng = np.random.default_rng(5)
    return {k: rng.integers(0, 256, (h, w)) for k, (w, h) in enumerate(SIZES)}


def relation(spark, found):
    return spark.createDataFrame([(k, 0, a.shape[1], a.shape[0], x, y, int(a[y, x]), "e") for k, a in found.items() for y in range(a.shape[0]) for x in range(a.shape[1])], KIND)


def cosine(block):
    """The transform by its definition, eight times its size."""
    k, n = np.mgrid[:8, :8]
    c = np.cos((2 * n + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    return 8 * c @ (block - 128) @ c.T


def test_transform_within_one_of_the_definition_and_back(spark):
    found = rasters()
    coded = blocks.forward(blocks.blocks(relation(spark, found)))
    rows = coded.collect()
    assert len(rows) == sum(-(-w // 8) * -(-h // 8) for w, h in SIZES)
    for r in rows:
        a = np.pad(found[r.doc_id], ((0, 8), (0, 8)), mode="edge")[r.by * 8 : r.by * 8 + 8, r.bx * 8 : r.bx * 8 + 8]
        want = cosine(a)
        got = np.array(r.s)
        assert np.abs(got - want).max() <= 8  # one step of the sample's own size
    ones = [1] * 64
    back = blocks.samples(blocks.inverse(blocks.dequantize(blocks.quantize(coded, ones), ones))).collect()
    assert len(back) == sum(w * h for w, h in SIZES)
    assert max(abs(int(found[r.doc_id][r.y, r.x]) - r.v) for r in back) <= 1


def test_halves_away_from_zero(spark):
    df = spark.createDataFrame([(0, 0, 8, 8, 0, 0, [[4, -4, 3, -3, 12, -12, 0, 8]] * 8)], "doc_id int, item_index int, w int, h int, bx int, by int, s array<array<bigint>>")
    assert blocks.quantize(df, [1] * 64).first().s[0] == [1, -1, 0, 0, 2, -2, 0, 1]


def test_empty(spark):
    none = relation(spark, rasters()).limit(0)
    assert blocks.samples(blocks.inverse(blocks.forward(blocks.blocks(none)))).count() == 0
    assert pyramid.pyramid(none, 2).count() == 0


def smaller(a):
    for axis in (1, 0):
        b = np.moveaxis(a, axis, 0)
        p = np.concatenate([b[:1], b, b[-1:]])
        a = np.moveaxis(((p[:-2] + 2 * b + p[2:]) // 4)[::2], 0, axis)
    return a


def larger(a):
    for axis in (1, 0):
        b = np.moveaxis(a, axis, 0)
        n = np.concatenate([b[1:], b[-1:]])
        a = np.moveaxis(np.stack([b, (b + n) // 2], 1).reshape(-1, *b.shape[1:]), 0, axis)
    return a


def test_pyramid_of_odd_sizes(spark):
    found = rasters()
    parts = pyramid.pyramid(relation(spark, found), 3).cache()
    got = {(r.doc_id, r.level, r.x, r.y): (r.w, r.h, r.v) for r in parts.collect()}
    n = 0
    for k, a in found.items():
        for level in range(4):
            small = smaller(a)
            left = a - larger(small)[: a.shape[0], : a.shape[1]] if level < 3 else a
            for (y, x), v in np.ndenumerate(left):
                assert got[k, level, x, y] == (a.shape[1], a.shape[0], v)
                n += 1
            a = small
    assert n == len(got)
    again = pyramid.rebuilt(parts, 3).collect()
    assert len(again) == sum(a.size for a in found.values()) and all(r.v == found[r.doc_id][r.y, r.x] for r in again)
