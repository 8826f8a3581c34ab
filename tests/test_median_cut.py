"""Median cut by rounds against the sequential rule, and counts of colours that stop early."""

from collections import Counter

import numpy as np
import pytest

from pixelloom.operators import mediancut, palette


def rasters(spark, seed, documents):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(documents):
        w, h = int(rng.integers(3, 30)), int(rng.integers(3, 20))
        steps = int(rng.choice([2, 5, 40, 256]))
        v = rng.integers(0, steps, (h, w, 4)) * (255 // max(1, steps - 1))
        if d % 3 == 0:
            v[..., 3] = 255
        if d % 4 == 1:
            v[: h // 2] = v[0, 0]  # one colour of very many pixels
        rows += [(d, k, w, h, x, y, *map(int, v[y, x])) for k in range(1) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "doc_id int, item_index int, w int, h int, x int, y int, r int, g int, b int, a int").repartition(4)


@pytest.mark.parametrize("seed, most, broadcast", [(1, 12, 100_000), (2, 5, -1)])
def test_rounds_equal_the_sequential_rule(spark, seed, most, broadcast, monkeypatch):
    monkeypatch.setattr(mediancut, "MAX_BROADCAST", broadcast)
    df = rasters(spark, seed, 5)
    want = Counter(map(tuple, palette.build_palette(df, most).collect()))
    got = Counter(map(tuple, palette.build_palette(df, most, local=0).collect()))
    assert got == want and sum(got.values()) > 8


def test_a_common_colour_and_equal_worths(spark):
    colours = [(10 * k % 251, 7 * k % 251, 0, 255) for k in range(40)] + [(0, 0, 0, 0)] * 3000 + [(255, 0, 0, 255), (0, 255, 0, 255)] * 2
    rows = [(1, 0, 100, 40, k % 100, k // 100, *c) for k, c in enumerate(colours)]
    df = spark.createDataFrame(rows, "doc_id int, item_index int, w int, h int, x int, y int, r int, g int, b int, a int")
    for most in (3, 9):
        assert Counter(map(tuple, palette.build_palette(df, most, local=0).collect())) == Counter(map(tuple, palette.build_palette(df, most).collect()))


def test_replay_splits_before_its_turn_and_then_numbers():
    worth = {"": 10}
    assert mediancut.replay(worth, set(), 3) == ([""], {})
    worth |= {"0": 6, "1": 9}
    assert mediancut.replay(worth, {""}, 3) == (["1"], {})
    worth |= {"10": 2, "11": 1, "00": 1, "01": 1}
    assert mediancut.replay(worth, {"", "1", "0"}, 3) == ([], {"0": 0, "10": 1, "11": 2})


@pytest.mark.parametrize("held", [1_000_000, 3])
def test_few_colours_are_shuffled(spark, held, monkeypatch):
    monkeypatch.setattr(palette, "HELD", held)
    df = rasters(spark, 5, 6)
    by = ["doc_id", "item_index"]
    want = {r.doc_id: r.n for r in palette.histogram(df).groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    for limit in (1, 20, 5000):
        got = {r.doc_id: (r.colors, r.exact) for r in palette.count_colors(df, limit).collect()}
        assert got == {d: (min(n, limit), n <= limit) for d, n in want.items()}
        if held > 3:
            assert palette.few_colours(df, limit, by).count() <= df.rdd.getNumPartitions() * len(want) * (limit + 1)
