"""Canvases of animations: their pixels stay where their frames were dealt to."""

import random
from collections import Counter

import pytest

from pixelloom.operators import animation
from pixelloom.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
FRAME = "doc_id int, item_index int, lft int, top int, width int, height int, disposal int, dispose int, blend int"
PIXEL = "doc_id int, item_index int, x int, y int, r int, g int, b int, a int"


def shuffles(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in line and "REPARTITION_BY_NUM" not in line]


@pytest.mark.parametrize("name", ["w3_webp_canvases", "w2_apng_canvases", "w2_apng_canvas", "w3_webp_canvas", "w1_gif_canvases"])
def test_only_frames_are_shuffled(spark, name):
    assert shuffles(QUERIES[name](spark, DATA)) == []


def animations(spark, opaque):
    rng = random.Random(5)
    frames, pixels, every = [], [], []
    for d in range(6):
        for k in sorted(rng.sample(range(40), rng.randrange(1, 12))):
            f = (d, k, rng.randrange(4), rng.randrange(4), rng.randrange(1, 5), rng.randrange(1, 5), rng.randrange(4), rng.randrange(3), rng.randrange(2))
            frames.append(f)
            for x in range(f[2], f[2] + f[4]):
                for y in range(f[3], f[3] + f[5]):
                    a = rng.choice((0, 255)) if opaque else rng.choice((0, 255, rng.randrange(256)))
                    p = (d, k, x, y, *[rng.randrange(256) if a else 0 for _ in "rgb"], a)
                    every.append(p)
                    if p[7]:
                        pixels.append(p)
    f = spark.createDataFrame(frames, FRAME)
    return f, spark.createDataFrame(pixels, PIXEL), spark.createDataFrame(every, PIXEL).join(f, ["doc_id", "item_index"]), frames, pixels


def rows(df):
    return Counter(tuple(r) for r in df.select("doc_id", "item_index", "x", "y", "r", "g", "b", "a").collect())


def test_replacing_equals_a_walk_over_the_frames(spark):
    f, px, whole, frames, pixels = animations(spark, True)
    want = Counter()
    for d in range(6):
        own = [x for x in frames if x[0] == d]
        cells = {p[2:4] for p in pixels if p[0] == d} | {(x, y) for g in own if g[6] == 2 for x in range(g[2], g[2] + g[4]) for y in range(g[3], g[3] + g[5])}
        screen = {}
        for g in own:
            shown = screen | {p[2:4]: p[4:] for p in pixels if p[:2] == g[:2]}
            want.update((*g[:2], *c, *shown.get(c, (0, 0, 0, 0))) for c in cells)
            if g[6] != 3:
                screen = {c: v for c, v in shown.items() if not (g[6] == 2 and g[2] <= c[0] < g[2] + g[4] and g[3] <= c[1] < g[3] + g[5])}
    assert rows(animation.canvases_replacing(f, px)) == want
    assert rows(animation.canvases_replacing(f, whole, whole=True)) == want


@pytest.mark.parametrize("over", [animation.APNG_OVER, animation.WEBP_OVER])
def test_blending_of_whole_patches_is_that_of_joined_ones(spark, over):
    f, px, whole, frames, _ = animations(spark, False)
    every = rows(animation.canvases_blending(f, px, over))
    assert rows(animation.canvases_blending(f, whole, over, whole=True)) == every
    last = {d: max(x[1] for x in frames if x[0] == d) for d in range(6)}
    want = Counter((k[0], *k[2:]) for k in every if k[1] == last[k[0]])
    for p, w in ((px, False), (whole, True)):
        assert Counter(tuple(r) for r in animation.canvas_blending(f, p, over, whole=w).select("doc_id", "x", "y", "r", "g", "b", "a").collect()) == want
