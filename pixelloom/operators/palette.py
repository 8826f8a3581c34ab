"""Colour counting, palettes, quantization and dithering.

Every clear pixel counts as one colour. Histograms are aggregated before they are shuffled; palettes and median cut
work on the histogram of distinct colours, of one group at a time up to ``LOCAL`` colours, by rounds over the cluster beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import KEYS, RGBA
from .join import bounded, palette_apply
from .mediancut import median_cut, settled

#: Distinct colours of a group that one task cuts (some MB); groups of more are cut by rounds.
LOCAL = 1 << 16
#: Colours that a partition remembers while it looks for the first few of each group.
HELD = 1_000_000


def _cleared() -> dict[str, Column]:
    """The channels of a pixel's colour, all 0 for clear pixels."""
    return {c: F.when(F.col("a") == 0, 0).otherwise(F.col(c)).cast("int").alias(c) for c in RGBA}


def histogram(df: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """``by, r, g, b, a, pixels, first``: distinct colours, how many pixels they have, and the first place they take.

    ``first`` orders colours by item, row and column, as the rasters of one group are scanned one after the other.
    """
    first = F.min(F.struct("item_index", "y", "x")).alias("first")
    return df.select(*dict.fromkeys([*by, *KEYS]), "x", "y", *_cleared().values()).groupBy(*by, *RGBA).agg(F.least(F.count("*"), F.lit((1 << 32) - 1)).alias("pixels"), first)


def count_colors(df: DataFrame, limit: int = 0, by: list[str] = KEYS) -> DataFrame:
    """``colors, exact``: the number of colours, at most ``limit`` unless that is 0, and whether it is all."""
    own = histogram(df, by) if limit == 0 else few_colours(df, limit, by).distinct()
    n = own.groupBy(*by).agg(F.count("*").alias("n"))
    exact = F.lit(True) if limit == 0 else F.col("n") <= limit
    return n.select(*by, F.when(exact, F.col("n")).otherwise(limit).cast("long").alias("colors"), exact.alias("exact"))


def few_colours(df: DataFrame, limit: int, by: list[str] = KEYS) -> DataFrame:
    """``by, colour``: of each group and partition its distinct colours, until there are ``limit + 1`` of them.

    A partition stops to keep a group's colours then, since no more are asked for, and so shuffles at most so many rows a group.
    What it keeps is forgotten when it is much, and then kept anew; colours may come twice after that.
    """
    packed = sum((c.cast("long") * (1 << 16 * k) if k < 3 else F.shiftleft(c.cast("long"), 48) for k, c in enumerate(_cleared().values())), F.lit(0).cast("long"))
    own = df.select(*by, packed.alias("colour"))
    names = [*by, "colour"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, set] = {}
        held = 0
        for batch in batches:
            new = []
            rows = pa.Table.from_batches([batch]).group_by(names, use_threads=False).aggregate([]).to_pydict()
            for *key, colour in zip(*(rows[c] for c in names)):
                some = kept.setdefault(tuple(key), set())
                if len(some) <= limit and colour not in some:
                    some.add(colour)
                    new.append((*key, colour))
            if new:
                yield pa.RecordBatch.from_arrays([pa.array(c, batch.schema.field(k).type) for k, c in enumerate(zip(*new))], names)
            held += len(new)
            if held > HELD:
                kept.clear()
                held = 0

    return own.mapInArrow(run, own.schema)


def exact_palette(df: DataFrame, most: int = 256, by: list[str] = KEYS) -> DataFrame:
    """``idx, r, g, b, a`` in order of first appearance; groups of more than ``most`` colours give no rows."""
    h = histogram(df, by)
    many = h.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") <= most).select(*by)
    order = Window.partitionBy(*by).orderBy("first")
    return h.join(many, by).select(*by, (F.row_number().over(order) - 1).cast("int").alias("idx"), *RGBA)


def cut_boxes(colours: np.ndarray, pixels: np.ndarray, most: int) -> np.ndarray:
    """Median cut: the palette of distinct ``colours`` (n, 4), in order of the boxes' making."""
    boxes = [np.arange(len(colours))]
    spread = lambda box: (colours[box].max(0) - colours[box].min(0)).astype(np.int64)
    worth = lambda box: int(pixels[box].sum()) * int(spread(box).max()) if len(box) > 1 else 0
    score = [worth(boxes[0])]
    while len(boxes) < most:
        k = max(range(len(boxes)), key=lambda i: (score[i], -i))
        if score[k] <= 0:
            break
        box = boxes[k]
        box = box[np.argsort(colours[box, int(spread(box).argmax())], kind="stable")]
        passed = np.cumsum(pixels[box][:-1]) > int(pixels[box].sum()) // 2
        at = int(passed.argmax()) + 1 if passed.any() else len(box) - 1
        boxes[k] = box[:at]
        boxes.append(box[at:])
        score[k] = worth(boxes[k])
        score.append(worth(boxes[-1]))
    out = np.zeros((len(boxes), 4), np.int64)
    for i, box in enumerate(boxes):
        total = int(pixels[box].sum())
        out[i] = ((colours[box].astype(np.int64) * pixels[box][:, None]).sum(0) + total // 2) // total
    return out


def build_palette(df: DataFrame, most: int = 256, by: list[str] = ["doc_id"], local: int = LOCAL) -> DataFrame:
    """``idx, r, g, b, a`` of each group: its colours if they fit, else those that median cut picks.

    A group of at most ``local`` colours is cut in one task, larger ones by rounds over the cluster, with equal results.
    """

    def cut(table: pa.Table) -> pa.Table:
        first = table.column("first").combine_chunks()
        order = np.lexsort([first.field(k).to_numpy() for k in (2, 1, 0)])
        colours = np.stack([table.column(c).to_numpy() for c in RGBA], 1)[order]
        pixels = table.column("pixels").to_numpy()[order]
        entries = colours if len(colours) <= most else cut_boxes(colours, pixels, most)
        cols = {b: pa.array([table.column(b)[0].as_py()] * len(entries), table.schema.field(b).type) for b in by}
        return pa.table(cols | {"idx": pa.array(np.arange(len(entries)), pa.int32())} | {c: pa.array(entries[:, i], pa.int32()) for i, c in enumerate(RGBA)})

    h = histogram(df, by)
    keys = ", ".join(f"{b} {t}" for b, t in h.select(*by).dtypes)
    counted = settled(h.join(h.groupBy(*by).agg(F.count("*").alias("__n")), by))
    bound = max(most, local)
    small = counted.filter(F.col("__n") <= bound).drop("__n").groupBy(*by).applyInArrow(cut, f"{keys}, idx int, r int, g int, b int, a int")
    large = counted.filter(F.col("__n") > bound).drop("__n")
    return small if large.isEmpty() else small.unionByName(median_cut(large, most, by).select(*small.columns))


def quantize(df: DataFrame, most: int = 256) -> DataFrame:
    """Every document's pixels in at most ``most`` colours of its own palette."""
    entries = build_palette(df, most)
    wide = entries.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", *RGBA))).alias("entries"))
    colours = df.select("doc_id", *_cleared().values()).distinct().join(wide, "doc_id")
    distance = lambda e: sum(((F.col(c) - e[c]) * (F.col(c) - e[c]) for c in RGBA[1:]), (F.col("r") - e["r"]) * (F.col("r") - e["r"]))
    best = colours.withColumn("best", F.array_min(F.transform("entries", lambda e: F.struct(distance(e).alias("d"), *[e[c].alias(c) for c in ("idx", *RGBA)]))))
    best = best.select("doc_id", *[F.col(c).alias(f"k{c}") for c in RGBA], F.col("best.idx").alias("idx"), *[F.col(f"best.{c}").alias(f"n{c}") for c in RGBA])
    keyed = df.select("*", *[c.alias(f"k{n}") for n, c in _cleared().items()])
    return keyed.join(best, ["doc_id", *[f"k{c}" for c in RGBA]]).select(*[F.col(f"n{c}").alias(c) if c in RGBA else F.col(c) for c in df.columns], "idx")


def diffuse(pixels: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """Floyd-Steinberg, back and forth, with shares rounded towards zero; indices of an (h, w, 4) raster."""
    h, w, _ = pixels.shape
    out = np.zeros((h, w), np.int32)
    palette = palette.astype(np.int64)
    now = np.zeros((w + 2, 4), np.int64)
    part = lambda d, k: (np.abs(d) * k // 16) * np.sign(d)
    for y in range(h):
        below = np.zeros((w + 2, 4), np.int64)
        ahead = -1 if y & 1 else 1
        for x in range(w)[::ahead]:
            c = pixels[y, x].astype(np.int64)
            clear = c[3] == 0
            want = c if clear else np.clip(c + now[x + 1], 0, 255)
            idx = int(((palette - want) ** 2).sum(1).argmin())
            out[y, x] = idx
            if clear:
                continue
            d = want - palette[idx]
            now[x + 1 + ahead] += part(d, 7)
            below[x + 1 - ahead] += part(d, 3)
            below[x + 1] += part(d, 5)
            below[x + 1 + ahead] += part(d, 1)
        now = below
    return out


def dither(df: DataFrame, palette: DataFrame) -> DataFrame:
    """``df`` in the colours of ``palette (idx, r, g, b, a)``, errors diffused; one task a raster.

    The order inside a raster is sequential by nature; rasters are independent.
    """
    entries = bounded(palette).orderBy("idx").select(*RGBA).collect()  # at most 256 rows
    colours = np.array([tuple(e) for e in entries], np.int64).reshape(-1, 4)

    def run(table: pa.Table) -> pa.Table:
        w, h = table.column("w")[0].as_py(), table.column("h")[0].as_py()
        x, y = table.column("x").to_numpy(), table.column("y").to_numpy()
        raster = np.zeros((h, w, 4), np.int64)
        raster[y, x] = np.stack([table.column(c).to_numpy() for c in RGBA], 1)
        idx = diffuse(raster, colours)[y, x]
        new = {c: pa.array(colours[idx, i], pa.int32()) for i, c in enumerate(RGBA)}
        return pa.table({n: new.get(n, table.column(n)) for n in table.schema.names} | {"idx": pa.array(idx, pa.int32())})

    schema = ", ".join(f"{n} {t}" for n, t in df.dtypes) + ", idx int"
    return df.groupBy(*KEYS).applyInArrow(run, schema)


def smallest_depth(df: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """Colours of each raster and the fewest bits (1, 2, 4, 8) that index them; null for more than 256."""
    n = histogram(df, by).groupBy(*by).agg(F.count("*").alias("colors"))
    return n.withColumn("depth", F.expr("case when colors <= 2 then 1 when colors <= 4 then 2 when colors <= 16 then 4 when colors <= 256 then 8 end"))


def writer_facts(df: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """What writers ask of 8-bit RGBA: ``opaque``, ``gray``, the fewest bits that hold its grays, and the one clear colour, if any.

    A gray fits 1, 2 or 4 bits if its value is one that such samples expand to. ``key`` is the colour of the clear
    pixels if all of them have the same and no visible pixel does, and alpha is only 0 or 255; else null.
    """
    colour = F.struct("r", "g", "b")
    clear, seen = F.col("a") == 0, F.col("a") > 0
    fits = {b: F.min((F.col("r") % (255 // ((1 << b) - 1)) == 0).cast("int")) for b in (1, 2, 4)}
    facts = df.groupBy(*by).agg(
        (F.min("a") == 255).alias("opaque"), (F.min(((F.col("r") == F.col("g")) & (F.col("g") == F.col("b"))).cast("int")) == 1).alias("gray"), *[f.alias(f"f{b}") for b, f in fits.items()],
        F.min(F.when(clear, colour)).alias("k0"), F.max(F.when(clear, colour)).alias("k1"), (F.min(F.col("a").isin(0, 255).cast("int")) == 1).alias("hard"),
    )
    depth = F.when(~F.col("gray"), None).when(F.col("f1") == 1, 1).when(F.col("f2") == 1, 2).when(F.col("f4") == 1, 4).otherwise(8)
    keyed = facts.select(*by, "opaque", "gray", depth.alias("gray_bits"), F.when((F.col("k0") == F.col("k1")) & F.col("hard"), F.col("k0")).alias("key"))
    shown = df.filter(seen).select(*by, colour.alias("key")).distinct().withColumn("__shown", F.lit(True))
    joined = keyed.join(shown, [*by, "key"], "left")
    return joined.select(*by, "opaque", "gray", "gray_bits", F.when(F.col("__shown").isNull(), F.col("key")).alias("key"))


def fits_palette(df: DataFrame, palette: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """Whether each raster has only colours of ``palette``."""
    have = palette.select(*RGBA).distinct().withColumn("__in", F.lit(True))
    h = histogram(df, by).join(have, RGBA, "left")
    return h.groupBy(*by).agg((F.count(F.when(F.col("__in").isNull(), 1)) == 0).alias("fits"))


__all__ = ["build_palette", "count_colors", "cut_boxes", "diffuse", "dither", "exact_palette", "fits_palette", "histogram", "palette_apply", "quantize", "smallest_depth", "writer_facts"]
