"""Median cut over the cluster: boxes of colours are split level by level, and no task holds the colours of a document.

The sequential rule splits the box of the largest ``pixels * extent`` (the first of equal ones), along its widest channel, where half of
its pixels are passed. A part of a box is always worth less than the box, so boxes can be split before their turn: every
round splits all boxes that the rule would come to with what is known so far, and the rule is replayed on the boxes' worth alone, a
few hundred rows a document. Once it needs no other box, that replay numbers the palette.

A split takes weighted histograms of one channel (256 bins a box), which are aggregated before the shuffle. The bin in which half of
the pixels are passed is cut inside: its colours are ranked in the order that earlier splits left them in, by the channels of
those splits, the last one first, and then by first appearance.
"""

from __future__ import annotations

import heapq
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import RGBA

#: Rows of decisions that are broadcast at most, and parts in which a box's colours are joined beyond that.
MAX_BROADCAST, SALTS = 100_000, 16


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder; on one machine without one, to a temporary folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="pixelloom-checkpoint-"))
    return df.checkpoint(eager=True)


def with_boxes(colours: DataFrame, boxes: DataFrame, on: list[str], count: int) -> DataFrame:
    """``colours`` with the row of their box, of which there are ``count`` or fewer; a box of very many colours is joined in parts."""
    if count <= MAX_BROADCAST:
        return colours.join(F.broadcast(boxes), on)
    left = colours.withColumn("__salt", F.pmod(F.xxhash64(*RGBA), F.lit(SALTS)))
    return left.join(boxes.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [*on, "__salt"]).drop("__salt")


def replay(worth: dict[str, int], split: set[str], most: int) -> tuple[list[str], dict[str, int]]:
    """The rule on boxes named by their way from the root: which boxes to split next, else the number of each that stays."""
    ready, used, needed = [(-worth[""], 0, "")], 1, []
    while used < most and ready and ready[0][0] < 0:
        _, number, box = heapq.heappop(ready)
        if box in split:
            heapq.heappush(ready, (-worth[box + "0"], number, box + "0"))
            heapq.heappush(ready, (-worth[box + "1"], used, box + "1"))
        else:
            needed.append(box)
        used += 1
    return needed, {} if needed else {box: number for _, number, box in ready}


def decided(nodes: DataFrame, by: list[str], most: int) -> DataFrame:
    """``by, box, idx`` for the leaves of ``nodes (by, box, worth, leaf)``: idx null to split; documents that need no split have all leaves."""
    keys = ", ".join(f"{b} {t}" for b, t in nodes.select(*by).dtypes)

    def run(table: pa.Table) -> pa.Table:
        box, worth, leaf = (table.column(c).to_pylist() for c in ("box", "worth", "leaf"))
        needed, number = replay(dict(zip(box, worth)), {b for b, x in zip(box, leaf) if not x}, most)
        rows = [(b, None) for b in needed]
        if not needed:  # a leaf may be part of a box that was split before its turn
            rows = [(b, next(number[b[:k]] for k in range(len(b) + 1) if b[:k] in number)) for b, x in zip(box, leaf) if x]
        own = {b: pa.array([table.column(b)[0].as_py()] * len(rows), table.schema.field(b).type) for b in by}
        return pa.table(own | {"box": pa.array([r[0] for r in rows], pa.string()), "idx": pa.array([r[1] for r in rows], pa.int32())})

    return nodes.groupBy(*by).applyInArrow(run, f"{keys}, box string, idx int")  # at most some hundred rows a group


def channel(axis: Column) -> Column:
    return F.element_at(F.array(*RGBA), axis + 1)


def halved(colours: DataFrame, by: list[str], count: int) -> DataFrame:
    """Colours of boxes to split (with ``axis``, the channel to cut) in their halves: ``box`` and ``axes`` anew."""
    on, box = [*by, "box"], Window.partitionBy(*by, "box")
    valued = colours.withColumn("v", channel(F.col("axis")))
    bins = valued.groupBy(*on, "v").agg(F.sum("pixels").alias("weight"))
    bins = bins.withColumns({"upto": F.sum("weight").over(box.orderBy("v")), "half": F.floor(F.sum("weight").over(box) / 2), "last": F.max("v").over(box)})
    at = bins.filter("upto > half").groupBy(*on).agg(F.min(F.struct("v", "upto", "weight", "half", "last")).alias("m"))
    at = at.select(*on, F.col("m.v").alias("cut"), (F.col("m.upto") - F.col("m.weight")).alias("before"), "m.half", (F.col("m.v") == F.col("m.last")).alias("ends"))
    known = with_boxes(valued, at, on, count)
    # Only the colours of the bin that is cut are ranked.
    earlier = F.transform(F.split("axes", ""), lambda a: F.when(a != "", channel(a.cast("int"))))
    ranked = known.filter("v = cut").withColumn("order", F.struct(earlier.alias("by"), "first")).withColumns({"nth": F.row_number().over(box.orderBy("order")), "upto": F.col("before") + F.sum("pixels").over(box.orderBy("order")), "n": F.count("*").over(box)})
    passed = F.min(F.when(F.col("upto") > F.col("half"), F.col("nth"))).over(box)
    inside = ranked.withColumn("side", F.when(F.col("nth") <= passed - F.when(F.col("ends") & (passed == F.col("n")), 1).otherwise(0), "0").otherwise("1"))
    outside = known.filter("v <> cut").withColumn("side", F.when(F.col("v") < F.col("cut"), "0").otherwise("1"))
    keep = [*by, *RGBA, "pixels", "first", F.concat("box", "side").alias("box"), F.concat(F.col("axis").cast("string"), F.replace("axes", F.col("axis").cast("string"), F.lit(""))).alias("axes")]
    return inside.select(*keep).unionByName(outside.select(*keep))


def median_cut(histogram: DataFrame, most: int, by: list[str]) -> DataFrame:
    """``by, idx, r, g, b, a``: the palette of each document of a histogram ``(by, r, g, b, a, pixels, first)``, in order of the boxes' making."""
    colours = settled(histogram.select(*by, *RGBA, "pixels", "first", F.lit("").alias("box"), F.lit("").alias("axes")))
    on, done, inner = [*by, "box"], [], None
    while True:
        extent = {c: F.max(c) - F.min(c) for c in RGBA}
        widest = F.array_max(F.array(*[F.struct(e.alias("e"), F.lit(-k).alias("k")) for k, e in enumerate(extent.values())]))  # the first of equal ones
        leaves = colours.groupBy(*on).agg(F.sum("pixels").alias("pixels"), widest.alias("w"))
        leaves = settled(leaves.select(*on, (F.col("pixels") * F.col("w.e")).alias("worth"), (-F.col("w.k")).alias("axis")))
        nodes = leaves.select(*on, "worth", F.lit(True).alias("leaf"))
        every = nodes if inner is None else nodes.unionByName(inner.join(leaves.select(*by).distinct(), by))
        said = settled(decided(every, by, most).join(leaves.drop("worth"), on))
        count, open_ = said.agg(F.count("*"), F.count(F.when(F.col("idx").isNull(), 1))).first()
        known = with_boxes(colours, said, on, count)
        ended = known.filter("idx is not null").groupBy(*by, "idx").agg(F.sum("pixels").alias("total"), *[F.sum(F.col(c) * F.col("pixels")).alias(c) for c in RGBA])
        done.append(ended.select(*by, "idx", *[F.floor((F.col(c) + F.floor(F.col("total") / 2)) / F.col("total")).cast("int").alias(c) for c in RGBA]))
        if not open_:
            break
        split = said.filter("idx is null").select(*on)
        now = leaves.join(split, on).select(*on, "worth", F.lit(False).alias("leaf"))
        inner = now if inner is None else inner.unionByName(now)
        # Other boxes of documents in which some are split wait.
        waiting = leaves.join(split.select(*by).distinct(), by).join(split, on, "left_anti").select(*on)
        halves = halved(known.filter("idx is null").drop("idx"), by, count)
        colours = settled(halves.unionByName(with_boxes(colours, waiting, on, count * most).select(*halves.columns)))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out
