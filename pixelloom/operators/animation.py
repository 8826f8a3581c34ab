"""Animation folds: canvases from frames, timelines and differences between frames.

Frames are patches: pixel rows with the frame's ``item_index``, in canvas coordinates, next to a table of
frames with each one's rectangle and operations. Where the fold only replaces, it is a window over paint and
clear events of a pixel; where it blends with rounding, the pixel's events are folded in order. Either gives steps, at which a
pixel changes; only the rows that are returned are spread over the frames, behind the last shuffle, join and sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import RGBA

_VALUE = "struct<r:int,g:int,b:int,a:int>"
NOTHING = f"cast(null as {_VALUE})"


def _listed(rows: DataFrame, frames: DataFrame, dealt: bool) -> DataFrame:
    """``rows`` with ``ks``, the frames of their document in order. ``dealt``: both are dealt out by document, so a merge join needs no shuffle."""
    lists = frames.groupBy("doc_id").agg(F.sort_array(F.collect_list("item_index")).alias("ks"))
    return rows.join(lists.hint("merge") if dealt else lists, "doc_id")


def placed(steps: DataFrame) -> DataFrame:
    """``steps`` with ``lo, hi``: the first of the frames (from 1) that show the value, and the first that does not any more.

    A step ``(doc_id, x, y, ks, seq, until, ..)`` holds from ``seq`` on, to before ``until`` (null: to the end), where frame k is
    at 2k and what follows it at 2k + 1.
    """
    place = "cast(array_position(ks, cast(shiftright({0}, 1) as int)) as int) + ({0} & 1)"
    return steps.withColumns({"lo": F.expr(place.format("seq")), "hi": F.expr(f"if(until is null, size(ks) + 1, {place.format('until')})")})


def _shown(steps: DataFrame) -> DataFrame:
    """The canvases of ``steps (doc_id, x, y, ks, seq, until, first, v)``: every step spread over its frames, and nothing over those before a pixel's ``first``."""
    own = "named_struct('lo', lo, 'hi', hi, 'v', v)"
    spans = placed(steps).select("doc_id", "x", "y", "ks", F.expr(f"inline(if(first, array(named_struct('lo', 1, 'hi', lo, 'v', {NOTHING}), {own}), array({own})))"))
    rows = spans.filter("lo < hi").select("doc_id", F.explode(F.expr("slice(ks, lo, hi - lo)")).alias("item_index"), "x", "y", "v")
    return rows.select("doc_id", "item_index", "x", "y", *[F.coalesce(F.col(f"v.{c}"), F.lit(0)).alias(c) for c in RGBA])


def _rectangles(frames: DataFrame, *names: str) -> DataFrame:
    """Every pixel of the frames' rectangles, with the columns named."""
    rect = frames.select("doc_id", "item_index", *names, F.explode(F.expr("sequence(lft, lft + width - 1)")).alias("x"), "top", "height")
    return rect.select("doc_id", "item_index", *names, "x", F.explode(F.expr("sequence(top, top + height - 1)")).alias("y"))


def steps_replacing(frames: DataFrame, patches: DataFrame, whole: bool = False) -> DataFrame:
    """``doc_id, x, y, ks, seq, until, first, v``: what a pixel of an animation that paints over shows, and from where to where (see ``placed``).

    Arguments as in ``canvases_replacing``.
    """
    rgba = F.struct(*[F.col(c).cast("int").alias(c) for c in RGBA]).alias("v")
    clears = "named_struct('seq', item_index * 2 + 1, 'v', named_struct('r', 0, 'g', 0, 'b', 0, 'a', 0), 'lasts', true)"
    paints = "named_struct('seq', item_index * 2, 'v', v, 'lasts', disposal <> 3)"
    # What is brought back after a brief frame is the last value that lasts, so it comes as an event without one.
    back = f"named_struct('seq', item_index * 2 + 1, 'v', {NOTHING}, 'lasts', false)"
    painted = f"if(disposal = 3, array({paints}, {back}), array({paints}))"
    if whole:
        px = patches.filter("a > 0 or disposal = 2").select("doc_id", "x", "y", "item_index", "disposal", rgba)
        events = px.select("doc_id", "x", "y", F.expr(f"inline(case when disposal <> 2 then {painted} when v.a > 0 then array({paints}, {clears}) else array({clears}) end)"))
    else:
        paint = patches.join(frames.select("doc_id", "item_index", "disposal"), ["doc_id", "item_index"]).select("doc_id", "x", "y", "item_index", "disposal", rgba)
        events = paint.select("doc_id", "x", "y", F.expr(f"inline({painted})")).unionByName(_rectangles(frames.filter("disposal = 2")).select("doc_id", "x", "y", F.expr(f"inline(array({clears}))")))
    w = Window.partitionBy("doc_id", "x", "y").orderBy("seq")
    last = F.last(F.when(F.col("lasts"), F.col("v")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    steps = events.select("doc_id", "x", "y", "seq", F.lead("seq").over(w).alias("until"), (F.row_number().over(w) == 1).alias("first"), F.coalesce("v", last).alias("v"))
    return _listed(steps, frames, whole)


def canvases_replacing(frames: DataFrame, patches: DataFrame, whole: bool = False) -> DataFrame:
    """Every canvas of animations that paint over: ``doc_id, item_index, x, y, r, g, b, a`` for pixels ever touched.

    ``frames (doc_id, item_index, lft, top, width, height, disposal)``; ``patches`` only has opaque pixels.
    Disposal 2 clears the frame's rectangle after it, 3 brings back what was there before it.
    ``whole``: patches were exploded from ``frames`` and have their ``disposal`` and every pixel of their rectangles, with an alpha of 0 where nothing
    is painted, so that nothing is joined. Frames that are dealt out by document (``repartition``) are not shuffled again then, neither are their pixels.
    """
    return _shown(steps_replacing(frames, patches, whole))


# The value of a pixel after frame pixel `s` is drawn on canvas pixel `d`, in the rounding of each format.
APNG_OVER = (
    "case when s.a = 255 or s.source then named_struct('r', s.r, 'g', s.g, 'b', s.b, 'a', s.a) when s.a = 0 then d else "
    "named_struct({0}, 'a', (s.a * 255 + d.a * (255 - s.a)) div 255) end"
).format(", ".join(f"'{c}', (s.{c} * s.a * 255 + d.{c} * d.a * (255 - s.a)) div greatest(1, s.a * 255 + d.a * (255 - s.a))" for c in "rgb"))
_F = "shiftright(d.a * (256 - s.a), 8)"
_BA = f"((s.a + {_F}) & 255)"
WEBP_OVER = (
    "case when s.source then named_struct('r', s.r, 'g', s.g, 'b', s.b, 'a', s.a) when s.a = 0 then d when s.a = 255 then named_struct('r', s.r, 'g', s.g, 'b', s.b, 'a', 255L) "
    f"when {_BA} = 0 then named_struct('r', 0L, 'g', 0L, 'b', 0L, 'a', 0L) else "
    "named_struct({0}, 'a', " + _BA + ") end"
).format(", ".join(f"'{c}', shiftright(pmod((s.{c} * s.a + d.{c} * {_F}) * (16777216 div greatest(1, {_BA})), 4294967296), 24)" for c in "rgb"))


def _folded(frames: DataFrame, patches: DataFrame, over: str, whole: bool) -> DataFrame:
    """``doc_id, x, y, seen``: a pixel's frames in order, each with what it shows and what it leaves."""
    if whole:
        drawn = patches.filter("x >= lft and x < lft + width and y >= top and y < top + height")
    else:
        drawn = _rectangles(frames, "dispose", "blend").join(patches.select("doc_id", "item_index", "x", "y", *RGBA), ["doc_id", "item_index", "x", "y"], "left")
    one = F.struct("item_index", "dispose", (F.col("blend") == 0).alias("source"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in RGBA])
    events = drawn.groupBy("doc_id", "x", "y").agg(F.array_sort(F.collect_list(one)).alias("events"))
    nothing = "named_struct('r', 0L, 'g', 0L, 'b', 0L, 'a', 0L)"
    kind = "struct<r:bigint,g:bigint,b:bigint,a:bigint>"
    # What is due after a frame happens before the next event of the pixel.
    after = lambda acc: f"case {acc}.due when 1 then {nothing} when 2 then {acc}.back else {acc}.v end"
    draw = over.replace("d.", f"({after('acc')}).").replace(" d else", f" {after('acc')} else").replace("then d ", f"then {after('acc')} ")
    fold = (
        f"aggregate(events, named_struct('v', {nothing}, 'back', {nothing}, 'due', 0, 'seen', cast(array() as array<struct<item_index:int,shown:{kind},rest:{kind}>>)), (acc, s) -> "
        f"transform(array(named_struct('v', cast({draw} as {kind}), 'back', {after('acc')})), n -> named_struct('v', n.v, 'back', n.back, 'due', s.dispose, 'seen', "
        f"concat(acc.seen, array(named_struct('item_index', s.item_index, 'shown', n.v, 'rest', case s.dispose when 1 then {nothing} when 2 then n.back else n.v end)))))[0], acc -> acc.seen)"
    )
    return events.select("doc_id", "x", "y", F.expr(fold).cast(f"array<struct<item_index:int,shown:{_VALUE},rest:{_VALUE}>>").alias("seen"))


def canvases_blending(frames: DataFrame, patches: DataFrame, over: str = APNG_OVER, whole: bool = False) -> DataFrame:
    """Every canvas of animations that blend: ``doc_id, item_index, x, y, r, g, b, a`` for pixels ever touched.

    ``frames`` has ``blend`` (0 source, 1 over) and ``dispose`` (0 none, 1 clear, 2 previous), which acts on
    the frame's rectangle before the next one is drawn. The fold of a pixel goes through its own events only and keeps its
    value, and the one to go back to; what is left after an event is spread over the frames up to the next one.
    ``whole``: patches were exploded from ``frames``, have their columns and every pixel of their rectangles, so that nothing is joined.
    Frames that are dealt out by document (``repartition``) are not shuffled again then, neither are their pixels.
    """
    seen = _listed(_folded(frames, patches, over, whole), frames, whole).select("doc_id", "x", "y", "ks", "seen", F.posexplode("seen").alias("at", "e"))
    both = "inline(array(named_struct('seq', e.item_index * 2, 'until', e.item_index * 2 + 1, 'first', at = 0, 'v', e.shown), named_struct('seq', e.item_index * 2 + 1, 'until', get(seen, at + 1).item_index * 2, 'first', false, 'v', e.rest)))"
    return _shown(seen.select("doc_id", "x", "y", "ks", F.expr(both)))


def canvas_blending(frames: DataFrame, patches: DataFrame, over: str = APNG_OVER, whole: bool = False) -> DataFrame:
    """The last canvas of each: ``doc_id, x, y, r, g, b, a``."""
    final = frames.groupBy("doc_id").agg(F.max("item_index").alias("final"))
    final = final.hint("merge") if whole else final
    last = _folded(frames, patches, over, whole).select("doc_id", "x", "y", F.element_at("seen", -1).alias("e")).join(final, "doc_id")
    return last.select("doc_id", "x", "y", F.expr("if(e.item_index = final, e.shown, e.rest)").alias("v")).select("doc_id", "x", "y", *[F.col(f"v.{c}") for c in RGBA])


def key_frames(frames: DataFrame) -> DataFrame:
    """``frames`` with ``is_key``: drawing the frame does not need the canvas before it.

    The first frame is one, so is one that replaces or whose own pixels cover the whole canvas; and one
    after a frame that was cleared and covered the canvas or was a key frame itself.
    """
    one = F.struct("item_index", "blend", "dispose", (F.expr("lft = 0 and top = 0 and width = cw and height = ch")).alias("full"))
    lists = frames.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("f"))
    fold = (
        "aggregate(f, named_struct('out', cast(array() as array<struct<item_index:int,is_key:boolean>>), 'full', false, 'cleared', false, 'key', false),"
        " (acc, s) -> named_struct('out', concat(acc.out, array(named_struct('item_index', s.item_index, 'is_key', size(acc.out) = 0 or (s.full and s.blend = 0) or (acc.cleared and (acc.full or acc.key))))),"
        " 'full', s.full, 'cleared', s.dispose = 1, 'key', size(acc.out) = 0 or (s.full and s.blend = 0) or (acc.cleared and (acc.full or acc.key))), acc -> acc.out)"
    )
    flags = lists.select("doc_id", F.explode(F.expr(fold)).alias("k")).select("doc_id", "k.item_index", "k.is_key")
    return frames.join(flags, ["doc_id", "item_index"])


def timeline(items: DataFrame) -> DataFrame:
    """``items`` with the start and end of each in milliseconds; a denominator of 0 is read as 100."""
    w = Window.partitionBy("doc_id").orderBy("item_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ms = F.expr("(cast(delay_num as bigint) * 1000) div if(delay_den = 0, 100, delay_den)")
    timed = items.withColumn("delay_ms", ms).withColumn("end_ms", F.sum("delay_ms").over(w))
    return timed.withColumn("start_ms", F.col("end_ms") - F.col("delay_ms"))


def changes(df: DataFrame, channels: list[str]) -> DataFrame:
    """Pixels that differ from the frame before, with whether they do: ``changed``."""
    w = Window.partitionBy("doc_id", "x", "y").orderBy("item_index")
    own = F.struct(*channels)
    return df.withColumn("changed", ~own.eqNullSafe(F.lag(own).over(w)))


def change_box(df: DataFrame, channels: list[str]) -> DataFrame:
    """The rectangle of each frame that differs from the one before; 1x1 at the origin if none does."""
    c = changes(df, channels).groupBy("doc_id", "item_index").agg(
        *[f(F.when(F.col("changed"), F.col(k))).alias(n) for f, k, n in ((F.min, "x", "x0"), (F.max, "x", "x1"), (F.min, "y", "y0"), (F.max, "y", "y1"))]
    )
    return c.selectExpr("doc_id", "item_index", "coalesce(x0, 0) as lft", "coalesce(y0, 0) as top", "coalesce(x1 - x0 + 1, 1) as width", "coalesce(y1 - y0 + 1, 1) as height")


def union_box(boxes: DataFrame) -> DataFrame:
    """The smallest rectangle that holds all of a document's."""
    u = boxes.groupBy("doc_id").agg(F.min("lft").alias("lft"), F.min("top").alias("top"), F.max(F.expr("lft + width")).alias("r"), F.max(F.expr("top + height")).alias("b"))
    return u.selectExpr("doc_id", "lft", "top", "r - lft as width", "b - top as height")
