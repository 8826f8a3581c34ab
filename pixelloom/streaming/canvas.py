"""Canvases of blending animations from a stream of frames that come in any order.

The canvas is dealt in tiles; a tile's state is its pixels, what is due to them, and the frames that came too early, all in the state store.
A frame is drawn when those before it are, so what comes out does not depend on the order of arrival. A timer of event time frees a
tile when nothing came for ``gap`` and the watermark has passed.

Defined cases: a frame that comes twice is drawn once; frames after one that never comes are not drawn; a frame without pixels clears its rectangle
or changes nothing, as its blend says; pixels outside the canvas are left out. Needs the RocksDB state store of Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Side of a tile.
SIDE = 32
FRAME = ["lft", "top", "width", "height", "dispose", "blend"]
OUT = "doc_id int, item_index int, x int, y int, r int, g int, b int, a int"


def over(s: np.ndarray, d: np.ndarray, source: bool) -> np.ndarray:
    """Pixels ``s`` drawn on ``d``, ``(n, 4)`` each."""
    sa, da = s[:, 3:], d[:, 3:]
    part = sa * 255 + da * (255 - sa)
    mixed = np.hstack([(s[:, :3] * sa * 255 + d[:, :3] * da * (255 - sa)) // np.maximum(1, part), part // 255])
    return s if source else np.where(sa == 255, s, np.where(sa == 0, d, mixed))


class Tile(StatefulProcessor):
    """One tile of one document."""

    def __init__(self, gap_ms: int) -> None:
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.canvas = handle.getValueState("canvas", "upcoming int, pixels binary, back binary, due int, rect array<int>")
        self.early = handle.getMapState("early", "item_index int", "frame array<int>, px binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        doc, tx, ty = (int(k) for k in key)
        if self.canvas.exists():
            upcoming, pixels, back, due, rect = self.canvas.get()
            pixels, back = (np.frombuffer(bytes(b), np.uint8).astype(np.int64).reshape(SIDE, SIDE, 4) for b in (pixels, back))
        else:
            upcoming, due, rect = 0, 0, [0, 0, 0, 0]
            pixels = back = np.zeros((SIDE, SIDE, 4), np.int64)
        pixels, back, last = pixels.copy(), back.copy(), 0
        for part in rows:
            for r in part.itertuples(index=False):
                last = max(last, int(r.ts.timestamp() * 1000))
                if r.item_index >= upcoming:
                    px = np.array([[p["x"] - tx * SIDE, p["y"] - ty * SIDE, p["r"], p["g"], p["b"], p["a"]] for p in r.px], np.uint8)
                    self.early.updateValue((int(r.item_index),), ([int(getattr(r, c)) for c in FRAME], px.tobytes()))
        drawn = []
        while self.early.containsKey((upcoming,)):
            frame, data = self.early.getValue((upcoming,))
            self.early.removeKey((upcoming,))
            lft, top, width, height, dispose, blend = frame
            x0, x1 = (min(SIDE, max(0, v - tx * SIDE)) for v in (lft, lft + width))
            y0, y1 = (min(SIDE, max(0, v - ty * SIDE)) for v in (top, top + height))
            a, b, c, d = rect
            if due:
                pixels[b:d, a:c] = 0 if due == 1 else back[b:d, a:c]
            back = pixels.copy()
            own = np.zeros((SIDE, SIDE, 4), np.int64)
            px = np.frombuffer(bytes(data), np.uint8).reshape(-1, 6)
            own[px[:, 1], px[:, 0]] = px[:, 2:]
            area = (slice(y0, y1), slice(x0, x1))
            new = over(own[area].reshape(-1, 4), pixels[area].reshape(-1, 4), blend == 0)
            pixels[area] = new.reshape(y1 - y0, x1 - x0, 4)
            y, x = (v.reshape(-1) for v in np.mgrid[y0:y1, x0:x1])
            drawn.append(np.column_stack([np.full(len(x), doc), np.full(len(x), upcoming), x + tx * SIDE, y + ty * SIDE, new]))
            due, rect, upcoming = dispose, [x0, y0, x1, y1], upcoming + 1
        self.canvas.update((upcoming, pixels.astype(np.uint8).tobytes(), back.astype(np.uint8).tobytes(), int(due), [int(v) for v in rect]))
        for t in list(self.handle.listTimers()):
            last = max(last, t - self.gap_ms)
            self.handle.deleteTimer(t)
        self.handle.registerTimer(last + self.gap_ms)
        if drawn:
            yield pd.DataFrame(np.concatenate(drawn).astype(np.int32), columns=["doc_id", "item_index", "x", "y", "r", "g", "b", "a"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.canvas.clear()
        self.early.clear()
        yield from ()


def canvases(frames: DataFrame, gap_ms: int = 600_000, late: str = "10 minutes") -> DataFrame:
    """``doc_id, item_index, x, y, r, g, b, a`` of every pixel in the rectangle of each frame, after it was drawn.

    ``frames`` is a stream of ``ts, doc_id, item_index, cw, ch, lft, top, width, height, dispose, blend, px``, a frame a row, numbered from 0;
    ``px`` holds structs ``x, y, r, g, b, a`` on the canvas. Every tile hears of every frame, since none can tell otherwise which are still to come.
    """
    number = lambda n: F.expr(f"sequence(0, cast(({n} - 1) div {SIDE} as int))")
    tiles = frames.withWatermark("ts", late).select("*", F.explode(number("cw")).alias("tx")).select("*", F.explode(number("ch")).alias("ty"))
    inside = f"filter(px, p -> p.x < cw and p.y < ch and p.x >= tx * {SIDE} and p.x < tx * {SIDE} + {SIDE} and p.y >= ty * {SIDE} and p.y < ty * {SIDE} + {SIDE})"
    dealt = tiles.select("ts", "doc_id", "item_index", *FRAME, "tx", "ty", F.expr(inside).alias("px"))
    return dealt.groupBy("doc_id", "tx", "ty").transformWithStateInPandas(Tile(gap_ms), OUT, "Append", "EventTime")
