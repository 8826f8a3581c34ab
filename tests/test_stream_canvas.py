import random
from collections import Counter

from pyspark.sql import functions as F

from pixelloom.operators import animation
from pixelloom.streaming import canvas

KIND = "ts timestamp, doc_id int, item_index int, cw int, ch int, lft int, top int, width int, height int, dispose int, blend int, px array<struct<x:int,y:int,r:int,g:int,b:int,a:int>>"


def test_shuffled_frames_equal_the_batch(spark, tmp_path):
    from datetime import datetime, timedelta

    rng = random.Random(3)
    rows = []
    for doc in range(3):
        for k in range(8):
            lft, top, width, height = rng.randrange(28), rng.randrange(28), 1 + rng.randrange(9), 1 + rng.randrange(9)
            px = [(x, y, *(rng.randrange(256) for _ in range(3)), rng.choice([0, 90, 255])) for x in range(lft, lft + width) for y in range(top, top + height) if (x + y) % 4]
            rows.append((datetime(2024, 1, 1) + timedelta(seconds=k), doc, k, 40, 40, lft, top, width, height, rng.randrange(3), rng.randrange(2), px))
    frames = spark.createDataFrame(rows, KIND)
    patches = frames.select("doc_id", "item_index", F.explode("px").alias("p")).select("doc_id", "item_index", "p.*")
    inside = frames.selectExpr("doc_id", "item_index", "explode(sequence(lft, lft + width - 1)) as x", "top", "height").selectExpr("doc_id", "item_index", "x", "explode(sequence(top, top + height - 1)) as y")
    names = ["doc_id", "item_index", "x", "y", "r", "g", "b", "a"]
    want = Counter(tuple(r) for r in animation.canvases_blending(frames.drop("px"), patches).join(inside, names[:4]).select(*names).collect())
    rng.shuffle(rows)
    again = [rows[0], *rows[:5]]  # frames that come twice
    late = datetime(2024, 1, 2)
    end = [(late, 9, 0, 1, 1, 0, 0, 1, 1, 0, 0, [(0, 0, 1, 2, 3, 4)])]
    source = str(tmp_path / "in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for n, part in enumerate((rows[:12], again + rows[12:], end, end)):
            spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(source)
            stream = canvas.canvases(spark.readStream.schema(KIND).parquet(source))
            q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            assert q.awaitTermination(60)
            left = sum(s["numRowsTotal"] for s in (q.lastProgress or {"stateOperators": []})["stateOperators"])
            if n == 1:
                assert left > 4
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = Counter(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).filter("doc_id < 9").select(*names).collect())
    assert got == want
    assert left <= 4  # what the last document keeps, with its timer
