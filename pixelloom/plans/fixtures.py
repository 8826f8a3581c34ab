"""Rasters derived from tables, as pixel relations; the tables hold no images themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship

#: Frames of animations in a task, which become some hundred times as many pixels, and the most tasks.
FRAMES_A_TASK, TASKS = 10_000, 20_000
GRID = "select x, y from (select explode(sequence(0, 63)) as x), lateral (select explode(sequence(0, 47)) as y)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64x48 gray heat map of order lines by part and supplier: ``v``."""
    return spark.sql(
        f"""select 0 as doc_id, 0 as item_index, 64 as w, 48 as h, g.x, g.y, coalesce(c.v, 0) as v from ({GRID}) g left join (
          select cast(l_partkey % 64 as int) as x, cast(l_suppkey % 48 as int) as y, cast(least(255, count(*)) as int) as v from {{lineitem}} group by 1, 2
        ) c on g.x = c.x and g.y = c.y""",
        lineitem=table(spark, sf_dir, "lineitem"),
    )


def rgba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64x48 colour raster with clear, opaque and translucent pixels: ``r, g, b, a``."""
    return spark.sql(
        f"""select 0 as doc_id, 0 as item_index, 64 as w, 48 as h, g.x, g.y, cast(coalesce(sl, 0) * 37 % 256 as int) as r, cast(coalesce(sq, 0) % 256 as int) as g, cast(coalesce(ss, 0) % 256 as int) as b,
          cast(case when (g.x + g.y) % 5 = 0 then 0 when (g.x * g.y) % 3 = 0 then 255 else coalesce(so, 0) % 256 end as int) as a
        from ({GRID}) g left join (
          select cast(l_partkey % 64 as int) as x, cast(l_suppkey % 48 as int) as y, cast(sum(l_linenumber) as bigint) as sl, sum(cast(l_quantity as bigint)) as sq, sum(l_suppkey) as ss, sum(l_orderkey) as so
          from {{lineitem}} group by 1, 2
        ) c on g.x = c.x and g.y = c.y""",
        lineitem=table(spark, sf_dir, "lineitem"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 gray frames of ten documents, one a vector: ``v``."""
    return spark.sql(
        """select doc_id, item_index, 8 as w, 8 as h, cast(i % 8 as int) as x, cast(i div 8 as int) as y, cast(floor((cast(e as double) + 1.0D) * 127.5D) as int) as v from (
          select doc_id, item_index, posexplode(embedding) as (i, e) from (
            select label as doc_id, cast(row_number() over (partition by label order by vec_id) - 1 as int) as item_index, embedding from {embeddings}))""",
        embeddings=table(spark, sf_dir, "embeddings"),
    )


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of an animation a user on a 16x16 canvas: rectangle, operations and one colour each; dealt out by document, before they become pixels."""
    events = table(spark, sf_dir, "events")
    tasks = min(TASKS, 2 + events.count() // FRAMES_A_TASK)
    return spark.sql(
        """select doc_id, cast(rn - 1 as int) as item_index, 16 as cw, 16 as ch, cast(event_id % 8 as int) as lft, cast((event_id div 8) % 8 as int) as top,
          cast(1 + event_id % 5 as int) as width, cast(1 + (event_id div 5) % 5 as int) as height, cast(event_id % 4 as int) as disposal, cast(event_id % 3 as int) as dispose, cast((event_id div 3) % 2 as int) as blend,
          cast(pmod(cast(floor(value * 100.0D) as bigint), 256) as int) as r, cast(event_id * 53 % 256 as int) as g, cast(doc_id * 29L % 256 as int) as b, cast(event_id * 17 % 256 as int) as a,
          cast(event_id % 50 as int) as delay_num, cast(event_id % 4 * 50 as int) as delay_den
        from (select *, row_number() over (partition by doc_id order by ts, event_id) as rn from {events})""",
        events=events.selectExpr("cast(user_id as int) as doc_id", "ts", "event_id", "value").repartition(tasks, "doc_id"),
    )


def patch_pixels(frames: DataFrame, opaque: bool, whole: bool = False) -> DataFrame:
    """The pixels of ``patches``: those of (x + y + item) % 3 = 0 are clear, the others have alpha ``a``, or 255 where ``opaque``.

    Clear ones are left out where ``opaque``, unless ``whole``, which keeps the frame's rectangle and operations beside its pixels too.
    """
    px = frames.selectExpr("*", "explode(sequence(lft, lft + width - 1)) as x").selectExpr("*", "explode(sequence(top, top + height - 1)) as y")
    more = ["lft", "top", "width", "height", "disposal", "dispose", "blend"] if whole else []
    if opaque and not whole:
        px = px.filter("(x + y + item_index) % 3 <> 0")
    return px.selectExpr("doc_id", "item_index", "x", "y", "r", "g", "b", f"if((x + y + item_index) % 3 = 0, 0, {255 if opaque else 'a'}) as a", *more)


def palette16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A palette of 16 colours: ``idx, r, g, b, a``."""
    return spark.sql(
        """select cast(row_number() over (order by p_partkey) - 1 as int) as idx, cast(p_size * 5 % 256 as int) as r, cast(p_partkey * 67 % 256 as int) as g, cast(cast(floor(p_retailprice) as bigint) % 256 as int) as b, 255 as a
        from {part} where p_partkey between 1 and 16""",
        part=table(spark, sf_dir, "part"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image documents out of orders: size, orientation, resolution, loop count."""
    return spark.sql(
        """select o_orderkey as doc_id, cast(16 + o_orderkey % 100 as int) as w, cast(16 + o_custkey % 80 as int) as h, cast(o_orderkey % 9 as int) as orientation, cast(72 + o_custkey % 300 as int) as x_dpi,
          cast(nullif(o_custkey % 4, 3) as int) as loop_count, element_at(array('png', 'jpeg', 'gif', 'bmp', 'tiff'), cast(o_custkey % 5 as int) + 1) as format,
          element_at(array('PRESERVE_ALL', 'DROP_ALL', 'STRIP_GPS'), cast(o_orderkey % 3 as int) + 1) as policy from {orders}""",
        orders=table(spark, sf_dir, "orders"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of those documents out of order lines: role, subject, delay."""
    return spark.sql(
        """select doc_id, item_index, case when f = 'R' then 'FRAME' when f = 'A' then 'THUMBNAIL' else 'IMAGE' end as role, cast(case when f = 'A' then 0 else item_index end as int) as role_subject, delay_num, delay_den from (
          select l_orderkey as doc_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 as int) as item_index, l_returnflag as f,
            cast(l_partkey % 40 as int) as delay_num, cast(l_suppkey % 3 * 50 as int) as delay_den from {lineitem})""",
        lineitem=table(spark, sf_dir, "lineitem"),
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata blocks of documents out of order lines: kind, raw or common, size."""
    return spark.sql(
        """select l_orderkey as doc_id, element_at(array('EXIF', 'XMP', 'ICC', 'GPS', 'TEXT', 'EXIF_ORIENTATION'), cast(l_partkey % 6 as int) + 1) as kind, l_suppkey % 2 = 0 as is_raw, cast(l_quantity as bigint) as size from {lineitem}""",
        lineitem=table(spark, sf_dir, "lineitem"),
    )
