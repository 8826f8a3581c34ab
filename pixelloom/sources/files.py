"""Image files as DataFrames: directories of files in, documents, items, rasters and pixels out, and back.

``documents`` and ``items`` decode in executors, a file a row; data errors become ``error_code`` and never fail
a job. Rasters travel as one BINARY each; ``pixels`` turns them into the pixel relation. Files of one
batch are decoded together, so batches are kept small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ImageError, Limits
from . import codecs
from .codecs import Document, Item, Raster
from .probe import probe

ITEMS = (
    "path string, format string, error_code string, error string, item_count int, item_index int, role string, role_subject int, delay_num int, delay_den int, dispose int, blend int, "
    "hotspot_x int, hotspot_y int, model string, bits int, w int, h int, orientation int, x_dpi int, y_dpi int, loop_count int, description string, samples binary"
)
ENCODED = "path string, format string, error_code string, content binary"


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files under ``path`` with their bytes and probed format."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return probe((reader.option("pathGlobFilter", glob) if glob else reader).load(path))


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream of arriving files."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return probe(spark.readStream.format("binaryFile").schema(schema).load(path))


def _rows(path: str, content: bytes | None, limits: Limits, pixels: bool) -> list[dict]:
    base = {"path": path, "format": codecs.name_of(content or b""), "error_code": "OK"}
    try:
        doc = codecs.load(content or b"", limits)
    except ImageError as e:
        return [base | {"error_code": e.code, "error": str(e)}]
    out = []
    for k, i in enumerate(doc.items):
        s = i.raster.samples
        out.append(
            base | {
                "format": doc.format, "item_count": len(doc.items), "item_index": k, "role": i.role, "role_subject": i.subject, "delay_num": i.delay[0], "delay_den": i.delay[1], "dispose": i.dispose, "blend": i.blend,
                "hotspot_x": i.hotspot[0], "hotspot_y": i.hotspot[1], "model": i.raster.model, "bits": i.raster.bits, "w": i.raster.width, "h": i.raster.height, "orientation": doc.orientation, "x_dpi": doc.dpi[0], "y_dpi": doc.dpi[1],
                "loop_count": doc.loop_count, "description": doc.description, "samples": s.astype(s.dtype.newbyteorder("<")).tobytes() if pixels else None,
            }
        )
    return out


def items(files: DataFrame, limits: Limits = Limits(), pixels: bool = True) -> DataFrame:
    """One row per item of each file ``(path, content)``; a file that cannot be read is one row with its error."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_schema(files.sparkSession, ITEMS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                yield pa.RecordBatch.from_pylist(_rows(path.as_py(), content.as_py(), limits, pixels), schema)

    return files.select("path", "content").mapInArrow(run, ITEMS)


def _schema(spark: SparkSession, text: str):
    return spark.createDataFrame([], text).schema


def documents(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per file: format, error, size and facts of its first item."""
    found = items(files, limits, pixels=False)
    return found.filter("item_index is null or item_index = 0").select("path", "format", "error_code", "error", "item_count", "w", "h", "model", "bits", "orientation", "x_dpi", "y_dpi", "loop_count", "description")


def pixels(items: DataFrame) -> DataFrame:
    """The pixel relation of 8-bit RGBA, a row a pixel, ``doc_id`` being a hash of the path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rgba = _raster(r).rgba8()
                h, w, _ = rgba.shape
                for y in range(0, h, max(1, 1_000_000 // w)):
                    part = rgba[y : y + max(1, 1_000_000 // w)]
                    n = part.shape[0] * w
                    at = np.arange(n, dtype=np.int32)
                    cols = [pa.array(np.full(n, v), t) for v, t in ((r["doc_id"], pa.int64()), (r["item_index"], pa.int32()), (w, pa.int32()), (h, pa.int32()))]
                    cols += [pa.array(at % w), pa.array(at // w + y, pa.int32())] + [pa.array(part[..., k].reshape(-1).astype(np.int32)) for k in range(4)]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_index", "w", "h", "x", "y", "r", "g", "b", "a"])

    good = items.filter("error_code = 'OK'").select(F.xxhash64("path").alias("doc_id"), "item_index", "model", "bits", "w", "h", "samples")
    return good.mapInArrow(run, "doc_id bigint, item_index int, w int, h int, x int, y int, r int, g int, b int, a int")


def from_pixels(px: DataFrame, animated: bool = False) -> DataFrame:
    """Rasters of a pixel relation of 8-bit RGBA as items, a file each, or a file a document with its frames.

    The rows of one raster meet in one task, which is what a blob needs.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_schema(px.sparkSession, ITEMS))

    def run(table: pa.Table) -> pa.Table:
        doc_id, item, w, h = (table.column(c)[0].as_py() for c in ("doc_id", "item_index", "w", "h"))
        s = np.zeros((h, w, 4), np.uint8)
        s[table.column("y").to_numpy(), table.column("x").to_numpy()] = np.stack([table.column(c).to_numpy() for c in "rgba"], 1)
        row = {
            "path": f"{doc_id}" if animated else f"{doc_id}/{item}", "error_code": "OK", "item_index": item if animated else 0, "role": "FRAME" if animated else "IMAGE", "role_subject": item if animated else 0,
            "delay_num": 1, "delay_den": 10, "dispose": 0, "blend": 0, "hotspot_x": 0, "hotspot_y": 0, "model": "RGBA", "bits": 8, "w": w, "h": h, "orientation": 1, "x_dpi": 0, "y_dpi": 0, "samples": s.tobytes(),
        }
        return pa.Table.from_pylist([row], schema)

    return px.select("doc_id", "item_index", "w", "h", "x", "y", "r", "g", "b", "a").groupBy("doc_id", "item_index").applyInArrow(run, ITEMS)


def _raster(r: dict) -> Raster:
    n = 1 if r["model"] == "GRAY" else 4
    return Raster(np.frombuffer(r["samples"], f"<u{r['bits'] // 8}").reshape(r["h"], r["w"], n).astype(f"u{r['bits'] // 8}"), r["model"])


def encode(items: DataFrame, format: str, **options) -> DataFrame:
    """Files ``(path, format, error_code, content)`` of the items of each path; a refused document has no content."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["item_index"])
        first = rows[0]
        doc = Document(
            [Item(_raster(r), r["role"], r["role_subject"], (r["delay_num"], r["delay_den"]), hotspot=(r["hotspot_x"], r["hotspot_y"])) for r in rows],
            format, dpi=(first["x_dpi"] or 0, first["y_dpi"] or 0), description=first["description"], loop_count=first["loop_count"],
        )
        try:
            content, code = codecs.save(doc, format, **options), "OK"
        except ImageError as e:
            content, code = None, e.code
        return pa.table({"path": [first["path"]], "format": [format], "error_code": [code], "content": pa.array([content], pa.binary())})

    return items.filter("error_code = 'OK'").groupBy("path").applyInArrow(run, ENCODED)
