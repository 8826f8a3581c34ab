"""``spark.read.format("pixelloom")`` and ``df.write.format("pixelloom")``: files as a Python data source, a partition a file.

Writing takes encoded files ``(path, format, error_code, content)``, as ``files.encode`` and ``structure.transcode`` give them. Each
file is written beside its place and then moved there, so readers never see half of one, and a task that is run again puts the
same bytes there. Refused documents are left out; paths are kept below ``path``, whatever they name. Mode append adds and replaces
files by name, overwrite is refused if the folder has other files than those.

Options: ``path`` (a folder or file that executors see as a local or mounted path), ``pixels`` (false: headers and facts
only), ``maxDecodedPixels``, ``maxFrameCount``. Where files are in a store that only Spark's readers open,
``files.read_files`` does the same over ``binaryFile``.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..model import Limits
from .files import ITEMS, _rows

NAMES = [c.split()[0] for c in ITEMS.split(", ")]


class FilePartition(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        options = {k.lower(): v for k, v in options.items()}
        number = lambda k, d: int(options[k.lower()]) if k.lower() in options else d
        self.path = options["path"]
        self.pixels = options.get("pixels", "true").lower() != "false"
        base = Limits()
        self.limits = Limits(max_decoded_pixels=number("maxDecodedPixels", base.max_decoded_pixels), max_frame_count=number("maxFrameCount", base.max_frame_count))

    def partitions(self) -> list[FilePartition]:
        top = Path(self.path)
        return [FilePartition(str(p)) for p in ([top] if top.is_file() else sorted(p for p in top.rglob("*") if p.is_file() and p.name[0] not in "._"))]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        for row in _rows(partition.path, Path(partition.path).read_bytes(), self.limits, self.pixels):
            yield tuple(row.get(n) for n in NAMES)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path = {k.lower(): v for k, v in options.items()}["path"]
        if overwrite and any(p.is_file() for p in Path(self.path).rglob("*")):
            raise ValueError("the folder has files already")

    def write(self, iterator: Iterator) -> Written:
        names = []
        for row in iterator:
            if row["error_code"] != "OK" or row["content"] is None:
                continue
            parts = [x for x in row["path"].replace(":", "/").split("/") if x not in ("", ".", "..")]
            name = "/".join(parts) + "." + row["format"]
            at = Path(self.path) / name
            at.parent.mkdir(parents=True, exist_ok=True)
            beside = at.parent / f".{uuid.uuid4().hex}.part"
            beside.write_bytes(row["content"])
            os.replace(beside, at)
            names.append(name)
        return Written(names)

    def commit(self, messages: list) -> None:
        (Path(self.path) / "_SUCCESS").touch()

    def abort(self, messages: list) -> None:
        """Files that were moved to their places are whole; nothing has to be taken back."""


class ImageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pixelloom"

    def schema(self) -> str:
        return ITEMS

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ImageSource)
