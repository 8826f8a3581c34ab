"""Makes this package importable in Python workers, wherever the driver was started."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a session; the driver serves the file itself."""
    context = spark.sparkContext
    if getattr(context, "_pixelloom_shipped", False):
        return
    top = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    folder = Path(tempfile.mkdtemp(prefix="pixelloom-ship-"))
    (folder / "pixelloom.zip").write_bytes(packed.getvalue())
    context.addPyFile(str(folder / "pixelloom.zip"))
    context._pixelloom_shipped = True
