import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.addPyFile(packed())
    yield session
    session.stop()


def packed() -> str:
    """The package as a zip for Python workers, wherever the tests are started."""
    import tempfile
    import zipfile

    path = Path(tempfile.mkdtemp()) / "pixelloom-tests.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in (ROOT / "pixelloom").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    return str(path)
