"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Java pattern: runs of ASCII letters and digits and of anything beyond ASCII.
ALNUM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Java pattern: runs of anything but ASCII white space.
SPACED_WORDS = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Send the package to the executors, and keep Arrow batches small, since texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    ship(spark)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_cache: dict = {}


def worker_cache(key: tuple) -> dict:
    """What a Python worker remembers for ``key``. A worker is used by one operator after the other, so it keeps one cache."""
    if key not in _cache:
        _cache.clear()
        _cache[key] = {}
    return _cache[key]


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column, pattern: str) -> Column:
    """Words of a text, an empty array for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only where that is unset
    and Spark runs on one machine (tests) a temporary folder stands in.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="pixelloom-checkpoint-"))
    return df.checkpoint(eager=True)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` cut, and its number of rows, observed while it is written instead of by a job of its own."""
    seen = Observation()
    kept = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    # A plan that proves empty while it runs may lose the observation.
    n = seen.get.get("n")
    return kept, kept.count() if n is None else n


def compact(df: DataFrame, rows_per_partition: int = 100_000) -> DataFrame:
    """``df`` cut, in as many partitions as its rows need: what follows has as many tasks and shuffle files."""
    return fitted(df, rows_per_partition)[0]


def fitted(df: DataFrame, rows_per_partition: int = 100_000) -> tuple[DataFrame, int]:
    """``compact``, and the number of rows."""
    kept, n = counted(df)
    return kept.coalesce(max(1, -(-n // rows_per_partition))), n


def sized(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` cut, and hinted for broadcast only if it has at most ``max_rows`` rows.

    Beyond the bound the hint is left out and the planner shuffles.
    """
    kept, n = counted(df)
    return F.broadcast(kept) if n <= max_rows else kept


def salted_join(big: DataFrame, small: DataFrame, on: list[str], salts: int) -> DataFrame:
    """Inner equi join in which the rows of one key of ``big`` are dealt to ``salts`` tasks; ``small`` goes to all of them."""
    left = big.withColumn("__salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right, [*on, "__salt"]).drop("__salt")
