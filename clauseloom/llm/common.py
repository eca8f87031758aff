"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters to lower case; every other ASCII byte outside [0-9A-Za-z] to a space; bytes from 0x80 stay.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or where it is unset a temporary one, which
    only a local session can share with its executors; elsewhere that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="clauseloom-"))
        root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return root


def staged(df: DataFrame, label: str, codec: str = "none", files: int = 0) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors.

    Hashes, counts and coded ids gain nothing from a codec, and codecs hold memory outside the heap for each open column;
    tables with texts name one. ``files`` is for tables of numbers behind a shuffle: so many files at most, since stores
    dislike many small ones; ``pieces`` of a larger table gives a number that grows with the data."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/clauseloom/{label}-{uuid.uuid4().hex}"
    if files:
        df = df.coalesce(files)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pieces(scan: DataFrame) -> int:
    """The number of tasks that read ``scan`` (a table that is read, not computed), and two for each core at least."""
    return max(2 * scan.sparkSession.sparkContext.defaultParallelism, scan.rdd.getNumPartitions())


def workers_import(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it, whatever the driver's working folder."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in batches of about ``BATCH_BYTES``, unless the session sets a size: by rows alone, batches
    of texts and sets are of some ten MB, and an executor holds several copies of each outside its heap."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


def remainder(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as the empty text, whose remainder is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % k


def text_column(docs: DataFrame) -> int:
    """Where the column ``text`` is, by Spark's rule for names (upper and lower case alike)."""
    return [c.lower() for c in docs.columns].index("text")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(values: list, limit: int = 500_000):
    """(start, stop) over a list of texts so that a slice has at most ``limit`` characters, or one text."""
    start = size = 0
    for i, v in enumerate(values):
        n = len(v) if v else 0
        if size + n > limit and i > start:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(values):
        yield start, len(values)
