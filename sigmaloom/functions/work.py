"""Work tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes and, on request, rows of an Arrow batch while a work table is written.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES = 4 << 20
_LOCK = threading.RLock()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where none is set, a temporary folder in local mode (tests) and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("sigmaloom.work.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="sigmaloom-")
        spark.conf.set("sigmaloom.work.dir", folder)
    return folder


@contextmanager
def small_batches(spark: SparkSession, rows: int | None = None):
    """Arrow batches of bounded bytes, and of ``rows`` rows if given, for what runs inside; one thread at a time."""
    with _LOCK:
        before = {k: spark.conf.get(k) for k in (ARROW_BYTES, ARROW_ROWS)}
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))
        if rows:
            spark.conf.set(ARROW_ROWS, str(min(rows, int(before[ARROW_ROWS])) if int(before[ARROW_ROWS]) > 0 else rows))
        try:
            yield
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)


def bound_batches(spark: SparkSession) -> None:
    """Bounds the bytes of Arrow batches for the session, for results that the caller writes; a lower setting stays."""
    if int(spark.conf.get(ARROW_BYTES).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))


def written(df: DataFrame, name: str, arrow_rows: int | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: it cuts the lineage and survives lost executors.

    Arrow batches of Python stages are bounded by bytes while it is written, and by ``arrow_rows`` rows where given.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark, arrow_rows):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
