"""Intermediate tables: written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``; where that is unset a local one, but only if all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{folder}/tessella-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Cut lineage in a folder of ``scratch``, so that several readers share one computation and a lost executor costs little."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, object]) -> Iterator[None]:
    """Settings of the session for the plans that run inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that the optimiser doesn't inline into what reads them, so that plans of large expressions stay small."""
    return df.select("*", F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


#: Rows and bytes of one batch that a Python worker gets; Spark's own limits allow batches of whole partitions.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def bound_batches(df: DataFrame) -> DataFrame:
    """Keep the batches of the session that go to Python small, as pages may be long; stricter settings stay."""
    conf = df.sparkSession.conf
    for key, limit in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(conf.get(key)).upper().removesuffix("B")
        if not now.isdigit() or int(now) <= 0 or int(now) > limit:
            conf.set(key, str(limit))
    return df
