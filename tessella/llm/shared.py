"""What the operators of this subpackage share: tables, intermediate tables, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regular expression of the white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of one batch that a Python worker gets; Spark's own limits allow batches of whole partitions.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def bound_batches(df: DataFrame) -> DataFrame:
    """Keep the batches that go to Python small, as texts may be long; stricter settings of the session stay."""
    conf = df.sparkSession.conf
    for key, limit in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(conf.get(key)).upper().removesuffix("B")
        if not now.isdigit() or int(now) <= 0 or int(now) > limit:
            conf.set(key, str(limit))
    return df


#: What Python workers keep between tasks, each with a way to drop it.
_kept: list[Callable[[], None]] = []


def keeps(drop: Callable[[], None]) -> None:
    """Register what a module keeps in a worker."""
    _kept.append(drop)


def drop_kept() -> None:
    """Called where a worker begins work that doesn't use what earlier work has kept."""
    for drop in _kept:
        drop()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set and all run in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints"


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it again.

    The files outlive any executor, so a lost one costs the tasks of the current
    stage only, and the readers below it share one computation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialised tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for internal columns that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs outside the white space of SPACE, in order."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")
