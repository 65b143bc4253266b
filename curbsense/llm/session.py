"""Session helpers of the training-data operators: staged tables and Python batch size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Rows in one Arrow batch: texts can be long, so batches stay well under the default of 10,000 rows.
ARROW_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, where the session names one.

    Only a local master may fall back to a temporary folder of the machine.
    """
    sc = spark.sparkContext
    if found := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(found)
        return found
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


#: Paths of the tables staged in the scope that is open in this thread or task.
_made: ContextVar[list[str] | None] = ContextVar("staged tables", default=None)


def staged(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here.

    A lost executor costs nothing that was staged, and later readers prune columns. Outside of
    staging() the tables stay, as results may be read at any time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """A scope whose staged tables are deleted at its end. Other scopes, also those of other threads, keep theirs."""
    token = _made.set([])
    try:
        yield
    finally:
        made = _made.get()
        _made.reset(token)
        for path in made:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def outside(stage: Callable[[DataFrame], DataFrame], df: DataFrame) -> DataFrame:
    """stage(df) as outside of any scope of staging()."""
    token = _made.set(None)
    try:
        return stage(df)
    finally:
        _made.reset(token)


def python_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts small enough for an executor's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
