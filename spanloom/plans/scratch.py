"""Tables that cut lineage, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Runtime setting under which Spark drops the shuffle files of a query once it has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Folders made up for sessions without the setting, by application.
_made_up: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. A temporary one is made up only where that is unset and Spark runs on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        application = spark.sparkContext.applicationId
        if application not in _made_up:
            _made_up[application] = f"file://{tempfile.mkdtemp(prefix='spanloom-')}"
            spark.sparkContext.setCheckpointDir(_made_up[application])
        found = _made_up[application]
    return found.rstrip("/")


@contextmanager
def dropping_shuffles(spark: SparkSession):
    """While this holds, shuffle files go as soon as the query that wrote them has ended."""
    before = spark.conf.get(CLEAN, None)
    try:
        spark.conf.set(CLEAN, "true")
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN)
        else:
            spark.conf.set(CLEAN, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet under the shared folder and returns the table read back.

    A lost executor then costs the tasks it ran, not the stages before; shuffle files of the
    write are dropped, so what stays on disk is the compact table; that goes when the driver ends, or before, by ``release``.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/spanloom/{name}-{uuid.uuid4().hex}"
    with dropping_shuffles(spark):
        df.write.parquet(path)
    target, fs = _at(spark, path)
    fs.deleteOnExit(target)  # at the latest; ``release`` does so where nothing reads the table again
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def release(*tables: DataFrame) -> None:
    """Deletes tables of ``materialise`` that later tables have been written from, so that disk follows the live ones."""
    for table in tables:
        path, fs = _at(table.sparkSession, table.scratch_path)
        fs.delete(path, True)
        fs.cancelDeleteOnExit(path)
