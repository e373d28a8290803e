"""Cutting lineage through files in the cluster's shared folder.

A written table survives the loss of executors, keeps column pruning and row
counts for its readers, and has true size statistics for the optimizer.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the session names none, a single-process session (``local[...]``, as
    in tests) gets a temporary folder of its own; a cluster gets an error, as
    executors cannot see the driver's folders.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="tremolo-")
    return _LOCAL_FOLDERS[context.applicationId]


def scratch_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/tremolo/{kind}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, kind: str = "table", by: str | list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a scan of it; with
    ``by``, in one folder for each value of that column (or those columns)."""
    spark = df.sparkSession
    path = scratch_path(spark, kind)
    by = [by] if isinstance(by, str) else by
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    if by:  # reading puts these columns last
        table = table.select(*df.columns)
    table.scratch_path = path
    return table


def written(table: DataFrame) -> bool:
    """Whether ``materialize`` returned this very table, so that it need not be written again."""
    return hasattr(table, "scratch_path")


def discard(table: DataFrame, part: str = "") -> None:
    """Delete the files, or those of one part ``column=value``, of a table that
    ``materialize`` returned and that no later step reads."""
    context = table.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{table.scratch_path}/{part}".rstrip("/"))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of steps whose results are
    written and whose plans are no longer held; otherwise they stay until the
    driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()

