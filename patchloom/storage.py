"""Shared scratch tables: the way an operator cuts lineage.

A stage that is read more than once, or that an iterative operator builds on, is written as Parquet
under the folder the cluster names in ``spark.checkpoint.dir`` and read back. The files live in shared
storage, so a lost executor costs a re-read and nothing else.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """A folder of the application's own under ``spark.checkpoint.dir``; Hadoop deletes it when the application ends.

    Without that setting a temporary folder serves in local mode; on a cluster, whose machines share no such
    folder, it is an error."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="patchloom-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            named = f"file://{folder}"
        root = f"{named.rstrip('/')}/patchloom-{app}"
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        _ROOTS[app] = root
    return _ROOTS[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


#: Set while a table is written: Spark then drops the shuffle files of that write when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, by: str | None = None, dictionary: int = 1 << 20) -> DataFrame:
    """``df`` written once to shared storage and read back with the same schema; its shuffle files go at once.

    ``by`` names a column with few values, whose rows get a folder each, so that a filter on it reads only those.
    ``dictionary`` bounds the bytes of a column's dictionary in a file: repeated hashes are then short indexes."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        writer = df.write.option("compression", "zstd").option("parquet.dictionary.page.size", dictionary)
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        jvm, root = spark._jvm, scratch_root(spark)
        folders = {f.rpartition("/")[0] for f in df.inputFiles()}
        for folder in folders:
            if root.split("://")[-1].removeprefix("file:").lstrip("/") in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
