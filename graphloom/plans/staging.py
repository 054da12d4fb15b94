"""Cutting lineage with tables written to the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only in local mode, where none is set.

    On a cluster executors would each write to a disk of their own, so there it must be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def stage_table(df: DataFrame, tag: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and return a scan of it.

    Unlike ``checkpoint()`` this computes the plan a single time, keeps column pruning and statistics, and survives
    lost executors. The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def stage_bucketed(df: DataFrame, key: str, tag: str = "bucketed") -> DataFrame:
    """Like :func:`stage_table`, dealt by ``key``: joins on it read the table as it lies, round after round, and only
    what meets it is shuffled. Each task writes one bucket, so there are as many files as partitions are set."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"graphloom_{tag}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/graphloom/{name}"
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(name)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.table(name)


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`stage_table` that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    paths = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for path in paths:
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
