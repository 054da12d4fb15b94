"""Documents as numbered blocks in a table bucketed by block, so that what is found for a block joins it unshuffled."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from graphloom.llm.common import give_back, id_text, slices
from graphloom.plans.staging import shared_dir


def pack(values: np.ndarray) -> bytes:
    """Compressed, the bytes of equal weight together."""
    width = values.dtype.itemsize
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes(), 3)


def unpack(blob: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(kind)


def block_table(docs: DataFrame, limit: int, make: Callable[[pa.RecordBatch], list], schema: str) -> DataFrame:
    """A table ``block, *schema``: ``make`` gives the values of one row from a slice of about ``limit`` bytes of text.

    It lies in the shared folder, is bucketed by block, and joins other frames on block without a shuffle of its own.
    """
    spark = docs.sparkSession
    names = ["block", *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        give_back()
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, limit=limit):
                yield pa.RecordBatch.from_arrays([pa.array([number]), *(x if isinstance(x, pa.Array) else pa.array([x]) for x in make(part))], names)
                give_back()
                number += 1

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"graphloom_blocks_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/graphloom/{name}"
    made = id_text(docs).mapInArrow(run, f"block long, {schema}")
    made.write.format("parquet").bucketBy(n, "block").option("path", path).saveAsTable(name)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.table(name)
