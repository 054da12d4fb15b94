"""What the document operators share."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of text that one unit of work holds at most, unless a single document is longer.
BLOCK_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns that an operator reads, by fixed names and types, whatever else ``docs`` carries."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes, one row at least."""
    texts = batch.column(column)
    sizes = [0 if n is None else n for n in pc.binary_length(texts).to_pylist()]
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def carried_schema(docs: DataFrame, carry: tuple[str, ...]) -> str:
    """Columns that pass through an operator unread, as the end of a schema string."""
    return "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)


@cache
def _libc() -> ctypes.CDLL | None:
    """The C library, told to give large arrays and free memory back at once; None where it isn't glibc.

    Arrow then allocates through it as well, and native tokenizer threads, each with an arena of its own, stay off.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    try:
        libc = ctypes.CDLL(None)
        for option, value in ((-3, 1 << 18), (-1, 1 << 20), (-8, 2)):  # mmap and trim thresholds, arenas
            libc.mallopt(option, value)
        libc.malloc_trim(0)
    except (OSError, AttributeError):
        return None
    pa.set_memory_pool(pa.system_memory_pool())
    return libc


def give_back() -> None:
    """Return freed memory of this Python worker to the machine; workers live on from task to task."""
    if libc := _libc():
        libc.malloc_trim(0)
    pa.default_memory_pool().release_unused()


@cache
def one_thread() -> None:
    """Matrix products of this Python worker in one thread: small ones gain nothing from more, which wait by spinning."""
    try:
        with open("/proc/self/maps") as f:
            paths = {x.split()[-1] for x in f if "openblas" in x}
    except OSError:
        return
    for path in paths:
        lib = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)
