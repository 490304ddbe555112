"""Small helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import os
import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

from gridwise.session import use_checkpoint_dir


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows are whole texts, so a batch is bounded by its bytes.
BYTES_PER_BATCH = 2 << 20
DEFAULT_BYTES = "67108864b"


def ship(spark: SparkSession) -> SparkSession:
    """Prepare a session for the Python stages: the byte bound of its Arrow batches is lowered where none was chosen.

    Plans read that setting when they run, so it stays. Workers find this package where its folder exists; on other
    clusters pass it with --py-files.
    """
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting) == DEFAULT_BYTES:
        spark.conf.set(setting, str(BYTES_PER_BATCH))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    context = spark.sparkContext
    paths = context.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        context.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared checkpoint folder."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write `df` as compressed Parquet under the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    use_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(kind: str, key: Any, make: Callable[[], Any]) -> Any:
    """What `make` gives, made once in each Python worker process and kept until another key of its kind comes.

    The first word of a kind names its operator. Workers are used again by later stages, so what another operator has
    left behind goes first, and the memory that it took goes back to the system.
    """
    store = sys.modules.setdefault("_gridwise_llm_once", types.ModuleType("_gridwise_llm_once"))
    kept = store.__dict__.setdefault("kept", {})
    if kind in kept and kept[kind][0] == key:
        return kept[kind][1]
    operator = kind.split()[0]
    left = [x for x in kept if x.split()[0] != operator or x == kind]
    for x in left:
        del kept[x]
    if left:
        hand_back()
    kept[kind] = key, make()
    return kept[kind][1]


def hand_back() -> None:
    """Give freed memory back to the system, where it can be asked to."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def tidied(run: Callable[[Iterator[Any]], Iterator[Any]]) -> Callable[[Iterator[Any]], Iterator[Any]]:
    """`run`, after which a worker hands back what a task has freed; it waits for its next task with what it keeps only."""

    def tidy(batches: Iterator[Any]) -> Iterator[Any]:
        try:
            yield from run(batches)
        finally:
            hand_back()

    return tidy


def by_bytes(batches: Iterable[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that `column` holds about `most` bytes in each; a longer single row stays whole."""
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start = size = 0
        for i, n in enumerate(lengths):
            if size and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)


def fresh(taken: Iterable[str], name: str) -> str:
    """`name`, with underscores before it until no column of `taken` has it."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name
