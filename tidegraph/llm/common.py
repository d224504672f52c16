"""Shared plumbing of the llm operators: table access, scratch tables, packed numbers.

Every operator selects the columns it needs before anything else, so extra
columns, whatever their names, never reach a mapper.
"""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BatchMapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the checkpoint folder that the session's owner has set.

    There is no local fallback: on a cluster it would lose rows.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    current = conf or spark.sparkContext.getCheckpointDir()
    if not current:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return current


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    Unlike a cache or a local checkpoint the rows survive the loss of any
    executor. The shuffle files behind them go when they are written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more: all that was made from them must be written by now."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_memos: dict[str, Callable[[], None]] = {}
_owner: str | None = None


def memo_of(name: str, clear: Callable[[], None]) -> None:
    """Names a worker-wide memo of an operator and how to empty it."""
    _memos[name] = clear


def claim(name: str) -> None:
    """Called where an operator starts to work in a Python worker: a worker outlives stages, so memos of other operators go, and their memory with them."""
    global _owner
    if _owner == name:
        return
    _owner = name
    for other, clear in _memos.items():
        if other != name:
            clear()
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps what it likes
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of unsigned 64-bit numbers (multiply and shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class WordHashes(dict):
    """Memo from a word (bytes) to its 64-bit hash; emptied when it has ``limit`` words."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit
        import xxhash

        self._digest = xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = self._digest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def texts_of(batch: pa.RecordBatch, column: str) -> list:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; on executors it is found anew."""
    import public_tokenizers

    return public_tokenizers.path(os.path.basename(name))
