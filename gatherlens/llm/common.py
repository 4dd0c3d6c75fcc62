"""What the operators of this subpackage share: staged tables, bounded chunks of
texts inside a task, word hashes."""
from __future__ import annotations

import ctypes
import gc
import inspect
import re
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatherlens.session import _conf

CHUNK_BYTES = 4 << 20
RELEASE_BYTES = 4 << 20   # smaller groups leave little to release


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.  Only a local session in
    which it is unset gets a folder of its own."""
    path = _conf(spark, "spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="shared-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: the
    lineage is cut, a lost executor costs a re-read, and the planner knows the size
    of what it reads (it broadcasts below its own threshold and shuffles beyond)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    # The cleaner drops shuffle files once the driver has collected their handles.
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def file_system(path: str):
    """pyarrow's file system of a path, and the path in it."""
    # 'file:/x' is how Hadoop prints a local path.
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more: what was made of them must be
    staged or written itself, as a lost executor would read them again."""
    for table in tables:
        fs, path = file_system(table.staged_at)
        fs.delete_dir(path)


def release() -> None:
    """Gives memory that a worker has freed back to the machine.  Workers are kept for
    later tasks, and would else hold their peak beside the JVM's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """``run`` (for mapInArrow or applyInArrow), releasing memory after each task or group.
    A task's tables of many small objects have no cycles: they are not searched for any."""
    def mapped(batches):
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()
            release()

    def grouped(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            if table.nbytes > RELEASE_BYTES:
                release()

    def cogrouped(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            release()
    if run.__code__.co_flags & inspect.CO_GENERATOR:
        return mapped
    return grouped if run.__code__.co_argcount == 1 else cogrouped


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_hash(*columns) -> F.Column:
    """128 bits of the columns, as text: two 64-bit hashes that start differently."""
    return F.concat_ws(":", F.xxhash64(*columns), F.xxhash64(F.lit("row"), *columns))


def utf8(texts: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null gives empty."""
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    return [b or b"" for b in texts.cast(kind).to_pylist()]


def chunks(batches, column: str, max_bytes: int = CHUNK_BYTES):
    """Slices of Arrow batches with at most ``max_bytes`` of text in ``column`` each
    (one row at least), so that a task holds the words of few texts at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def hash_words(words: list[bytes]) -> np.ndarray:
    """A keyed 64-bit hash (SipHash) of each word."""
    flat = np.empty(len(words), dtype=object)
    flat[:] = words
    return pd.util.hash_array(flat, categorize=False) if len(words) else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` neighbouring hashes (order counts)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out = mix(out) + hashes[j:j + n]
    return mix(out)
