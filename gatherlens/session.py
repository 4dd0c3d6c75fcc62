"""SparkSession setup shared by the library, the tests and the bench.

The library never creates a session on its own inside an operator: operators take
DataFrames.  ``get_session`` is a convenience for scripts and tests; ``configure``
pins the few runtime settings the operators rely on on a session somebody else
built (the cluster's, or the driver's).
"""
from __future__ import annotations

import os
import re
import tempfile
import uuid
import warnings

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators are written for.  All are SQL runtime confs, so
# they can be set on an existing session.
RUNTIME_CONF = {
    # Local wall-clock fields are derived from explicit zones; the session zone
    # only matters when a TIMESTAMP (with local time zone) is cast to a wall time.
    "spark.sql.session.timeZone": "UTC",
    # AQE: coalesce small shuffle partitions, turn sort-merge joins into broadcast
    # joins once the *measured* build side is small, and split skewed partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


MB = 1 << 20


def cluster_conf(input_bytes: int, total_cores: int, target_partition_mb: int = 128) -> dict:
    """Partition sizing for a cluster run, as SQL confs to pass to ``get_session``
    (``extra=``) or set on a session.

    Shuffles start with about one partition per ``target_partition_mb`` of input
    (at least two per core); AQE then coalesces small ones toward the same
    advisory size and splits skewed ones.  Scans read splits of up to 256 MB.  For
    100 TB this gives 819,200 initial shuffle partitions, coalesced at run time.
    """
    initial = max(2 * total_cores, input_bytes // (target_partition_mb * MB))
    return {
        "spark.sql.shuffle.partitions": str(initial),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(initial),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_mb * MB),
        "spark.sql.files.maxPartitionBytes": str(256 * MB),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_mb * MB),
    }


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings and wire the checkpoint directory, if any."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    checkpoint_dir(spark)
    return spark


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "gatherlens", checkpoint: str | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session.  ``checkpoint`` is only used when the cluster
    has not named a shared ``spark.checkpoint.dir`` itself (tests, local runs)."""
    builder = SparkSession.builder.appName(app_name).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if checkpoint and not _conf(spark, "spark.checkpoint.dir"):
        spark.conf.set("spark.checkpoint.dir", checkpoint)
    return configure(spark)


def _conf(spark: SparkSession, key: str) -> str | None:
    value = spark.conf.get(key, None)
    if value:
        return value
    return spark.sparkContext.getConf().get(key, None)


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder named by ``spark.checkpoint.dir`` (or None).

    The folder is read from the session, never invented here: on a cluster it
    must be a shared file system that survives executor loss.
    """
    path = _conf(spark, "spark.checkpoint.dir")
    if path:
        sc = spark.sparkContext
        on_disk = path.startswith("file:") or "://" not in path
        if on_disk and not re.match(r"local(-cluster)?\b", sc.master) and not os.path.ismount(
                re.sub("^file:/+", "/", path)):
            warnings.warn(f"spark.checkpoint.dir {path} looks local; it must be shared by all executors", stacklevel=2)
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of a DataFrame that several later jobs reuse.

    With a shared checkpoint folder the rows are written there (reliable
    checkpoint: a lost executor costs a re-read, not a recompute of the whole
    lineage).  Without one the rows are persisted to memory and disk.
    """
    if checkpoint_dir(df.sparkSession):
        # Persist first: writing a reliable checkpoint runs the lineage again
        # unless the rows are already kept.
        kept = df.persist(StorageLevel.MEMORY_AND_DISK)
        out = kept.checkpoint(eager=True)
        kept.unpersist()
        return out
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the session's shared checkpoint folder.  Only a local
    session without one gets a folder of its own under /tmp."""
    base = checkpoint_dir(spark)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="gatherlens-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: one job that cuts the
    lineage, where a checkpoint takes two, and later reads take only the columns they need."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
