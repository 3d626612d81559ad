"""Session construction and lineage management."""

from __future__ import annotations

import os
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Defaults tuned for the operators in this package (builder settings; a
# deployment's own configuration is applied on top by spark-submit).
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "cohortlens",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a SparkSession with the package defaults."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def size_for_input(spark: SparkSession, input_bytes: int, target_partition_bytes: int = 128 << 20,
                   overwrite: bool = False) -> int:
    """Spill-aware sizing from the input size: shuffle partitions so each
    holds about ``target_partition_bytes`` (never fewer than the default
    parallelism), the same advisory size for AQE coalescing/skew splits, and
    the scan split size.  Keys already set by the deployment are kept unless
    ``overwrite``.  Returns the shuffle partition count.
    """
    n = max(spark.sparkContext.defaultParallelism, -(-int(input_bytes) // int(target_partition_bytes)))
    settings = {"spark.sql.shuffle.partitions": str(n),
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(int(target_partition_bytes)),
                "spark.sql.files.maxPartitionBytes": str(int(target_partition_bytes))}
    conf = spark.sparkContext.getConf()
    for k, v in settings.items():
        if overwrite or not conf.contains(k):
            spark.conf.set(k, v)
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``; we only create our own
    (under /tmp) when it is unset *and* Spark runs in local mode, i.e. in
    tests.  On a cluster an unset folder is an error, never a local path.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not conf_dir:
        if not _is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf_dir = tempfile.mkdtemp(prefix="cohortlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return conf_dir


def materialize(df: DataFrame, cut_lineage: bool = True) -> DataFrame:
    """Persist a DataFrame that many later jobs re-read.

    With ``cut_lineage`` the result is a reliable checkpoint in the shared
    checkpoint folder, so a lost executor re-reads the checkpoint instead of
    replaying scans, joins and aggregations.  Otherwise it is cached
    memory-and-disk (lineage kept, recomputed on loss).
    """
    if cut_lineage:
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    return df.persist(StorageLevel.MEMORY_AND_DISK)
