"""Spark session construction and lineage helpers.

The library never hard-codes a storage location.  Reliable checkpoints go to
``spark.checkpoint.dir`` as configured by the cluster; only tests and local
runs (where it is unset) get a directory set for them.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a cluster job wants regardless of data size: adaptive execution
# re-plans joins from real shuffle sizes (broadcast only what is measured to
# be small), splits skewed join partitions and coalesces small ones.
ADAPTIVE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    master: str | None = None,
    app_name: str = "polyrisk",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the adaptive settings above.

    On a cluster, leave ``master`` and ``shuffle_partitions`` unset and let
    the submit configuration decide; locally pass e.g. ``local[8]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(ADAPTIVE_CONF)
    conf["spark.ui.enabled"] = "false"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint directory named by the cluster, if any."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    return spark.sparkContext.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the checkpoint directory, setting one only when none is set.

    A cluster always names a shared folder in ``spark.checkpoint.dir``; this
    fallback exists for tests and single-machine runs.
    """
    current = checkpoint_dir(spark)
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError(
            "spark.checkpoint.dir is not set: configure a shared folder (e.g. on the "
            "cluster file system) so lineage cuts survive lost executors"
        )
    path = fallback or tempfile.mkdtemp(prefix="polyrisk-ckpt-")
    os.makedirs(path, exist_ok=True)
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` to the reliable checkpoint directory.

    Used before iterative work (training passes) so that a lost executor
    re-reads checkpoint files instead of re-running the whole scan.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    One job, where a checkpoint computes its input twice; columns drawn from
    partition ids are fixed from here on.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
