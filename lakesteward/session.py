"""Session settings and the shared folder that jobs write intermediate tables to."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

_local_bases: dict[str, str] = {}


def build_session(app_name: str, master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings the operators are written for.

    AQE does the work that depends on real sizes: it coalesces small shuffle partitions, splits
    skewed join and rebalance partitions, and turns a join into a broadcast once a side has
    proved small. Everything here can be overridden through ``conf`` or spark-submit.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        # once every partition of the smaller side has proved this small, hash it instead of sorting both
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
        # a union inside a union of co-partitioned joins can fail under AQE in Spark 4.1 with
        # "Can't zip RDDs with unequal numbers of partitions"
        "spark.sql.unionOutputPartitioning": "false",
        # streaming state on the executors' disks instead of in their heaps
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **(conf or {}),
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, falls back to a temporary
    folder; on a cluster a missing setting is an error rather than a machine-local path.
    """
    context = spark.sparkContext
    base = context.getConf().get(CHECKPOINT_CONF) or spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        base = _local_bases.get(context.applicationId)
        if base is None:
            base = tempfile.mkdtemp(prefix="lakesteward-")
            _local_bases[context.applicationId] = base
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base


def workspace(spark: SparkSession, label: str) -> str:
    """A fresh, not yet existing directory below the shared folder."""
    return os.path.join(shared_root(spark), f"{label}-{uuid.uuid4().hex}")


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back.

    Cuts the lineage, survives the loss of executors, and gives the optimizer the true size.
    """
    path = workspace(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
