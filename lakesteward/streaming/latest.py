"""The latest state per key, kept up to date instead of polled."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lakesteward.sources.manifest import list_prefix, path_exists


def event_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files below a directory or matching a glob, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def latest_states(events: DataFrame, key: list[str], order: str, values: list[str]) -> DataFrame:
    """Running aggregate: latest values, their position, and the number of events per key."""
    return (
        events.groupBy(*key)
        .agg(
            F.max_by(F.struct(*values), F.col(order)).alias("_last"),
            F.max(order).alias(order),
            F.count("*").alias("n"),
        )
        .select(*key, *(F.col(f"_last.{v}").alias(v) for v in values), order, "n")
    )


def stream_latest_state(
    events: DataFrame, key: list[str], order: str, values: list[str], root: str
) -> StreamingQuery:
    """Start the aggregation over what has arrived and write each batch's changed keys.

    Run it again with the same ``root`` and it goes on from its checkpoint. A batch goes to a
    directory named by its number, so one that is repeated after a failure overwrites itself.
    """
    def write_changes(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(root, "changes", f"batch={batch_id}"))

    return (
        latest_states(events, key, order, values)
        .writeStream.outputMode("update")
        .foreachBatch(write_changes)
        .option("checkpointLocation", os.path.join(root, "progress"))
        .trigger(availableNow=True)
        .start()
    )


def latest_snapshot(spark: SparkSession, root: str, key: list[str]) -> DataFrame:
    """The newest row per key: the last folded state and the finished batches written since."""
    changes, _ = _changes(spark, root)
    if changes is None:
        raise FileNotFoundError(f"no finished batch below {root}")
    return _newest(changes, key).drop("batch")


def fold_changes(spark: SparkSession, root: str, key: list[str]) -> int | None:
    """Store the newest row per key as one folded state, so that a snapshot need not read every
    batch ever written. Returns the number of the last batch that it covers.

    Folded states have their own directories: nothing that is being read is replaced, and one
    that was not finished is ignored, as is a batch that is not finished, with all after it. The
    batches covered may then be vacuumed.
    """
    changes, upto = _changes(spark, root)
    if upto is None or upto == _folded_upto(spark, root):
        return upto
    _newest(changes, key).write.mode("overwrite").parquet(os.path.join(root, "folded", f"upto={upto}"))
    return upto


def _newest(changes: DataFrame, key: list[str]) -> DataFrame:
    kept = [c for c in changes.columns if c not in key]
    newest = changes.groupBy(*key).agg(F.max_by(F.struct(*kept), F.col("batch")).alias("_row"))
    return newest.select(*key, "_row.*")


def _finished(spark: SparkSession, folder: str) -> dict[int, bool]:
    """Numbers of the directories ``name=number`` below ``folder``, and whether each was written to its end."""
    if not path_exists(spark, folder):
        return {}
    names = [os.path.basename(r["path"].rstrip("/")) for r in list_prefix(spark, folder).filter("is_dir").collect()]
    return {int(n.split("=")[1]): path_exists(spark, os.path.join(folder, n, "_SUCCESS")) for n in names if "=" in n}


def _folded_upto(spark: SparkSession, root: str) -> int | None:
    return max((n for n, done in _finished(spark, os.path.join(root, "folded")).items() if done), default=None)


def _changes(spark: SparkSession, root: str) -> tuple[DataFrame | None, int | None]:
    """Rows with their batch number, and the last batch: the folded state, if any, and the batches after it.

    Batches are taken up to the first unfinished one.
    """
    folder, upto = os.path.join(root, "changes"), _folded_upto(spark, root)
    batches = {n: done for n, done in sorted(_finished(spark, folder).items()) if upto is None or n > upto}
    ready = []
    for n, done in batches.items():
        if not done:
            break
        ready.append(n)
    folded = None if upto is None else spark.read.parquet(os.path.join(root, "folded", f"upto={upto}"))
    if not ready:
        return folded, upto
    paths = [os.path.join(folder, f"batch={n}") for n in ready]
    rows = spark.read.option("basePath", folder).parquet(*paths).withColumn("batch", F.col("batch").cast("bigint"))
    return (rows if folded is None else folded.unionByName(rows)), ready[-1]
