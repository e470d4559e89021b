"""Packing the small files of a catalogued table in place."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import partial
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesteward.functions.paths import basename, canonical_path, dirname, join_uri
from lakesteward.operators.clustering import pack_files
from lakesteward.operators.maintenance import vacuum_execute
from lakesteward.operators.manifests import data_files
from lakesteward.operators.quality import row_count
from lakesteward.plans.offboard import CountMismatch
from lakesteward.session import saved
from lakesteward.sources.manifest import MANIFEST_SCHEMA, file_manifest, path_exists, storage_opener, storage_options

#: small files that are read at once
FILES_PER_ROUND = 20_000

PLAN = "path STRING, folder STRING, length BIGINT, bin STRING"


def table_folders(spark: SparkSession, table: str) -> list[str]:
    """Folders that hold the files of a table, wherever its partitions lie.

    The session's file index, which every query of the table needs, names them.
    """
    return sorted({os.path.dirname(unquote(f)) for f in spark.table(table).inputFiles()})


def table_files(spark: SparkSession, table: str) -> DataFrame:
    """Manifest of the data files of a table."""
    folders = table_folders(spark, table)
    listed = file_manifest(spark, folders, recursive=False) if folders else spark.createDataFrame([], MANIFEST_SCHEMA)
    return data_files(listed)


def pack_table(spark: SparkSession, table: str, journal_root: str, target_bytes: int = 512 * 1024 * 1024) -> DataFrame:
    """Join the small files of each folder of a Parquet table into files of at most ``target_bytes``.

    Files of the target size or more, and those that have no partner, keep their path and are not
    read. The packed files are written beside the table and their rows counted against those of
    the small files; then they are moved into the folders and the small files are deleted. Plain
    files have no transactions: a reader that starts between the two sees rows twice, so pack while
    nobody reads, or publish a version with ``compact_table`` instead. If the job dies, ``finish_packing``
    goes on from the journal, whose folder is the first column of the result. Returns journal,
    packed files and files replaced.
    """
    journal = f"{journal_root.rstrip('/')}/packing-{uuid.uuid4().hex}"
    pack_files(table_files(spark, table), target_bytes).write.parquet(f"{journal}/plan")
    plan = spark.read.schema(PLAN).parquet(f"{journal}/plan")
    partitions = {c.name for c in spark.catalog.listColumns(table) if c.isPartition}
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.table(table).schema.fields if f.name not in partitions)
    bins = plan.select("bin").distinct().count()
    rounds = -(-plan.count() // FILES_PER_ROUND)
    for i in range(rounds):
        own = plan.filter(F.pmod(F.xxhash64("bin"), F.lit(rounds)) == i)
        paths = [r["path"] for r in own.select("path").toLocalIterator()]
        if not paths:
            continue
        rows = spark.read.schema(schema).parquet(*paths)
        named = rows.withColumn("packing_file", canonical_path(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))))
        to_bin = own.select(canonical_path(F.col("path")).alias("packing_file"), F.col("bin").alias("packing_bin"))
        joined = named.join(to_bin, "packing_file").drop("packing_file")
        # a bin is at most one file's bytes, so one task writes it
        joined.repartition("packing_bin").write.mode("append").partitionBy("packing_bin").parquet(f"{journal}/files")
        written = spark.read.schema(f"{schema}, packing_bin STRING").parquet(f"{journal}/files").join(own.select(F.col("bin").alias("packing_bin")).distinct(), "packing_bin", "left_semi")
        before, after = row_count(rows).first()["n"], row_count(written).first()["n"]
        if before != after:
            raise CountMismatch(f"{table}: {before} rows in small files, but {after} packed")
    spark.createDataFrame([(table,)], "tbl STRING").coalesce(1).write.parquet(f"{journal}/ready")
    finish_packing(spark, journal)
    counts = spark.range(1).select(F.lit(journal).alias("journal"), F.lit(bins).cast("bigint").alias("packed"), F.lit(plan.count()).alias("replaced"))
    return saved(counts, "packing")


def finish_packing(spark: SparkSession, journal: str) -> None:
    """Move the packed files into place, then delete what they replace; repeating it is harmless.

    A journal that is not ready, as its job died while writing, is refused: the table is as it was.
    """
    if not path_exists(spark, f"{journal}/ready/_SUCCESS"):
        raise FileNotFoundError(f"{journal} is not complete; pack the table again")
    plan = spark.read.schema(PLAN).parquet(f"{journal}/plan")
    table = spark.read.schema("tbl STRING").parquet(f"{journal}/ready").first()["tbl"]
    if path_exists(spark, f"{journal}/files"):
        if not path_exists(spark, f"{journal}/moves"):
            staged = data_files(file_manifest(spark, [f"{journal}/files"]))
            own = staged.select("path", F.regexp_extract(dirname(F.col("path")), "packing_bin=([0-9a-f]+)$", 1).alias("bin"))
            target = join_uri(F.col("folder"), F.concat(F.lit("packed-"), F.col("bin"), F.lit("-"), basename(F.col("path"))))
            moves = own.join(plan.select("bin", "folder").distinct(), "bin").select("path", target.alias("target"))
            moves.write.parquet(f"{journal}/moves")
        moves = spark.read.schema("path STRING, target STRING").parquet(f"{journal}/moves")
        n = moves.count()
        if moves.select("target").distinct().count() != n:
            raise ValueError(f"{journal}: two packed files would go to one place")
        tasks = max(1, min(n, spark.sparkContext.defaultParallelism))
        mover = partial(_move, options=storage_options(spark))
        saved(moves.repartition(tasks, F.xxhash64("path")).mapInArrow(mover, "target STRING"), "packing-moves")
    outcome = vacuum_execute(plan.select("path"), dry_run=False)
    failed = outcome.filter("status = 'failed'").first()
    spark.catalog.refreshTable(table)
    if failed:
        raise OSError(f"{failed['path']}: {failed['error']}")


def _move(batches: Iterator, options: dict[str, str]) -> Iterator:
    import pyarrow as pa

    open_path = storage_opener(options)
    for batch in batches:
        for path, target in zip(batch.column("path").to_pylist(), batch.column("target").to_pylist(), strict=True):
            store, inner = open_path(path)
            place = open_path(target)[1]
            try:
                store.move(inner, place)
            except FileNotFoundError:
                if not store.get_file_info(place).is_file:
                    raise  # neither here nor moved by an earlier attempt
        yield pa.RecordBatch.from_arrays([batch.column("target")], ["target"])
