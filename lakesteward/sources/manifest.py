"""Listings of stored objects, produced by tasks rather than by the driver."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesteward.session import workspace
from lakesteward.sources.basic import rows_source

MANIFEST_SCHEMA = "prefix STRING, path STRING, is_dir BOOLEAN, length BIGINT, mtime TIMESTAMP"
_ROWS_PER_BATCH = 8192


# Settings of Spark's object-store connector and what Arrow calls them.
_S3_SETTINGS = {
    "spark.hadoop.fs.s3a.endpoint": "endpoint_override",
    "spark.hadoop.fs.s3a.endpoint.region": "region",
    "spark.hadoop.fs.s3a.access.key": "access_key",
    "spark.hadoop.fs.s3a.secret.key": "secret_key",
    "spark.hadoop.fs.s3a.session.token": "session_token",
}


def storage_options(spark: SparkSession) -> dict[str, str]:
    """Object-store options for tasks, taken from the settings Spark's own connector uses."""
    conf = spark.sparkContext.getConf()
    found = {option: conf.get(key) for key, option in _S3_SETTINGS.items()}
    options = {option: value for option, value in found.items() if value}
    if conf.get("spark.hadoop.fs.s3a.connection.ssl.enabled") == "false":
        options["scheme"] = "http"
    if "endpoint_override" in options:
        options["endpoint_override"] = re.sub("^https?://", "", options["endpoint_override"])
    return options


def storage_opener(options: dict[str, str] | None = None) -> Callable[[str], tuple]:
    """Function from a path to its Arrow file system and the path inside it.

    File systems are kept from call to call. ``s3a`` is the same store as ``s3``.
    """
    from pyarrow import fs

    stores: dict[str, fs.FileSystem] = {}

    def open_path(path: str) -> tuple:
        match = re.match(r"^([A-Za-z][A-Za-z0-9+.\-]*):(//[^/]*)?(.*)$", path)
        scheme, inner = ("file", path) if match is None else (match.group(1), match.group(3))
        scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
        authority = "" if match is None else (match.group(2) or "//")[2:]
        place = f"{scheme}://{authority}"
        if place not in stores:
            if scheme == "file":
                stores[place] = fs.LocalFileSystem()
            elif scheme == "s3" and options:
                stores[place] = fs.S3FileSystem(**options)
            else:
                stores[place] = fs.FileSystem.from_uri(place)[0]
        # object stores take the bucket as part of the path
        return stores[place], inner if scheme in ("file", "hdfs", "viewfs") else authority + inner

    return open_path


def path_exists(spark: SparkSession, path: str) -> bool:
    from pyarrow import fs

    store, inner = storage_opener(storage_options(spark))(qualified(spark, path))
    return store.get_file_info(inner.rstrip("/") or "/").type != fs.FileType.NotFound


def _entries(store, inner: str, path: str) -> Iterator[tuple[str, bool, int, int | None]]:
    """(path, is_dir, length, mtime in microseconds) of a file, or of what a directory holds."""
    from pyarrow import fs

    def entry(info: fs.FileInfo, shown: str) -> tuple[str, bool, int, int | None]:
        mtime = None if info.mtime_ns is None else info.mtime_ns // 1000
        return shown, info.type == fs.FileType.Directory, info.size or 0, mtime

    own = store.get_file_info(inner.rstrip("/") or "/")
    if own.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    parent = path.rstrip("/")
    if own.type == fs.FileType.File:
        yield entry(own, parent)
    elif store.type_name == "local":
        # one entry at a time, however many the directory holds
        with os.scandir(inner) as found:
            for item in found:
                try:
                    status = item.stat()
                except FileNotFoundError:
                    continue  # gone since it was listed
                is_dir = item.is_dir()
                yield f"{parent}/{item.name}", is_dir, 0 if is_dir else status.st_size, status.st_mtime_ns // 1000
    else:
        for info in store.get_file_info(fs.FileSelector(own.path, recursive=False)):
            yield entry(info, f"{parent}/{info.base_name}")


def _list_one_level(batches: Iterator, options: dict[str, str]) -> Iterator:
    import pyarrow as pa

    types = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", tz="UTC")]
    names = ["prefix", "path", "is_dir", "length", "mtime"]
    open_path = storage_opener(options)
    for batch in batches:
        for prefix, path in zip(batch.column("prefix").to_pylist(), batch.column("path").to_pylist()):
            entries = _entries(*open_path(path), path)
            while part := list(islice(entries, _ROWS_PER_BATCH)):
                columns = [[prefix] * len(part), *map(list, zip(*part))]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns, types)), names=names)


def _lister(spark: SparkSession) -> Callable[[Iterator], Iterator]:
    return partial(_list_one_level, options=storage_options(spark))


def qualified(spark: SparkSession, path: str) -> str:
    """A path without a scheme in the session's default file system, as Spark's readers take it."""
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    if re.match(r"^[A-Za-z][A-Za-z0-9+.\-]*:", path) or default.startswith("file:"):
        return path
    return default.rstrip("/") + "/" + path.lstrip("/")


def outermost(prefixes: Iterable[str]) -> list[str]:
    """The prefixes that lie below no other one, each once."""
    kept: list[str] = []
    for prefix in sorted({p.rstrip("/") or "/" for p in prefixes}, key=lambda p: p.rstrip("/") + "/"):
        if not kept or not (prefix.rstrip("/") + "/").startswith(kept[-1].rstrip("/") + "/"):
            kept.append(prefix)
    return kept


def list_prefix(spark: SparkSession, path: str) -> DataFrame:
    """One level below ``path``, directories included; a missing path is an error."""
    path = qualified(spark, path)
    start = rows_source(spark, [(path, path)], "prefix STRING, path STRING")
    return start.coalesce(1).mapInArrow(_lister(spark), MANIFEST_SCHEMA)


def file_manifest(spark: SparkSession, prefixes: Iterable[str], recursive: bool = True) -> DataFrame:
    """Every file below the prefixes, hidden ones included, once each: a prefix below another one adds nothing.

    The walk goes level by level. The directories of a level are spread evenly over the tasks,
    so one huge prefix is listed by many tasks, and each level is written to the shared folder,
    so no listing is repeated and neither paths nor file names pass through the driver.
    """
    root = workspace(spark, "manifest")
    most = spark.sparkContext.defaultParallelism
    starts = [(p, p) for p in outermost(qualified(spark, p) for p in prefixes)]
    frontier = rows_source(spark, starts, "prefix STRING, path STRING")
    level, directories, lister = 0, len(starts), _lister(spark)
    while True:
        # a fixed number of partitions, as AQE would merge small rows that are slow to serve
        spread = frontier.repartition(max(1, min(directories, most)), F.xxhash64("path"))
        spread.mapInArrow(lister, MANIFEST_SCHEMA).write.parquet(f"{root}/level={level}")
        listed = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{root}/level={level}")
        frontier = listed.filter("is_dir").select("prefix", "path")
        directories = frontier.count() if recursive else 0
        if directories == 0:
            break
        level += 1
    every_level = spark.read.schema(MANIFEST_SCHEMA + ", level INT").parquet(root)
    return every_level.filter(~F.col("is_dir")).drop("is_dir", "level")
