"""Copying scoped parts of a data set to another root."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lakesteward.functions.paths import canonical_path
from lakesteward.operators.maintenance import vacuum_execute
from lakesteward.operators.manifests import data_files, manifest_summary, table_roots
from lakesteward.operators.scope import CLONE_ORDER, any_scope, filter_scope, parse_scope
from lakesteward.session import saved
from lakesteward.sources.basic import rows_source
from lakesteward.sources.manifest import file_manifest, path_exists, qualified
from lakesteward.sources.sinks import overwrite_sink, same_or_nested


def clone_table(
    spark: SparkSession,
    src: str,
    dst: str,
    scope: dict[str, Iterable] | Column | None = None,
    replace: str = "all",
    fmt: str = "parquet",
    partition_by: list[str] | None = None,
    schema: StructType | str | None = None,
    rebalance: bool = True,
) -> DataFrame:
    """Copy the rows in ``scope`` as a clean snapshot and read it back.

    Rows are selected by predicate, never files by name, so the copy is always readable. By
    default everything at ``dst`` is replaced; ``replace="partitions"`` replaces only the
    partitions written, so one that has become empty at the source stays as it was. Turn
    ``rebalance`` off when the source already has the same partitioning: the copy then needs no
    shuffle.
    """
    if same_or_nested(src, dst):
        raise ValueError(f"{dst} overlaps {src}: overwriting a path that is being read destroys it")
    reader = spark.read.format(fmt)
    rows = filter_scope((reader.schema(schema) if schema is not None else reader).load(src), scope)
    return overwrite_sink(rows, dst, fmt, partition_by, replace, rebalance=rebalance)


def remap(prefix: str, source: str, target: str) -> str:
    """``remap_prefix`` for a path held on the driver."""
    if prefix == source or prefix.startswith(source + "/"):
        return target + prefix[len(source):]
    return prefix


def clone_prefixes(
    spark: SparkSession,
    src_root: str,
    dst_root: str,
    prefixes: list[str] | None = None,
    source_env: str = "qa",
    target_env: str = "local",
    replace: str = "all",
    fmt: str = "parquet",
) -> DataFrame:
    """Clone every table below the prefixes, moving ``source_env`` to ``target_env``.

    A prefix is a layer, a table or one partition of a table, as its directory is named; by default
    all four layers. One that does not exist adds nothing, nor does a table log by itself; but with no
    prefix at all there, a target that holds files is left alone and the call fails. A table
    whose directory holds a transaction log is refused: its files alone do not say which rows are
    valid. The columns of all files of a table are merged. ``replace="all"`` leaves nothing else
    below ``dst_root``. Returns the number of objects and bytes there.
    """
    if same_or_nested(src_root, dst_root):
        raise ValueError(f"{dst_root} overlaps {src_root}")
    src_root, dst_root = (qualified(spark, p.rstrip("/")) for p in (src_root, dst_root))
    wanted = prefixes or [f"{source_env}/{layer}" for layer in CLONE_ORDER]
    wanted = [p.strip("/") for p in wanted if not p.rstrip("/").endswith("/_delta_log")]
    present = [p for p in wanted if path_exists(spark, f"{src_root}/{p}")]
    if not present and path_exists(spark, dst_root) and not file_manifest(spark, [dst_root]).isEmpty():
        raise FileNotFoundError(f"none of {wanted} exists below {src_root}")
    scopes: dict[str, list[dict[str, str | None]]] = {}
    layouts: dict[str, list[str]] = {}
    # partition prefixes of one table count as the table here; its partitions are told apart below
    tables_of = sorted({parse_scope(p)[0] for p in present})
    listed = saved(file_manifest(spark, [f"{src_root}/{p}" for p in tables_of]), "clone-source") if tables_of else None
    if listed is not None:
        logged = listed.filter(F.col("path").rlike("/_delta_log/")).select("path").first()
        if logged:
            raise ValueError(f"a table with a transaction log cannot be cloned from its files: {logged['path']}")
        # one row per table, of which a lake has thousands rather than billions
        for row in table_roots(data_files(listed)).toLocalIterator():
            table = row["path"][len(src_root) + 1 :]
            for prefix in present:
                base, values = parse_scope(prefix)
                if table == base or (not values and f"{table}/".startswith(f"{base}/")):
                    scopes.setdefault(table, []).append(values)
                    layouts[table] = row["partition_by"]
    targets = []
    for table, choices in scopes.items():
        source, target = f"{src_root}/{table}", f"{dst_root}/{remap(table, source_env, target_env)}"
        columns = layouts[table]
        # partition values are kept as text, so that "006" is not copied as 6
        stored = spark.read.format(fmt).option("mergeSchema", True).load(source).schema
        schema = StructType([StructField(f.name, StringType()) if f.name in columns else f for f in stored])
        scope = any_scope(choices) if all(choices) else None
        clone_table(spark, source, target, scope, replace, fmt, columns, schema, rebalance=False)
        targets.append(target)
    if replace == "all" and path_exists(spark, dst_root):
        remove_others(spark, dst_root, targets)
    if not path_exists(spark, dst_root):
        return rows_source(spark, [(0, 0)], "objects BIGINT, bytes BIGINT")
    return manifest_summary(data_files(file_manifest(spark, [dst_root])))


def remove_others(spark: SparkSession, root: str, tables: list[str]) -> DataFrame:
    """Delete the files below ``root`` that lie directly in, or in a partition of, none of the ``tables``."""
    everything = file_manifest(spark, [root])
    directory = F.regexp_replace("path", r"/[^/]*$", "")
    place = canonical_path(F.regexp_replace(directory, r"(/[^/=]+=[^/]*)+$", ""))
    names = rows_source(spark, [(t,) for t in tables], "kept STRING").select(canonical_path(F.col("kept")).alias("kept"))
    return vacuum_execute(everything.join(names, place == F.col("kept"), "left_anti"), dry_run=False)
