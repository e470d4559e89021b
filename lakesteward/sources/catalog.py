"""Databases and external tables in the Spark catalog."""

from __future__ import annotations

import re
import time
import uuid
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain
from urllib.parse import unquote

from pyspark import InheritableThread
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakesteward.functions.paths import dirname
from lakesteward.operators.manifests import data_files
from lakesteward.sources.basic import rows_source
from lakesteward.sources.manifest import file_manifest, path_exists, qualified

OUTCOME_SCHEMA = "idx INT, total INT, path STRING, ok BOOLEAN, error STRING"


# Fixed value: how a partition directory names a null.
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"

#: the values of a partition's columns as text, null as None
PartitionKey = tuple[str | None, ...]


class SchemaDrift(ValueError):
    """Declared columns do not match the stored files."""


@dataclass(frozen=True)
class TableDefinition:
    table: str
    location: str
    columns: list[tuple[str, str]]
    database: str | None = None
    format: str = "parquet"
    partition_by: list[str] = field(default_factory=list)
    properties: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_row(cls, row: Row) -> TableDefinition:
        return cls(
            table=row["table"],
            location=row["location"],
            columns=[(c["name"], c["type"]) for c in row["columns"] or []],
            database=row["database"],
            format=row["format"] or "parquet",
            partition_by=list(row["partition_by"] or []),
            properties=dict(row["properties"] or {}),
        )

    @property
    def declared(self) -> StructType:
        return StructType.fromDDL(", ".join(f"{quoted(n)} {t}" for n, t in self.columns))

    @property
    def full_name(self) -> str:
        return f"{self.database}.{self.table}" if self.database else self.table


def quoted(name: str) -> str:
    """A possibly dotted name with each part in backticks."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split("."))


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _provider(fmt: str) -> str:
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_.]*", fmt):
        raise ValueError(f"not a data source name: {fmt!r}")
    return fmt


def ensure_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(name)}")


def table_details(spark: SparkSession, name: str) -> dict[str, str]:
    """What the catalog says of a table, without its columns, which may bear the same names."""
    rows = [(r["col_name"], r["data_type"]) for r in spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(name)}").collect()]
    begin = next((i for i, (title, _) in enumerate(rows) if title == "# Detailed Table Information"), len(rows))
    return dict(rows[begin + 1 :])


def table_location(spark: SparkSession, name: str) -> str | None:
    """The catalogued location of a table."""
    return table_details(spark, name).get("Location")


def table_properties(spark: SparkSession, name: str) -> dict[str, str]:
    """Properties that a user has set; Spark keeps its own under other names."""
    rows = spark.sql(f"SHOW TBLPROPERTIES {quoted(name)}").collect()
    return {r["key"]: r["value"] for r in rows if not r["key"].startswith(("spark.sql.", "transient_")) and r["key"] != "EXTERNAL"}


def catalogued_tables(spark: SparkSession) -> list[str]:
    """Names of all tables of the current catalog, temporary views left out."""
    found = []
    for database in spark.catalog.listDatabases():
        found += [f"{database.name}.{t.name}" for t in spark.catalog.listTables(database.name) if not t.isTemporary]
    return found


def check_drift(spark: SparkSession, definition: TableDefinition) -> None:
    """Fail if files exist at the location and their schema differs from the declared columns.

    A stored column that is not declared is a difference too, as readers would not see it.
    """
    try:
        stored = spark.read.format(_provider(definition.format)).load(definition.location).schema
    except AnalysisException as error:
        if error.getCondition() in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
            return  # registered ahead of its data
        raise
    actual = {f.name: f.dataType for f in stored.fields}
    problems = [
        f"{f.name} is not stored" if f.name not in actual
        else f"{f.name} is {actual[f.name].simpleString()}, declared {f.dataType.simpleString()}"
        for f in definition.declared.fields
        # a partition column's stored type is only guessed from its path
        if f.name not in definition.partition_by
        and (f.name not in actual or actual[f.name].simpleString() != f.dataType.simpleString())
    ]
    declared = {f.name for f in definition.declared.fields} | set(definition.partition_by)
    problems += [f"{name} is stored but not declared" for name in actual if name not in declared]
    if problems:
        raise SchemaDrift("; ".join(problems))


def register_table(spark: SparkSession, definition: TableDefinition, checked: bool = False) -> None:
    """Ensure the database and create the external table, or replace its catalog entry.

    Everything that can be checked is checked before the old entry is dropped. The files are
    never touched; a managed table of the same name is refused, as dropping it would delete data.
    ``checked`` says that ``check_drift`` has passed.
    """
    if not definition.columns:
        raise ValueError(f"{definition.full_name} declares no columns")
    if not checked:
        check_drift(spark, definition)
    if definition.database:
        ensure_database(spark, definition.database)
    name = definition.full_name
    columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in definition.declared.fields)
    statement = (
        f"CREATE TABLE {quoted(name)} ({columns}) USING {_provider(definition.format)}"
        + (f" PARTITIONED BY ({', '.join(map(quoted, definition.partition_by))})" if definition.partition_by else "")
        + f" LOCATION {_text(definition.location)}"
        + (
            " TBLPROPERTIES ("
            + ", ".join(f"{_text(k)} = {_text(v)}" for k, v in sorted(definition.properties.items()))
            + ")"
            if definition.properties
            else ""
        )
    )
    if spark.catalog.tableExists(name):
        if spark.catalog.getTable(name).tableType == "MANAGED":
            raise ValueError(f"{name} is a managed table")
        spark.sql(f"DROP TABLE {quoted(name)}")
    spark.sql(statement)
    if definition.partition_by:
        spark.sql(f"MSCK REPAIR TABLE {quoted(name)}")


def _existing(spark: SparkSession, table: str) -> TableDefinition:
    """The catalog entry of a table as a definition."""
    details = table_details(spark, table)
    database, _, name = table.rpartition(".")
    return TableDefinition(
        table=name,
        location=details.get("Location", ""),
        columns=[(f.name, f.dataType.simpleString()) for f in spark.table(table).schema.fields],
        database=database or None,
        format=details.get("Provider", "parquet"),
        partition_by=[c.name for c in spark.catalog.listColumns(table) if c.isPartition],
        properties=table_properties(spark, table),
    )


def _partition_key(path: str) -> PartitionKey:
    """Values out of ``a=1/b=x``, which escapes characters as a directory does."""
    values = [unquote(part.partition("=")[2]) for part in path.strip("/").split("/")]
    return tuple(None if v in (NULL_PARTITION, "") else v for v in values)


def catalogued_partitions(spark: SparkSession, table: str) -> set[PartitionKey]:
    """The partitions that the catalog knows."""
    return {_partition_key(r[0]) for r in spark.sql(f"SHOW PARTITIONS {quoted(table)}").collect()}


def written_partitions(spark: SparkSession, location: str) -> dict[PartitionKey, str]:
    """Directory of every partition that has data files below ``location``.

    The files are listed by the tasks; what is fetched is catalog metadata, one row per partition.
    """
    if not path_exists(spark, location):
        return {}
    root = qualified(spark, location.rstrip("/"))
    folders = data_files(file_manifest(spark, [root])).select(dirname(F.col("path")).alias("folder")).distinct()
    found = (r["folder"] for r in folders.toLocalIterator())
    return {_partition_key(f[len(root) :]): f for f in found if f != root}


def _partition(columns: list[str], key: PartitionKey) -> str:
    values = (f"{quoted(c)} = {'NULL' if v is None else _text(v)}" for c, v in zip(columns, key, strict=True))
    return f"PARTITION ({', '.join(values)})"


def switch_partitions(
    spark: SparkSession, table: str, columns: list[str], moved: dict[PartitionKey, str], emptied: Iterable[PartitionKey] = ()
) -> None:
    """Move, add and drop partitions of a catalogued table; no file is touched.

    Each partition is switched in one step, and the table is there all the time. A reader that
    starts while several are switched may see some of them old and some new. Repeating the call is
    harmless.
    """
    known = catalogued_partitions(spark, table)
    for key, location in sorted(moved.items(), key=str):
        place = _partition(columns, key)
        if key in known:
            spark.sql(f"ALTER TABLE {quoted(table)} {place} SET LOCATION {_text(location)}")
        else:
            spark.sql(f"ALTER TABLE {quoted(table)} ADD IF NOT EXISTS {place} LOCATION {_text(location)}")
    for key in sorted(set(emptied) & known, key=str):
        spark.sql(f"ALTER TABLE {quoted(table)} DROP IF EXISTS {_partition(columns, key)}")
    spark.catalog.refreshTable(table)


def point_table_at(
    spark: SparkSession,
    table: str,
    schema: StructType,
    location: str,
    fmt: str = "parquet",
    partition_by: list[str] | None = None,
) -> None:
    """Create ``table`` at ``location``, or move the existing entry there; its properties stay.

    An entry with the same columns, format and partitions is moved and is there all the time: one
    without partitions in one step, a partitioned one partition by partition (``switch_partitions``).
    Any other one is dropped and created anew, and for that moment readers do not find the table;
    if creating it fails, the old entry is put back.
    """
    columns = [(f.name, f.dataType.simpleString()) for f in schema.fields]
    old = _existing(spark, table) if spark.catalog.tableExists(table) else None
    database, _, name = table.rpartition(".")
    new = TableDefinition(
        table=name, location=location, columns=columns, database=database or None, format=fmt,
        partition_by=list(partition_by or []), properties=old.properties if old else {},
    )
    alike = old and (old.format.lower(), old.partition_by) == (fmt.lower(), new.partition_by)
    if alike and new.partition_by and sorted(old.columns) == sorted(new.columns):
        moved = written_partitions(spark, location)
        emptied = catalogued_partitions(spark, table) - set(moved)
        switch_partitions(spark, table, new.partition_by, moved, emptied)
    if alike and (sorted(old.columns) == sorted(new.columns) if new.partition_by else old.columns == new.columns):
        spark.sql(f"ALTER TABLE {quoted(table)} SET LOCATION {_text(location)}")
        spark.catalog.refreshTable(table)
        return
    try:
        register_table(spark, new)
    except Exception:
        if old and not spark.catalog.tableExists(table):
            register_table(spark, old)
        raise


class _Check:
    """The drift check of one definition in a thread of its own, whose jobs bear a tag."""

    def __init__(self, spark: SparkSession, row: Row) -> None:
        self.spark, self.row, self.error, self.definition = spark, row, None, None
        self.tag = f"drift-check-{uuid.uuid4().hex}"
        self.began = time.monotonic()
        self.thread = InheritableThread(target=self._run, session=spark)
        self.thread.daemon = True  # one that cannot be cancelled must not keep the process alive
        self.thread.start()

    def _run(self) -> None:
        self.spark.addTag(self.tag)
        try:
            if self.row["definition"] is None:
                raise ValueError("not a table definition")
            self.definition = TableDefinition.from_row(self.row["definition"])
            if self.definition.columns:
                check_drift(self.spark, self.definition)
        except Exception as problem:  # isolate whatever one definition raises
            self.error = problem

    def outcome(self, timeout_s: float | None) -> Exception | None:
        """The error, if any; a check that takes longer than its time is cancelled."""
        self.thread.join(None if timeout_s is None else max(0.0, self.began + timeout_s - time.monotonic()))
        if self.thread.is_alive():
            self.spark.interruptTag(self.tag)
            return TimeoutError(f"the files could not be checked within {timeout_s} s")
        return self.error


def _checked(spark: SparkSession, rows: Iterator[Row], threads: int, timeout_s: float | None) -> Iterator[tuple[_Check, Exception | None]]:
    """Definitions in their order with the outcome of their checks, of which ``threads`` run at a time."""
    running: deque[_Check] = deque()
    for row in chain(rows, [None]):
        while running and (row is None or len(running) == threads):
            check = running.popleft()
            yield check, check.outcome(timeout_s)
        if row is not None:
            running.append(_Check(spark, row))


def register_batch(
    spark: SparkSession,
    definitions: DataFrame,
    order: list[Column | str] | None = None,
    threads: int = 8,
    timeout_s: float | None = None,
) -> DataFrame:
    """Register every definition in this session; a bad one is reported and does not stop the rest.

    Definitions are catalog metadata and DDL runs on the driver by nature; they are fetched one
    partition at a time, in ``order``, by default that of their paths. The outcome has one row per
    definition, numbered ``idx`` of ``total`` in that order. The files of ``threads`` definitions are
    checked at the same time, and a check that takes longer than ``timeout_s`` is cancelled and
    reported; the catalog is changed in order, one definition after the other.
    """
    ordered = definitions.orderBy(*(order or ["path"])).select("path", "definition").persist()
    try:
        total = ordered.count()
        outcome = []
        for idx, (check, error) in enumerate(_checked(spark, ordered.toLocalIterator(), threads, timeout_s), start=1):
            try:
                if error is None:
                    register_table(spark, check.definition, checked=True)
            except Exception as problem:  # as above
                error = problem
            text = None if error is None else f"{type(error).__name__}: {error}"
            outcome.append((idx, total, check.row["path"], error is None, text))
    finally:
        ordered.unpersist()
    return rows_source(spark, outcome, OUTCOME_SCHEMA)


def referenced_locations(spark: SparkSession, tables: list[str]) -> list[str]:
    """Catalogued locations of the given tables."""
    return [location for location in (table_location(spark, t) for t in tables) if location]
