"""Removing a tenant's rows from related tables and putting them back."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import date, datetime, time
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, TimestampNTZType, TimestampType

from lakesteward.operators.matching import missing_copies
from lakesteward.session import saved
from lakesteward.sources.basic import rows_source

# beyond this many literals a tenant list is joined instead of written into the predicate; the keys
# have been converted before, so the two ways mean the same
MAX_LITERAL_KEYS = 1000


@dataclass(frozen=True)
class TenantTable:
    """A table and how its rows belong to a tenant: by its own column, or through a parent row.

    ``key`` is the column children refer to. ``unique_key`` identifies a row, where there is one.
    ``partition_by`` is how the table is stored.
    """

    name: str
    df: DataFrame
    tenant_col: str | None = None
    key: str | None = None
    parent: str | None = None
    fk: str | None = None
    unique_key: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()


@dataclass(frozen=True)
class Mark:
    """The values of one column that single out the tenants' rows: a short list or a DataFrame.

    A list, of Python values or literal columns, becomes a predicate, which reaches the scan and
    prunes partitions on both sides: the rows owned are found without reading the others, and the
    others without reading the owned.
    """

    column: str
    values: list | DataFrame

    def owned(self, df: DataFrame) -> DataFrame:
        if isinstance(self.values, DataFrame):
            return df.join(self.values, self.column, "left_semi").select(*df.columns)
        return df.filter(F.col(self.column).isin(self.values) if self.values else F.lit(False))

    def others(self, df: DataFrame) -> DataFrame:
        """All rows not owned. Rows without a value stay, which NOT IN alone would lose."""
        if isinstance(self.values, DataFrame):
            return df.join(self.values, self.column, "left_anti").select(*df.columns)
        column = F.col(self.column)
        return df.filter(~column.isin(self.values) | column.isNull()) if self.values else df


class InexactKey(ValueError):
    """A tenant key that the tenant column's type cannot hold unchanged."""


def exact_key(key: Column, source: DataType, kind: DataType) -> Column:
    """``key`` in the tenant column's type; one that would not come back unchanged is an error."""
    if source == kind:
        return key
    converted = key.try_cast(kind)
    same = converted.try_cast(source).eqNullSafe(key)
    problem = F.concat(F.lit(f"not exactly a {kind.simpleString()}: "), key.cast("string"))
    return F.when(same, converted).otherwise(F.raise_error(problem).cast(kind))


#: how a key is fetched to the driver and written as a literal again: times as whole numbers or text,
#: since a Python value without a zone means the zone of this process
_FETCHED = {
    DateType: ("INT", F.unix_date, F.date_from_unix_date),
    TimestampType: ("BIGINT", F.unix_micros, F.timestamp_micros),
    TimestampNTZType: ("STRING", lambda c: c.cast("string"), lambda c: c.cast("timestamp_ntz")),
}


def _key_type(values: list) -> str:
    """SQL type that holds all the given Python values as they are."""
    kinds = {type(v) for v in values}
    if kinds == {date}:
        return "date"
    if kinds <= {date, datetime}:
        zoned = {isinstance(v, datetime) and v.tzinfo is not None for v in values}
        if len(zoned) == 1:
            return "timestamp" if zoned.pop() else "timestamp_ntz"
    if kinds <= {int}:
        return "bigint" if all(-(2**63) <= v < 2**63 for v in values) else "decimal(38,0)"
    if kinds <= {int, float}:
        # a float that is a whole number means that number
        if all(float(v).is_integer() for v in values):
            return _key_type([int(v) for v in values])
        if all(float(v) == v for v in values):
            return "double"
    named = {str: "string", Decimal: "decimal(38,18)", bool: "boolean"}
    if len(kinds) == 1 and (kind := kinds.pop()) in named:
        return named[kind]
    raise InexactKey(f"tenant keys of one type are wanted, not {sorted(k.__name__ for k in {type(v) for v in values})}")


def listed_keys(keys: Iterable, table: TenantTable) -> list:
    """Distinct keys of a list in the tenant column's type, as they are fetched (``_FETCHED``); null keys dropped.

    A date is the midnight it begins with. A datetime without a zone is one of the session's zone.
    """
    kind = table.df.schema[table.tenant_col].dataType
    wanted = list(dict.fromkeys(k for k in keys if k is not None))
    if not wanted:
        return []
    source = _key_type(wanted)
    convert = {
        "bigint": int, "decimal(38,0)": lambda v: Decimal(int(v)), "double": float,
        "timestamp_ntz": lambda v: v if isinstance(v, datetime) else datetime.combine(v, time()),
    }.get(source, lambda v: v)
    frame = rows_source(table.df.sparkSession, [(convert(k),) for k in wanted], f"k {source.upper()}")
    known = frame.schema[0].dataType
    converted = F.col("k").try_cast(kind)
    _, fetched, _ = _FETCHED.get(type(kind), (None, lambda c: c, None))
    same = converted.try_cast(known).eqNullSafe(F.col("k"))
    rows = frame.select(F.col("k").cast("string").alias("k"), fetched(converted).alias("v"), same.alias("same")).collect()
    wrong = [r["k"] for r in rows if not r["same"]]
    if wrong:
        raise InexactKey(f"{table.tenant_col} is a {kind.simpleString()}; not exactly one: {wrong[:5]}")
    return list(dict.fromkeys(r["v"] for r in rows))


def tenant_mark(keys: DataFrame | Iterable, table: TenantTable) -> Mark:
    """Mark of a table with a tenant column. Keys are made distinct and null keys are dropped.

    Keys are converted to the column's type, and one that does not convert exactly is an error,
    whatever the number of keys and whether they come as a list or as a DataFrame.
    """
    column, kind = table.tenant_col, table.df.schema[table.tenant_col].dataType
    if not isinstance(keys, DataFrame):
        wanted = listed_keys(keys, table)
        held, _, literal = _FETCHED.get(type(kind), (kind.simpleString(), None, None))
        if len(wanted) <= MAX_LITERAL_KEYS:
            return Mark(column, [literal(F.lit(k)) for k in wanted] if literal else wanted)
        rows = rows_source(table.df.sparkSession, [(k,) for k in wanted], f"k {held}")
        return Mark(column, rows.select((literal(F.col("k")) if literal else F.col("k")).alias(column)))
    renamed = keys.toDF(column)
    given = renamed.filter(F.col(column).isNotNull()).select(exact_key(F.col(column), renamed.schema[0].dataType, kind).alias(column))
    return Mark(column, given.distinct())


def ownership(
    tables: list[TenantTable],
    tenant_keys: DataFrame | Iterable,
    save: Callable[[DataFrame, str], DataFrame] | None = None,
) -> dict[str, Mark]:
    """Mark of every table; parents come before their children.

    A child is marked by the distinct keys of its parent's owned rows, in the parent's type: Spark
    compares differing types in the wider one. ``save`` may store such a set and return it reread,
    so that children do not recompute the chain and the optimizer knows its true size when it
    chooses between a broadcast and a shuffle.
    """
    marks: dict[str, Mark] = {}
    by_name = {t.name: t for t in tables}
    for table in tables:
        if table.tenant_col:
            marks[table.name] = tenant_mark(tenant_keys, table)
        elif table.parent in marks:
            parent = by_name[table.parent]
            owned = marks[parent.name].owned(parent.df).select(F.col(parent.key).alias(table.fk))
            owned = owned.filter(F.col(table.fk).isNotNull()).distinct()
            marks[table.name] = Mark(table.fk, save(owned, table.name) if save else owned)
        else:
            raise ValueError(f"{table.name}: neither a tenant column nor a parent listed before it")
    return marks


def _stored(keys: DataFrame, name: str) -> DataFrame:
    return saved(keys, f"owned-{name}")


def tenant_delete(tables: list[TenantTable], tenant_keys: DataFrame | Iterable) -> dict[str, DataFrame]:
    """What is left of each table without the tenants' rows and the rows that hang on them.

    Joins carry no hints. Key sets of children are stored, so no chain is computed twice. A key set below the broadcast threshold costs the big table no shuffle;
    beyond it the anti join shuffles, and AQE splits a hot key on the big side.
    """
    marks = ownership(tables, tenant_keys, _stored)
    return {table.name: marks[table.name].others(table.df) for table in tables}


def tenant_recovery(
    current: list[TenantTable], snapshot: list[TenantTable], tenant_keys: DataFrame | Iterable
) -> dict[str, DataFrame]:
    """Current tables plus the tenants' snapshot rows that are missing from them.

    Rows count as present by ``unique_key``, or without one by all columns as a multiset, so a
    recovery that is run twice adds nothing the second time. Null keys are equal to each other.
    The current table is first cut down to the keys of the snapshot's owned rows.
    """
    marks = ownership(snapshot, tenant_keys, _stored)
    now = {t.name: t for t in current}
    restored = {}
    for old in snapshot:
        table, mark = now[old.name], marks[old.name]
        lost = mark.owned(old.df)
        if old.unique_key:
            keys = list(old.unique_key)
            named = {k: f"present_{i}" for i, k in enumerate(keys)}
            wanted = lost.select(*keys).distinct()
            present = table.df.select(*(F.col(k).alias(n) for k, n in named.items()))
            present = present.join(wanted, _same_keys(present, wanted, named), "left_semi").distinct()
            missing = lost.join(present, _same_keys(present, lost, named), "left_anti").select(*table.df.columns)
        else:
            missing = missing_copies(lost, mark.owned(table.df)).select(*table.df.columns)
        restored[old.name] = table.df.unionByName(missing)
    return restored


def _same_keys(present: DataFrame, rows: DataFrame, named: dict[str, str]) -> Column:
    """Null-safe equality of the unique key, whose columns have other names in ``present``."""
    return reduce(lambda a, b: a & b, (present[n].eqNullSafe(rows[k]) for k, n in named.items()))
