"""Generated and literal rows."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def range_source(spark: SparkSession, n: int) -> DataFrame:
    """``n`` consecutive bigints from zero, generated inside the tasks."""
    return spark.range(n)


def rows_source(spark: SparkSession, rows: Iterable[tuple], schema: StructType | str) -> DataFrame:
    """Literal rows under an explicit schema; for parameters and fixtures, not for data.

    They enter the plan as a local relation, whose size the optimizer knows, so that a join with
    them can be planned as a broadcast; a plain ``createDataFrame`` has no known size.
    """
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)
    rows = list(rows)
    columns = [pa.array([row[i] for row in rows], field.type) for i, field in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), fields)
