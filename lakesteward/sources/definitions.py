"""Table definitions: JSON documents grouped by layer directory."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakesteward.functions.paths import basename, dirname, strip_suffix
from lakesteward.functions.templates import resolve_template
from lakesteward.operators.scope import filter_sections, filter_tables

DEFINITION_SCHEMA = (
    "database STRING, table STRING, location STRING, format STRING, "
    "columns ARRAY<STRUCT<name: STRING, type: STRING>>, partition_by ARRAY<STRING>, "
    "properties MAP<STRING, STRING>"
)


def resolve_table_defs(
    texts: DataFrame,
    sections: Iterable[str] | None = None,
    tables: Iterable[str] | None = None,
    params: dict[str, str] | None = None,
    keep_unknown: bool = False,
) -> DataFrame:
    """Scope rows (path, section, name, body) and parse them after placeholder substitution.

    ``definition`` is null where the text is not a JSON object, for registration to report. With
    ``keep_unknown`` the column ``unknown`` maps the fields that the library does not know, whatever
    their shape, to their values as JSON; it is null where the text is not JSON, and empty where all are known.
    """
    scoped = filter_tables(filter_sections(texts, sections), tables)
    body = resolve_template(F.col("body"), params or {})
    parsed = F.from_json(body, DEFINITION_SCHEMA)
    valid = parsed["table"].isNotNull() & parsed["location"].isNotNull()
    found = scoped.select("path", "section", "name", F.when(valid, parsed).alias("definition"), body.alias("_body"))
    if not keep_unknown:
        return found.drop("_body")
    fields = F.try_parse_json("_body").try_cast("map<string, variant>")
    known = [f.name for f in StructType.fromDDL(DEFINITION_SCHEMA)]
    unknown = F.map_filter(fields, lambda name, _: ~name.isin(known))
    return found.select("path", "section", "name", "definition", F.transform_values(unknown, lambda _, v: F.to_json(v)).alias("unknown"))


def definition_shapes(texts: DataFrame) -> DataFrame:
    """Per section: the schema that fits all its definitions, as DDL, and how many texts are no JSON."""
    value = F.try_parse_json("body")
    return texts.groupBy("section").agg(F.schema_of_variant_agg(value).alias("shape"), F.count_if(value.isNull()).alias("broken"))


def definition_texts(spark: SparkSession, root: str) -> DataFrame:
    """Rows (path, section, name, body) of the files ``<root>/<section>/<name>.json``."""
    files = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .text(root, wholetext=True)
    )
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    bare = re.sub(r"^[A-Za-z0-9]+:/*|^\./", "", root).strip("/")
    depth_one = dirname(dirname(path)).endswith("/" + bare)
    return files.filter(depth_one).select(
        path.alias("path"),
        basename(dirname(path)).alias("section"),
        strip_suffix(basename(path), ".json").alias("name"),
        F.col("value").alias("body"),
    )


def read_table_defs(
    spark: SparkSession,
    root: str,
    sections: Iterable[str] | None = None,
    tables: Iterable[str] | None = None,
    params: dict[str, str] | None = None,
    keep_unknown: bool = False,
) -> DataFrame:
    """Definitions ``<root>/<section>/<name>.json``; a section without a directory adds nothing."""
    return resolve_table_defs(definition_texts(spark, root), sections, tables, params, keep_unknown)
