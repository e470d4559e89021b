"""Row scoping: layers, table names, partitions and path patterns."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesteward.functions.paths import any_name_regex, glob_to_regex

# The layers, in default order and in the order a clone takes them.
SECTIONS = ["bronze", "silver", "gold", "common"]
CLONE_ORDER = ["gold", "silver", "bronze", "common"]


def filter_sections(df: DataFrame, sections: Iterable[str] | None = None, column: str = "section") -> DataFrame:
    """Keep the given layers, by default all four; a layer without rows is no error."""
    return df.filter(F.col(column).isin(list(sections or SECTIONS)))


def filter_tables(df: DataFrame, names: Iterable[str] | DataFrame | None = None, column: str = "name") -> DataFrame:
    """Keep exact names; no names keeps all and unknown names are ignored.

    Names held in a one-column DataFrame are matched by a semi join.
    """
    if isinstance(names, DataFrame):
        return df.join(names.toDF(column), column, "left_semi")
    wanted = list(names or [])
    return df.filter(F.col(column).isin(wanted)) if wanted else df


# Fixed value: the directory name of a null partition value.
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def parse_scope(prefix: str) -> tuple[str, dict[str, str | None]]:
    """Split ``gold/t/organization_id=6`` into the table path and its partition values, unescaped; null as None."""
    parts = [p for p in prefix.strip("/").split("/") if p]
    first = next((i for i, p in enumerate(parts) if "=" in p), len(parts))
    values = dict(p.split("=", 1) for p in parts[first:] if "=" in p)
    return "/".join(parts[:first]), {unquote(k): None if v == NULL_PARTITION else unquote(v) for k, v in values.items()}


def scope_predicate(scope: dict[str, Iterable | str | None]) -> Column:
    """Conjunction of ``column IN (values)``, None meaning null: on partition columns it prunes directories."""
    def term(name: str, values: Iterable | str | None) -> Column:
        wanted = [values] if values is None or isinstance(values, str) else list(values)
        given, column = [v for v in wanted if v is not None], F.col(f"`{name}`")
        found = column.isin(given) if given else F.lit(False)
        return found | column.isNull() if None in wanted else found

    return reduce(lambda a, b: a & b, (term(c, v) for c, v in scope.items()), F.lit(True))


def any_scope(choices: list[dict[str, str | None]]) -> Column:
    """Rows in any of the partitions: one list per set of leading columns instead of a term per partition."""
    by_outer: dict[tuple, tuple[str, list]] = {}
    for choice in choices:
        *outer, (name, value) = choice.items()
        by_outer.setdefault((tuple(outer), name), (name, []))[1].append(value)
    terms = [scope_predicate({**dict(outer), name: values}) for (outer, _), (name, values) in by_outer.items()]
    while len(terms) > 1:  # in pairs, so that the expression stays shallow
        terms = [reduce(lambda a, b: a | b, terms[i : i + 2]) for i in range(0, len(terms), 2)]
    return terms[0]


def filter_scope(df: DataFrame, scope: dict[str, Iterable] | Column | None) -> DataFrame:
    if scope is None:
        return df
    return df.filter(scope if isinstance(scope, Column) else scope_predicate(scope))


def exclude_globs(manifest: DataFrame, globs: Iterable[str], column: str = "path") -> DataFrame:
    """Drop rows whose path matches any glob."""
    patterns = [F.col(column).rlike(glob_to_regex(g)) for g in globs]
    return manifest.filter(~reduce(lambda a, b: a | b, patterns, F.lit(False)))


def match_names(manifest: DataFrame, names: list[str], column: str = "path") -> DataFrame:
    """Keep rows in which any of the names occurs literally."""
    return manifest.filter(F.col(column).rlike(any_name_regex(names))) if names else manifest.filter(F.lit(False))


def runs_of_cluster(runs: DataFrame, vc_id: str) -> DataFrame:
    """Runs of one cluster; an unknown cluster simply has none."""
    return runs.filter(F.col("virtualClusterId") == vc_id)


def find_run(runs: DataFrame, vc_id: str, run_id: str) -> DataFrame:
    """The run with this id, provided it belongs to this cluster; otherwise no row."""
    return runs.filter((F.col("virtualClusterId") == vc_id) & (F.col("id") == run_id))


def with_defaults(df: DataFrame, defaults: dict[str, object], empty_is_missing: bool = False) -> DataFrame:
    """Fill missing values per column; with ``empty_is_missing`` empty text counts as missing too."""
    def filled(name: str, value: object) -> Column:
        column = F.col(name)
        if empty_is_missing and isinstance(value, str):
            column = F.nullif(column, F.lit(""))
        return F.coalesce(column, F.lit(value))

    return df.withColumns({name: filled(name, value) for name, value in defaults.items()})
