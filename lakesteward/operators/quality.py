"""Counts, expectations and batch outcomes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class HasCount:
    """Exactly ``n`` rows."""

    n: int
    name: str = "row_count"


@dataclass(frozen=True)
class NonEmpty:
    name: str = "non_empty"


@dataclass(frozen=True)
class Holds:
    """Every row satisfies a predicate; an unknown result counts as a violation."""

    name: str
    predicate: Column


@dataclass(frozen=True)
class Unique:
    """No two rows agree on all of ``keys``."""

    keys: tuple[str, ...]
    name: str = "key_unique"


Rule = HasCount | NonEmpty | Holds | Unique
_REPORT = ["rule", "ok", "message"]


def _measured(rule: Rule) -> tuple[Column, Column, Column]:
    """(aggregate, verdict, message) where verdict and message read the aggregate as ``m``."""
    m = F.col("m")
    if isinstance(rule, HasCount):
        return F.count("*"), m == rule.n, F.concat(F.lit(f"expected {rule.n}, got "), m.cast("string"))
    if isinstance(rule, NonEmpty):
        return F.count("*"), m > 0, F.concat(m.cast("string"), F.lit(" rows"))
    broken = F.count_if(~F.coalesce(rule.predicate, F.lit(False)))
    return broken, m == 0, F.concat(m.cast("string"), F.lit(" rows violate it"))


def expectations(df: DataFrame, rules: list[Rule], strict: bool = False) -> DataFrame:
    """One row (rule, ok, message) per rule; ``strict`` makes the job fail on a broken one.

    All count and predicate rules share one aggregation over one scan. Uniqueness counts rows per
    key, combined before the shuffle, and reads the key columns only.
    """
    if not rules:
        raise ValueError("no rules given")
    reports = []
    simple = [r for r in rules if not isinstance(r, Unique)]
    if simple:
        parts = [_measured(r) for r in simple]
        totals = df.agg(*(agg.alias(f"m{i}") for i, (agg, _, _) in enumerate(parts)))
        cells = F.array(
            *(F.struct(F.lit(r.name).alias("rule"), F.col(f"m{i}").alias("m")) for i, r in enumerate(simple))
        )
        rows = totals.select(F.posexplode(cells).alias("i", "cell")).select("i", "cell.*")
        pick = [F.when(F.col("i") == i, verdict) for i, (_, verdict, _) in enumerate(parts)]
        tell = [F.when(F.col("i") == i, text) for i, (_, _, text) in enumerate(parts)]
        reports.append(rows.select("rule", F.coalesce(*pick).alias("ok"), F.coalesce(*tell).alias("message")))
    for rule in rules:
        if isinstance(rule, Unique):
            per_key = df.groupBy(*rule.keys).agg(F.count("*").alias("n"))
            repeated = per_key.agg(F.count_if(F.col("n") > 1).alias("m"))
            reports.append(
                repeated.select(
                    F.lit(rule.name).alias("rule"),
                    (F.col("m") == 0).alias("ok"),
                    F.concat(F.col("m").cast("string"), F.lit(" keys are repeated")).alias("message"),
                )
            )
    report = reports[0]
    for other in reports[1:]:
        report = report.unionByName(other)
    if strict:
        text = F.concat(F.col("rule"), F.lit(": "), F.col("message"))
        report = report.filter(F.assert_true(F.col("ok"), text).isNull())
    return report


def batch_outcome(results: DataFrame, group: list[str] | None = None) -> DataFrame:
    """``total``, ``failed`` and ``exit_code`` (1 if anything failed) of rows with a nullable ``error``."""
    failed = F.count_if(F.col("error").isNotNull())
    return results.groupBy(*(group or [])).agg(
        F.count("*").alias("total"),
        failed.alias("failed"),
        F.when(failed > 0, 1).otherwise(0).alias("exit_code"),
    )


def batch_failures(results: DataFrame, group: list[str] | None = None, item: str = "path") -> DataFrame:
    """The failed items with their errors, one row each.

    Rows rather than an array per group: a group with most of the failures would not fit a row.
    """
    return results.filter(F.col("error").isNotNull()).select(*(group or []), item, "error")
