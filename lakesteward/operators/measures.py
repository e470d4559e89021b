"""Expectations measured in parts: what is stored with each part can be merged without reading rows again."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakesteward.operators.quality import HasCount, Holds, NonEmpty, Rule, Unique

#: sketch sizes, and the errors that follow: three standard errors of a number of keys, and the error of a rank
KEY_BITS, RANK_SIZE = 14, 400
KEY_ERROR = 3 * 1.04 / 2 ** (KEY_BITS / 2)
RANK_ERROR = 0.01

MEASURES = "measure STRING, kind STRING, n BIGINT, broken BIGINT, keys BINARY, spread BINARY"


def measured(df: DataFrame, rules: list[Rule], spreads: Iterable[str] = ()) -> DataFrame:
    """One row per rule and per numeric column in ``spreads``, by one aggregation over one scan.

    Counts and violations are exact. A uniqueness rule keeps a sketch of its keys, and a column one
    of its distribution; both have a fixed size, whatever the number of rows.
    """
    def row(name: str, kind: str, i: int, **values: Column) -> Column:
        fields = StructType.fromDDL(MEASURES).fields[2:]
        given = {"n": F.col("n"), **values}
        return F.struct(F.lit(name).alias("measure"), F.lit(kind).alias("kind"), *(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))

    aggregates, rows = [F.count("*").alias("n")], []
    for i, rule in enumerate(rules):
        if isinstance(rule, Unique):
            # the keys and which of them are null: a hash alone takes null and absent for the same
            marks = [F.col(f"`{k}`") for k in rule.keys] + [F.col(f"`{k}`").isNull() for k in rule.keys]
            aggregates.append(F.hll_sketch_agg(F.xxhash64(*marks), KEY_BITS).alias(f"m{i}"))
            rows.append(row(rule.name, "keys", i, keys=F.col(f"m{i}")))
        elif isinstance(rule, Holds):
            aggregates.append(F.count_if(~F.coalesce(rule.predicate, F.lit(False))).alias(f"m{i}"))
            rows.append(row(rule.name, "broken", i, broken=F.col(f"m{i}")))
        else:
            rows.append(row(rule.name, "rows", i))
    for j, column in enumerate(spreads):
        value = F.col(f"`{column}`").cast("double")
        aggregates.append(F.kll_sketch_agg_double(value, RANK_SIZE).alias(f"s{j}"))
        aggregates.append(F.count_if(value.isNull()).alias(f"e{j}"))
        rows.append(row(column, "spread", j, broken=F.col(f"e{j}"), spread=F.col(f"s{j}")))
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def merged_measures(parts: DataFrame) -> DataFrame:
    """The measures of all parts together, in any order and grouping: counts add up, sketches are united."""
    return parts.groupBy("measure", "kind").agg(
        F.sum("n").alias("n"), F.sum("broken").alias("broken"),
        F.when(F.first("kind") == "keys", F.hll_union_agg("keys")).alias("keys"),
        F.when(F.first("kind") == "spread", F.kll_merge_agg_double("spread")).alias("spread"),
    )


def measured_report(measures: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, ok, message) as ``expectations`` gives, out of measures.

    Exact for all rules but uniqueness: that one holds if the estimated number of keys is within
    ``KEY_ERROR`` of the number of rows, so that repeated keys are seen from a few per cent on.
    """
    found = measures.filter("kind <> 'spread'").withColumn("estimate", F.when(F.col("kind") == "keys", F.hll_sketch_estimate("keys")))
    n, broken = F.col("n"), F.col("broken")
    ok, told = F.lit(None).cast("boolean"), F.lit(None).cast("string")
    for rule in rules:
        own = F.col("measure") == rule.name
        if isinstance(rule, HasCount):
            verdict, message = n == rule.n, F.concat(F.lit(f"expected {rule.n}, got "), n.cast("string"))
        elif isinstance(rule, NonEmpty):
            verdict, message = n > 0, F.concat(n.cast("string"), F.lit(" rows"))
        elif isinstance(rule, Holds):
            verdict, message = broken == 0, F.concat(broken.cast("string"), F.lit(" rows violate it"))
        else:
            verdict = F.col("estimate") >= n * (1 - KEY_ERROR)
            message = F.concat(F.lit("about "), F.col("estimate").cast("string"), F.lit(" keys in "), n.cast("string"), F.lit(" rows"))
        ok, told = F.when(own, verdict).otherwise(ok), F.when(own, message).otherwise(told)
    names = [r.name for r in rules]
    return found.filter(F.col("measure").isin(names)).select(F.col("measure").alias("rule"), ok.alias("ok"), told.alias("message"))


def drift(before: DataFrame, after: DataFrame, most: float = 0.1, points: int = 19) -> DataFrame:
    """(column, distance, drifted) per measured column of both: how far the shares of rows below a value lie apart.

    The values are ``points`` quantiles of the earlier distribution; nulls count as a share of their
    own. A distance is off by up to twice ``RANK_ERROR``. It is null where one side has no value.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.filter("kind = 'spread'").select(
            F.col("measure").alias("column"), F.col("spread").alias(name), F.col("n").alias(f"{name}_n"), F.col("broken").alias(f"{name}_nulls")
        )

    both = side(before, "old").join(side(after, "new"), "column")
    some = (F.col("old_n") > F.col("old_nulls")) & (F.col("new_n") > F.col("new_nulls"))
    # a few numbers per column; a sketch is only asked for the rank of a constant
    shares = F.array(*(F.lit((i + 1) / (points + 1)) for i in range(points)))
    known = side(before, "old").filter(F.col("old_n") > F.col("old_nulls")).select("column", F.kll_sketch_get_quantile_double("old", shares).alias("q"))
    apart = F.lit(None).cast("double")
    for r in known.collect():
        ranks = (F.abs(F.kll_sketch_get_rank_double("new", F.lit(v)) - F.kll_sketch_get_rank_double("old", F.lit(v))) for v in sorted(set(r["q"])))
        apart = F.when(F.col("column") == r["column"], F.greatest(F.lit(0.0), *ranks)).otherwise(apart)
    nulls = F.abs(F.col("old_nulls") / F.col("old_n") - F.col("new_nulls") / F.col("new_n"))
    distance = F.when(some, F.greatest(nulls, apart))
    return both.select("column", distance.alias("distance")).withColumn("drifted", F.col("distance") > most)
