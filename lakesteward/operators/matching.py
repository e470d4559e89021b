"""Key matching: upsert, missing parents, run-to-cluster lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesteward.functions.names import spare_names
from lakesteward.session import saved


def autoregister_parents(
    children: DataFrame, parents: DataFrame, key: str, defaults: dict[str, Column] | None = None
) -> DataFrame:
    """``parents`` plus one default row per child key they lack.

    ``defaults`` gives column expressions over ``key``; other columns are null. Child keys are made
    distinct first, so a hot key shrinks to one row per task before any shuffle. An anti join
    would be pushed below that step; an outer join that keeps the unmatched rows is not.
    """
    keys = children.select(key).filter(F.col(key).isNotNull()).distinct()
    (mark,) = spare_names([key], "_known")
    known = parents.select(key, F.lit(True).alias(mark))
    unseen = keys.join(known, key, "left").filter(F.col(mark).isNull()).select(key)
    filled = {key: F.col(key), **(defaults or {})}
    rows = unseen.select(
        *(filled.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in parents.schema.fields)
    )
    return parents.unionByName(rows)


def auto_name(key: str) -> Column:
    """Name given to a parent that was registered on first use."""
    return F.concat(F.lit("auto-"), F.col(key).cast("string"))


def upsert(base: DataFrame, updates: DataFrame, key: str | list[str], order: str | None = None) -> DataFrame:
    """Rows of ``base`` with those of ``updates`` applied, and an ``action`` column.

    ``update`` takes the non-key values of the update row, ``create`` adds a row, ``keep`` is
    untouched. A key occurs once in ``updates``, or it is an error; with ``order`` the row with the
    highest value counts, a null being the lowest. ``base`` has no column ``action``.

    A left join plus an anti join stands in for a full outer join, because AQE can split a skewed
    left side but neither side of a full outer join. The anti join sees only base keys that occur
    in the updates. The updates by key are stored first: a side that comes straight out of an
    aggregation on the join key has no shuffle of its own, and then the other cannot be split.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if "action" in {c.lower() for c in base.columns}:
        raise ValueError("the base has a column action")
    new, times = spare_names([*base.columns, *updates.columns], "_u", "_n")
    others = [c for c in updates.columns if c not in keys and c in base.columns]
    values = [c for c in base.columns if c not in keys]
    row = F.struct(*(F.col(f"`{c}`") if c in others else F.lit(None).alias(c) for c in values))
    if order is not None:
        # within a struct a null is a value, the lowest one
        changed = updates.groupBy(*keys).agg(F.max_by(row, F.struct(order)).alias(new))
    else:
        repeated = F.raise_error(F.concat(F.lit("repeated update key: "), F.to_json(F.struct(*keys)))).cast("boolean")
        counted = updates.groupBy(*keys).agg(F.any_value(row).alias(new), F.count("*").alias(times))
        changed = counted.filter((F.col(times) == 1) | repeated).select(*keys, new)
    changed = saved(changed, "upsert-changes")
    hit = F.col(new).isNotNull()
    existing = base.join(changed, keys, "left").select(
        *(F.when(hit, F.col(f"{new}.`{c}`")).otherwise(base[f"`{c}`"]).alias(c) if c in others else base[f"`{c}`"] for c in base.columns),
        F.when(hit, "update").otherwise("keep").alias("action"),
    )
    known = base.select(*keys).join(changed.select(*keys), keys, "left_semi").distinct()
    created = changed.join(known, keys, "left_anti").select(
        *(F.col(c) if c in keys else F.col(f"{new}.`{c}`").cast(base.schema[c].dataType).alias(c) for c in base.columns),
        F.lit("create").alias("action"),
    )
    return existing.unionByName(created)


# rows that one task writes out of a single counted row
COPIES_PER_BLOCK = 10_000


def missing_copies(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Rows of ``wanted`` that ``present`` lacks, as multisets.

    Copies are counted within each task first, so only one row per distinct row is shuffled and
    joined. The struct key compares nulls as equal. What is missing is written out again in
    blocks spread over the tasks, so a row with very many copies is not produced by one of them.
    """
    def counted(df: DataFrame, name: str) -> DataFrame:
        row = F.struct(*(F.col(c) for c in wanted.columns)).alias("_row")
        return df.select(row).groupBy("_row").agg(F.count("*").alias(name))

    joined = counted(wanted, "_want").join(counted(present, "_have"), "_row", "left")
    lacking = joined.select("_row", (F.col("_want") - F.coalesce("_have", F.lit(0))).alias("_n")).filter("_n > 0")
    last = F.floor((F.col("_n") - 1) / COPIES_PER_BLOCK)
    blocks = lacking.select("_row", "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_block"))
    spread = blocks.repartition(F.xxhash64("_row", "_block"))
    size = F.least(F.lit(COPIES_PER_BLOCK), F.col("_n") - F.col("_block") * COPIES_PER_BLOCK).cast("int")
    return spread.select("_row", F.explode(F.array_repeat(F.lit(0), size))).select("_row.*")


def runs_with_cluster(runs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Runs with ``cluster_name`` and ``cluster_state``; runs of deleted clusters stay, with nulls.

    No broadcast hint: the optimizer broadcasts the clusters when their size allows it, and
    otherwise AQE splits a cluster that owns most of the runs.
    """
    attributes = clusters.select(
        F.col("id").alias("virtualClusterId"), F.col("name").alias("cluster_name"), F.col("state").alias("cluster_state")
    )
    return runs.join(attributes, "virtualClusterId", "left")
