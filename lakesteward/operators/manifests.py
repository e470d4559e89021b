"""Operators over object manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesteward.functions.paths import basename, flatten_name
from lakesteward.session import saved


def data_files(manifest: DataFrame) -> DataFrame:
    """Without marker, checksum and log files, whose names start with ``_`` or ``.``."""
    return manifest.filter(~basename(F.col("path")).rlike("^[_.]") & ~F.col("path").rlike("/_delta_log/"))


def manifest_summary(manifest: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Number of objects and total bytes, overall or per group."""
    return manifest.groupBy(*(by or [])).agg(
        F.count("*").alias("objects"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")
    )


def table_roots(manifest: DataFrame) -> DataFrame:
    """Table directories (path, partition_by): what lies above the ``column=value`` directories."""
    directory = F.regexp_replace("path", r"/[^/]*$", "")
    root = F.regexp_replace(directory, r"(/[^/=]+=[^/]*)+$", "")
    columns = F.regexp_extract_all(
        F.substring(directory, F.char_length(root) + 1, F.char_length(directory)), F.lit("/([^/=]+)="), F.lit(1)
    )
    return manifest.select(root.alias("path"), columns.alias("partition_by")).distinct()


def sync_plan(source: DataFrame, target: DataFrame, key: str = "key", compare_mtime: bool = True) -> DataFrame:
    """Label every object ``copy_new``, ``copy_changed``, ``same`` or ``stale`` (never deleted).

    Both manifests hold (key, length, mtime) with a key at most once. They are stacked and
    aggregated on the key, which costs one shuffle of narrow rows and no sort or join. An object
    has changed when its length differs or the source is newer; ``compare_mtime=False`` goes by the
    length alone and needs no mtime.
    """
    columns = [key, "length"] + (["mtime"] if compare_mtime else [])
    sides = source.select(*columns, F.lit(True).alias("is_source")).unionByName(
        target.select(*columns, F.lit(False).alias("is_source"))
    )
    src, dst = F.col("is_source"), ~F.col("is_source")

    def one(column: str, side: Column, name: str) -> Column:
        return F.max(F.when(side, F.col(column))).alias(name)

    sums = [F.max(src).alias("in_source"), F.max(dst).alias("in_target"),
            one("length", src, "source_length"), one("length", dst, "target_length")]
    changed = ~F.col("source_length").eqNullSafe(F.col("target_length"))
    if compare_mtime:
        sums += [one("mtime", src, "source_mtime"), one("mtime", dst, "target_mtime")]
        changed |= F.coalesce(F.col("source_mtime") > F.col("target_mtime"), F.lit(False))
    action = (
        F.when(~F.col("in_target"), "copy_new")
        .when(~F.col("in_source"), "stale")
        .when(changed, "copy_changed")
        .otherwise("same")
    )
    return sides.groupBy(key).agg(*sums).select(key, action.alias("action"), "source_length", "target_length")


#: bits of a key's hash in each step down the tree of checksums; a leaf then holds about this many keys
_STEP_BITS, _KEYS_PER_LEAF = 10, 2


def _range_of(key: str, bits: int) -> Column:
    """Number of the range of hashes that a key lies in: the first ``bits`` of its hash."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits)


def differing_ranges(source: DataFrame, target: DataFrame, key: str, columns: list[str], bits: int) -> DataFrame:
    """Numbers of the ranges in which the two sides differ, by count and checksums that do not depend on the order.

    Per side and range one row of fixed width leaves a task, whatever the length of the keys.
    """
    row = F.xxhash64(*(F.col(f"`{c}`") for c in columns), *(F.col(f"`{c}`").isNull() for c in columns))
    # a sum next to the exclusive or, which alone does not see a row that comes twice
    low = F.col("mark").bitwiseAND(0xFFFFFFFF)

    def side(df: DataFrame, sign: int) -> DataFrame:
        marked = df.select(_range_of(key, bits).alias("range"), row.alias("mark"))
        return marked.groupBy("range").agg(
            (F.count("*") * sign).alias("n"), F.bit_xor("mark").alias("x"), (F.sum(low) * sign).alias("s")
        )

    both = side(source, 1).unionByName(side(target, -1))
    sums = both.groupBy("range").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.sum("s").alias("s"))
    return sums.filter("n <> 0 OR x <> 0 OR s <> 0").select("range")


def sync_plan_by_ranges(source: DataFrame, target: DataFrame, key: str = "key", compare_mtime: bool = True) -> DataFrame:
    """The rows of ``sync_plan``, for manifests that are mostly equal.

    Both sides are compared by checksums over ranges of the keys' hashes, first few and wide, then
    narrower ones within those that differ, down to about two keys. Only keys of narrow ranges that
    differ are shuffled and compared row by row; the others are ``same`` as they stand. Each step
    reads both manifests once, and ends the search where all ranges are equal. Two different
    contents of a range are taken for equal with a chance of one in 2^64 or less.
    """
    columns = [key, "length"] + (["mtime"] if compare_mtime else [])
    # in common types, as a number's checksum depends on its type
    common = source.select(*columns).unionByName(target.select(*columns)).schema
    left, right = (df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in common)) for df in (source, target))
    leaf = max(_STEP_BITS, (source.count() // _KEYS_PER_LEAF).bit_length())
    unequal, at = None, 0
    own, other = left, right
    while at < leaf:
        at = min(leaf, at + _STEP_BITS)
        unequal = saved(differing_ranges(own, other, key, columns, at), "unequal-ranges")
        if unequal.isEmpty():
            own, other = left.limit(0), right.limit(0)
            break
        own, other = (df.join(unequal, _range_of(key, at) == unequal["range"], "left_semi") for df in (left, right))
    compared = sync_plan(own, other, key, compare_mtime)
    same = left.join(unequal, _range_of(key, at) == unequal["range"], "left_anti")
    length = F.col("length")
    return compared.unionByName(
        same.select(key, F.lit("same").alias("action"), length.alias("source_length"), length.alias("target_length"))
    )


def name_collisions(manifest: DataFrame, env: str, path: str = "path") -> DataFrame:
    """Flattened names that more than one path would be published under, with their count."""
    return (
        manifest.groupBy(flatten_name(F.col(path), env).alias("name"))
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
    )
