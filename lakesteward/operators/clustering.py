"""Layout: rows along a space-filling curve, small files in bins."""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

from lakesteward.functions.names import spare_names
from lakesteward.functions.paths import dirname
from lakesteward.operators.ordering import with_ties_placed

#: most files that are packed by one call of the packing function
PACKED_AT_ONCE = 2000
#: a file's share of the rows is known in so many steps, and a border of files may move by so many of them
STEPS, SLACK = 8, 2


def _scale(column: Column, kind: DataType) -> Column:
    """A number that is ordered as the column; of a text its first seven bytes, enough for a layout."""
    if isinstance(kind, StringType):
        return F.conv(F.rpad(F.hex(F.substring(F.encode(column, "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("bigint")
    if isinstance(kind, DateType):
        return F.unix_date(column)
    if isinstance(kind, TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, TimestampNTZType):
        return F.unix_micros(column.cast("timestamp"))
    if isinstance(kind, (NumericType, BooleanType)):
        return column.cast("double") if not isinstance(kind, BooleanType) else column.cast("int")
    raise ValueError(f"no order along a curve for a {kind.simpleString()}")


def _rank(column: str, bounds: list) -> Column:
    """How many of the sorted bounds are at most the column's value, by nested comparisons; a null ranks 0."""
    known = [b for b in bounds if isinstance(b, int) or math.isfinite(b)]

    def among(low: int, high: int) -> str:
        if low == high:
            return str(low)
        middle = (low + high) // 2
        bound = f"{known[middle]}L" if isinstance(known[middle], int) else f"{known[middle]!r}D"
        return f"CASE WHEN {column} >= {bound} THEN {among(middle + 1, high)} ELSE {among(low, middle)} END"

    # as text, which is parsed at once: hundreds of calls to build columns take seconds
    return F.expr(among(0, len(known)))


def with_curve_key(df: DataFrame, columns: list[str], name: str, bits: int = 8) -> DataFrame:
    """``df`` with the place of each row on a curve through the space of the columns' quantile ranks.

    Each column's values are cut into 2 ** bits parts of about equal numbers of rows, estimated in
    one aggregation; the bits of the ranks are interleaved. Rows that are near each other in all
    columns are near on the curve, whatever the columns' distributions are.
    """
    if len(columns) * bits > 62:
        raise ValueError(f"{len(columns)} columns of {bits} bits do not fit a key")
    values = [_scale(F.col(f"`{c}`"), df.schema[c].dataType) for c in columns]
    shares = F.array(*(F.lit(i / 2**bits) for i in range(1, 2**bits)))
    found = df.agg(*(F.percentile_approx(v, shares, 2 ** (bits + 4)).alias(f"q{i}") for i, v in enumerate(values))).first()
    # in steps, as a value is compared and a rank is shifted many times
    own = spare_names([*df.columns, name], *(f"_v{i}" for i in range(len(columns))), *(f"_r{i}" for i in range(len(columns))))
    named, ranks = own[: len(columns)], own[len(columns) :]
    ranked = df.withColumns(dict(zip(named, values, strict=True))).withColumns(
        {r: _rank(v, sorted(set(bounds or []))) for r, v, bounds in zip(ranks, named, found, strict=True)}
    )
    taken = [
        F.shiftleft(F.shiftright(F.col(r), b).bitwiseAND(1).cast("bigint"), b * len(columns) + len(columns) - 1 - i)
        for b in range(bits)
        for i, r in enumerate(ranks)
    ]
    return ranked.withColumn(name, reduce(lambda a, b: a.bitwiseOR(b), taken)).drop(*own)


def roundest(low: int, high: int) -> int:
    """The number in (low, high] with the most zero bits at its end; ``low`` if there is none."""
    zeros = max((low ^ high).bit_length() - 1, 0)
    return high >> zeros << zeros


def file_borders(shares: list[int], files: int) -> list[int]:
    """First curve key of each file but the first, out of the keys at all shares of 1 / (files * STEPS).

    A border lies near its share of the rows where the curve enters as large a cell as can be: a file
    that begins in the midst of cells would reach over parts of two that may be far apart.
    """
    at = [(i * STEPS - SLACK - 1, i * STEPS + SLACK - 1) for i in range(1, files)]
    return [roundest(shares[low], shares[high]) for low, high in at] if shares else []


def _file_number(key: str, part: str, shares: list[int], files: int) -> Column:
    """The file of a row by its curve key; a key that fills a file deals its rows by ``part``, a number from 0 to 1."""
    borders = file_borders(shares, files)
    number = _rank(key, borders)
    for hot in sorted(h for h in set(borders) if shares.count(h) >= STEPS):
        first, last = sum(b < hot for b in borders), sum(b <= hot for b in borders)
        place = F.floor((F.lit(shares.index(hot)) + F.lit(shares.count(hot)) * F.col(part)) / STEPS).cast("int")
        number = F.when(F.col(key) == hot, F.least(F.lit(last), F.greatest(F.lit(first), place))).otherwise(number)
    return number


def cluster(df: DataFrame, files: int, columns: list[str], bits: int = 8, from_scan: bool = False) -> DataFrame:
    """The same rows in ``files`` partitions along a curve, so that a filter on any of the columns meets few of them.

    ``compact`` serves filters on its first column only. A partition has at least half and at most one and a half times its
    share of the rows, about, as it begins where the curve enters a large cell if one is near. Rows of one place on the curve are told
    apart, so that a hot value is spread. ``from_scan`` as in ``with_ties_placed``.
    """
    key, part, number = spare_names(df.columns, "_curve", "_part", "_file")
    keyed = with_curve_key(df, columns, key, bits)
    n = files * STEPS
    shares = keyed.agg(F.percentile_approx(key, F.array(*(F.lit(i / n) for i in range(1, n))), 4 * n)).first()[0] if files > 1 else []
    placed, ties = with_ties_placed(keyed, [key], from_scan)
    parted = placed.withColumn(part, F.pmod(F.xxhash64(*ties), F.lit(1 << 20)) / F.lit(1 << 20))
    dealt = parted.withColumn(number, _file_number(key, part, shares or [], files)).repartitionById(files, number)
    return dealt.sortWithinPartitions(key, *columns, *ties).drop(key, part, number, *ties)


def _first_fit(lengths: list[int], target: int) -> list[int]:
    """Bin of each file: falling by length, into the first bin that has room."""
    room: list[int] = []
    bins = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        for b, left in enumerate(room):
            if lengths[i] <= left:
                break
        else:
            b = len(room)
            room.append(target)
        room[b] -= lengths[i]
        bins[i] = b
    return bins


def pack_files(manifest: DataFrame, target_bytes: int) -> DataFrame:
    """path, folder, length, bin: files below ``target_bytes`` of one folder, in bins of at most that size.

    First fit by falling length. A file of the target size or more is in no bin, and neither is one
    that is alone in its bin: both stay where they are. The files of a folder are packed in parts of a bounded number,
    dealt by a hash of their paths, so that a folder of very many files is shared by tasks.
    """
    small = manifest.filter(F.col("length") < target_bytes).select("path", dirname(F.col("path")).alias("folder"), "length")
    counts = small.groupBy("folder").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / PACKED_AT_ONCE).cast("bigint")
    dealt = small.join(counts, "folder").select("path", "folder", "length", F.pmod(F.xxhash64("path"), parts).alias("part"))

    def pack(table: pa.Table) -> pa.Table:
        # equal lengths go by path, so that a repeated task gives the same bins
        table = table.sort_by("path")
        return table.append_column("n", pa.array(_first_fit(table["length"].to_pylist(), target_bytes), pa.int32()))

    packed = dealt.groupBy("folder", "part").applyInArrow(pack, "path STRING, folder STRING, length BIGINT, part BIGINT, n INT")
    named = packed.select("path", "folder", "length", F.sha1(F.concat_ws("/", "folder", "part", "n")).alias("bin"))
    full = named.groupBy("bin").agg(F.count("*").alias("files")).filter("files > 1")
    return named.join(full, "bin", "left_semi").select("path", "folder", "length", "bin")
