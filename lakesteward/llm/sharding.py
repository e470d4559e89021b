"""Reproducible global shuffle into shards by a keyed permutation of row numbers.

Rows get dense numbers 0 to N - 1 in a fixed order. A Feistel network permutes the pairs
(x, y) = (number mod a, number div a) with a * b >= N, a = ceil(sqrt(N)): even rounds add a
function of y to x, odd rounds one of x to y, each modulo its side, so every round can be undone.
Fewer than a of the a * b numbers lie beyond the rows; a row that lands there walks on through the
permutation until it lands inside, which leaves a permutation of the row numbers. From the
permuted number p, shard = p mod S and slot = p div S follow without looking at any other row, and
the shards' counts differ by one at most (law ``rows``). All of it is Spark's own expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesteward.llm.common import saved

#: round functions: square of (value * factor + shift) modulo the prime 2**31 - 1
PRIME = 2147483647
FACTORS = (48271, 69621, 16807, 39373, 1078318381, 950706376)


def round_shift(seed: int, i: int) -> int:
    return (seed * 2654435761 + i * 40503 + 1) % PRIME


def sides(total: int) -> tuple[int, int]:
    """The two sides of the network's domain for ``total`` rows."""
    a = max(1, math.isqrt(max(total - 1, 0)) + 1)
    return a, max(1, -(-total // a))


def feistel(df: DataFrame, name: str, total: int, seed: int) -> DataFrame:
    """Send the numbers in column ``name`` through the network once."""
    a, b = sides(total)
    x, y = f"{name}_x", f"{name}_y"
    df = df.withColumns({x: F.col(name) % a, y: F.expr(f"`{name}` div {a}")})
    for i, factor in enumerate(FACTORS):
        side, other, most = (x, y, a) if i % 2 == 0 else (y, x, b)
        # values stay below 2**31 and products below 2**62
        inner = f"{name}_t{i}"
        df = df.withColumn(inner, (F.col(other) * factor + round_shift(seed, i)) % PRIME)
        df = df.withColumn(side, (F.col(side) + (F.col(inner) * F.col(inner)) % PRIME) % most).drop(inner)
    return df.withColumn(name, F.col(y) * a + F.col(x)).drop(x, y)


def permuted(df: DataFrame, number: str, total: int, name: str, seed: int) -> DataFrame:
    """Add the permuted row number ``name``. 2**62 rows or more are refused.

    Every pass is stored, as a filter on a number that is still an expression would be pushed into
    it and multiply it. The first pass leaves about one row in sqrt(N) outside, each further one as
    small a part of those.
    """
    if total >= 1 << 62:
        raise ValueError("too many rows")
    step = saved(feistel(df.withColumn(name, F.col(number)), name, total, seed), "shard-walk")
    inside, beyond = step.filter(F.col(name) < total), step.filter(F.col(name) >= total)
    while not beyond.isEmpty():
        step = saved(feistel(beyond, name, total, seed), "shard-walk")
        inside = inside.unionByName(step.filter(F.col(name) < total))
        beyond = step.filter(F.col(name) >= total)
    return inside


def row_numbers(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """Dense numbers from 0 in ``order`` and the row count: a range sort, stored, and one offset per sorted partition.

    Rows that agree in all of ``order`` must be interchangeable. Their place in the stored input is
    the last range column, so copies of one row, however many, spread over the tasks.
    """
    place, part = f"{name}_place", f"{name}_part"
    stored = saved(df.withColumn(place, F.monotonically_increasing_id()), "shard-input")
    ranged = saved(stored.sort(*order, place).withColumn(place, F.monotonically_increasing_id()), "shard-order")
    ranged = ranged.withColumn(part, F.shiftright(place, 33))
    # one row per partition of the sort, a number that the session's settings bound
    sizes = ranged.groupBy(part).agg(F.count("*").alias("n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(part, "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    total = stored.count()
    number = F.col("offset") + F.col(place).bitwiseAND((1 << 33) - 1)
    joined = ranged.join(F.broadcast(offsets), part)
    return joined.select(*df.columns, number.cast("bigint").alias(name)), total


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus one; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def sharded(docs: DataFrame, shards: int = 16, seed: int = 2024) -> DataFrame:
    """Every row's shard and slot: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Rows are numbered by doc_id, size and checksum, so the result depends on the rows alone, not on
    their order or partitioning. A null doc_id comes first; a null text counts as the empty text
    (size 1, checksum 0); repeated rows each get a slot of their own; other columns are ignored;
    an empty table gives an empty result. The law is ``rows``; ``grown_shard`` is null.
    """
    text = F.col("text")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        text_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    numbers, total = row_numbers(rows, ["doc_id", "size", "text_crc32"], "number")
    placed = permuted(numbers, "number", total, "target", seed)
    return placed.select(
        "doc_id", "size", "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("target") % shards).cast("int").alias("shard"),
        F.expr(f"target div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
