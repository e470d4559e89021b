"""Nearest vectors by a permutation index.

A vector is represented by its ``nearest`` nearest pivots, in order. Blocks of vectors hold one
inverted file per pivot: which of the block's vectors name the pivot, and in which place. For a
query, the files of its own pivots give every vector's footrule distance, the sum of the
differences of places (a pivot that a vector does not name counts as in place ``nearest``). The
block's part with the smallest distances is reranked by exact cosine, and the best of all blocks win.

The pivots are a bounded sample; every vector is indexed. Queries come in bounded chunks, each sent
to all blocks; a block returns no more than ``k`` vectors per query.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesteward.llm.common import numbered, saved

#: pivots, and how many of them a vector names
PIVOTS, NEAREST = 256, 192
#: a vector's number in its block takes two bytes and a place one, hence at most 65536 rows and 256 places
BLOCK_ROWS = 8192
QUERY_CHUNK = 16384
#: part of a block that is reranked, and the least number of vectors
RERANKED_SHARE, RERANKED_LEAST = 0.2, 200

INDEX = "rows BINARY, ids BINARY, vectors BINARY, files ARRAY<BINARY>"


def usable(vectors: DataFrame) -> DataFrame:
    """The rows that take part, stored as ``row``, ``vec_id``, ``v`` (doubles).

    Left out are a null id, a null or empty vector, one with a null or non-finite component, and one
    of norm zero.
    """
    plain = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = plain.filter("vec_id IS NOT NULL AND v IS NOT NULL").filter(finite & F.exists("v", lambda x: x != 0))
    return numbered(good, "vectors")


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _unit(matrix: np.ndarray) -> np.ndarray:
    # scaled first, so that neither huge nor tiny components leave the range of squares
    matrix = matrix / np.abs(matrix).max(1, keepdims=True)
    return matrix / np.sqrt((matrix * matrix).sum(1, keepdims=True))


def permutations(units: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Each vector's nearest pivots, nearest first; equal ones in the pivots' order."""
    return np.argsort(-np.round(units @ pivots.T, 12), axis=1, kind="stable")[:, :nearest]


def build_index(vectors: DataFrame, pivots: np.ndarray, nearest: int = NEAREST, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One stored row per block: its rows, ids and vectors, and for each pivot the places that its vectors give it."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            ids, rows = table["vec_id"].to_numpy(), table["row"].to_numpy()
            order = np.lexsort((rows, ids))  # equal distances are cut by id
            matrix = _matrix(table["v"].chunk(0))[order]
            named = permutations(_unit(matrix), pivots, nearest)
            files = []
            for p in range(len(pivots)):
                vector, place = np.nonzero(named == p)
                files.append(vector.astype(np.uint16).tobytes() + place.astype(np.uint8).tobytes())
            return pa.RecordBatch.from_arrays(
                [pa.array([x], pa.binary()) for x in (rows[order].tobytes(), ids[order].tobytes(), matrix.tobytes())]
                + [pa.array([files], pa.list_(pa.binary()))],
                ["rows", "ids", "vectors", "files"],
            )

        for batch in batches:
            for low in range(0, batch.num_rows, block_rows):
                part = batch.slice(low, block_rows)
                if count and count + part.num_rows > block_rows:
                    yield block()
                    held, count = [], 0
                held.append(part)
                count += part.num_rows
        if count:
            yield block()

    parts = max(1, -(-vectors.count() // block_rows))
    return saved(vectors.repartition(parts).select("row", "vec_id", "v").mapInArrow(build, INDEX), "permutation-index")


def search(index: DataFrame, queries: list[tuple[int, int, list[float]]], pivots: np.ndarray, k: int, nearest: int, share: float, least: int) -> DataFrame:
    """The best ``k`` of each block for each query (row, vec_id, vector): query_row, query_id, vec_id, score."""
    query_rows = np.array([q[0] for q in queries])
    query_ids = np.array([q[1] for q in queries])
    query_units = _unit(np.array([q[2] for q in queries], float))
    named = permutations(query_units, pivots, nearest)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                rows, ids = np.frombuffer(block["rows"], np.int64), np.frombuffer(block["ids"], np.int64)
                units = _unit(np.frombuffer(block["vectors"], float).reshape(len(ids), -1))
                places = np.full((len(pivots), len(ids)), nearest, np.int32)
                for p, content in enumerate(block["files"]):
                    named_by = len(content) // 3
                    places[p, np.frombuffer(content, np.uint16, named_by)] = np.frombuffer(content, np.uint8, offset=2 * named_by)
                wanted = min(len(ids), max(least, k + 1, int(share * len(ids))))
                position = np.arange(len(ids))
                out_query, out_id, out_score = [], [], []
                for q in range(len(query_ids)):
                    distance = np.zeros(len(ids), np.int32)
                    for place, p in enumerate(named[q].tolist()):
                        distance += np.abs(places[p] - place)
                    # the position, by id, decides between equal distances
                    chosen = np.argpartition(distance.astype(np.int64) * len(ids) + position, wanted - 1)[:wanted]
                    chosen = chosen[rows[chosen] != query_rows[q]]
                    score = (units[chosen] * query_units[q]).sum(1)
                    top = np.lexsort((ids[chosen], -score))[:k]
                    out_query.append(np.full(len(top), q))
                    out_id.append(ids[chosen[top]])
                    out_score.append(score[top])
                at = np.concatenate(out_query)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query_rows[at]), pa.array(query_ids[at]), pa.array(np.concatenate(out_id)), pa.array(np.concatenate(out_score))],
                    ["query_row", "query_id", "vec_id", "score"],
                )

    found = index.mapInArrow(find, "query_row BIGINT, query_id BIGINT, vec_id BIGINT, score DOUBLE")
    # one row stays one task's work: blocks are spread, however few files they are stored in
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def nearest_vectors(
    vectors: DataFrame, every: int = 50, k: int = 5, pivots: int = PIVOTS, nearest: int = NEAREST,
    share: float = RERANKED_SHARE, least: int = RERANKED_LEAST, chunk: int = QUERY_CHUNK,
) -> DataFrame:
    """The ``k`` vectors of largest cosine found for each row whose vec_id is divisible by ``every``.

    query_id, rank, vec_id, score; nearest first, ties to the smaller vec_id. Every usable row but
    the query's own is a candidate, so a row that repeats the query's id is one too, and each of
    several rows with one id is a query. Vectors of different lengths have no cosine: each length is
    indexed and searched on its own. What is not usable is said at ``usable``; other columns are
    ignored; with no usable rows, no rows come out.
    """
    spark = vectors.sparkSession
    stored = usable(vectors)
    result = spark.createDataFrame([], "query_id BIGINT, rank INT, vec_id BIGINT, score DOUBLE")
    for r in stored.select(F.size("v").alias("length")).distinct().orderBy("length").collect():
        own = stored.filter(F.size("v") == r["length"])
        result = result.unionByName(_nearest_of_length(own, every, k, pivots, nearest, share, least, chunk))
    return result


def _nearest_of_length(
    stored: DataFrame, every: int, k: int, pivots: int, nearest: int, share: float, least: int, chunk: int
) -> DataFrame:
    """``nearest_vectors`` among usable vectors of one length."""
    spark = stored.sparkSession
    sample = stored.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(pivots).collect()
    empty = spark.createDataFrame([], "query_id BIGINT, rank INT, vec_id BIGINT, score DOUBLE")
    centres = _unit(np.array([r["v"] for r in sample], float))
    nearest = min(nearest, len(centres))
    index = build_index(stored, centres, nearest)
    rows = stored.filter(F.col("vec_id") % every == 0).select("row", "vec_id", "v").toLocalIterator()
    result = None
    while part := [(r["row"], r["vec_id"], r["v"]) for r in itertools.islice(rows, chunk)]:
        found = search(index, part, centres, k, nearest, share, least).select("query_id", "rank", "vec_id", "score")
        result = found if result is None else result.unionByName(found)
    return empty if result is None else result
