"""Exact top-k inner products, a block of vectors at a time.

Vectors lie in blocks of neighbours in an order that puts those near the same centre together. A
dimension stands for two terms, one for its positive and one for its negative components. A block
knows the maximum of every term, so that a query's weights times these maxima, summed, bound the
score of every vector in it. A query takes blocks by falling bound, scores their vectors from the
block's own copy of them (its forward index), and stops when no bound reaches its k-th score.

Every query first scores one block of each group, the one of the largest bound; the k-th best
score of all groups is the threshold that all tasks start from. Nothing is approximated: a block is
skipped only where its bound proves that it holds no result.

Queries come in rounds of bounded bytes, each stored before the next, so the driver and a task hold
the queries of one round. Blocks and results are never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesteward.llm.common import numbered, saved, workspace
from lakesteward.llm.integer_vectors import EXACT, integer_vectors, largest

SCALE = 256
#: vectors in a block, and in a group, which is a row of the stored index
BLOCK_ROWS, GROUP_ROWS = 32, 8192
#: at most so many vectors are centres of the order; all vectors are indexed
CENTRES = 128
#: bytes of query vectors in a round
ROUND_BYTES = 16 << 20
#: (query, block) scores that a task computes at once
WAVE_PAIRS = 1 << 16

INDEX = "length INT, vec_ids BINARY, id_nulls BINARY, rows BINARY, vectors BINARY"
FOUND = "query_row BIGINT, query_id BIGINT, vec_id BIGINT, score BIGINT"


def _near_centre(vectors: DataFrame, centres: int) -> DataFrame:
    """``vectors`` with ``place``, the centre whose direction is nearest: an order only, any order gives the same results."""
    sample = vectors.orderBy(F.xxhash64("row"), "row").limit(centres).select("x").collect()
    by_length: dict[int, np.ndarray] = {}
    for r in sample:
        x = np.array(r["x"], float)
        if x.any():
            by_length.setdefault(len(x), []).append(x / np.sqrt(x @ x))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("x")
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            values = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
            starts = np.cumsum(lengths) - lengths
            places = np.zeros(len(lengths), np.int32)
            for length, units in by_length.items():
                rows = np.flatnonzero(lengths == length)
                places[rows] = (values[starts[rows][:, None] + np.arange(length)] @ np.array(units).T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths), pa.array(places)], [*batch.schema.names, "length", "place"])

    return vectors.mapInArrow(place, "vec_id BIGINT, x ARRAY<BIGINT>, row BIGINT, length INT, place INT")


def build_index(vectors: DataFrame, centres: int = CENTRES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One stored row per group of vectors of one length: their ids, rows and components, in block order."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def group(table: pa.Table) -> pa.RecordBatch:
            x = table["x"].combine_chunks()
            ids = table["vec_id"].combine_chunks()
            values = x.flatten().to_numpy(zero_copy_only=False)
            contents = [ids.fill_null(0).to_numpy().tobytes(), ids.is_null().to_numpy(zero_copy_only=False).tobytes(), table["row"].to_numpy().tobytes(), values.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([table["length"][0].as_py()], pa.int32())] + [pa.array([c], pa.binary()) for c in contents], ["length", "vec_ids", "id_nulls", "rows", "vectors"])

        def groups(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            table = pa.Table.from_batches(held)
            low = 0
            while low < len(table):
                part = table.slice(low, group_rows)
                lengths = part["length"].to_numpy()
                same = int((lengths == lengths[0]).argmin()) or len(part) if (lengths != lengths[0]).any() else len(part)
                if same == len(part) < group_rows and not last:
                    break
                yield group(part.slice(0, same))
                low += same
            held = table.slice(low).to_batches() if low < len(table) else []

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= group_rows:
                yield from groups(False)
        if held:
            yield from groups(True)

    parts = max(1, -(-vectors.count() // group_rows))
    placed = saved(_near_centre(vectors, centres), "placed-vectors")
    # the row spreads a place that very many vectors share
    ordered = placed.repartitionByRange(parts, "length", "place", "row").sortWithinPartitions("length", "place", "vec_id", "row")
    return saved(ordered.mapInArrow(pack, INDEX), "block-index")


class Blocks:
    """The blocks of one group: vectors by block and the maximum of every term."""

    def __init__(self, group: dict, block_rows: int) -> None:
        self.rows = np.frombuffer(group["rows"], np.int64)
        n, length = len(self.rows), group["length"]
        self.nulls = np.frombuffer(group["id_nulls"], bool)
        self.ids = np.frombuffer(group["vec_ids"], np.int64)
        self.vectors = np.frombuffer(group["vectors"], np.int64).reshape(n, length)
        self.starts = np.arange(0, n, block_rows)
        self.ends = np.r_[self.starts[1:], n]
        self.highest = np.maximum.reduceat(self.vectors, self.starts) if length else np.zeros((len(self.starts), 0), np.int64)
        self.lowest = np.minimum.reduceat(self.vectors, self.starts) if length else self.highest
        self.largest = largest(self.vectors)

    def numbers(self, queries: np.ndarray) -> type:
        """Doubles where every sum of products is exact in them, else Python's integers."""
        return float if largest(queries) * self.largest * max(1, queries.shape[1]) < EXACT else object

    def bounds(self, queries: np.ndarray, kind: type) -> np.ndarray:
        """Summed term maxima: no vector of the block scores higher."""
        up, down = np.maximum(queries, 0).astype(kind), np.minimum(queries, 0).astype(kind)
        return up @ np.maximum(self.highest, 0).astype(kind).T + down @ np.minimum(self.lowest, 0).astype(kind).T


class Best:
    """The k best (score, id) of each query found so far; a null id comes after all others."""

    def __init__(self, queries: int, k: int, kind: type, floor: np.ndarray) -> None:
        self.k = k
        self.scores = np.full((queries, k), -np.inf if kind is float else -(1 << 200), kind)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)
        self.nulls = np.ones((queries, k), bool)
        self.filled = np.zeros((queries, k), bool)
        #: a score that k other vectors are known to reach
        self.floor = floor

    def least(self) -> np.ndarray:
        """What a score must reach to matter."""
        return np.maximum(self.scores[:, -1], self.floor)

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        """One (query, vector) per entry."""
        if not len(queries):
            return
        own = np.unique(queries)
        at = np.concatenate([np.repeat(own, self.k)[self.filled[own].ravel()], queries])
        kept = self.filled[own]
        score = np.concatenate([self.scores[own][kept], scores])
        who = np.concatenate([self.ids[own][kept], ids])
        null = np.concatenate([self.nulls[own][kept], nulls])
        order = np.lexsort((who, null, -score, at))
        at = at[order]
        first = np.searchsorted(at, at)
        rank = np.arange(len(at)) - first
        order, at, rank = order[rank < self.k], at[rank < self.k], rank[rank < self.k]
        for target, values in ((self.scores, score), (self.ids, who), (self.nulls, null)):
            target[at, rank] = values[order]
        self.filled[at, rank] = True


def _score(blocks: Blocks, best: Best, queries: np.ndarray, query_rows: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> None:
    """Score (query, block) pairs through the blocks' forward index."""
    order = np.argsort(pairs[1], kind="stable")
    at, block = pairs[0][order], pairs[1][order]
    cuts = np.flatnonzero(np.diff(block)) + 1
    least = best.least()
    found: list[tuple[np.ndarray, ...]] = []
    for low, high in zip(np.r_[0, cuts], np.r_[cuts, len(block)], strict=True):
        own = at[low:high]
        rows = slice(blocks.starts[block[low]], blocks.ends[block[low]])
        scores = queries[own] @ blocks.vectors[rows].astype(queries.dtype).T
        who, which = np.nonzero((scores >= least[own][:, None]) & (blocks.rows[rows] != query_rows[own][:, None]))
        place = which + rows.start
        found.append((own[who], scores[who, which], blocks.ids[place], blocks.nulls[place]))
    best.add(*(np.concatenate(parts) for parts in zip(*found, strict=True)))


def search_group(blocks: Blocks, queries: np.ndarray, query_rows: np.ndarray, k: int, floor: np.ndarray | None, seeds: bool) -> tuple[Best, int]:
    """The best of one group per query, and how many (query, block) pairs were scored.

    With ``seeds`` only the block of the largest bound is scored.
    """
    kind = blocks.numbers(queries)
    weights = queries.astype(kind)
    bounds = blocks.bounds(queries, kind)
    n, many = bounds.shape
    none = np.full(n, -np.inf) if kind is float else np.full(n, -(1 << 200), object)
    best = Best(n, k, kind, none if floor is None else floor.astype(kind))
    turn = np.argsort(-bounds, axis=1, kind="stable") if kind is float else np.array([sorted(range(many), key=lambda b, row=row: -row[b]) for row in bounds]).reshape(n, many)
    scored, low, width = 0, 0, 1
    active = np.arange(n)
    while low < many and len(active):
        high = min(many, low + width)
        block = turn[active, low:high]
        wanted = bounds[active[:, None], block] >= best.least()[active][:, None]
        who, which = np.nonzero(wanted)
        if not len(who):
            break
        # bounds fall along a row, so a query without a wanted block is done
        _score(blocks, best, weights, query_rows, (active[who], block[who, which]))
        scored += len(who)
        if seeds:
            break
        active = active[wanted[:, -1]]
        # waves grow, as long as their pairs are bounded
        low, width = high, max(1, min(2 * width, WAVE_PAIRS // max(1, len(active))))
    return best, scored


def _searched(index: DataFrame, queries: list, k: int, block_rows: int, floors: dict[int, int] | None) -> DataFrame:
    """Best of every group for the queries (row, id, vector) of one round; without ``floors`` from one block of each."""
    by_length: dict[int, tuple] = {}
    for length in {len(q[2]) for q in queries}:
        own = [q for q in queries if len(q[2]) == length]
        floor = None if floors is None else np.array([floors.get(q[0], -(2**62)) for q in own], object)
        by_length[length] = (np.array([q[0] for q in own]), np.array([q[1] for q in own]), np.array([q[2] for q in own], np.int64).reshape(len(own), length), floor)
    sent = index.sparkSession.sparkContext.broadcast(by_length)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.to_pylist():
                if group["length"] not in sent.value:
                    continue
                rows, ids, vectors, floor = sent.value[group["length"]]
                best, _ = search_group(Blocks(group, block_rows), vectors, rows, k, floor, floors is None)
                at, rank = np.nonzero(best.filled)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows[at]), pa.array(ids[at]), pa.array(best.ids[at, rank], mask=best.nulls[at, rank]),
                        pa.array([int(s) for s in best.scores[at, rank]], pa.int64()),
                    ],
                    ["query_row", "query_id", "vec_id", "score"],
                )

    return index.mapInArrow(find, FOUND)


def top_products(
    vectors: DataFrame, every: int = 50, k: int = 5, centres: int = CENTRES, block_rows: int = BLOCK_ROWS,
    group_rows: int = GROUP_ROWS, round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest integer inner products of each row whose vec_id is divisible by ``every``.

    Ties go to the smaller vec_id, a null one last. Every row but the query's own is a candidate, so
    a row that repeats its id is one too, and each of several rows with one id is a query. Vectors
    of different lengths have no product: each length is searched on its own. Vectors of zeros, or
    without components, take part with scores of 0. See ``integer_vectors`` for what is left out;
    a score beyond a long is an error; an empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    stored = numbered(integer_vectors(vectors, SCALE), "search-input")
    index = build_index(stored.select("vec_id", "x", "row"), centres, group_rows)
    asked = stored.filter(F.col("vec_id") % every == 0)
    size = asked.agg(F.sum(F.size("x") * 8 + 32)).first()[0] or 0
    rounds = -(-size // round_bytes)
    # a hash deals the queries to rounds of about even size; each round is read once
    by_round = workspace(spark, "search-queries")
    number = F.pmod(F.xxhash64("row"), F.lit(max(1, rounds))).cast("int")
    asked.withColumn("round", number).repartition("round").write.partitionBy("round").parquet(by_round)
    result = spark.createDataFrame([], "query_id BIGINT, rank INT, vec_id BIGINT, score BIGINT")
    for i in range(rounds):
        own = spark.read.schema("row BIGINT, vec_id BIGINT, x ARRAY<BIGINT>, round INT").parquet(by_round).filter(F.col("round") == i)
        queries = [(r["row"], r["vec_id"], r["x"]) for r in own.select("row", "vec_id", "x").collect()]
        if not queries:
            continue
        seeds = _searched(index, queries, k, block_rows, None)
        kept = seeds.withColumn("rank", F.row_number().over(_order())).filter(F.col("rank") == k)
        floors = {r["query_row"]: r["score"] for r in kept.select("query_row", "score").collect()}
        found = _searched(index, queries, k, block_rows, floors)
        best = found.withColumn("rank", F.row_number().over(_order())).filter(F.col("rank") <= k)
        result = result.unionByName(saved(best.select("query_id", "rank", "vec_id", "score"), "search-round"))
    return result


def _order() -> Window:
    return Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
