"""Sampled SentencePiece segmentations by forward filtering and backward sampling, and decoding.

Pieces get Zipf weights, one over their rank in the vocabulary: the model at hand has ranks only.
Forward: a trie over the task's distinct pre-tokens holds, for every prefix, the logarithm of the
summed weights of all its segmentations, and the chance of each last piece. Backward: from a
pre-token's end, a random number picks the last piece, then the one before it, until its start;
all pre-tokens of a slice take each step together. The random numbers are hashes of the seed, the
row's key, the pre-token's place in the text and the step, so a row's segmentation does not depend
on partitions, order or other rows. Decoding gives back the text, byte by byte; every slice is
decoded and compared before it is returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesteward.llm.common import list_array, text_column, text_slices
from lakesteward.llm.pieces import DEFAULT_MODEL, PreTokens, Terminals, Vocabulary, load_vocabulary
from lakesteward.llm.words import Powers, mixed

MOST_NODES = 500_000
#: weights are raised to this power: 0 makes all segmentations equally likely, a large one the best one certain
SHARPNESS = 1.0
#: weight of a character without a piece, against the rarest piece
UNKNOWN_WEIGHT = 1e-3


class Lattice:
    """Trie of prefixes; a node's edges lead to the prefix before its last piece."""

    def __init__(self, vocabulary: Vocabulary, sharpness: float) -> None:
        self.vocabulary = vocabulary
        order = {piece: rank for rank, piece in enumerate(sorted(vocabulary.ids.values()), 1)}
        self.weight = {piece: -sharpness * math.log(rank) for piece, rank in order.items()}
        self.unknown = sharpness * (math.log(UNKNOWN_WEIGHT) - math.log(len(order) + 1))
        #: per suffix of a piece, log weight and place in ``pool``, or nothing if it is no piece
        self.known = {
            text: (self.weight[piece], order[piece] - 1) if piece >= 0 else () for text, piece in vocabulary.suffixes.items()
        }
        self.pieces = list(order)
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.total = [0.0]
        #: per edge: node + summed chance, node before, place and number of its tokens in ``pool``
        self.edges = np.array([0.0]), np.array([-1]), np.array([0]), np.array([0])
        self.fresh: tuple[list, ...] = [], [], [], []
        self.pool = list(self.pieces)
        self.spelled: dict[str, int] = {}

    def _bytes(self, character: str) -> tuple[int, int]:
        """Place and number of the byte tokens of a character."""
        ids = [self.vocabulary.byte_ids[b] for b in character.encode("utf-8", "surrogateescape")]
        if character not in self.spelled:
            self.spelled[character] = len(self.pool)
            self.pool += ids
        return self.spelled[character], len(ids)

    def insert(self, text: str) -> int:
        """The node of ``text``."""
        path = [0]
        children, total, known, exp = self.children, self.total, self.known, math.exp
        limit, before, place, width = self.fresh
        for end, character in enumerate(text, 1):
            key = path[-1] << 21 | ord(character)
            node = children.get(key)
            if node is None:
                node = children[key] = len(total)
                logs, start, single = [], end - 1, False
                while start >= 0 and (hit := known.get(text[start:end])) is not None:
                    if hit:
                        logs.append(total[path[start]] + hit[0])
                        before.append(path[start])
                        place.append(hit[1])
                        width.append(1)
                        single = single or start == end - 1
                    start -= 1
                if not single:
                    logs.append(total[path[end - 1]] + self.unknown)
                    before.append(path[end - 1])
                    at, n = self._bytes(character)
                    place.append(at)
                    width.append(n)
                if len(logs) == 1:
                    total.append(logs[0])
                else:
                    top = max(logs)
                    chances = [exp(x - top) for x in logs]
                    mass = sum(chances)
                    total.append(top + math.log(mass))
                    upto = 0.0
                    for chance in chances[:-1]:
                        upto += chance
                        limit.append(node + min(upto / mass, 1.0))
                limit.append(node + 1.0)
            path.append(node)
        return path[-1]

    def arrays(self) -> tuple[np.ndarray, ...]:
        """The edges so far: limit, before, place, width."""
        if self.fresh[0]:
            self.edges = tuple(np.concatenate([a, np.array(b, a.dtype)]) for a, b in zip(self.edges, self.fresh, strict=True))
            self.fresh = [], [], [], []
        return self.edges


def _uniform(state: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1) from hashed states."""
    return (mixed(state + np.uint64((step * 0xD1342543DE82EF95 + 1) % (1 << 64))) >> np.uint64(12)).astype(float) * 2.0**-52


def sample(lattice: Lattice, nodes: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of one segmentation of each node, in text order, and how many each has."""
    limit, before, _, _ = lattice.arrays()
    at, where = nodes.copy(), np.arange(len(nodes))
    lengths = np.zeros(len(nodes), np.int64)
    owners, edges, steps = [], [], []
    step = 0
    while len(where):
        edge = np.searchsorted(limit, at + _uniform(state[where], step), "right")
        owners.append(where)
        edges.append(edge)
        steps.append(np.full(len(where), step))
        lengths[where] += 1
        at = before[edge]
        where, at = where[at > 0], at[at > 0]
        step += 1
    if not owners:
        return np.zeros(0, np.int64), lengths
    ends = np.cumsum(lengths)
    owner = np.concatenate(owners)
    ordered = np.empty(len(owner), np.int64)
    ordered[ends[owner] - 1 - np.concatenate(steps)] = np.concatenate(edges)
    return ordered, lengths


def _spread(place: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Indices place, place + 1, ... of each run."""
    ends = np.cumsum(width)
    return np.repeat(place - (ends - width), width) + np.arange(int(ends[-1]) if len(ends) else 0)


class Decoder:
    """Token ids back to bytes."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        size = max([*vocabulary.ids.values(), *vocabulary.byte_ids]) + 1
        spelled = [b""] * size
        for piece, i in vocabulary.ids.items():
            spelled[i] = piece.encode()
        for b, i in enumerate(vocabulary.byte_ids):
            spelled[i] = bytes([b])
        self.width = np.array([len(s) for s in spelled])
        self.place = np.r_[0, np.cumsum(self.width)[:-1]]
        self.pool = np.frombuffer(b"".join(spelled), np.uint8)

    def bytes(self, ids: np.ndarray) -> np.ndarray:
        return self.pool[_spread(self.place[ids], self.width[ids])]

    def text(self, ids: list[int]) -> str:
        """The text of one row's ids, without the space in front."""
        return self.bytes(np.array(ids, np.int64)).tobytes()[1:].decode("utf-8", "surrogateescape")


def sampled_segmentations(
    docs: DataFrame, model_path: str = DEFAULT_MODEL, seed: int = 1, sharpness: float = SHARPNESS, most_nodes: int = MOST_NODES
) -> DataFrame:
    """doc_id, n_tokens, token_ids and ``lossless`` for every row of ``docs``.

    ``lossless`` says that decoding the ids gave the text's bytes. The row's key is its doc_id, so
    rows that repeat an id draw the same numbers; a null id is a key of its own. A null or empty text
    has no tokens; other columns are ignored. The model file is read on the driver.
    """
    vocabulary = load_vocabulary(model_path)
    joined = vocabulary.joined

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, lattice, terminals, decoder = Powers(), Lattice(vocabulary, sharpness), Terminals(most_nodes), Decoder(vocabulary)
        for batch in batches:
            keys = batch["key"].to_numpy().view(np.uint64)
            for low, high, data, offsets in text_slices(batch["text"]):
                tokens = PreTokens(data, offsets, joined, powers)
                nodes = terminals.look_up(tokens, lattice.insert)
                counts = np.diff(tokens.first)
                place = np.arange(len(nodes)) - np.repeat(tokens.first[:-1], counts)
                state = mixed(np.repeat(keys[low:high], counts) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                edges, lengths = sample(lattice, nodes, state)
                _, _, place_of, width_of = lattice.arrays()
                width = width_of[edges]
                ids = np.array(lattice.pool, np.int32)[_spread(place_of[edges], width)] if len(edges) else np.zeros(0, np.int32)
                token_ends = np.r_[0, np.cumsum(width)][np.r_[0, np.cumsum(lengths)]][tokens.first]
                # bytes up to each token's end, to compare text by text
                back = decoder.bytes(ids)
                byte_ends = np.r_[0, np.cumsum(decoder.width[ids])][token_ends]
                same = np.array([
                    a1 - a0 == b1 - b0 and bool((back[a0:a1] == tokens.data[b0:b1]).all())
                    for a0, a1, b0, b1 in zip(byte_ends[:-1].tolist(), byte_ends[1:].tolist(), tokens.offsets[:-1].tolist(), tokens.offsets[1:].tolist(), strict=True)
                ])
                n = np.diff(token_ends)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(low, high - low), pa.array(n), list_array(ids, n, pa.int32()), pa.array(same, pa.bool_())],
                    ["doc_id", "n_tokens", "token_ids", "lossless"],
                )
                if len(lattice.total) > most_nodes:
                    lattice.clear()
                    terminals.clear()

    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.lit(seed), F.col("doc_id").cast("bigint")).alias("key"), text_column().alias("text")
    )
    return texts.mapInArrow(segment, "doc_id BIGINT, n_tokens BIGINT, token_ids ARRAY<INT>, lossless BOOLEAN")
