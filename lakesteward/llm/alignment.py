"""Tokens of two vocabularies aligned by the bytes they cover, with the corpus-wide count of every id pair.

The first pass aligns the documents and sums, within tasks, how often each pair of ids overlaps. The
distinct pairs get a minimal perfect hash function: shards of bounded size are hashed level by
level, each key that is alone in its place sets a bit there, and the rank of its bit is its number.
Counts are then dense vectors indexed by that number; tasks' vectors are summed in a tree. The keys
are kept in the same order, so that a looked-up number is checked against the key. The second pass
aligns the documents again and looks their pairs up.

Texts are cut before a space that follows a visible ASCII character which no piece joins to a space:
neither tokenizer ever crosses such a border, so a chunk is tokenized and aligned once per task.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesteward.llm.common import key_runs, numbered, saved, text_slices
from lakesteward.llm.pieces import DEFAULT_MODEL, MARK, load_vocabulary
from lakesteward.llm.words import mixed

DEFAULT_BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
#: chunks up to so many bytes are remembered, and at most so many links of them in a task
REMEMBERED_BYTES, REMEMBERED_LINKS = 64, 6_000_000
#: new chunks encoded as one text
JOINED = 256
#: distinct pairs in a shard of the hash function, and in the tables that one pass looks up
SHARD_PAIRS, ROUND_PAIRS = 1 << 17, 1 << 22
#: fixed slots that shards are runs of
SLOTS = 4096
#: bits per key and level
SPREAD = 1.5
#: entries in a stored part of a count vector, and vectors added in one step of the tree
SEGMENT, FAN_IN = 1 << 16, 8

NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
#: numbers looked up for every pair
RATINGS = 3
ROW = "doc_id BIGINT, n_a BIGINT, n_b BIGINT, n_groups BIGINT, n_links BIGINT, n_best BIGINT, count_sum BIGINT, groups_sha256 STRING"


def _byte_level_alphabet() -> dict[str, int]:
    """Byte of each character of byte-level pieces: visible Latin-1 stands for itself, the rest for 256 and on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both vocabularies: the bytes of every id, and ids of many texts at once."""

    def __init__(self, byte_level: str, pieces: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        alphabet = _byte_level_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in piece)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.a_lengths, self.b_lengths = (np.array(list(map(len, t)), np.int64) for t in (self.a_bytes, self.b_bytes))
        # ids as text, with what follows one within a group and at the end of its side of the group
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.a_written, self.b_written = (
            np.array([[f"{i}{mark}" for i in range(most)] for mark in marks], object) for marks in (",|", ",;")
        )
        self.digits = np.array([len(str(i)) for i in range(most)], np.int64)
        # where a space may begin a chunk: after a visible ASCII character that no piece joins to a space
        joined = load_vocabulary(pieces).joined[32::256]
        self.cut_after = ~joined & (np.arange(256) > 32) & (np.arange(256) < 127)

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts that begin with a space; the second model adds that space itself."""
        first = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        return first, self.b.encode([c[1:] for c in chunks], num_threads=1)


@lru_cache(maxsize=1)
def tokenizers(byte_level: str, pieces: str) -> Tokenizers:
    return Tokenizers(byte_level, pieces)


class Aligner:
    """Chunks a task has seen: their numbers of tokens, groups and links, pairs of ids, and groups as text."""

    def __init__(self, tools: Tokenizers, rate: Callable[[np.ndarray], np.ndarray] | None = None) -> None:
        self.tools = tools
        #: the numbers looked up for each pair, which are summed per chunk
        self.rate = rate
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.whole = np.zeros(0, bool)
        self.numbers = np.zeros((0, 4 + RATINGS), np.int64)
        self.texts: list[bytes] = []
        #: chunk and pair of every link of the chunks, kept only where no pair is looked up
        self.owners: list[np.ndarray] = []
        self.pairs: list[np.ndarray] = []
        self.links = 0

    @property
    def full(self) -> bool:
        return self.links > REMEMBERED_LINKS

    def _encoded(self, chunks: list[bytes]) -> tuple[np.ndarray, ...]:
        """Whether each chunk keeps its bytes in both vocabularies; and of those that do the ids and ends of all tokens, and the ends of the chunks.

        Chunks that may border on one another are joined to longer texts, which both tokenizers take
        much faster; a joined text that does not come back whole is encoded chunk by chunk.
        """
        tools = self.tools
        joinable = [len(c) > 1 and bool(tools.cut_after[c[-1]]) and c[1] > 32 and c[1] != 127 for c in chunks]
        runs = [[i for i, j in enumerate(joinable) if j]]
        runs = [runs[0][n : n + JOINED] for n in range(0, len(runs[0]), JOINED)] + [[i] for i, j in enumerate(joinable) if not j]
        whole = np.zeros(len(chunks), bool)
        found: list[tuple[list[int], np.ndarray, np.ndarray]] = []
        while runs:
            texts, kept = [], []
            for run in runs:
                try:
                    texts.append(b"".join([chunks[i] for i in run]).decode())
                    kept.append(run)
                except UnicodeDecodeError:
                    if len(run) > 1:
                        kept.append(run)
                        texts.append(" ")  # comes back changed
            again = []
            for run, text, a, b in zip(kept, texts, *tools.encode(texts), strict=True):
                data = b"".join([chunks[i] for i in run])
                if b"".join([tools.a_bytes[t] for t in a]) == data == b"".join([tools.b_bytes[t] for t in b]):
                    whole[run] = True
                    found.append((run, np.array(a, np.int64), np.array(b, np.int64)))
                elif len(run) > 1:
                    again += [[i] for i in run]
            runs = again
        found.sort(key=lambda f: f[0][0])
        order = [i for run, _, _ in found for i in run]
        none = np.zeros(0, np.int64)
        flat_a, flat_b = (np.concatenate([none, *(f[side] for f in found)]) for side in (1, 2))
        return whole, np.array(order, np.int64), flat_a, flat_b, np.cumsum(tools.a_lengths[flat_a]), np.cumsum(tools.b_lengths[flat_b])

    def _learn(self, chunks: list[bytes]) -> None:
        """Tokenize and align new chunks."""
        # in the order in which their tokens follow each other
        whole, place, flat_a, flat_b, ends_a, ends_b = self._encoded(chunks)
        numbers = np.zeros((len(chunks), 4 + RATINGS), np.int64)
        strings = [b""] * len(chunks)
        if len(place):
            chunk_ends = np.cumsum([len(chunks[i]) for i in place.tolist()])
            # between two ends lies one overlap of one token with one token
            ends = np.union1d(ends_a, ends_b)
            at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
            pair = (flat_a[at_a] << 32) | flat_b[at_b]
            owner = np.searchsorted(chunk_ends, ends)
            common = (ends_a[at_a] == ends) & (ends_b[at_b] == ends)
            if common[np.searchsorted(ends, chunk_ends)].sum() != len(place):
                raise ValueError("a token crosses the border of a chunk")
            for n, of in enumerate((np.searchsorted(chunk_ends, ends_a), np.searchsorted(chunk_ends, ends_b), owner[common], owner)):
                numbers[place, n] = np.bincount(of, minlength=len(place))
            if self.rate is None:
                self.owners.append(len(self.texts) + place[owner])
                self.pairs.append(pair)
            else:
                for n, rating in enumerate(self.rate(pair)):
                    # exact: whole numbers are added as such
                    sums = np.r_[0, np.cumsum(rating)]
                    cuts = np.r_[0, np.searchsorted(owner, np.arange(len(place)), "right")]
                    numbers[place, 4 + n] = np.diff(sums[cuts])
                self._write_groups(strings, place, flat_a, flat_b, at_a[common] + 1, at_b[common] + 1, owner[common])
            self.links += len(pair)
        self.links += len(chunks)
        self.whole = np.r_[self.whole, whole]
        self.numbers = np.concatenate([self.numbers, numbers])
        self.texts += strings

    def _write_groups(self, strings: list[bytes], place: np.ndarray, flat_a: np.ndarray, flat_b: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray, owner: np.ndarray) -> None:
        """Each chunk's groups as text, from the tokens of either side up to which every group goes."""
        tools = self.tools
        group_a, group_b = (np.searchsorted(upto, np.arange(len(flat)), "right") for upto, flat in ((upto_a, flat_a), (upto_b, flat_b)))
        # a group's first ids, then its second ones, each with what follows it
        at_a = np.arange(len(flat_a)) + np.r_[0, upto_b][group_a]
        at_b = np.arange(len(flat_b)) + upto_a[group_b]
        parts = np.empty(len(flat_a) + len(flat_b), object)
        lengths = np.empty(len(parts), np.int64)
        for at, flat, upto, written in ((at_a, flat_a, upto_a, tools.a_written), (at_b, flat_b, upto_b, tools.b_written)):
            last = np.zeros(len(flat), np.int64)
            last[upto - 1] = 1
            parts[at] = written[last, flat]
            lengths[at] = tools.digits[flat]
        text = "".join(parts.tolist()).encode()
        ends = np.cumsum(lengths + 1)
        last_group = np.searchsorted(owner, np.arange(len(place)), "right") - 1
        cuts = np.r_[0, ends[upto_a[last_group] + upto_b[last_group] - 1]].tolist()
        for n, i in enumerate(place.tolist()):
            strings[i] = text[cuts[n] : cuts[n + 1] - 1]

    def look_up(self, data: bytes, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry of every chunk of the texts that begin at ``heads``, and each text's first chunk."""
        b = np.frombuffer(data, np.uint8)
        begin = np.zeros(len(b), bool)
        if len(b) > 2:
            begin[1:-1] = (b[1:-1] == 32) & self.tools.cut_after[b[:-2]] & (b[2:] > 32) & (b[2:] != 127)
        begin[heads] = True
        starts = np.flatnonzero(begin)
        ends = np.r_[starts[1:], len(b)].astype(np.int64)
        chunks = [data[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        found = list(map(self.known.get, chunks))
        missing = [n for n, i in enumerate(found) if i is None]
        if missing:
            unknown = [chunks[n] for n in missing]
            new = list(dict.fromkeys(unknown))
            base = len(self.texts)
            self._learn(new)
            fresh = dict(zip(new, range(base, base + len(new)), strict=True))
            for n, c in zip(missing, unknown, strict=True):
                found[n] = fresh[c]
            self.known.update((c, i) for c, i in fresh.items() if len(c) <= REMEMBERED_BYTES)
        return np.array(found, np.int64), np.searchsorted(starts, heads)


def _slices(column: pa.Array) -> Iterator[tuple[int, int, bytes, np.ndarray, np.ndarray]]:
    """Runs of texts: first row, end row, bytes with a space before each text, the rows with text, their heads."""
    for low, high, data, offsets in text_slices(column):
        lengths = np.diff(offsets)
        filled = np.flatnonzero(lengths)
        raw = data.tobytes()
        spaced = b"".join([b" " + raw[offsets[i] : offsets[i + 1]] for i in filled.tolist()])
        heads = np.cumsum(lengths[filled] + 1) - (lengths[filled] + 1)
        yield low, high, spaced, filled, heads


def _whole_texts(aligner: Aligner, entries: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Texts all of whose chunks keep their bytes in both vocabularies."""
    return np.logical_and.reduceat(aligner.whole[entries], first)


def partial_counts(documents: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """slot, pair, n: links per pair of ids, summed within tasks; stored."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(tokenizers(byte_level, pieces))
        seen = np.zeros(0, np.int64)

        def sums() -> pa.RecordBatch:
            none = np.zeros(0, np.int64)
            times = seen[np.concatenate([none, *aligner.owners])]
            own, place = np.unique(np.concatenate([none, *aligner.pairs]), return_inverse=True)
            n = np.zeros(len(own), np.int64)
            np.add.at(n, place, times)
            own, n = own[n > 0], n[n > 0]
            return pa.RecordBatch.from_arrays([pa.array(_slot(own).astype(np.int32)), pa.array(own), pa.array(n)], ["slot", "pair", "n"])

        for batch in batches:
            for _, _, data, filled, heads in _slices(batch.column("text")):
                if not len(filled):
                    continue
                entries, first = aligner.look_up(data, heads)
                good = np.repeat(_whole_texts(aligner, entries, first), np.diff(np.r_[first, len(entries)]))
                fresh = np.bincount(entries[good], minlength=len(aligner.texts))
                fresh[: len(seen)] += seen
                seen = fresh
                if aligner.full:
                    yield sums()
                    aligner.clear()
                    seen = np.zeros(0, np.int64)
        yield sums()

    return saved(documents.select("text").mapInArrow(count, "slot INT, pair BIGINT, n BIGINT"), "pair-partials")


def _slot(pairs: np.ndarray) -> np.ndarray:
    return (mixed(pairs.astype(np.uint64)) >> np.uint64(52)).astype(np.int64)


def _level_hash(pairs: np.ndarray, level: int) -> np.ndarray:
    # halves of the golden ratio's fraction keep the levels apart
    return mixed(pairs.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64))


def hash_levels(pairs: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes of the levels in bits, the bits of all levels as bytes, and the keys by number.

    Keys that share a place go on to the next level, until none is left. Sizes are whole bytes.
    """
    sizes, parts, ordered = [], [], []
    left = pairs
    while len(left):
        size = max(64, -(-int(SPREAD * len(left)) // 64) * 64)
        at = (_level_hash(left, len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, bool)
        bits[at[alone]] = True
        ordered.append(left[alone][np.argsort(at[alone])])
        sizes.append(size)
        parts.append(np.packbits(bits, bitorder="little"))
        left = left[~alone]
    none = np.zeros(0, np.int64)
    return sizes, np.concatenate([none.astype(np.uint8), *parts]), np.concatenate([none, *ordered])


def hashed_shards(partials: DataFrame, shard_pairs: int = SHARD_PAIRS) -> tuple[DataFrame, int]:
    """One stored row per shard of the distinct pairs: its hash function and its keys by number; and the number of shards."""
    distinct = saved(partials.select("slot", "pair").distinct(), "pairs")
    shards = min(SLOTS, max(1, -(-distinct.count() // shard_pairs)))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_runs(batches, "shard", shard_pairs):
            keys = table["shard"].to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(keys)) + 1, len(keys)]
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                sizes, bits, ordered = hash_levels(table["pair"].slice(low, high - low).to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(keys[low])], pa.int32()), pa.array([high - low], pa.int64()), pa.array([sizes], pa.list_(pa.int64())),
                        pa.array([bits.tobytes()], pa.binary()), pa.array([ordered.tobytes()], pa.binary()),
                    ],
                    ["shard", "n", "sizes", "bits", "pairs"],
                )

    placed = distinct.select(F.floor(F.col("slot") * shards / SLOTS).cast("int").alias("shard"), "pair")
    dealt = placed.repartition(shards, "shard").sortWithinPartitions("shard")
    schema = "shard INT, n BIGINT, sizes ARRAY<BIGINT>, bits BINARY, pairs BINARY"
    return saved(dealt.mapInArrow(build, schema), "pair-hash"), shards


@dataclass
class PerfectHash:
    """Numbers 0 to n - 1 of the pairs of consecutive shards, each checked against the stored pair."""

    shards: int
    first: int
    #: start and size of each shard's levels in ``bits``; size 0 where a shard has no such level
    starts: np.ndarray
    sizes: np.ndarray
    bits: np.ndarray
    #: set bits before each 64-bit word
    before: np.ndarray
    pairs: np.ndarray

    @staticmethod
    def of(rows: list, shards: int) -> PerfectHash:
        """From the rows of consecutive shards, in order; a shard without pairs has no row."""
        first = rows[0]["shard"]
        depth = max(len(r["sizes"]) for r in rows)
        sizes = np.zeros((rows[-1]["shard"] - first + 1, depth), np.int64)
        for r in rows:
            sizes[r["shard"] - first, : len(r["sizes"])] = r["sizes"]
        starts = (np.cumsum(sizes.ravel()) - sizes.ravel()).reshape(sizes.shape)
        bits = np.frombuffer(b"".join(bytes(r["bits"]) for r in rows), np.uint64)
        counts = np.bitwise_count(bits).astype(np.int64)
        pairs = np.frombuffer(b"".join(bytes(r["pairs"]) for r in rows), np.int64)
        return PerfectHash(shards, first, starts, sizes, bits, np.cumsum(counts) - counts, pairs)

    def numbers(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``pairs`` that belong to these shards, and their numbers, -1 for a pair that is not the stored one."""
        shard = _slot(pairs) * self.shards // SLOTS - self.first
        mine = np.flatnonzero((shard >= 0) & (shard < len(self.sizes)))
        number = np.full(len(mine), -1, np.int64)
        left = np.arange(len(mine))
        for level in range(self.sizes.shape[1]):
            size = self.sizes[shard[mine[left]], level]
            left = left[size > 0]
            if not len(left):
                break
            own = mine[left]
            spot = (_level_hash(pairs[own], level) % size[size > 0].astype(np.uint64)).astype(np.int64) + self.starts[shard[own], level]
            word, bit = self.bits[spot >> 6], (spot & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            lower = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            number[left[hit]] = (self.before[spot >> 6] + lower)[hit]
            left = left[~hit]
        number[(number < 0) | (self.pairs[number] != pairs[mine])] = -1
        return mine, number


def summed_counts(partials: DataFrame, function: PerfectHash) -> np.ndarray:
    """Dense counts by number: each task fills a vector, and vectors are added in a tree, part by part."""
    n = len(function.pairs)
    sent = partials.sparkSession.sparkContext.broadcast(function)
    low, high = -(-function.first * SLOTS // function.shards), -(-(function.first + len(function.sizes)) * SLOTS // function.shards)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vector = np.zeros(n, np.int64)
        for batch in batches:
            mine, number = sent.value.numbers(batch.column("pair").to_numpy())
            if (number < 0).any():
                raise ValueError("a pair without a number")
            np.add.at(vector, number, batch.column("n").to_numpy()[mine])
        part = TaskContext.get().partitionId()
        for i, start in enumerate(range(0, n, SEGMENT)):
            content = vector[start : start + SEGMENT].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([i], pa.int64()), pa.array([content], pa.binary())], ["part", "segment", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_py(), np.int64) for c in table["counts"])
        return pa.table({"part": [table["part"][0].as_py() // FAN_IN], "segment": [table["segment"][0].as_py()], "counts": pa.array([total.tobytes()], pa.binary())})

    own = partials.filter((F.col("slot") >= low) & (F.col("slot") < high)).select("pair", "n")
    # a vector is worth its bytes once a task has as many partial counts as it has entries
    parts = max(1, -(-own.count() // max(1, n)))
    schema = "part BIGINT, segment BIGINT, counts BINARY"
    vectors = saved(own.coalesce(parts).mapInArrow(fill, schema), "pair-counts")
    while parts > 1:
        parts = -(-parts // FAN_IN)
        step = vectors.groupBy("segment", F.floor(F.col("part") / FAN_IN).alias("into"))
        vectors = saved(step.applyInArrow(add, schema), "pair-counts")
    rows = vectors.select("segment", "counts").orderBy("segment").collect()
    return np.frombuffer(b"".join(bytes(r["counts"]) for r in rows), np.int64)


@dataclass
class Counts:
    """Pairs of some shards with their counts, and the highest count of every second id in all shards."""

    function: PerfectHash
    counts: np.ndarray
    best: np.ndarray

    def rate(self, pairs: np.ndarray) -> np.ndarray:
        """Per pair: 1 if its count is the highest of its second id, its count, and 1 if it has none; 0 for pairs of other shards."""
        mine, number = self.function.numbers(pairs)
        out = np.zeros((RATINGS, len(pairs)), np.int64)
        out[2, mine[number < 0]] = 1
        mine, number = mine[number >= 0], number[number >= 0]
        out[1, mine] = self.counts[number]
        out[0, mine] = out[1, mine] == self.best[pairs[mine] & 0xFFFFFFFF]
        return out


def _aligned(documents: DataFrame, keys: list[str], counts: Counts | None, byte_level: str, pieces: str) -> DataFrame:
    """One row per document with the sums over its chunks."""
    sent = documents.sparkSession.sparkContext.broadcast(counts)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = (lambda pairs: np.zeros((RATINGS, len(pairs)), np.int64)) if sent.value is None else sent.value.rate
        aligner = Aligner(tokenizers(byte_level, pieces), rate)
        for batch in batches:
            numbers = np.zeros((batch.num_rows, 6), np.int64)
            digests = [""] * batch.num_rows
            for low, _, data, filled, heads in _slices(batch.column("text")):
                if not len(filled):
                    continue
                entries, first = aligner.look_up(data, heads)
                good = _whole_texts(aligner, entries, first)
                sums = np.add.reduceat(aligner.numbers[entries], first, axis=0)
                numbers[low + filled[good]] = sums[good, :6]
                if sums[good, 6].any():
                    raise ValueError("a pair without a count")
                flat, ends = entries.tolist(), [*first[1:].tolist(), len(entries)]
                texts = aligner.texts
                for row, begin, end, whole in zip((low + filled).tolist(), first.tolist(), ends, good.tolist(), strict=True):
                    if whole:
                        digests[row] = hashlib.sha256(b";".join([texts[i] for i in flat[begin:end]])).hexdigest()
                if aligner.full:
                    aligner.clear()
            columns = [batch.column(k) for k in keys] + [pa.array(numbers[:, i]) for i in range(6)] + [pa.array(digests)]
            yield pa.RecordBatch.from_arrays(columns, [*keys, *NUMBERS, "n_best", "count_sum", "groups_sha256"])

    schema = ("row BIGINT, " if "row" in keys else "") + ROW
    return documents.select(*keys, "text").mapInArrow(align, schema)


def aligned_tokens(
    documents: DataFrame, byte_level: str = DEFAULT_BYTE_LEVEL, pieces: str = DEFAULT_MODEL,
    shard_pairs: int = SHARD_PAIRS, round_pairs: int = ROUND_PAIRS,
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each document.

    The text with a space in front is encoded by both vocabularies. Both cut it into the same bytes;
    where tokens of both end, a group ends. A link is an occurrence of a token of either that share
    bytes; the count of a pair of ids is the number of its links in all documents. ``n_best`` counts
    links whose pair has the highest count of its second id, ties included, ``count_sum`` adds the
    counts over the links. ``groups_sha256`` is the digest of the groups' ids as text.

    A text that is null or empty, is no valid UTF-8, or comes back changed from either vocabulary has
    zeros and an empty digest, and adds to no count. Rows that repeat a document count as often as
    they occur; other columns are ignored; an empty table gives no rows. Counts of at most
    ``round_pairs`` pairs are sent to the tasks at a time: beyond that, the documents are passed over
    once for each part of the pairs, and the parts' sums are added.
    """
    plain = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    partials = partial_counts(plain, byte_level, pieces)
    functions, shards = hashed_shards(partials, shard_pairs)
    rounds: list[list[int]] = []
    room = 0
    for r in functions.select("shard", "n").orderBy("shard").collect():
        if not rounds or room + r["n"] > round_pairs:
            rounds.append([])
            room = 0
        rounds[-1].append(r["shard"])
        room += r["n"]

    def function(own: list[int]) -> PerfectHash:
        rows = functions.filter(F.col("shard").between(own[0], own[-1])).orderBy("shard").collect()
        return PerfectHash.of(rows, shards)

    # the second vocabulary bounds this vector
    best = np.zeros(len(tokenizers(byte_level, pieces).b_bytes), np.int64)
    held = None
    counted: list[DataFrame] = []
    for own in rounds:
        held = function(own)
        counts = summed_counts(partials, held)
        np.maximum.at(best, held.pairs & 0xFFFFFFFF, counts)
        counted.append(counts if len(rounds) == 1 else _stored(plain, counts))
    if len(rounds) <= 1:
        table = Counts(held, counted[0], best) if rounds else None
        return _aligned(plain, ["doc_id"], table, byte_level, pieces)
    rows = numbered(plain, "aligned-documents")
    parts = None
    for own, stored in zip(rounds, counted, strict=True):
        counts = np.frombuffer(b"".join(bytes(r["counts"]) for r in stored.orderBy("segment").collect()), np.int64)
        part = saved(_aligned(rows, ["row", "doc_id"], Counts(function(own), counts, best), byte_level, pieces), "aligned-part")
        parts = part if parts is None else parts.unionByName(part)
    same = [F.any_value(c).alias(c) for c in ["doc_id", *NUMBERS, "groups_sha256"]]
    added = parts.groupBy("row").agg(*same, F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return added.select("doc_id", *NUMBERS, "n_best", "count_sum", "groups_sha256")


def _stored(documents: DataFrame, counts: np.ndarray) -> DataFrame:
    """A round's counts in the shared folder until its pass over the documents."""
    parts = [(i, counts[s : s + SEGMENT].tobytes()) for i, s in enumerate(range(0, len(counts), SEGMENT))]
    return saved(documents.sparkSession.createDataFrame(parts, "segment BIGINT, counts BINARY"), "round-counts")
