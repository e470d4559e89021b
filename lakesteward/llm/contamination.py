"""Benchmark passages in training documents: n-gram seeds, then Smith-Waterman alignment.

All word n-grams of an item are its seeds, however many documents hold them: an edited or partial
copy that is itself widespread may keep none that is rare. Of a document's items by its seeds, those
of whose words it holds too few for the threshold are left out at once, which no alignment can
outdo; so an n-gram that many items and documents share costs little. Every remaining place where a
document holds a seed is aligned, word by word, with the item around it; the local alignment's score
over the item's length tells exact, edited and paraphrased copies from chance. A copy that keeps no
n-gram of the item is not seen: with three words, one that has an insertion at every second word.

Words are compared in lower case and without punctuation marks, on both sides; a word of marks alone
is none, and places count the others. The items are taken in blocks of bounded size, each sent to the
tasks for one pass over the documents. No text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesteward.functions.names import spare_names
from lakesteward.llm.common import text_column, text_slices
from lakesteward.llm.words import Powers, Words

N = 3
#: local alignment score (1 a match, -1 a mismatch or gap) over the item's words
THRESHOLD = 0.5
#: an item needs this many words, and an alignment at least this score, to be evidence of a leak
LEAST_SCORE = 6
BLOCK_BYTES = 4 << 20

#: marks that words are compared without
MARKS = ".,;:!?\"'()[]{}<>*#$%&|"

HITS = "doc_id BIGINT, item_id BIGINT, score DOUBLE, first_word INT, last_word INT, points INT"


def plain_text(name: str = "text") -> Column:
    """The text in lower case, in any script, and without marks; null as empty."""
    return F.translate(F.lower(text_column(name)), MARKS, "")


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local score, and the first and last passage word of that alignment (the leftmost end on a tie)."""
    width = len(passage)
    steps = np.arange(width + 1)
    above, began = np.zeros(width + 1, np.int64), steps.copy()
    best, at, origin = 0, 0, 0
    for word in item:
        gain = np.where(passage == word, 1, -1)
        here = np.zeros(width + 1, np.int64)
        start = steps.copy()
        diagonal, up = above[:-1] + gain, above[1:] - 1
        step = np.where(diagonal >= up, diagonal, up)
        here[1:] = np.maximum(step, 0)
        start[1:] = np.where(step > 0, np.where(diagonal >= up, began[:-1], began[1:]), steps[1:])
        # gaps along the passage: the best earlier cell less its distance
        lifted = np.maximum.accumulate(here + steps)
        source = np.maximum.accumulate(np.where(here + steps == lifted, steps, 0))
        start = start[source]
        here = lifted - steps
        top = int(here.argmax())
        if here[top] > best:
            best, at, origin = int(here[top]), top, int(start[top])
        above, began = here, start
    return best, origin, max(at - 1, 0)


def _spans(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All places of the ranges [begin, end), one range after the other."""
    counts = end - begin
    return np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


class Block:
    """Items of one block, their n-grams and their words, as arrays that tasks search."""

    def __init__(self, ids: list[int], texts: list[str], n: int) -> None:
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        offsets = np.r_[0, np.cumsum([len(t.encode()) for t in texts])].astype(np.int64)
        words = Words(data, offsets, Powers())
        grams, first = words.shingles(n)
        held = np.flatnonzero(np.diff(words.first) >= max(LEAST_SCORE, n))
        self.ids = [ids[k] for k in held.tolist()]
        self.words = [words.hashes[words.first[k] : words.first[k + 1]] for k in held.tolist()]
        lengths = np.diff(first)[held]
        gram, item = grams[_spans(first[held], first[held + 1])], np.repeat(np.arange(len(held)), lengths)
        place = np.arange(len(gram)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        # sorted by n-gram, then item, then place
        order = np.argsort(gram, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, begin = np.unique(gram[order], return_index=True)
        self.begin = np.r_[begin, len(gram)]
        # an item's entries, as the n-grams are sorted
        self.order, self.gram_first = np.argsort(self.item, kind="stable"), np.r_[0, np.cumsum(lengths)]
        self.first = np.r_[0, np.cumsum([len(w) for w in self.words])].astype(np.int64)
        self.vocabulary, self.word = np.unique(np.concatenate(self.words) if self.words else np.zeros(0, np.uint64), return_inverse=True)

    def candidates(self, seeds: np.ndarray, own: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Items with one of the seeds, of whose words the text holds as many as are needed."""
        items = np.unique(self.item[_spans(self.begin[seeds], self.begin[seeds + 1])])
        at = np.minimum(np.searchsorted(self.vocabulary, own), len(self.vocabulary) - 1)
        held = np.zeros(len(self.vocabulary), bool)
        held[at[self.vocabulary[at] == own]] = True
        held = held[self.word[_spans(self.first[items], self.first[items + 1])]]
        lengths = self.first[items + 1] - self.first[items]
        return items[np.add.reduceat(held.astype(np.int64), np.cumsum(lengths) - lengths) >= need[items]]

    def starts(self, item: int, seeds: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Where the item would begin in a text, by the text's seeds and their places."""
        own = self.order[self.gram_first[item] : self.gram_first[item + 1]]
        keys = np.searchsorted(self.begin, own, "right") - 1
        low, high = np.searchsorted(keys, seeds), np.searchsorted(keys, seeds, "right")
        return np.unique(np.repeat(places, high - low) - self.place[own[_spans(low, high)]])


def _member(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are among the sorted keys, by a table of 2**20 bits first."""
    if not len(keys):
        return np.zeros(len(values), bool)
    table = np.zeros(1 << 20, bool)
    table[(keys >> np.uint64(44)).astype(np.int64)] = True
    found = table[(values >> np.uint64(44)).astype(np.int64)]
    at = np.flatnonzero(found)
    spot = np.minimum(np.searchsorted(keys, values[at]), len(keys) - 1)
    found[at] = keys[spot] == values[at]
    return found


def _windows(starts: np.ndarray, m: int, words: int) -> list[tuple[int, int]]:
    """Passages around the sorted places where the item would begin, overlapping ones joined."""
    margin = m // 2 + 2
    out: list[tuple[int, int]] = []
    for s in starts.tolist():
        low, high = max(0, s - margin), min(words, s + m + margin)
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _aligned(texts: pa.Array, block: Block, n: int, threshold: float, powers: Powers) -> Iterator[tuple[int, int, int, int, int]]:
    """Of each text of a batch with each item that it holds: row, item, score, first and last word."""
    need = np.maximum(threshold * np.diff(block.first), LEAST_SCORE)
    for low, _, data, offsets in text_slices(texts):
        words = Words(data, offsets, powers)
        grams, first = words.shingles(n)
        at = np.flatnonzero(_member(block.keys, grams))
        seed = np.searchsorted(block.keys, grams[at])
        cuts = np.searchsorted(at, first)
        for d in np.flatnonzero(np.diff(cuts)).tolist():
            own = words.hashes[words.first[d] : words.first[d + 1]]
            seeds, places = seed[cuts[d] : cuts[d + 1]], at[cuts[d] : cuts[d + 1]] - first[d]
            items = block.candidates(np.unique(seeds), own, need)
            for item in items.tolist():
                target = block.words[item]
                m = len(target)
                best = (0, 0, 0)
                for a, b in _windows(block.starts(item, seeds, places), m, len(own)):
                    # no alignment scores more than the words that both sides hold
                    if int(np.isin(target, own[a:b]).sum()) < need[item]:
                        continue
                    score, x, y = smith_waterman(target, own[a:b])
                    if score > best[0]:
                        best = (score, a + x, a + y)
                if best[0] >= need[item]:
                    yield (low + d, item, *best)


def block_hits(texts: DataFrame, block: Block, n: int, threshold: float) -> DataFrame:
    """Best alignment of each document with each item of the block, where it reaches the threshold."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            rows = [
                (ids[d], block.ids[i], score / len(block.words[i]), x, y, score)
                for d, i, score, x, y in _aligned(batch["text"], block, n, threshold, powers)
            ]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
            names = [c.split()[0] for c in HITS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return texts.mapInArrow(align, HITS)


def without_hits(docs: DataFrame, block: Block, n: int, threshold: float) -> DataFrame:
    """The rows of ``docs`` that hold no item of the block."""

    names = docs.columns
    (plain,) = spare_names(names, "plain")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            kept = np.ones(batch.num_rows, bool)
            for d, *_ in _aligned(batch[plain], block, n, threshold, powers):
                kept[d] = False
            yield pa.RecordBatch.from_arrays([batch[c] for c in names], names).filter(pa.array(kept))

    return docs.withColumn(plain, plain_text()).mapInArrow(clean, docs.schema)


def item_blocks(items: DataFrame, n: int, block_bytes: int) -> Iterator[Block]:
    """The items, a bounded number of bytes at a time; a longer item is a block of its own."""
    ids: list[int] = []
    texts: list[str] = []
    held = 0
    rows = items.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint"), plain_text())
    for item_id, text in rows.distinct().toLocalIterator():
        ids.append(item_id)
        texts.append(text)
        held += len(text)
        if held >= block_bytes:
            yield Block(ids, texts, n)
            ids, texts, held = [], [], 0
    if ids:
        yield Block(ids, texts, n)


def leaks(docs: DataFrame, items: DataFrame, n: int = N, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents that hold an item: doc_id, item_id, score, first_word, last_word, points.

    One row per document row and item, its best alignment: ``points`` is its score, ``score`` that
    over the item's words. Items of fewer than ``LEAST_SCORE`` words are no evidence and are left
    out, as are those without id or text. A null text holds nothing; repeated rows are reported
    each; other columns are ignored; without items, no rows.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), plain_text().alias("text"))
    found = None
    for block in item_blocks(items, n, block_bytes):
        hits = block_hits(texts, block, n, threshold)
        found = hits if found is None else found.unionByName(hits)
    return docs.sparkSession.createDataFrame([], HITS) if found is None else found


def decontaminated(docs: DataFrame, items: DataFrame, n: int = N, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns, each row judged by itself."""
    clean = docs
    for block in item_blocks(items, n, block_bytes):
        clean = without_hits(clean, block, n, threshold)
    return clean
