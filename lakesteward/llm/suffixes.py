"""Removal of repeated byte strings by a logarithmic family of sparse suffix arrays.

Only strings of ``LENGTH`` bytes matter, so suffixes are told apart by that many bytes, and only
some suffixes are kept: of every LENGTH-byte window, the one whose first ``GRAM`` bytes have the
smallest fingerprint (the leftmost of equal ones). Equal windows choose equal suffixes, whatever
stands around them. An entry is the fingerprint, the document, and the run of window starts that
chose the suffix. A level is a table of entries sorted by fingerprint, and so by suffix up to GRAM
bytes.

A batch becomes a level of size one. While the family has a level of the same size, the two are
merged, which scans them side by side, and the double size goes on; larger levels are scanned and
stay. A scan marks the entries, old or new, whose suffix also starts elsewhere: candidates.

For candidates, the windows that chose them travel with the fingerprint, as one stretch of bytes;
tasks sort the window starts of a fingerprint by a fingerprint of all LENGTH bytes, a suffix array
to the depth that matters, and equal neighbours are repeats. Fingerprints of 64 bits are compared
under equal fingerprints of the first GRAM bytes only. A fingerprint with very many stretches is
instead counted window by window, in aggregations that combine within tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesteward.llm.common import key_runs, list_array, numbered, saved, text_column, text_slices
from lakesteward.llm.words import Powers, mixed

LENGTH, GRAM = 200, 32
REACH = LENGTH - GRAM + 1
BATCHES = 2
#: stretches of one fingerprint that a task takes at once
HOT_STRETCHES = 20_000
#: a run of window starts is packed as start * RUN + length
RUN = 512


class Fingerprints:
    """Fingerprints of byte ranges of one array."""

    def __init__(self, data: np.ndarray, powers: Powers) -> None:
        n = len(data)
        powers.grow(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers.up[:n], out=self.sums[1:])
        self.down = powers.down

    def of(self, starts: np.ndarray, length: int) -> np.ndarray:
        return mixed((self.sums[starts + length] - self.sums[starts]) * self.down[starts])

    def every(self, length: int) -> np.ndarray:
        n = max(len(self.sums) - length, 0)
        return mixed((self.sums[length:] - self.sums[:n]) * self.down[:n])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from block-wise minima in both directions."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def chosen_suffixes(data: np.ndarray, offsets: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint and packed run of window starts (from the text's begin) per chosen suffix, and how many each text has."""
    counts = np.zeros(len(offsets) - 1, np.int64)
    if len(data) < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), counts
    grams = Fingerprints(data, powers).every(GRAM)
    # the place below the fingerprint's upper half makes the leftmost of equal ones the smallest
    least = sliding_least((grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64), REACH)
    owner = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edge = np.zeros(len(data) + 1, np.int64)
    long = np.diff(offsets) >= LENGTH
    edge[offsets[:-1][long]] += 1
    edge[offsets[1:][long] - LENGTH + 1] -= 1
    starts = np.flatnonzero(np.cumsum(edge)[: len(owner)] > 0)
    own = owner[starts]
    head = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    runs = np.diff(np.r_[head, len(own)])
    text = np.searchsorted(offsets, starts[head], "right") - 1
    counts = np.bincount(text, minlength=len(counts))
    return grams[own[head]], (starts[head] - offsets[text]) * RUN + runs, counts


def documents_table(docs: DataFrame) -> DataFrame:
    """One stored row per document: doc_id, text_key, sha, n_bytes and its chosen suffixes (keys, runs)."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for low, high, data, offsets in text_slices(batch["text"]):
                keys, runs, counts = chosen_suffixes(data, offsets, powers)
                yield pa.RecordBatch.from_arrays(
                    [batch[c].slice(low, high - low) for c in ("doc_id", "text_key", "sha", "n_bytes")]
                    + [list_array(keys.view(np.int64), counts, pa.int64()), list_array(runs, counts, pa.int64())],
                    ["doc_id", "text_key", "sha", "n_bytes", "keys", "runs"],
                )

    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.unhex(F.sha2(text_column().cast("binary"), 256)).alias("sha"),
        F.octet_length(text_column()).cast("bigint").alias("n_bytes"), text_column().alias("text"),
    )
    schema = "doc_id BIGINT, text_key BIGINT, sha BINARY, n_bytes BIGINT, keys ARRAY<BIGINT>, runs ARRAY<BIGINT>"
    return numbered(texts.mapInArrow(choose, schema), "suffix-documents")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mark entries whose key occurs again, in batches sorted by key; only each batch's last key is held back."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        # without the schema's nullability, which the entry held back need not share
        table = pa.Table.from_arrays(batch.columns, names=batch.schema.names)
        table = table if held is None else pa.concat_tables([held, table])
        keys = table["key"].to_numpy()
        # two entries of the last key are enough to know that the next one repeats it
        same = np.r_[keys[1:] == keys[:-1], False]
        again = same | np.r_[False, same[:-1]]
        ready = table.num_rows - 1
        yield _marked(table.slice(0, ready), again[:ready])
        held = table.slice(ready).combine_chunks()
        if again[-1]:
            held = held.set_column(held.schema.get_field_index("repeated"), "repeated", pa.chunked_array([[True]]))
    if held is not None:
        yield _marked(held, np.zeros(1, bool))


def _marked(table: pa.Table, again: np.ndarray) -> pa.RecordBatch:
    columns = [table[c].combine_chunks() for c in ("key", "row", "run", "age")]
    columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
    repeated = again | table["repeated"].to_numpy()
    return pa.RecordBatch.from_arrays([*columns, pa.array(repeated)], ["key", "row", "run", "age", "repeated"])


class SuffixFamily:
    """Levels of sorted entries (key, row, run, age, repeated), the sizes of all of them different powers of two."""

    def __init__(self) -> None:
        self.levels: dict[int, DataFrame] = {}

    @staticmethod
    def scanned(entries: DataFrame) -> DataFrame:
        """A stored level of the entries, sorted by key, with the repeated ones marked."""
        dealt = entries.repartition("key").sortWithinPartitions("key", "row", "run")
        return saved(dealt.mapInArrow(_scan, "key BIGINT, row BIGINT, run BIGINT, age INT, repeated BOOLEAN"), "suffix-level")

    def add(self, batch: DataFrame) -> DataFrame:
        """Take in a batch of entries (key, row, run); give the entries (key, row, run) that repeat because of it or within it."""
        size, merged = 1, batch.withColumns({"age": F.lit(0), "repeated": F.lit(False)})
        while size in self.levels:
            older = self.levels.pop(size)
            merged = merged.unionByName(older)
            size *= 2
        merged = self.scanned(merged)
        found = merged.filter("repeated").select("key", "row", "run")
        for level in self.levels.values():
            both = self.scanned(merged.withColumn("age", F.lit(1)).unionByName(level.withColumn("age", F.lit(0))))
            found = found.unionByName(both.filter("repeated").select("key", "row", "run"))
        self.levels[size] = merged
        return found


def candidates(table: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Entries (key, row, run) of the stored documents whose suffix also starts elsewhere, stored.

    Documents with equal texts are one document here, the one with the smallest row.
    """
    first = table.groupBy("sha").agg(F.min("row").alias("least"), F.count("*").alias("n")).filter("n > 1")
    copies = table.select("row", "sha").join(first, "sha").filter("row > least").select("row")
    single = table.join(saved(copies, "suffix-copies"), "row", "left_anti").filter(F.size("keys") > 0)
    entries = single.select("row", F.explode(F.arrays_zip("keys", "runs")).alias("e")).select(F.col("e.keys").alias("key"), "row", F.col("e.runs").alias("run"))
    family, found = SuffixFamily(), None
    for b in range(batches):
        part = family.add(entries.filter(F.pmod(F.xxhash64("row"), F.lit(batches)) == b))
        found = part if found is None else found.unionByName(part)
    # with one level left, its marks are all there are
    last = list(family.levels.values())
    return last[0].filter("repeated").select("key", "row", "run") if len(last) == 1 else saved(found.distinct(), "suffix-candidates")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate entries of each text with the bytes of their windows, once per text; ``times`` they occur in it.

    A further occurrence of the same stretch has no bytes: its windows are repeats for certain.
    """
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
    names = ["key", "row", "run", "stretch", "twice"]
    for batch in batches:
        out: list[tuple] = []
        for text, row, found in zip(batch["text"].cast(pa.binary()), batch["row"].to_pylist(), batch["found"].to_pylist(), strict=True):
            content, seen = text.as_py(), {}
            for e in found:
                start, length = divmod(e["run"], RUN)
                piece = content[start : start + length + LENGTH - 1]
                if (e["key"], piece) in seen:
                    seen[e["key"], piece][4] = True
                    out.append((e["key"], row, e["run"], None, True))
                else:
                    seen[e["key"], piece] = entry = [e["key"], row, e["run"], piece, False]
                    out.append(entry)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)


def _window_starts(pieces: list[bytes], runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pieces in one array, the windows' starts in it, and the piece of each."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    begin = np.r_[0, np.cumsum(sizes)]
    lengths = runs % RUN
    ends = np.cumsum(lengths)
    piece = np.repeat(np.arange(len(pieces)), lengths)
    starts = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin[:-1] - (ends - lengths), lengths)
    return np.frombuffer(b"".join(pieces), np.uint8), starts, piece


def _ranges(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of the bytes covered by repeated windows at ``start``; the input is sorted by row and start."""
    head = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (start[1:] > start[:-1] + LENGTH)]) if len(row) else np.zeros(0, np.int64)
    last = np.r_[head[1:], len(row)] - 1 if len(row) else head
    return row[head], start[head], start[last] + LENGTH


RANGES = "row BIGINT, start BIGINT, stop BIGINT"


def _repeated_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte ranges covered by repeated windows, out of stretches sorted by key."""
    powers = Powers()
    for table in key_runs(batches, "key", 4000):
        key, row, run, twice = (table[c].to_numpy() for c in ("key", "row", "run", "twice"))
        column = table["stretch"].combine_chunks()
        full = column.is_valid().to_numpy(zero_copy_only=False)
        pieces = [p for p in column.to_pylist() if p is not None]
        found_row, found_start = [row[~full]], [run[~full]]
        key, row, run, twice = key[full], row[full], run[full], twice[full]
        data, starts, piece = _window_starts(pieces, run)
        prints = Fingerprints(data, powers).of(starts, LENGTH) ^ mixed(key.view(np.uint64))[piece]
        # the windows in order of their fingerprints: equal neighbours are equal windows
        order = np.argsort(prints, kind="stable")
        same = prints[order][1:] == prints[order][:-1]
        again = np.zeros(len(prints), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        again |= twice[piece]
        first = np.cumsum(run % RUN) - run % RUN
        inside = np.arange(len(starts)) - first[piece]
        at = np.flatnonzero(again)
        rows, place = row[piece[at]], run[piece[at]] // RUN + inside[at]
        # stretches without bytes are repeated from their first to their last window
        whole_row, whole_run = found_row[0], found_start[0]
        lengths = whole_run % RUN
        rows = np.r_[rows, np.repeat(whole_row, lengths)]
        ends = np.cumsum(lengths)
        place = np.r_[place, np.repeat(whole_run // RUN - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
        order = np.lexsort((place, rows))
        columns = _ranges(rows[order], place[order])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "start", "stop"])


def _hot_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per window of stretches of hot keys: key, print, row, start, certain."""
    powers = Powers()
    for batch in batches:
        for low in range(0, batch.num_rows, 2000):
            part = batch.slice(low, 2000)
            key, row, run, twice = (part[c].to_numpy(zero_copy_only=False) for c in ("key", "row", "run", "twice"))
            pieces = [p or b"" for p in part["stretch"].to_pylist()]
            sure = np.array([not p for p in pieces])
            # a stretch without bytes stands for windows that are sure; they need no print of their own
            pieces = [p or bytes(int(r % RUN) + LENGTH - 1) for p, r in zip(pieces, run.tolist(), strict=True)]
            data, starts, piece = _window_starts(pieces, run)
            prints = Fingerprints(data, powers).of(starts, LENGTH)
            first = np.cumsum(run % RUN) - run % RUN
            place = run[piece] // RUN + np.arange(len(starts)) - first[piece]
            certain = (twice | sure)[piece]
            prints = np.where(sure[piece], mixed(row[piece].view(np.uint64) ^ place.view(np.uint64)), prints)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[piece]), pa.array(prints.view(np.int64)), pa.array(row[piece]), pa.array(place), pa.array(certain)],
                ["key", "print", "row", "start", "certain"],
            )


def repeated_ranges(stretches: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Byte ranges (row, start, stop) covered by repeated windows; ``hot`` holds the keys with too many stretches."""
    usual = stretches if hot is None else stretches.join(hot, "key", "left_anti")
    dealt = usual.repartition("key").sortWithinPartitions("key")
    found = dealt.mapInArrow(_repeated_ranges, RANGES)
    if hot is None:
        return found
    windows = stretches.join(hot, "key", "left_semi").mapInArrow(_hot_windows, "key BIGINT, print BIGINT, row BIGINT, start BIGINT, certain BOOLEAN")
    windows = saved(windows, "hot-windows")
    again = windows.groupBy("key", "print").agg(F.count("*").alias("n"), F.max("certain").alias("sure")).filter("n > 1 OR sure")
    hit = windows.join(again, ["key", "print"], "left_semi")
    return found.unionByName(hit.select("row", "start", (F.col("start") + LENGTH).alias("stop")))


def merged_spans(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of half-open ranges."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(ranges):
        if out and start <= out[-1][1]:
            if stop > out[-1][1]:
                out[-1] = (out[-1][0], stop)
        else:
            out.append((start, stop))
    return out


def _cut(keep: bool):
    """Measures of texts without their repeated ranges, and with ``keep`` what is left, less characters that were cut apart."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, text, ranges in zip(batch["row"].to_pylist(), batch["text"].cast(pa.binary()), batch["ranges"].to_pylist(), strict=True):
                content, spans = text.as_py(), merged_spans([(r["start"], r["stop"]) for r in ranges])
                ends = [0, *(x for span in spans for x in span), len(content)]
                kept = b"".join(content[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                rows.append((row, len(content) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if keep else None))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["row", "n_removed", "n_spans", "kept_sha256", "kept"])

    return cut


def removals(docs: DataFrame, batches: int, hot_stretches: int, keep: bool) -> tuple[DataFrame, DataFrame]:
    """The stored documents, and of those that lose bytes: row, n_removed, n_spans, kept_sha256, and kept with ``keep``.

    A text that several documents have is looked at once, and as if only one had it.
    """
    table = documents_table(docs)
    found = candidates(table, batches)
    counts = found.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot_stretches).select("key")
    hot = saved(counts, "suffix-hot")
    hot = None if hot.isEmpty() else hot
    wanted = found.groupBy("row").agg(F.collect_list(F.struct("key", "run")).alias("found"))
    wanted = wanted.join(table.select("row", "doc_id", "text_key"), "row")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("hashed"), text_column().alias("text"))
    # the same plan at every size, whether or not the wanted rows would fit a broadcast
    matched = texts.join(wanted.hint("merge"), texts["id"].eqNullSafe(wanted["doc_id"]) & (texts["hashed"] == wanted["text_key"]))
    matched = saved(matched.select("row", "text", "found"), "suffix-texts")
    stretches = matched.mapInArrow(_stretches, "key BIGINT, row BIGINT, run BIGINT, stretch BINARY, twice BOOLEAN")
    ranges = repeated_ranges(stretches if hot is None else saved(stretches, "suffix-stretches"), hot)
    by_row = ranges.groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    # rows that repeat id and text come once
    hit = matched.select("row", "text").join(by_row.hint("merge"), "row").dropDuplicates(["row"])
    return table, saved(hit.mapInArrow(_cut(keep), "row BIGINT, n_removed BIGINT, n_spans BIGINT, kept_sha256 STRING, kept STRING"), "suffix-cut")


def repeat_removal(docs: DataFrame, batches: int = BATCHES, hot_stretches: int = HOT_STRETCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document.

    Every byte goes that a 200-byte string covers which also starts elsewhere in ``docs``, the same
    document included. A null text has no bytes; a text under 200 bytes keeps all; one of 200 or more
    that occurs twice as a whole, in rows that repeat each other as well, loses all; a null doc_id
    is a document like any other; other columns are ignored.
    """
    table, cut = removals(docs, batches, hot_stretches, keep=False)
    times = table.groupBy("sha").agg(F.count("*").alias("times"))
    rows = table.select("row", "doc_id", "sha", "n_bytes").join(times, "sha").join(cut.select("row", "n_removed", "n_spans", "kept_sha256"), "row", "left")
    gone = (F.col("times") > 1) & (F.col("n_bytes") >= LENGTH)
    return rows.select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, batches: int = BATCHES, hot_stretches: int = HOT_STRETCHES) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``; the bytes of a character that was cut apart go too.

    ``n_chars``, where there is one, becomes that of the text that is left. All rows stay, those
    without any text left as well.
    """
    table, cut = removals(docs, batches, hot_stretches, keep=True)
    times = table.groupBy("sha").agg(F.count("*").alias("times")).filter("times > 1")
    several = table.filter(F.col("n_bytes") >= LENGTH).join(times, "sha", "left_semi")
    gone = several.select(F.col("doc_id").alias("cut_id"), F.col("text_key").alias("cut_key"), F.lit("").alias("kept"))
    changed = cut.join(table.select("row", "doc_id", "text_key"), "row").select(F.col("doc_id").alias("cut_id"), F.col("text_key").alias("cut_key"), "kept")
    changes = gone.unionByName(changed.join(gone.select("cut_key"), "cut_key", "left_anti"))
    changes = saved(changes.dropDuplicates(["cut_id", "cut_key"]), "suffix-changes")
    match = docs["doc_id"].cast("bigint").eqNullSafe(changes["cut_id"]) & (F.xxhash64(docs["text"]) == changes["cut_key"])
    left = docs.join(changes.hint("merge"), match, "left")
    new = {"text": F.coalesce(changes["kept"], docs["text"])}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(changes["kept"].isNotNull(), F.char_length(changes["kept"]).cast(kind)).otherwise(docs["n_chars"])
    return left.select(*(new[c].alias(c) if c in new else docs[c] for c in docs.columns))
