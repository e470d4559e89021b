"""Quality from compressed size: one zstandard dictionary per label, one calibrated score.

A text that resembles the good training texts gets smaller under the dictionary built from them,
one that resembles the bad ones under theirs. The difference of the two sizes, over the text's
length and over their sum, is the signal; the sizes over the length, without a dictionary too, say
how much of it to believe in a text that repeats itself. A logistic curve over these, fitted on
labelled texts that no dictionary holds, turns them into a probability of the good label.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesteward.functions.names import spare_names
from lakesteward.llm.common import text_column

#: bound of what training takes from the labelled rows: rows per label, and bytes of their texts per label
SAMPLE_ROWS = 2000
SAMPLE_BYTES = 16 << 20
DICTIONARY_BYTES = 512 << 10
LEVEL = 3
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id's text divisible by 5; so is a null id."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


@dataclass(frozen=True)
class Model:
    """Dictionaries (empty: none), and a logistic curve over scaled features; without weights, 0.5."""

    good: bytes = b""
    bad: bytes = b""
    centre: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()

    def score(self, features: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(features), 0.5)
        scaled = (features - np.array(self.centre)) / np.array(self.scale)
        return 1 / (1 + np.exp(-np.clip(scaled @ np.array(self.weights[:-1]) + self.weights[-1], -60, 60)))


def dictionary(texts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Whole texts, as they come, as long as they fit."""
    chosen, held = [], 0
    for text in texts:
        if text and held + len(text) <= size:
            chosen.append(text)
            held += len(text) + 1
    return b"\n".join(chosen)


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    if not content:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    ready = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    ready.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=ready, write_content_size=False, write_dict_id=False)


def features(texts: Iterable[bytes], good: bytes, bad: bytes) -> np.ndarray:
    """Per text: size difference over length and over the sizes' sum, the three sizes over length, log length."""
    machines = [_compressor(good), _compressor(bad), _compressor(b"")]
    rows = [(*(len(m.compress(t)) for m in machines), len(t) + 1) for t in texts]
    g, b, plain, n = np.array(rows, float).reshape(-1, 4).T
    return np.column_stack([(b - g) / n, (b - g) / (b + g), g / n, b / n, plain / n, np.log(n)])


def logistic_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Weights and, last, offset by Newton steps on the weighted log-likelihood with a small ridge."""
    design, weight = np.c_[x, np.ones(len(x))], weight / weight.sum()
    beta = np.zeros(design.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -60, 60)))
        slope = design.T @ (weight * (p - y)) + ridge * beta
        bend = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(beta))
        step = np.linalg.solve(bend, slope)
        step *= min(1.0, 5 / max(1e-12, float(np.abs(step).max())))
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, most_bytes: int) -> tuple[list[tuple[bytes, int]], dict[int, int]]:
    """Texts and labels of a bounded sample of the training rows, in an order of its own, and rows per label.

    The rows with the smallest hash of their id are taken, ``rows`` per label at most and as long as
    their texts stay within ``most_bytes``. A null label or id, one that is neither 0 nor 1, and
    documents labelled both ways take no part.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("y_most")).filter("y = y_most").select("doc_id", "y")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    chosen = [known.filter(F.col("y") == y).orderBy(order, "doc_id").limit(rows) for y in (0, 1)]
    ids = {r["doc_id"]: r["y"] for c in chosen for r in c.collect()}
    # at most twice ``rows`` ids
    few = F.broadcast(docs.sparkSession.createDataFrame(list(ids.items()), "doc_id BIGINT, y INT"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_column().alias("text")).join(few, "doc_id")
    sizes = texts.select("doc_id", "y", F.octet_length("text").alias("n"), order.alias("h")).orderBy("h", "doc_id", "n").limit(4 * rows)
    spent, kept = {0: 0, 1: 0}, []
    for r in sizes.collect():
        spent[r["y"]] += r["n"]
        if spent[r["y"]] <= most_bytes:
            kept.append(r["doc_id"])
    few = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in set(kept)], "doc_id BIGINT"))
    found = texts.join(few, "doc_id").select("text", "y", order.alias("h")).limit(4 * rows).collect()
    found.sort(key=lambda r: (r["h"], r["text"]))
    return [(r["text"].encode(), r["y"]) for r in found], counts


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Build both dictionaries from half of a bounded sample and fit the curve on the other half.

    The sample has as many rows of either label as it can; weights give the labels their true shares.
    Without training rows of both labels nothing can be told apart and every score is 0.5.
    """
    sample, counts = labelled_sample(docs, labels, rows, most_bytes)
    by_label = {y: [t for t, label in sample if label == y] for y in (0, 1)}
    if min(map(len, by_label.values())) < 2:
        return Model()
    good, bad = dictionary(by_label[1][::2]), dictionary(by_label[0][::2])
    rest = [(t, y) for y in (0, 1) for t in by_label[y][1::2]]
    y = np.array([label for _, label in rest], float)
    share = {label: counts[label] / len(by_label[label][1::2]) for label in (0, 1)}
    x = features((t for t, _ in rest), good, bad)
    centre, scale = x.mean(0), x.std(0) + 1e-12
    beta = logistic_fit((x - centre) / scale, y, np.where(y == 1, share[1], share[0]))
    return Model(good, bad, tuple(centre.tolist()), tuple(scale.tolist()), tuple(beta.tolist()))


def scored(docs: DataFrame, model: Model, score_name: str = "score", predicted_name: str = "predicted") -> DataFrame:
    """``docs`` with a score and what it predicts, under these names; a null text is scored as the empty one."""
    names = docs.columns
    if {score_name, predicted_name} & set(names):
        raise ValueError(f"the input has a column {score_name} or {predicted_name}")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch["text"].cast(pa.large_binary())
            values = model.score(features((t.as_py() or b"" for t in text), model.good, model.bad))
            columns = [batch[c] for c in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(values, pa.float64()), pa.array(values >= THRESHOLD, pa.bool_()).cast(pa.int32())],
                [*names, score_name, predicted_name],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(score, f"{kinds}, `{score_name}` DOUBLE, `{predicted_name}` INT")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; only doc_id and text are read."""
    model = fit(docs, labels)
    found = scored(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier takes for good, with their columns; a score of ``THRESHOLD`` is enough."""
    names = spare_names(docs.columns, "score", "predicted")
    return scored(docs, fit(docs, labels), *names).filter(F.col(names[1]) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))
