"""Token counts by dynamic programming over a trie of the distinct pre-tokens.

A task inserts each distinct pre-token of its texts into a trie once. A node stands for a prefix
and holds the best unigram score of a segmentation of the prefix, and the number of its tokens; both
depend on the prefix alone, so pre-tokens with a common prefix share them. The node at the end of a
pre-token is its terminal count, and a text's count is the sum over its pre-tokens. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesteward.llm.common import text_column, text_slices
from lakesteward.llm.pieces import DEFAULT_MODEL, PreTokens, Terminals, Vocabulary, load_vocabulary, pieces_ending
from lakesteward.llm.words import Powers

#: nodes of a task's trie; a larger one is begun anew
MOST_NODES = 500_000
#: a character without a piece costs this much more than the worst piece
UNKNOWN_COST = 10.0


class CountTrie:
    """Trie with best score and token count of every prefix."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.unknown = min(vocabulary.scores.values(), default=0.0) - UNKNOWN_COST
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.score, self.count = [0.0], [0]

    def insert(self, text: str) -> int:
        """The number of tokens of the best segmentation; of equally good ones, the fewest."""
        path = [0]
        children, score, count, scores = self.children, self.score, self.count, self.vocabulary.scores
        for end, character in enumerate(text, 1):
            key = path[-1] << 21 | ord(character)
            node = children.get(key)
            if node is None:
                best, fewest = -np.inf, 0
                for start, piece in pieces_ending(self.vocabulary, text, end):
                    before = path[start]
                    if piece < 0:
                        gain, tokens = self.unknown, len(character.encode("utf-8", "surrogateescape"))
                    else:
                        gain, tokens = scores[piece], 1
                    total, used = score[before] + gain, count[before] + tokens
                    if total > best or (total == best and used < fewest):
                        best, fewest = total, used
                node = children[key] = len(score)
                score.append(best)
                count.append(fewest)
            path.append(node)
        return count[path[-1]]


def token_counts(docs: DataFrame, model_path: str = DEFAULT_MODEL, most_nodes: int = MOST_NODES) -> DataFrame:
    """doc_id, n_tokens, n_pretokens for every row of ``docs``.

    The model file is read on the driver. A null or empty text has no tokens; repeated rows are
    counted each; a null doc_id stays null; other columns are ignored.
    """
    vocabulary = load_vocabulary(model_path)
    joined = vocabulary.joined

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, trie, terminals = Powers(), CountTrie(vocabulary), Terminals(most_nodes)
        for batch in batches:
            for low, high, data, offsets in text_slices(batch["text"]):
                tokens = PreTokens(data, offsets, joined, powers)
                counts = np.r_[0, np.cumsum(terminals.look_up(tokens, trie.insert))]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(low, high - low), pa.array(counts[tokens.first[1:]] - counts[tokens.first[:-1]]), pa.array(np.diff(tokens.first))],
                    ["doc_id", "n_tokens", "n_pretokens"],
                )
                if len(trie.score) > most_nodes:
                    trie.clear()
                    terminals.clear()

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_column().alias("text"))
    return texts.mapInArrow(count, "doc_id BIGINT, n_tokens BIGINT, n_pretokens BIGINT")
