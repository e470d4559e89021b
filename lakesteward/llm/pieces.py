"""Pre-tokens and the lattice of a piece vocabulary, as a trie that texts of a task share.

A text gets one space in front. A new pre-token begins wherever two neighbouring characters are
neighbours in no piece, as before a space that follows another character. No piece crosses such a
border, so pre-tokens can be segmented one by one. Spaces stand for the vocabulary's space mark, and the mark
itself, like every character without a piece, is written as its bytes, so nothing gets lost.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from lakesteward.llm.words import Powers, mixed

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces, with spaces for space marks, by id; the id of each byte's token."""

    ids: dict[str, int]
    scores: dict[int, float]
    byte_ids: list[int]
    #: every suffix of a piece; its id, or -1 if it is no piece itself
    suffixes: dict[str, int] = field(repr=False)

    @property
    def joined(self) -> np.ndarray:
        """Whether a byte follows a byte in some piece, at 256 * first + second; within a character it always does."""
        table = np.zeros(65536, bool)
        for piece in self.ids:
            b = np.frombuffer(piece.encode(), np.uint8).astype(np.int64)
            table[256 * b[:-1] + b[1:]] = True
        second = np.arange(65536) % 256
        return table | ((second >= 128) & (second < 192))


def load_vocabulary(path: str = DEFAULT_MODEL) -> Vocabulary:
    """Read the ordinary pieces of a SentencePiece model, and its byte tokens."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, scores, byte_ids = {}, {}, [-1] * 256
    for i in range(model.vocab_size()):
        if model.is_byte(i):
            byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            piece = model.id_to_piece(i).replace(MARK, " ")
            ids[piece], scores[i] = i, model.get_score(i)
    if -1 in byte_ids:
        raise ValueError("the model has no token for some byte")
    return Vocabulary(ids, scores, byte_ids, {p[i:]: ids.get(p[i:], -1) for p in ids for i in range(len(p))})


def pieces_ending(vocabulary: Vocabulary, text: str, end: int) -> list[tuple[int, int]]:
    """Start and id of every piece that ends at ``end``, shortest first; (end - 1, -1) if no piece is the last character."""
    found = []
    suffixes = vocabulary.suffixes
    start = end - 1
    while start >= 0 and (piece := suffixes.get(text[start:end])) is not None:
        if piece >= 0:
            found.append((start, piece))
        start -= 1
    if not found or found[0][0] != end - 1:
        found.insert(0, (end - 1, -1))
    return found


class PreTokens:
    """Pre-tokens of a slice of texts: ``data`` (with the spaces in front), ``starts``, ``ends``, ``first`` of each text, ``hashes``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, joined: np.ndarray, powers: Powers) -> None:
        lengths = np.diff(offsets)
        filled = lengths > 0
        self.offsets = offsets + np.r_[0, np.cumsum(filled)]
        n = int(self.offsets[-1])
        heads = self.offsets[:-1][filled]
        real = np.ones(n, bool)
        real[heads] = False
        self.data = np.full(n, 32, np.uint8)
        self.data[real] = data
        begin = np.ones(n, bool)
        begin[1:] = ~joined[self.data[:-1].astype(np.int64) * 256 + self.data[1:]]
        begin[heads] = True
        self.starts = np.flatnonzero(begin)
        self.ends = np.r_[self.starts[1:], n].astype(np.int64) if len(self.starts) else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.starts, self.offsets)
        powers.grow(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers.up[:n], out=sums[1:])
        raw = (sums[self.ends] - sums[self.starts]) * powers.down[self.starts]
        self.hashes = mixed(raw + (self.ends - self.starts).astype(np.uint64))

    def text(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "surrogateescape")


class Terminals:
    """Value of each distinct pre-token seen by a task, found for whole slices at once."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def look_up(self, tokens: PreTokens, insert) -> np.ndarray:
        """One value per pre-token; ``insert`` gives that of a new one's text, in sorted order of the texts."""
        keys, sample, place = np.unique(tokens.hashes, return_index=True, return_inverse=True)
        spot = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            spot = np.minimum(spot, len(self.keys) - 1)
            known = self.keys[spot] == keys
        fresh = np.flatnonzero(~known)
        values = np.zeros(len(keys), np.int64)
        values[known] = self.values[spot[known]]
        if len(fresh):
            texts = [tokens.text(i) for i in sample[fresh].tolist()]
            for i in sorted(range(len(texts)), key=texts.__getitem__):
                values[fresh[i]] = insert(texts[i])
            order = np.argsort(np.r_[self.keys, keys[fresh]], kind="stable")
            self.keys = np.r_[self.keys, keys[fresh]][order]
            self.values = np.r_[self.values, values[fresh]][order]
        return values[place]
