import itertools
import random
from collections import Counter

import numpy as np
import pytest

from lakesteward.llm.pieces import PreTokens, load_vocabulary
from lakesteward.llm.sampling import Decoder, Lattice, sample, sampled_segmentations
from lakesteward.llm.token_counts import CountTrie, token_counts
from lakesteward.llm.words import Powers, mixed

TEXTS = [
    "Hello world", " ", "a  b", "x\ny\t z ", "▁a ▁", "日本語 テスト 😀😀", "\n\n", "ééé", "<0x0A> </s>", "a" * 60, "   lead", "trail   ", "\x00\x7f", "don't stop-believing 1234",
]


@pytest.fixture(scope="module")
def vocabulary():
    return load_vocabulary()


def pretokens(text, vocabulary):
    data = np.frombuffer(text.encode(), np.uint8)
    found = PreTokens(data, np.array([0, len(data)]), vocabulary.joined, Powers())
    return [found.text(i) for i in range(len(found.starts))]


def best_count(text, vocabulary):
    """Plain dynamic programming over the whole text."""
    x, unknown = " " + text, min(vocabulary.scores.values()) - 10
    best = [(0.0, 0)]
    for end in range(1, len(x) + 1):
        options = []
        for start in range(max(0, end - 16), end):
            piece = vocabulary.ids.get(x[start:end])
            if piece is not None:
                options.append((best[start][0] + vocabulary.scores[piece], -best[start][1] - 1))
        if x[end - 1] not in vocabulary.ids:
            options.append((best[end - 1][0] + unknown, -best[end - 1][1] - len(x[end - 1].encode())))
        score, tokens = max(options)
        best.append((score, -tokens))
    return best[-1][1]


def test_pretokens_put_together_are_the_text(vocabulary):
    for text in TEXTS:
        assert "".join(pretokens(text, vocabulary)) == " " + text
    assert pretokens("", vocabulary) == []
    assert pretokens("a  b\n c", vocabulary) == [" a", "  b", "\n", " c"]
    # no piece goes from one pre-token into the next
    pieces = set(vocabulary.ids)
    for text in TEXTS:
        parts, at = pretokens(text, vocabulary), 0
        for part in parts[:-1]:
            at += len(part)
            whole = " " + text
            assert not any(whole[a:b] in pieces for a in range(max(0, at - 16), at) for b in range(at + 1, min(len(whole), at + 16) + 1))


def test_counts_against_plain_dynamic_programming(spark, documents, vocabulary, sf_dir):
    rows = list(enumerate(TEXTS)) + [(100, None), (101, ""), (None, "a b"), (102, "same"), (102, "same")]
    rows += [(200 + i, r["text"][:300]) for i, r in enumerate(spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30).collect())]
    found = token_counts(documents(rows)).collect()
    expected = [(i, best_count(t, vocabulary) if t else 0) for i, t in rows]
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in found), key=str) == sorted(expected, key=str)
    # a trie that is begun anew all the time counts the same
    again = token_counts(documents(rows), most_nodes=1).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, found), key=str)
    assert token_counts(documents([])).collect() == []


def test_trie_shares_prefixes(vocabulary):
    trie = CountTrie(vocabulary)
    trie.insert(" thing")
    nodes = len(trie.score)
    trie.insert(" things")
    assert len(trie.score) == nodes + 1


def test_sampling_follows_the_weights(vocabulary):
    lattice = Lattice(vocabulary, 0.3)
    text = " then"
    weights = {}
    for cuts in itertools.product((0, 1), repeat=len(text) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(text)]
        parts = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        if all(p in vocabulary.ids for p in parts):
            weights[tuple(vocabulary.ids[p] for p in parts)] = np.exp(sum(lattice.weight[vocabulary.ids[p]] for p in parts))
    n = 40_000
    nodes = np.full(n, lattice.insert(text))
    edges, lengths = sample(lattice, nodes, mixed(np.arange(n, dtype=np.uint64)))
    _, _, place, _ = lattice.arrays()
    ids, ends = np.array(lattice.pool)[place[edges]], np.cumsum(lengths)
    drawn = Counter(tuple(ids[e - m : e].tolist()) for e, m in zip(ends.tolist(), lengths.tolist(), strict=True))
    total = sum(weights.values())
    assert set(drawn) <= set(weights)
    assert all(abs(drawn[s] / n - w / total) < 0.02 for s, w in weights.items())


def test_segmentations_are_lossless_and_reproducible(spark, documents, vocabulary):
    rng = random.Random(2)
    rows = list(enumerate(TEXTS)) + [(100, None), (101, ""), (None, "a b"), (102, "same words"), (102, "same words"), (103, "long " * 60_000)]
    rows += [(200 + i, "".join(chr(rng.choice([32, 97, 98, 0x2581, 0x10FFFF, 0xE9, 10])) for _ in range(40))) for i in range(30)]
    found = sampled_segmentations(documents(rows, 4)).collect()
    decoder = Decoder(vocabulary)
    by_id = dict(rows)
    assert len(found) == len(rows) and all(r["lossless"] for r in found)
    for r in found:
        assert decoder.text(r["token_ids"]) == (by_id[r["doc_id"]] or "")
        assert r["n_tokens"] == len(r["token_ids"])
    again = sampled_segmentations(documents(rows[::-1], 1), most_nodes=1).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    other = sampled_segmentations(documents(rows, 4), seed=2).collect()
    assert sorted(map(str, other)) != sorted(map(str, found))
    assert sampled_segmentations(documents([])).collect() == []


def test_a_high_sharpness_gives_the_best_segmentation(spark, documents, vocabulary):
    rows = [(i, "the thing and other things") for i in range(5)]
    found = {tuple(r["token_ids"]) for r in sampled_segmentations(documents(rows), sharpness=200.0).collect()}
    assert len(found) == 1
