import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lakesteward.llm.suffixes import LENGTH, SuffixFamily, chosen_suffixes, repeat_removal, sliding_least, without_repeats
from lakesteward.llm.words import Powers


def brute_force(rows):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[p : p + LENGTH] for t in texts for p in range(len(t) - LENGTH + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - LENGTH + 1):
            if seen[t[p : p + LENGTH]] > 1:
                gone[p : p + LENGTH] = True
        spans = int(np.diff(np.r_[False, gone].astype(int)).clip(0).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def text_of(n, seed, letters="abcdefghij \n"):
    rng = random.Random(seed)
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.fixture
def rows():
    p, q = text_of(450, 1), text_of(200, 2, "xyzé")
    out = [(i, text_of(150 + 40 * i, 10 + i)) for i in range(8)]
    out += [(20, "a" + p + text_of(300, 31)), (21, text_of(99, 32) + p), (22, p[3:]), (23, text_of(300, 33) + p[100:300] + "!"), (24, p[:199] + "?")]
    out += [(30, q), (31, "1" + q), (32, q + q), (33, q[:150]), (34, q[:150])]
    out += [(40, "z" * 1000), (41, "ab" * 150), (42, "z" * 199), (43, text_of(3000, 41, "ab"))]
    out += [(50, out[3][1]), (51, out[3][1]), (52, None), (53, ""), (None, out[5][1]), (54, p), (54, p)]
    return out


def as_rows(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("batches, hot", [(1, 20_000), (2, 20_000), (5, 20_000), (2, 2)])
def test_against_brute_force(spark, documents, rows, batches, hot):
    assert as_rows(repeat_removal(documents(rows), batches, hot)) == brute_force(rows)


def test_many_near_copies(spark, documents):
    base, rng, rows = text_of(1500, 5), random.Random(6), []
    for i in range(30):
        t = list(base)
        for _ in range(rng.randrange(6)):
            t[rng.randrange(len(t))] = "#"
        rows.append((i, "".join(t)))
    assert as_rows(repeat_removal(documents(rows))) == brute_force(rows)
    assert as_rows(repeat_removal(documents(rows), 3, 4)) == brute_force(rows)


def test_empty_table_and_no_repeats(spark, documents):
    assert repeat_removal(documents([])).collect() == []
    rows = [(1, text_of(500, 1)), (2, "short")]
    assert as_rows(repeat_removal(documents(rows))) == brute_force(rows)


def test_equal_windows_choose_equal_suffixes():
    a, b = text_of(700, 1).encode(), text_of(900, 2).encode()
    both = np.frombuffer(a + b[:300] + a[100:500] + b[300:], np.uint8)
    keys, runs, counts = chosen_suffixes(both, np.array([0, 700, len(both)]), Powers())
    assert counts.sum() == len(keys) and counts[0] > 0
    own = set(keys[: counts[0]].tolist())
    assert len(own & set(keys[counts[0] :].tolist())) >= 2
    # every window start of both texts belongs to one run
    assert int((runs % 512).sum()) == 700 - 199 + len(both) - 700 - 199


def test_sliding_least():
    values = np.random.default_rng(0).integers(0, 1000, 500).astype(np.uint64)
    for width in (1, 2, 7, 499, 500):
        assert sliding_least(values, width).tolist() == [values[i : i + width].min() for i in range(500 - width + 1)]
    assert len(sliding_least(values, 501)) == 0


def test_levels_merge_geometrically(spark):
    family, found = SuffixFamily(), []
    for b in range(7):
        rows = [(k, 100 * b + k, 1) for k in range(b, 60, b + 2)]
        found += family.add(spark.createDataFrame(rows, "key BIGINT, row BIGINT, run BIGINT").repartition(2)).collect()
    assert sorted(family.levels) == [1, 2, 4]
    keys = Counter(k for b in range(7) for k in range(b, 60, b + 2))
    expected = {(k, 100 * b + k) for b in range(7) for k in range(b, 60, b + 2) if keys[k] > 1}
    assert {(r["key"], r["row"]) for r in found} == expected


def test_without_repeats_changes_text_and_length(spark, documents, rows):
    expected = {i: (n, gone) for i, n, gone, _, _ in brute_force(rows)}
    docs = documents(rows)
    found = without_repeats(docs)
    assert found.columns == docs.columns and found.count() == len(rows)
    for r in found.collect():
        n, gone = expected[r["doc_id"]]
        assert r["text"] is None or len(r["text"].encode()) in range(n - gone - 6, n - gone + 1)
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    assert {r["doc_id"]: r["text"] for r in found.collect()}[52] is None
