import random

import numpy as np
import pytest

from lakesteward.llm import hyperminhash
from lakesteward.llm.components import components
from lakesteward.llm.hyperminhash import deduplicated, estimated_jaccard, linked_groups, near_duplicates, registers
from lakesteward.llm.words import Powers, Words, mixed


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_force(rows, k, percent=80):
    sets = [shingle_set(t, k) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for x, (i, _) in zip(label, rows, strict=True):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    return sorted(((i, len(s), least.get(x)) for (i, _), s, x in zip(rows, sets, label, strict=True)), key=str)


def edited(base, n, rng):
    out = list(base)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


def as_rows(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def test_words_and_shingles_follow_the_definition():
    texts = ["A b\x0bc\x0cd\re\tf", "ÄB x ä\x85b", "", "one", "x  y\n\nz", "Zz zZ zz ZZ zz"]
    data = "".join(texts).encode()
    offsets = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    w = Words(np.frombuffer(data, np.uint8), offsets, Powers())
    own = [data[a:b] for a, b in zip(w.starts, w.ends, strict=True)]
    assert [[x.lower() for x in own[a:b]] for a, b in zip(w.first[:-1], w.first[1:], strict=True)] == [t.encode().lower().split() for t in texts]
    runs, first = w.shingles(3)
    for d, text in enumerate(texts):
        assert len(set(runs[first[d] : first[d + 1]].tolist())) == len(shingle_set(text, 3))


def test_estimate_is_near_the_index():
    for shared in (100, 400, 800, 950):
        a, b = mixed(np.arange(1000, dtype=np.uint64)), mixed(np.arange(1000 - shared, 2000 - shared, dtype=np.uint64))
        sketch = registers(np.r_[np.sort(a), np.sort(b)], np.array([1000, 1000]))
        true = shared / (2000 - shared)
        assert abs(estimated_jaccard(sketch[:1], sketch[1:], np.array([1000]), np.array([1000]))[0] - true) < 0.2


@pytest.mark.parametrize("limits", [{}, {"hot_rows": 3, "hot_documents": 2}])
def test_against_brute_force(spark, documents, words, limits):
    rng, rows = random.Random(3), []
    for g in range(12):
        base = words(rng.choice([5, 9, 30, 120]), g)
        for _ in range(rng.choice([1, 2, 6, 14])):
            rows.append((len(rows), edited(base, rng.randrange(0, 1 + len(base) // 18), rng)))
    rows += [(500, None), (501, ""), (502, "  \n"), (503, "one two"), (504, "One  TWO"), (505, "one"), (None, "one"), (506, rows[0][1]), (506, rows[0][1])]
    rows += [(600 + i, "A\tB c d " + " ".join(words(40, 77))) for i in range(3)]
    found = near_duplicates(documents(rows), 4, 80, **limits)
    assert as_rows(found) == brute_force(rows, 4)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found.collect())


def test_chains_and_exact_thresholds(spark, documents):
    # 8 of 10 shingles shared is a link, just below is none; a chain joins its ends
    seq = [f"t{i}" for i in range(60)]
    rows = [(i, " ".join(seq[i : i + 12])) for i in range(0, 40)]
    assert as_rows(near_duplicates(documents(rows), 4, 80)) == brute_force(rows, 4)
    assert len({r[2] for r in brute_force(rows, 4)}) == 1
    far = [(i, " ".join(seq[2 * i : 2 * i + 12])) for i in range(0, 20)]
    assert as_rows(near_duplicates(documents(far), 4, 80)) == brute_force(far, 4)


def test_linked_groups_checks_across_groups():
    sets = [np.arange(i, i + 20, dtype=np.uint64) for i in (0, 2, 4, 40, 42, 100)]
    label = linked_groups(sets, 80)
    assert label[0] == label[1] == label[2] and label[3] == label[4] and len(set(label.tolist())) == 3


def test_empty_table(spark, documents):
    assert near_duplicates(documents([]), 4, 80).collect() == []


def test_deduplicated_keeps_one_of_each_group(spark, documents, words):
    base = " ".join(words(60, 1))
    rows = [(5, base), (3, base), (3, base), (9, " ".join(words(60, 2))), (None, None), (11, None)]
    kept = deduplicated(documents(rows))
    assert kept.columns == documents(rows).columns
    assert sorted((str(r["doc_id"]) for r in kept.collect())) == ["11", "3", "9", "None"]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (20, 20)] + [(100 + i, 101 + i) for i in range(30)] + [(300, x) for x in range(301, 340)]
    found = {r["row"]: r["component"] for r in components(spark.createDataFrame(edges, "a BIGINT, b BIGINT")).collect()}
    assert {found[x] for x in (1, 2, 3)} == {1} and {found[x] for x in (7, 8, 9)} == {7} and found[20] == 20
    assert {found[x] for x in range(100, 131)} == {100} and {found[x] for x in range(300, 340)} == {300}
    assert components(spark.createDataFrame([], "a BIGINT, b BIGINT")).collect() == []


def test_limits_are_only_sizes_of_pieces():
    assert hyperminhash.HOT_ROWS > 1000 and hyperminhash.BAND * hyperminhash.BANDS == hyperminhash.REGISTERS
