import numpy as np
import pytest

from lakesteward.llm.contamination import decontaminated, leaks, smith_waterman

ITEM = "item_id BIGINT, text STRING, lang STRING"


def plain_smith_waterman(item, passage):
    h = np.zeros((len(item) + 1, len(passage) + 1), int)
    for i in range(1, len(item) + 1):
        for j in range(1, len(passage) + 1):
            same = 1 if item[i - 1] == passage[j - 1] else -1
            h[i, j] = max(0, h[i - 1, j - 1] + same, h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment_score_against_the_plain_recurrence():
    rng = np.random.default_rng(0)
    for _ in range(200):
        item, passage = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 25))
        score, first, last = smith_waterman(item, passage)
        assert score == plain_smith_waterman(item, passage)
        if score:
            assert plain_smith_waterman(item, passage[first : last + 1]) == score


@pytest.fixture
def items(spark, words):
    texts = [(i, " ".join(words(40, 100 + i)), "en") for i in range(5)] + [(90, None, "en"), (None, "a b c d e f g", "en"), (91, "too short", "en"), (92, "", "en")]
    return spark.createDataFrame(texts, ITEM)


def test_exact_edited_and_partial_copies(spark, documents, items, words):
    item = words(40, 101)
    swapped = [w if i % 9 else "other" for i, w in enumerate(item)]
    dropped = [w for i, w in enumerate(item) if i % 8]
    inserted = [x for i, w in enumerate(item) for x in ([w, "extra"] if i % 10 == 0 else [w])]
    noise = words(300, 7)
    rows = [
        (1, " ".join(noise[:50] + item + noise[50:])), (2, " ".join(noise[:90] + swapped + noise[90:])), (3, " ".join(dropped)),
        (4, " ".join(noise + inserted).upper()), (5, " ".join(noise[:150] + item[:28] + noise[150:])),
        (6, " ".join(noise + item[:12])), (7, " ".join(noise)), (8, None), (9, ""), (None, " ".join(item)), (10, " ".join(noise[:50] + item)), (10, " ".join(noise[:50] + item)),
    ]
    found = leaks(documents(rows), items).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(["1", "2", "3", "4", "5", "None", "10", "10"])
    assert {r["item_id"] for r in found} == {1}
    exact = next(r for r in found if r["doc_id"] == 1)
    assert (exact["score"], exact["first_word"], exact["last_word"], exact["points"]) == (1.0, 50, 89, 40)
    kept = decontaminated(documents(rows), items)
    assert kept.columns == documents(rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [6, 7, 8, 9]


def test_case_and_marks_do_not_matter(spark, documents):
    item = "La Éai éonleeau pour an, éonqueê aivi ai. Éenaitreoiaux éoiré anvitre"
    items = spark.createDataFrame([(7, item, "fr")], ITEM)
    rows = [(1, "!! ".join(item.upper().split()) + "!!"), (2, "tout autre chose, vraiment pas cela du tout")]
    assert [(r["doc_id"], r["item_id"], r["score"]) for r in leaks(documents(rows), items).collect()] == [(1, 7, 1.0)]


def test_widespread_item_is_still_found(spark, documents, items, words):
    item = " ".join(words(40, 102))
    rows = [(i, " ".join(words(60, 1000 + i)) + (" " + item if i % 3 == 0 else "")) for i in range(90)]
    assert sorted(r["doc_id"] for r in leaks(documents(rows), items).collect()) == list(range(0, 90, 3))
    # one item per block gives the same
    assert leaks(documents(rows), items, block_bytes=1).count() == 30


@pytest.mark.parametrize("extra", [0, 110])
def test_widespread_edited_and_partial_copies(spark, documents, items, words, extra):
    item, other = words(40, 103), words(40, 104)
    edited = [w if i not in (6, 18, 30) else "other" for i, w in enumerate(item)]
    rows = [(i, " ".join(words(60, 2000 + i) + (edited if i % 3 == 0 else []))) for i in range(90 + extra)]
    assert sorted(r["doc_id"] for r in leaks(documents(rows), items).collect()) == list(range(0, 90 + extra, 3))
    # the whole item in some documents, its back half in one
    rows = [(i, " ".join(words(60, 3000 + i) + (other if i % 3 == 0 else []))) for i in range(90 + extra)]
    rows.append((1000, " ".join(words(30, 4) + other[18:])))
    assert sorted(r["doc_id"] for r in leaks(documents(rows), items).collect()) == [*range(0, 90 + extra, 3), 1000]
    assert 1000 not in {r["doc_id"] for r in decontaminated(documents(rows), items).collect()}


def test_items_that_share_an_n_gram_are_told_apart(spark, documents, words):
    shared = ["which", "of", "the", "following"]
    items = spark.createDataFrame([(i, " ".join(shared + words(20, 5000 + i)), "en") for i in range(300)], ITEM)
    rows = [(i, " ".join(shared * 5 + words(40, 6000 + i) + (shared + words(20, 5000 + i) if i % 2 else []))) for i in range(20)]
    assert sorted((r["doc_id"], r["item_id"]) for r in leaks(documents(rows), items).collect()) == [(i, i) for i in range(1, 20, 2)]


def test_without_items_or_documents(spark, documents, items):
    assert leaks(documents([]), items).collect() == []
    assert leaks(documents([(1, "a b c d e f g h")]), items.limit(0)).collect() == []
    assert decontaminated(documents([(1, "a")]), items.limit(0)).count() == 1


def test_clean_documents_of_the_test_tables_stay(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    held = {(d["doc_id"], i["item_id"]) for d in docs.collect() for i in items.collect() if i["text"] in d["text"]}
    found = {(r["doc_id"], r["item_id"]) for r in leaks(docs, items).collect()}
    assert held <= found and len(found) <= len(held) + 3
