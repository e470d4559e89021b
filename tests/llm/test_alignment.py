import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lakesteward.llm import alignment
from lakesteward.llm.alignment import DEFAULT_BYTE_LEVEL, DEFAULT_MODEL, PerfectHash, aligned_tokens, hash_levels, tokenizers

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute_force(rows):
    """Whole texts, token by token, through the two libraries."""
    tools = tokenizers(DEFAULT_BYTE_LEVEL, DEFAULT_MODEL)
    counts, kept = Counter(), []
    for doc_id, text in rows:
        spans = []
        if text:
            data = (" " + text).encode()
            first, second = tools.a.encode(" " + text, add_special_tokens=False).ids, tools.b.encode(text)
            for ids, table in ((first, tools.a_bytes), (second, tools.b_bytes)):
                at, own = 0, []
                for i in ids:
                    own.append((at, at + len(table[i]), i))
                    at += len(table[i])
                if b"".join(table[i] for i in ids) == data:
                    spans.append(own)
        if len(spans) < 2:
            kept.append((doc_id, None, None, None))
            continue
        a, b = spans
        links, j = [], 0
        for s, e, i in a:
            while b[j][1] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][0] < e:
                links.append((i, b[k][2]))
                k += 1
        common = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups, low = [], 0
        for high in common:
            parts = [",".join(str(i) for s, e, i in side if low <= s and e <= high) for side in spans] if len(a) < 3000 else None
            groups.append(parts and "|".join(parts))
            low = high
        counts.update(links)
        kept.append((doc_id, spans, links, groups))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    out = []
    for doc_id, spans, links, groups in kept:
        if spans is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if None not in groups else None
        out.append((doc_id, len(spans[0]), len(spans[1]), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), digest))
    return out


def same(found, rows):
    wanted, got = sorted(map(str, brute_force(rows))), sorted(str(tuple(r)) for r in found.select(*COLUMNS).collect())
    assert got == wanted


TEXTS = [
    "plain words and  two spaces", " leading", "trailing ", "  ", " ", "\n\n new lines \n", "tab\tand hard space", "<|endoftext|> and </s> <s>",
    "don't stop. It's 12,345 o'clock!! (really)", "größer straße Ærø naïve", "漢字かな交じり文 と 空白", "emoji 👩‍👩‍👧 here", "mark ▁ inside", "nul \x00 byte \x7f del \x7f x",
    "é combining ́ alone", "a wide　spaces", "x" * 500, "ab " * 300, "​ zero width", "! !! a! b", "\r\n\r\n", "a  \n  b", "▁", "tail of spaces    ",
]


def test_many_kinds_of_texts(spark, documents):
    rows = list(enumerate(TEXTS)) + [(100, None), (101, ""), (None, "a b"), (102, "same words"), (102, "same words")]
    rng = random.Random(3)
    rows += [(200 + i, "".join(chr(rng.choice([32, 32, 97, 98, 33, 39, 115, 10, 0xE9, 0x4E00, 0x1F600, 0x301, 0xA0])) for _ in range(40))) for i in range(60)]
    same(aligned_tokens(documents(rows, 4)), rows)


def test_whole_table_with_passes_for_parts_of_the_pairs(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect() if len(r["text"] or "") < 4000]
    some = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(5)
    whole = aligned_tokens(some)
    same(whole, rows)
    parts = aligned_tokens(some, shard_pairs=1500, round_pairs=4000).select(*COLUMNS)
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.select(*COLUMNS).collect()))


def test_forgetting_chunks_changes_nothing(spark, documents, monkeypatch, sf_dir):
    # the task's own module decides, so the work is done here rather than in a worker
    import pyarrow as pa

    tools = tokenizers(DEFAULT_BYTE_LEVEL, DEFAULT_MODEL)
    data = [b" one two three one two", b" three one", b" two"]
    aligner = alignment.Aligner(tools)
    whole = b"".join(data)
    heads = np.array([0, len(data[0]), len(data[0]) + len(data[1])])
    entries, first = aligner.look_up(whole, heads)
    assert first.tolist() == [0, 5, 7] and entries.tolist() == [0, 1, 2, 0, 1, 2, 0, 1]
    slices = list(alignment._slices(pa.array([None, "a", "", "b c"])))
    assert [(s[2], s[3].tolist(), s[4].tolist()) for s in slices] == [(b" a b c", [1, 3], [0, 2])]


def test_long_texts_and_no_texts(spark, documents):
    rows = [(1, "long words " * 40_000), (2, "y" * 30_000)]
    found = {r["doc_id"]: r for r in aligned_tokens(documents(rows)).collect()}
    for (doc_id, *numbers, digest) in brute_force(rows):
        assert [found[doc_id][c] for c in COLUMNS[1:7]] == numbers and digest in (None, found[doc_id]["groups_sha256"])
    assert aligned_tokens(documents([])).collect() == []
    assert [tuple(r)[1:] for r in aligned_tokens(documents([(1, None), (2, "")])).select(*COLUMNS).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_invalid_bytes_have_no_tokens(spark):
    rows = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text UNION ALL SELECT 2L, 'fine words'")
    found = {r["doc_id"]: r for r in aligned_tokens(rows).collect()}
    assert found[1]["n_links"] == 0 and found[1]["groups_sha256"] == "" and found[2]["n_links"] > 0




@pytest.mark.parametrize("n, shards", [(1, 1), (5, 3), (20_000, 7)])
def test_perfect_hash_is_minimal_and_knows_its_keys(n, shards):
    rng = np.random.default_rng(n)
    pairs = np.unique(rng.integers(0, 1 << 47, n))
    shard = alignment._slot(pairs) * shards // alignment.SLOTS
    rows = []
    for s in sorted(set(shard.tolist())):
        sizes, bits, ordered = hash_levels(pairs[shard == s])
        rows.append({"shard": s, "n": int((shard == s).sum()), "sizes": sizes, "bits": bits.tobytes(), "pairs": ordered.tobytes()})
    function = PerfectHash.of(rows, shards)
    mine, number = function.numbers(pairs)
    assert len(mine) == len(pairs) and sorted(number.tolist()) == list(range(len(pairs)))
    assert (function.pairs[number] == pairs).all()
    strangers = np.arange(1 << 48, (1 << 48) + 5000)
    assert (function.numbers(strangers)[1] == -1).all()
    if len(rows) > 2:
        part = PerfectHash.of(rows[1:2], shards)
        mine, number = part.numbers(pairs)
        assert (shard[mine] == rows[1]["shard"]).all() and sorted(number.tolist()) == list(range(rows[1]["n"]))
