import zlib

from lakesteward.llm.sharding import feistel, permuted, sharded, sides


def test_every_pass_is_a_permutation(spark):
    for total in (1, 2, 3, 10, 17, 1000):
        a, b = sides(total)
        assert a * b >= total
        domain = spark.range(a * b).toDF("p")
        assert sorted(r["p"] for r in feistel(domain, "p", total, 5).collect()) == list(range(a * b))
        rows = permuted(spark.range(total).toDF("n"), "n", total, "p", 5)
        assert sorted(r["p"] for r in rows.collect()) == list(range(total))


def test_shards_are_even_and_reproducible(spark, documents):
    rows = [(i, f"text {i % 7}") for i in range(103)]
    found = sharded(documents(rows), 16).collect()
    counts = [sum(r["shard"] == s for r in found) for s in range(16)]
    assert max(counts) - min(counts) <= 1
    for s in range(16):
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(counts[s]))
    again = sharded(documents(rows[::-1], 5), 16).collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, again), key=str)
    assert [r["doc_id"] for r in sorted(found, key=lambda r: (r["slot"], r["shard"]))] != list(range(103))


def test_null_empty_long_and_repeated_rows(spark, documents):
    rows = [(None, "a"), (1, None), (1, None), (2, ""), (3, "é" * 100_000)]
    found = sharded(documents(rows), 2).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in found) == sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    assert {r["law"] for r in found} == {"rows"} and {r["grown_shard"] for r in found} == {None}
    assert sharded(documents([]), 4).collect() == []
