"""Near-duplicate documents by HyperMinHash sketches, with every link confirmed on the full sets.

A document's word shingles are hashed once each. The hash picks one of ``REGISTERS`` buckets, and a
bucket keeps its smallest remaining hash as a count of leading zeros and ten mantissa bits: two
bytes. Runs of ``BAND`` registers are band keys; an empty bucket is a value like any other, so a
band is broken only by shingles that the two documents do not share. Within a band key, documents
are compared with leaders: the Jaccard index estimated from the registers, corrected for accidental
collisions, makes candidate links from ``EDGE`` on, and from ``CLOSE`` on a document needs no other
leader. As one minus the Jaccard index is a metric, a partner of a closed document is a candidate
of the same leader, so the two stay in one candidate component. Within such a component exact
intersections decide, until every pair across two groups has been looked at or is joined.

Documents with equal sets are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesteward.llm.common import key_runs, list_array, numbered, saved, text_column, text_slices
from lakesteward.llm.components import components
from lakesteward.llm.words import Powers, Words, mixed

BAND, BANDS = 4, 24
#: bands whose links are found first
FIRST_BANDS = 6
REGISTERS = BAND * BANDS
MANTISSA = 10
EMPTY = 0xFFFF
#: estimated Jaccard index from which two documents are candidates, and from which one stands for the other
EDGE, CLOSE = 0.55, 0.9
#: rows of a band key, and documents of a candidate component, that one task handles
HOT_ROWS, HOT_DOCUMENTS = 50_000, 10_000
#: leaders, and shingles of theirs, that are sent to all tasks at once
LEADERS, LEADER_SHINGLES = 1024, 2_000_000

SKETCHES = "doc_id BIGINT, text_key BIGINT, n_shingles BIGINT, set_a BIGINT, set_b BIGINT, sketch BINARY"


def _sorted_sets(shingles: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ascending, and their counts."""
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        shingles[low:high].sort()
    fresh = np.ones(len(shingles), bool)
    fresh[1:] = shingles[1:] != shingles[:-1]
    fresh[first[:-1][first[:-1] < len(shingles)]] = True
    upto = np.r_[0, np.cumsum(fresh)]
    return shingles[fresh], upto[first[1:]] - upto[first[:-1]]


def registers(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Compressed registers, one row per text."""
    doc = np.repeat(np.arange(len(counts)), counts)
    bucket = ((shingles >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    least = np.full(len(counts) * REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, doc * REGISTERS + bucket.astype(np.int64), mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)))
    # a float's exponent is the count of leading zeros, its mantissa the bits that follow the leading one
    bits = least.astype(np.float64).view(np.int64) >> (52 - MANTISSA)
    zeros = 1087 - (bits >> MANTISSA)
    packed = (zeros << MANTISSA | bits & ((1 << MANTISSA) - 1)).astype(np.uint16)
    packed[least == np.iinfo(np.uint64).max] = EMPTY
    return packed.reshape(len(counts), REGISTERS)


def estimated_jaccard(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard index of pairs of sketches; ``n`` and ``m`` are the sets' sizes."""
    held = (a != EMPTY) | (b != EMPTY)
    equal = ((a == b) & held).sum(1)
    filled = held.sum(1)
    ratio = 4 * n * m / (n + m) ** 2
    # expected accidental collisions per register that both sides fill
    accidental = ((a != EMPTY) & (b != EMPTY)).sum(1) * 0.169919487159739 * 2.0**-MANTISSA * ratio
    return np.maximum(equal - accidental, 0) / np.maximum(filled, 1)


def sketched(docs: DataFrame, words: int) -> DataFrame:
    """One stored row per document: its sketch, the size and a 128-bit hash of its shingle set."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for low, high, data, offsets in text_slices(batch["text"]):
                values, counts = _sorted_sets(*Words(data, offsets, powers).shingles(words))
                ends = np.r_[0, np.cumsum(counts)]
                marks = []
                for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                    sums = np.r_[np.uint64(0), np.cumsum(mixed(values ^ np.uint64(salt)))]
                    marks.append((sums[ends[1:]] - sums[ends[:-1]]).view(np.int64))
                packed = registers(values, counts)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(low, high - low), batch["text_key"].slice(low, high - low), pa.array(counts.astype(np.int64)),
                     pa.array(marks[0]), pa.array(marks[1]), pa.array([r.tobytes() for r in packed], pa.binary())],
                    ["doc_id", "text_key", "n_shingles", "set_a", "set_b", "sketch"],
                )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), text_column().alias("text"))
    return numbered(texts.mapInArrow(sketch, SKETCHES), "sketches")


def band_rows(nodes: DataFrame) -> DataFrame:
    """``band`` key, ``row`` and band ``number`` of every band that holds a shingle."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = np.frombuffer(b"".join(batch["sketch"].to_pylist()), np.uint16).reshape(-1, BANDS, BAND)
            keys = np.ascontiguousarray(packed).view(np.uint64)[:, :, 0]
            keys = mixed(keys + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            full = (packed != EMPTY).any(2)
            rows = np.repeat(batch["row"].to_numpy(), BANDS).reshape(-1, BANDS)
            numbers = np.broadcast_to(np.arange(BANDS, dtype=np.int32), full.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[full].view(np.int64)), pa.array(rows[full]), pa.array(numbers[full])], ["band", "row", "number"]
            )

    return nodes.select("row", "sketch").mapInArrow(bands, "band BIGINT, row BIGINT, number INT")


def _unpacked(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _forest(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A smallest set of edges with the same connected components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    kept = []
    for a, b in edges:
        p, q = root(a), root(b)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append((a, b))
    return kept


def _group_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate links between labels within each band key of batches sorted by band and row.

    Only as many links are given as connect what they connect.
    """
    for table in key_runs(batches, "band", 20_000):
        band, label, size = (table[c].to_numpy() for c in ("band", "label", "n_shingles"))
        sketch = _unpacked(table["sketch"])
        group = np.cumsum(np.r_[True, band[1:] != band[:-1]]) - 1
        waiting = np.arange(len(band))
        found: set[tuple[int, int]] = set()
        while len(waiting):
            head = np.r_[True, group[waiting][1:] != group[waiting][:-1]]
            leader = waiting[head][np.cumsum(head) - 1]
            other, lead = waiting[~head], leader[~head]
            near = np.zeros(len(other))
            # neither threshold can be met by sets of too different sizes
            fit = np.minimum(size[other], size[lead]) >= EDGE * 0.8 * np.maximum(size[other], size[lead])
            for at in np.array_split(np.flatnonzero(fit), max(1, int(fit.sum()) // 20_000)):
                near[at] = estimated_jaccard(sketch[lead[at]], sketch[other[at]], size[lead[at]], size[other[at]])
            link = (near >= EDGE) & (label[lead] != label[other])
            found.update(zip(label[lead[link]].tolist(), label[other[link]].tolist(), strict=True))
            waiting = other[near < CLOSE]
        pairs = np.array(_forest(sorted(found)), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _hot_round(rows: DataFrame) -> DataFrame:
    """Estimate between each row of the hot band keys and its key's leader: a, b, band, near; stored."""
    leaders = rows.groupBy("band").agg(F.min_by(F.struct("row", "n_shingles", "sketch"), "row").alias("lead"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = estimated_jaccard(
                _unpacked(batch["lead_sketch"]), _unpacked(batch["sketch"]), batch["lead_n"].to_numpy(), batch["n_shingles"].to_numpy()
            )
            yield pa.RecordBatch.from_arrays([batch["lead"], batch["row"], batch["band"], pa.array(near)], ["a", "b", "band", "near"])

    pairs = rows.join(leaders, "band").select(
        F.col("lead.row").alias("lead"), F.col("lead.sketch").alias("lead_sketch"), F.col("lead.n_shingles").alias("lead_n"), "row", "band", "sketch", "n_shingles"
    )
    return saved(pairs.mapInArrow(compare, "a BIGINT, b BIGINT, band BIGINT, near DOUBLE"), "hot-bands")


def _band_links(rows: DataFrame, nodes: DataFrame, labels: DataFrame | None, hot_rows: int) -> DataFrame:
    """Stored candidate links (a, b) of the given rows of band keys, between labels where there are some."""
    links = None
    ordinary, hot = rows.filter(F.col("n") <= hot_rows), rows.filter(F.col("n") > hot_rows)
    while not hot.isEmpty():
        # one leader per key and round takes its near copies out, until the rest fits a task
        near = _hot_round(hot)
        link = near.filter((F.col("near") >= EDGE) & (F.col("a") != F.col("b"))).select("a", "b")
        links = link if links is None else links.unionByName(link)
        rest = near.filter((F.col("near") < CLOSE) & (F.col("a") != F.col("b"))).select("band", F.col("b").alias("row"))
        left = rest.groupBy("band").agg(F.count("*").alias("n"))
        hot = saved(rest.join(left, "band").join(nodes.select("row", "n_shingles", "sketch"), "row"), "hot-rest")
        ordinary = ordinary.unionByName(hot.filter(F.col("n") <= hot_rows), allowMissingColumns=True)
        hot = hot.filter(F.col("n") > hot_rows)
    ordinary = ordinary.select("band", "row", "n_shingles", "sketch")
    if labels is None:
        ordinary = ordinary.withColumn("label", F.col("row"))
    else:
        ordinary = ordinary.join(labels, "row", "left").withColumn("label", F.coalesce("component", "row")).drop("component")
    grouped = ordinary.repartition("band").sortWithinPartitions("band", "row")
    found = grouped.mapInArrow(_group_edges, "a BIGINT, b BIGINT")
    return saved((found if links is None else found.unionByName(links)).distinct(), "candidates")


def candidate_components(nodes: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``row`` and ``component`` of the ``nodes`` (row, n_shingles, sketch) with candidates, stored.

    The first bands connect nearly all that belongs together; the others then only give links
    between what they left apart, so a large group of copies has few links per document.
    """
    bands = saved(band_rows(nodes), "bands")
    counts = bands.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    shared = bands.join(counts, "band").select("band", "number", "row", "n")
    rows = saved(shared.join(nodes.select("row", "n_shingles", "sketch"), "row"), "band-groups")
    early = F.col("number") < FIRST_BANDS
    labels = saved(components(_band_links(rows.filter(early), nodes, None, hot_rows)), "first-components")
    more = _band_links(rows.filter(~early), nodes, labels, hot_rows)
    stars = labels.select(F.col("row").alias("a"), F.col("component").alias("b"))
    return saved(components(stars.unionByName(more)), "candidate-components")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """``texts`` (component, row, text) with the text replaced by its distinct shingles, ``shingles``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for low, high, data, offsets in text_slices(batch["text"]):
                values, counts = _sorted_sets(*Words(data, offsets, powers).shingles(words))
                lists = list_array(values.view(np.int64), counts, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch["component"].slice(low, high - low), batch["row"].slice(low, high - low), lists], ["component", "row", "shingles"]
                )

    return texts.mapInArrow(build, "component BIGINT, row BIGINT, shingles ARRAY<BIGINT>")


def linked_groups(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Group number per set: sets are in one group when links of at least ``percent`` connect them.

    One set at a time is intersected with all; a set needs no turn of its own while it belongs to
    the largest group, as any link across two groups has an end outside of it.
    """
    label = np.arange(len(sets))
    sizes = np.array([len(s) for s in sets])
    values, ids, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # a shingle of one set alone is in no intersection; counts fit 32 bits
    shared_id = times > 1
    kept = shared_id[ids]
    place = np.cumsum(shared_id) - 1
    owner = np.repeat(np.arange(len(sets)), sizes)[kept]
    ids = place[ids[kept]].astype(np.int32)
    begin = np.searchsorted(owner, np.arange(len(sets) + 1))
    filled = np.flatnonzero(np.diff(begin))
    own = np.zeros(int(shared_id.sum()), np.int32)
    tried = np.zeros(len(sets), bool)
    while True:
        largest = np.bincount(label).argmax()
        rest = np.flatnonzero((label != largest) & ~tried)
        if not len(rest):
            return label
        turn = int(rest[0])
        tried[turn] = True
        mine = ids[begin[turn] : begin[turn + 1]]
        own[mine] = 1
        shared = np.zeros(len(sets), np.int64)
        if len(filled):
            shared[filled] = np.add.reduceat(own[ids], begin[filled])
        own[mine] = 0
        shared[turn] = sizes[turn]
        joined = np.unique(label[100 * shared >= percent * (sizes + sizes[turn] - shared)])
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]


def _exact_groups(percent: int):
    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_runs(batches, "component", 500):
            component, row = table["component"].to_numpy(), table["row"].to_numpy()
            lists = table["shingles"].combine_chunks()
            values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            begin = np.flatnonzero(np.r_[True, component[1:] != component[:-1]])
            out = []
            for low, high in zip(begin, np.r_[begin[1:], len(component)], strict=True):
                # a row can come twice where the documents repeat
                rows, first = np.unique(row[low:high], return_index=True)
                label = linked_groups([values[offsets[low + i] : offsets[low + i + 1]] for i in first], percent)
                _, root, place = np.unique(label, return_index=True, return_inverse=True)
                out += zip(rows.tolist(), rows[root][place].tolist(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["a", "b"])

    return resolve


def _leader_links(leaders: list[tuple[int, int, np.ndarray]], percent: int):
    """Links between every set and the leaders of its component; leaders are (component, row, set)."""
    by_component: dict[int, list[tuple[int, np.ndarray]]] = {}
    for component, row, values in leaders:
        by_component.setdefault(component, []).append((row, values))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for component, row, own in zip(batch["component"].to_pylist(), batch["row"].to_pylist(), batch["shingles"], strict=True):
                mine = own.values.to_numpy()
                for lead, values in by_component.get(component, ()):
                    spot = np.minimum(np.searchsorted(values, mine.view(np.uint64)), len(values) - 1)
                    shared = int((values[spot] == mine.view(np.uint64)).sum())
                    if lead != row and 100 * shared >= percent * (len(values) + len(mine) - shared):
                        out.append((lead, row))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["a", "b"])

    return links


def hot_links(sets: DataFrame, percent: int) -> DataFrame:
    """Exact links that connect the sets of very large candidate components; ``sets`` must be stored.

    The scheme of ``linked_groups`` with the sets spread over the tasks: a bounded number of leaders
    per round, until no set outside its component's largest group is left untried.
    """
    spark = sets.sparkSession
    links = sets.select(F.col("row").alias("a"), F.col("row").alias("b"))
    tried = spark.createDataFrame([], "row BIGINT")
    while True:
        state = sets.select("component", "row", F.size("shingles").alias("n")).join(
            components(links).withColumnRenamed("component", "label"), "row"
        )
        state = saved(state, "hot-state")
        sizes = state.groupBy("component", "label").agg(F.count("*").alias("members"))
        largest = sizes.groupBy("component").agg(F.max_by("label", F.struct("members", "label")).alias("top"))
        rest = state.join(largest, "component").filter("label <> top").join(tried, "row", "left_anti")
        picked, spent = [], 0
        for r in rest.orderBy(F.xxhash64("row"), "row").limit(LEADERS).collect():
            if picked and spent + r["n"] > LEADER_SHINGLES:
                break
            picked.append(r["row"])
            spent += r["n"]
        if not picked:
            return links
        chosen = sets.filter(F.col("row").isin(picked)).collect()
        leaders = [(r["component"], r["row"], np.array(r["shingles"], np.int64).view(np.uint64)) for r in chosen]
        found = saved(sets.mapInArrow(_leader_links(leaders, percent), "a BIGINT, b BIGINT"), "hot-links")
        links = links.unionByName(found)
        tried = saved(tried.unionByName(spark.createDataFrame([(p,) for p in picked], "row BIGINT")), "hot-tried")


def near_groups(
    docs: DataFrame, words: int = 5, percent: int = 80, hot_rows: int = HOT_ROWS, hot_documents: int = HOT_DOCUMENTS
) -> DataFrame:
    """One stored row per document: doc_id, text_key, row, n_shingles, component_id.

    Two documents are linked when 100 * shared >= percent * united shingles, and ``component_id`` is
    the smallest doc_id that links lead to. A text of fewer than ``words`` words is one shingle; one
    without words, a null one included, has none and is alone. Repeated rows are documents of their
    own; a null doc_id is no component's name unless the document has no other, which gives null.
    """
    base = sketched(docs, words)
    full = base.filter("n_shingles > 0")
    sets = saved(full.groupBy("n_shingles", "set_a", "set_b").agg(F.min("row").alias("node")), "nodes")
    nodes = full.join(sets.select(F.col("node").alias("row")), "row", "left_semi")
    near = candidate_components(nodes, hot_rows)
    sizes = near.groupBy("component").agg(F.count("*").alias("members"))
    members = saved(near.join(sizes, "component").join(nodes.select("row", "doc_id", "text_key"), "row"), "members")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("key"), text_column().alias("text"))
    # the same plan at every size, whether or not the members would fit a broadcast
    matched = texts.join(members.hint("merge"), texts["id"].eqNullSafe(members["doc_id"]) & (texts["key"] == members["text_key"]))
    matched = matched.select("component", "row", "text", "members")
    small = shingle_sets(matched.filter(F.col("members") <= hot_documents), words)
    small = small.repartition("component").sortWithinPartitions("component", "row")
    links = saved(small.mapInArrow(_exact_groups(percent), "a BIGINT, b BIGINT"), "groups")
    if not sizes.filter(F.col("members") > hot_documents).isEmpty():
        large = shingle_sets(matched.filter(F.col("members") > hot_documents), words).dropDuplicates(["row"])
        found = components(hot_links(saved(large, "hot-sets"), percent))
        links = links.unionByName(found.select(F.col("row").alias("a"), F.col("component").alias("b")))
    labelled = sets.join(links, sets["node"] == links["a"], "left").select(
        "n_shingles", "set_a", "set_b", F.coalesce("b", "node").alias("label")
    )
    # documents without shingles name themselves by a negative label
    rows = base.join(labelled, ["n_shingles", "set_a", "set_b"], "left").select(
        "doc_id", "text_key", "row", "n_shingles", F.coalesce("label", -1 - F.col("row")).alias("label")
    )
    rows = saved(rows, "labelled")
    names = rows.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("keeper"))
    return rows.join(names, "label").select("doc_id", "text_key", "row", "n_shingles", "component_id", "keeper")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, **limits) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id = component_id) for every document; see ``near_groups``."""
    found = near_groups(docs, words, percent, **limits)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, with all its columns.

    Of rows that repeat both id and text one stays.
    """
    found = saved(near_groups(docs, words, percent), "near-groups")
    kept = found.filter("row = keeper").select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"))
    match = docs["doc_id"].cast("bigint").eqNullSafe(kept["kept_id"]) & (F.xxhash64(docs["text"]) == kept["kept_key"])
    unique = docs.join(kept, match, "left_semi")
    repeats = found.groupBy("doc_id", "text_key").count().filter("count > 1")
    return unique if repeats.isEmpty() else unique.dropDuplicates(["doc_id", "text"])
