import zlib
from collections import Counter, defaultdict

import numpy as np

from tracewarden.llm import packing


def test_edges(edge_documents):
    got = packing.shard_listing(edge_documents, 5).collect()
    expected = Counter(
        (r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in edge_documents.collect()
    )
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == expected
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert set(slots) <= set(range(5))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_hot_group_is_split_and_sizes_are_near(spark):
    rows = [(i, "copy of one text") for i in range(3000)] + [(i, f"text {i} " * (i % 90)) for i in range(3000, 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.shard_listing(docs, 8).collect()
    bytes_, counts = Counter(), Counter()
    for r in got:
        bytes_[r.shard] += r["size"]
        counts[r.shard] += 1
    sizes = np.array(list(bytes_.values()))
    assert len(sizes) == 8 and sizes.max() / sizes.min() < 1.01
    groups = defaultdict(set)
    texts = dict(rows)
    for r in got:
        groups[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for text, s in groups.items() if text != "copy of one text")
    assert max(counts.values()) / min(counts.values()) < 1.5


def test_shards_of_rows(edge_documents):
    out = packing.with_shards(edge_documents, 4)
    plain = [c for c in edge_documents.columns if c != "shard"]
    assert out.columns == [*plain, "shard"]
    assert Counter(out.select(plain).collect()) == Counter(edge_documents.select(plain).collect())


def test_empty(no_documents):
    assert packing.shard_listing(no_documents, 3).collect() == []
    assert packing.with_shards(no_documents, 3).collect() == []


def test_each_item_goes_where_the_product_with_the_residual_is_highest():
    """The placement against a plain loop, up to what floats cannot tell."""
    rng = np.random.default_rng(3)
    for shards in (1, 3, 7):
        weights = rng.pareto(1.5, (60, 3)) + 0.01
        weights[10:14] = weights[9]
        where = packing.place(weights, shards)
        capacity = weights.sum(axis=0) / shards
        share = weights / capacity
        residual = [[1.0] * 3 for _ in range(shards)]
        for i in sorted(range(60), key=lambda i: (-max(share[i]), i)):
            joint = min(1.0, 8 * max(share[i])) / 2
            look = [share[i][0], share[i][1] * joint, share[i][2] * joint]
            fits = [sum(a * b for a, b in zip(left, look, strict=True)) for left in residual]
            assert fits[where[i]] >= max(fits) - 1e-9
            residual[where[i]] = [a - b for a, b in zip(residual[where[i]], share[i], strict=True)]


def test_groups_up_to_half_a_shard_stay_whole(spark):
    """All rows weigh the same, so a shard's capacity is that of 100 rows."""
    for copies, split in ((50, False), (52, True)):
        rows = [(i, "same text..") for i in range(copies)] + [(i, f"text {i:06d}") for i in range(copies, 400)]
        got = packing.with_shards(spark.createDataFrame(rows, "doc_id long, text string"), 4)
        shards = {r.shard for r in got.filter("text = 'same text..'").collect()}
        assert (len(shards) > 1) == split
