import random

import numpy as np
import pytest
import xxhash

from tracewarden.llm import simhash

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_print(text, words=4):
    w = (text or "").translate(FOLD).encode().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), seed=42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius=4):
    """Smallest index reached over links, for each fingerprint."""
    least = list(range(len(prints)))
    links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(least[i], least[j])
            if (least[i], least[j]) != (low, low):
                least[i] = least[j] = low
                changed = True
    return least


def check(docs, got):
    rows = [(r.doc_id, plain_print(r.text)) for r in docs.select("doc_id", "text").collect()]
    least = plain_groups([p for _, p in rows])
    smallest = {}
    for (doc_id, _), g in zip(rows, least, strict=True):
        smallest[g] = min((x for x in (smallest.get(g), doc_id) if x is not None), default=None)
    expected = sorted(((d, f"{p:016x}", smallest[g]) for (d, p), g in zip(rows, least, strict=True)), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == expected


def test_edges(edge_documents):
    check(edge_documents, simhash.near_duplicates(edge_documents))


def test_empty(no_documents):
    assert simhash.near_duplicates(no_documents).collect() == []


def test_null_ids_alone(spark):
    got = simhash.near_duplicates(spark.createDataFrame([(None, "a b"), (None, "a b"), (4, None)], "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(None, f"{plain_print('a b'):016x}", None)] * 2 + [(4, "0" * 16, 4)], key=str
    )


def test_hash_is_that_of_the_sql_function(spark):
    row = spark.sql("SELECT xxhash64('é b') AS h").first()
    assert simhash.fingerprint("É B".lower().encode()) == row.h % (1 << 64)


def test_drifting_copies(spark):
    rng = random.Random(2)
    docs = []
    for _ in range(5):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        for _ in range(40):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            docs.append(" ".join(copy))
    rng.shuffle(docs)
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    check(table, simhash.near_duplicates(table))


@pytest.fixture(scope="module")
def many():
    """Fingerprints at all distances up to 8, in clusters, and a large part alike in 30 bits."""
    rng = random.Random(9)
    out = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            out.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 9))))
    shared = rng.getrandbits(30) << 34
    out |= {shared | rng.getrandbits(14) for _ in range(600)}
    return sorted(out | {0, 15, (1 << 64) - 1})


@pytest.mark.parametrize("agree", [1, 2, 3, 4])
def test_tiles_find_all_links(spark, many, agree, monkeypatch):
    """Whatever the number of agreeing blocks, and with buckets that are cut into many tiles."""
    monkeypatch.setattr(simhash, "agreeing", lambda *_: agree)
    table = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in many], "print long").cache()
    edges = simhash.print_links(table, tile=16).collect()
    found = plain_groups(many)
    number = {x - (1 << 64) if x >> 63 else x: i for i, x in enumerate(many)}
    root = list(range(len(many)))
    changed = True
    pairs = [(number[e.a], number[e.b]) for e in edges]
    assert all((many[i] ^ many[j]).bit_count() > 0 for i, j in pairs)
    while changed:
        changed = False
        for i, j in pairs:
            low = min(root[i], root[j])
            if (root[i], root[j]) != (low, low):
                root[i] = root[j] = low
                changed = True
    assert root == found


def test_masks():
    for radius in (0, 1, 4):
        for agree in (1, 2, 3, 4):
            found = [m % (1 << 64) for m in simhash.masks(radius, agree)]
            rng = random.Random(radius)
            for _ in range(200):
                gone = sum(1 << b for b in rng.sample(range(64), radius))
                assert any(m & gone == 0 for m in found)


def test_blocks_follow_the_number_of_prints():
    assert [simhash.agreeing(n, 4, 8192) for n in (0, 10**6, 10**8, 10**10, 10**12)] == [1, 1, 2, 2, 3]


def test_tile_pairs():
    rng = np.random.default_rng(3)
    one = rng.integers(0, 1 << 20, 300).astype(np.uint64)
    other = one[:50] ^ np.uint64(0b1011)
    a, b = simhash.tile_links(one, other, 3)
    assert len(a) <= 350
    assert set(other.tolist()) <= set(a.tolist()) | set(b.tolist())
    none = simhash.tile_links(one[:1], np.array([(1 << 64) - 1], dtype=np.uint64), 3)
    assert len(none[0]) == 0
