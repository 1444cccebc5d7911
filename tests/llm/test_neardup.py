import random
from collections import Counter

import pytest

from tracewarden.llm import neardup
from tracewarden.llm.components import components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = (text or "").translate(FOLD).encode().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(docs, n=5):
    sets = [(d, shingles(t, n)) for d, t in docs]
    least = {d: d for d, _ in sets}
    changed = True
    links = [
        (a, b)
        for a, x in sets
        for b, y in sets
        if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y)
    ]
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            if least[a] != low or least[b] != low:
                least[a] = least[b] = low
                changed = True
    return Counter((d, len(s), least[d], least[d] == d) for d, s in sets)


@pytest.mark.parametrize("n", [4, 5])
def test_edges(edge_documents, n):
    got = neardup.near_duplicates(edge_documents, words=n).collect()
    assert Counter(map(tuple, got)) == brute([(r.doc_id, r.text) for r in edge_documents.collect()], n)


def test_families(spark):
    """Copies that drift from a base: many are linked over others only, many are not."""
    rng = random.Random(3)
    docs = []
    for family in range(4):
        base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        for _ in range(40):
            copy = list(base)
            for _ in range(rng.randrange(0, 14)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            docs.append(" ".join(copy))
    rng.shuffle(docs)
    rows = list(enumerate(docs))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4)
    assert Counter(map(tuple, got.collect())) == brute(rows, 4)


def test_one_of_each_group_stays(edge_documents):
    out = neardup.distinct_documents(edge_documents)
    assert out.columns == edge_documents.columns
    kept = {r[0] for r in brute([(r.doc_id, r.text) for r in edge_documents.collect()]) if r[3]}
    assert {r.doc_id for r in out.collect()} == kept


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (95, 100), (7, 7), (200, 201), (200, 201)]
    got = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    expected = {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90, 200: 200, 201: 200}
    assert got == expected


def test_empty(no_documents):
    assert neardup.near_duplicates(no_documents).collect() == []
    assert neardup.distinct_documents(no_documents).collect() == []


def test_texts_are_found_without_a_shuffle(spark):
    """The filter keeps every wanted row, few others, and no exchange lies above the texts."""
    docs = spark.createDataFrame([(i - 3000, f"text {i}") for i in range(20000)] + [(None, "none")], "node long, text string")
    wanted = spark.range(-3000, 17000, 20).withColumnRenamed("id", "node")
    found = neardup._among(docs, wanted)
    assert found.columns == docs.columns
    nodes = {r.node for r in found.collect()}
    assert {r.node for r in wanted.collect()} <= nodes and len(nodes) < 1000 + 19000 / 8
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert neardup._among(docs, wanted.limit(0)).collect() == []
