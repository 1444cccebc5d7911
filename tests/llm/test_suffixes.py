import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tracewarden.llm import suffixes


@pytest.mark.parametrize("n", [2, 5, 60, 900])
def test_suffix_array(n):
    rng = np.random.default_rng(n)
    text = rng.integers(97, 99, n).astype(np.uint8)
    text[n // 2 : n // 2 + n // 4] = text[: n // 4]
    data = text.tobytes()
    order, rank = suffixes.refined(text)
    assert order.tolist() == sorted(range(n), key=lambda i: data[i:])
    assert rank[order].tolist() == list(range(n))
    shared = suffixes.common_prefixes(text, order, 30)
    for k in range(1, n):
        a, b = data[order[k] :], data[order[k - 1] :]
        same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert shared[k] == min(same, 30)


def brute(docs, length):
    """By document, in order: every window is looked up among those that start earlier."""
    seen, out = set(), {}
    for key, text in sorted(set(docs), key=lambda r: (r[0] is None, r[0])):
        data = (text or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = True
            seen.add(window)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out[key, text or ""] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return Counter((d, *out[d, t or ""]) for d, t in docs)


def passages(rng):
    """Copies, shared passages, runs of one letter and repeats inside a text."""
    words = ["alpha", "be", "gam", "é", "x\x00y", "delta zeta"]
    base = [" ".join(rng.choices(words, k=150)) for _ in range(4)]
    for i in range(60):
        kind = i % 6
        if kind == 0:
            yield " ".join(rng.choices(words, k=rng.randint(1, 200)))
        elif kind == 1:
            yield base[i % 4]
        elif kind == 2:
            yield " ".join(rng.choices(words, k=9)) + base[i % 4][20 : 120 + rng.randint(0, 300)] + "end"
        elif kind == 3:
            yield "a" * rng.randint(0, 400)
        elif kind == 4:
            yield "b" * rng.randint(0, 9) + "a passage of some words " * rng.randint(1, 15)
        else:
            yield ["", None, "short"][i % 3]


@pytest.mark.parametrize("limits", [{}, {"GROUP": 2, "CHUNK": 150, "SHARD": 400}])
def test_against_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(suffixes, name, value)
    rng = random.Random(8)
    rows = [(i * 7 % 61, text) for i, text in enumerate(passages(rng))]
    got = suffixes.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"))
    got = got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == brute(rows, 100)


def test_edges(edge_documents):
    got = suffixes.repeated_bytes(edge_documents)
    got = got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    rows = [(r.doc_id, r.text) for r in edge_documents.collect()]
    # Two rows without a doc_id differ in their texts; one of them is empty, so their order is no matter.
    assert Counter(map(tuple, got)) == brute(rows, 100)


def test_empty(no_documents):
    assert suffixes.repeated_bytes(no_documents).collect() == []
