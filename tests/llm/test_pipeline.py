"""The pipeline against its stages, and its filters against plain loops."""

import os
from collections import Counter

import pytest

import corpus_pipeline
from tracewarden.llm import queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_registry():
    numbers = [name.split("_")[0] for name in queries.REGISTRY if name.startswith("op")]
    assert sorted(numbers) == sorted(f"op{n}" for n in range(1, 11))
    assert "pipeline" in queries.REGISTRY and set(queries.ORACLES) <= set(queries.REGISTRY)


def test_stages(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs, columns = documents, documents.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR).cache()
        seen[name] = docs.collect()
        assert docs.columns[: len(columns)] == columns
        assert docs.columns == columns or name == "sharding"
    originals = {r.doc_id: r for r in documents.collect()}
    before = Counter(originals.values())
    for name in ("toxicity", "near_duplicates", "decontamination"):
        after = Counter(seen[name])
        assert after and not after - before
        before = after
    kept = {r.doc_id for r in seen["decontamination"]}
    assert {r.doc_id for r in seen["mixing"]} <= kept
    words = {r.doc_id: Counter((r.text or "").split()) for r in seen["decontamination"]}
    taken = Counter()
    for r in seen["mixing"]:
        taken.update((r.doc_id, w) for w in r.text.split())
        assert (r.lang, r.source) == (originals[r.doc_id].lang, originals[r.doc_id].source)
    assert all(n <= 2 * words[d][w] for (d, w), n in taken.items())
    assert Counter(r[:-1] for r in map(tuple, seen["sharding"])) == Counter(map(tuple, seen["mixing"]))
    assert {r.shard for r in seen["sharding"]} <= set(range(corpus_pipeline.SHARDS))
    whole = corpus_pipeline.run(spark, SF_DIR).collect()
    assert Counter(whole) == Counter(seen["sharding"])
