import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tracewarden.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000])
def test_permutation(n):
    assert sorted(mixing.permuted(np.arange(n), n, 5)) == list(range(n))


def test_shards_share_all_slots():
    spans = [mixing.dealt(1000, shard, 7, 3) for shard in range(7)]
    assert sum(n for _, n in spans) == 1000
    assert [first for first, _ in spans] == list(np.cumsum([0] + [n for _, n in spans])[:-1])


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000])
def test_place_of_undoes_the_permutation(n):
    for key in (0, 5, 77):
        assert [mixing.place_of(int(x), n, key) for x in mixing.permuted(np.arange(n), n, key)] == list(range(n))


@pytest.mark.parametrize("size", [1, 5, 20, 63, 64, 65, 130, 1000])
def test_slots_give_exactly_the_words_asked_for(size):
    """Also for sources below a block, and wherever the short block comes."""
    blocks = -(-size // 64)
    of = [min(64, size - 64 * b) for b in range(blocks)]
    for words in range(0, 2 * size + 1):
        slots, rest = mixing.slots_for(words, size, 64, 3)
        sizes = [of[b] for t in (0, 1) for b in mixing.permuted(np.arange(blocks), blocks, mixing.pass_key(3, t))]
        assert sum(sizes[: max(slots - 1, 0)]) + rest == words
        assert not slots or 0 < rest <= sizes[slots - 1]


@pytest.mark.parametrize("size", [1, 20, 65])
def test_a_small_source_stays_in_the_mix(spark, size):
    rows = [(1, "w " * size, "small"), (2, "v " * 5000, "large"), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for r in mixing.taken_words(docs).collect():
        assert r.taken == int(r.target + 0.5)


def test_repeated_rows_and_names_with_dots(spark):
    rows = [(1, "a b c d e", "s", i % 2) for i in range(50)] + [(2, "x " * 700, "t", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `x.y` int")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = Counter((r.doc_id, w) for r in out.collect() for w in r.text.split())
    taken = Counter()
    for r in mixing.taken_words(docs).collect():
        taken[r.doc_id] += r.taken
    assert {d: sum(n for (e, _), n in words.items() if e == d) for d in (1, 2)} == dict(taken)


def test_targets_share_the_excess():
    out = mixing.targets([10, 100, 100], (3, 1, 2), Fraction(3, 2), 2)
    assert out[0] == 20 and sum(out) == 315 and max(out) <= 200
    assert mixing.targets([], (3, 1, 2), Fraction(3, 2), 2) == []
    assert mixing.targets([0, 5], (3, 1), Fraction(3, 2), 2) == [0, Fraction(15, 2)]


def test_edges(edge_documents):
    rows = mixing.taken_words(edge_documents, block_words=16, shard_slots=32).collect()
    again = mixing.taken_words(edge_documents, block_words=16, shard_slots=32).collect()
    assert Counter(rows) == Counter(again)
    known = edge_documents.collect()
    sizes = Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in known)
    assert Counter((r.doc_id, r["size"]) for r in rows) == sizes
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    per_source = defaultdict(int)
    for r in known:
        per_source[r.source] += len(WORD.findall(r.text or ""))
    assert {r.source_size for r in rows} == set(per_source.values())
    taken = Counter()
    for r in rows:
        taken[r.source_size, r.target] += r.taken
    for (_, target), n in taken.items():
        assert n == int(target + 0.5)


def test_mix_holds_every_slot_once(edge_documents):
    mix, known = mixing.mix_documents(edge_documents, block_words=16, shard_slots=32)
    rows = mix.collect()
    slots = {(r.shard, r.slot) for r in rows}
    assert len({(r.shard, r.slot, r.sid, r["pass"], r.block) for r in rows}) == len(slots)
    for shard in {s for s, _ in slots}:
        mine = sorted(slot for s, slot in slots if s == shard)
        assert mine == list(range(len(mine)))
    assert len({(r.sid, r["pass"], r.block) for r in rows}) == len(slots)


def test_mixed_texts(edge_documents):
    out = mixing.mixed_documents(edge_documents, block_words=16)
    assert out.columns == edge_documents.columns
    words, limit = Counter(), Counter()
    for r in edge_documents.collect():
        limit.update({(r.doc_id, w): 2 * n for w, n in Counter(WORD.findall(r.text or "")).items()})
    for r in out.collect():
        found = WORD.findall(r.text)
        assert found and r.n_chars == len(r.text)
        words.update((r.doc_id, w) for w in found)
    assert all(n <= limit[k] for k, n in words.items())
    total = sum(r.taken for r in mixing.taken_words(edge_documents, block_words=16).collect())
    assert sum(words.values()) == total


def test_empty(no_documents):
    assert mixing.taken_words(no_documents).collect() == []
    assert mixing.mixed_documents(no_documents).collect() == []
