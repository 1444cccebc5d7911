import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from tracewarden.llm import runs


def brute(w, least=24, periods=3):
    """All runs by comparing words q apart, for every q; multiples of a smaller period go."""
    out, n = [], len(w)
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            part = w[i : j + q]
            if len(part) >= max(least, periods * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((i, len(part), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def looped(words, doc_id):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest_row(doc_id, text, edit):
    w = edit((text or "").encode().split(), doc_id)
    found = brute(w)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (
        doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


def pieces(rng, letters, upto):
    w = []
    while len(w) < upto:
        unit = [b"%d" % rng.randrange(letters) for _ in range(rng.randint(1, 12))]
        w += (unit * 12)[: rng.randint(1, 9 * len(unit))] if rng.random() < 0.6 else unit[:1]
    return w


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_words_of_few_letters(letters):
    rng = random.Random(letters)
    for _ in range(150):
        w = pieces(rng, letters, rng.randint(5, 150))
        for least, periods in ((24, 3), (3, 3), (6, 2), (3, 2), (10, 5)):
            assert runs.runs_of(w, least, periods) == brute(w, least, periods)


def test_fibonacci_words():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 300:
        a, b = b, b + a
    assert runs.runs_of(b, 3, 3) == brute(b, 3, 3)


def test_border_of_length():
    for q in (1, 7, 8, 9):
        for m in (23, 24, 25, 3 * q - 1, 3 * q, 3 * q + 1):
            w = [b"x", *([b"%d" % (i % q) for i in range(m)]), b"y"]
            assert runs.runs_of(w) == brute(w)


def test_stretches_hold_all_runs():
    rng = random.Random(8)
    for _ in range(100):
        w = [b"p%d" % rng.randrange(60) for _ in range(60)] + pieces(rng, 5, 80) + [b"p%d" % rng.randrange(60) for _ in range(60)]
        numbers = {}
        held = runs.stretches(runs.np.array([numbers.setdefault(x, len(numbers)) for x in w]))
        assert all(any(a <= s and s + m <= b for a, b in held) for s, m, _ in brute(w))


def test_long_texts_stay_near_linear():
    rng = random.Random(1)
    plain = [b"w%d" % rng.randrange(5000) for _ in range(300_000)]
    assert runs.runs_of(plain + [b"x", b"y"] * 100_000) == [(300_000, 200_000, 2)]
    unit = plain[:70_000]
    assert runs.runs_of(unit * 4) == [(0, 280_000, 70_000)]


def test_digests(edge_documents):
    rows = edge_documents.select("doc_id", "text").collect()
    for edit, plain in ((runs.as_is, lambda w, _: w), (runs.looped, looped)):
        got = runs.run_digests(edge_documents, edit).collect()
        expected = [digest_row(r.doc_id, r.text, plain) for r in rows if len(r.text or "") < 9000]
        found = sorted(map(tuple, got), key=str)
        assert len(found) == len(rows)
        assert [e for e in sorted(expected, key=str) if e not in found] == []
    assert any(r.n_runs for r in got)


def test_looped_follows_the_rule():
    for doc_id in range(300):
        words = [b"%d" % i for i in range(doc_id % 90)]
        assert runs.looped(words, doc_id) == looped(words, doc_id)


def test_runs_and_collapsed_texts(spark):
    rows = [(1, "a " + "b c " * 20 + "d", "x"), (1, None, None), (None, "z " * 30, "y"), (3, "  plain\ttext ", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")
    got = sorted(map(tuple, runs.periodic_runs(docs).collect()), key=str)
    assert got == [(1, 1, 40, 2, "b c"), (None, 0, 30, 1, "z")]
    out = runs.collapsed(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [(1, "a b c d", "x"), (1, None, None), (None, "z", "y"), (3, "  plain\ttext ", "y")], key=str
    )


def test_empty(no_documents):
    assert runs.run_digests(no_documents).collect() == []
    assert runs.periodic_runs(no_documents).collect() == []
    assert runs.collapsed(no_documents).collect() == []
