import hashlib
import math
import random

import numpy as np
import pytest

from tracewarden.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, v string, codes string, _label string, error long"


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """The contract in plain loops over Python integers."""
    kept = [
        (i, [math.floor(scale * x) for x in v], label)
        for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    if not kept:
        return []
    w = len(kept[0][1]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))
    books = [[cut[i][p] for i in order[:entries]] for p in range(parts)]

    def choose(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            taken = [choose(c[p], books[p])[1] for c in cut]
            new = list(books[p])
            for e in range(len(new)):
                mine = [c[p] for c, t in zip(cut, taken, strict=True) if t == e]
                if mine:
                    new[e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
            books[p] = new
    best = [[choose(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in b) for b in best]
    total = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        total[label] = total.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return [
        (i, "".join(f"{e:02x}" for _, e in b), error, total[label], digest)
        for (i, _, label), b, error in zip(kept, best, errors, strict=True)
    ]


def f32(x):
    return float(np.float32(x))


def rows_of(n, width=16, seed=1, spread=1.0):
    rng = random.Random(seed)
    rows = [(i, [f32(rng.gauss(0, spread)) for _ in range(width)], rng.choice([0, 1, None])) for i in range(n)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", 7) for r in rows], SCHEMA)


def run(spark, rows):
    return sorted(map(tuple, codes.vector_codes(frame(spark, rows).repartition(3)).collect()), key=str)


@pytest.mark.parametrize("n", [1, 5, 16, 150])
def test_plain_vectors(spark, n):
    rows = rows_of(n)
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_edges(spark):
    """Nulls, infinite and undefined components, ties, repeated rows, negative ids, exact steps."""
    rows = rows_of(40)
    nan, inf = float("nan"), float("inf")
    rows += [(100, None, 1), (101, [None, *rows[0][1][1:]], 1), (102, [nan, *rows[0][1][1:]], 1)]
    rows += [(103, [*rows[0][1][:-1], inf], 0), (104, [-inf, *rows[0][1][1:]], None)]
    rows += [rows[3], rows[3], rows[5], (None, rows[7][1], None), (-5, [0.0] * 16, None), (-6, [-1 / 8192] * 16, 2)]
    rows += [(200 + i, rows[i][1], 0) for i in range(10)]
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_large_components(spark):
    """More than one limb: integers of some 27 bits."""
    rows = rows_of(60, seed=4, spread=1e4)
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_products_are_exact():
    rng = np.random.default_rng(0)
    for high in (1, 1 << 20, 1 << 26, 1 << 28):
        one = rng.integers(-high, high, (7, 40), endpoint=True)
        other = rng.integers(-high, high, (40, 5), endpoint=True)
        expected = [[sum(int(a) * int(b) for a, b in zip(r, c, strict=True)) for c in other.T] for r in one]
        assert codes.exact_product(one, other).tolist() == expected


def test_ties_go_to_the_lower_entry():
    books = np.array([[[0, 0], [4, 0], [0, 0]]])
    code, error = codes.nearest(np.array([[2, 0], [0, 0], [4, 1]]), books)
    assert code.tolist() == [[0], [0], [1]]
    assert error.tolist() == [[4], [0], [1]]


def test_decoded(spark):
    vectors = codes.integer_vectors(frame(spark, rows_of(30)).select("vec_id", "label", "embedding"), codes.F.col("embedding"))
    vectors = vectors.select("vec_id", "label", "v").cache()
    books = codes.train(vectors)
    out = codes.decoded(codes.encode(vectors, books), books).join(vectors.drop("label"), "vec_id").collect()
    for r in out:
        assert sum((round(4096 * x) - y) ** 2 for x, y in zip(r.vector, r.v, strict=True)) == r.error


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, 1), (2, [None] * 16, None)]) == []
    rows = [(1, [], 1), (2, [], None)]
    assert [r[:4] for r in run(spark, rows)] == [(1, "00" * 8, 0, 0), (2, "00" * 8, 0, 0)]


def test_what_does_not_fit_is_refused(spark):
    with pytest.raises(ValueError, match="multiple of 8"):
        codes.vector_codes(frame(spark, [(1, [1.0] * 9, 0)]))
    with pytest.raises(Exception, match="64 bits"):
        codes.vector_codes(frame(spark, [(1, [1e15] * 16, 0)])).collect()
