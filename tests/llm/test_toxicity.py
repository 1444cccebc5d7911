import random
import zlib

import numpy as np
import pytest

from tracewarden.llm import toxicity


def made_up(n, seed=1):
    """Prose where toxic texts hold a bad word or a word with a bad beginning."""
    rng = random.Random(seed)
    parts = ["al", "be", "cor", "du", "fin", "gos", "il", "jon", "ra", "te"]
    word = lambda: "".join(rng.choices(parts, k=rng.randint(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 120))]
        toxic = int(rng.random() < 0.2)
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["rotter", "vek" + word()])
        rows.append((i, " ".join(words), toxic))
    return rows


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_gradients():
    rng = np.random.default_rng(0)
    words = [b"abc", b"hello", b"xyzzyq", b"foo"]
    grams = toxicity.gram_table(words)
    spots = np.zeros(toxicity.BUCKETS, np.int32)
    used = np.unique(grams)
    spots[used] = np.arange(len(used))
    grams = spots[grams]
    net = toxicity.Network.fresh({w: i + 1 for i, w in enumerate(words)}, spots, rng)
    for k in net.weights:
        net.weights[k] = net.weights[k].astype(np.float64)
    number = np.arange(1, 5)
    index = rng.integers(0, 4, (7, toxicity.WINDOW))
    index[3, 5:] = -1
    target, weight = rng.integers(0, 2, 7).astype(float), rng.random(7)

    def loss():
        p = 1 / (1 + np.exp(-net.run(net.projected(net.inputs(number, grams)), index)))
        return -((target * np.log(p) + (1 - target) * np.log(1 - p)) * weight).sum() / weight.sum()

    gradients = net.gradients(number, grams, index, target, weight)
    for name, values in net.weights.items():
        spot = tuple(int(rng.integers(0, s)) for s in values.shape)
        if name in ("word", "gram"):  # the first place is fixed evidence
            spot = (1, 3)
        kept = values[spot]
        values[spot] = kept + 1e-2
        high = loss()
        values[spot] = kept - 1e-2
        low = loss()
        values[spot] = kept
        assert gradients[name][spot] == pytest.approx((high - low) / 2e-2, rel=0.05, abs=3e-4), name


def test_windows_cover_every_word():
    for n in (0, 1, 23, 24, 25, 40, 41, 500):
        first = toxicity.windows(n)
        seen = {i for f in first for i in range(f, min(n, f + toxicity.WINDOW))}
        assert seen == set(range(n))


def test_held_out_accuracy(spark):
    rows = made_up(1500)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, _score string").repartition(3)
    labels = spark.createDataFrame([(i, 1 - y, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(r.held_out == held_out(i) and r.predicted == int(r.score >= 0.7) for i, r in got.items())
    pairs = [(got[i].predicted, y) for i, _, y in rows if held_out(i)]
    assert sum(p for p, y in pairs if y) / sum(y for _, y in pairs) > 0.9
    assert sum(p for p, y in pairs if not y) / sum(1 - y for _, y in pairs) < 0.03
    kept = toxicity.civil_documents(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_labels_of_held_out_rows_are_not_learned(spark):
    rows = made_up(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flipped = [(i, 1 - y if held_out(i) else y) for i, _, y in rows]
    one, other = (
        {r.doc_id: r.score for r in toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
        for labels in ([(i, y) for i, _, y in rows], flipped)
    )
    assert one == other


def test_edges(spark, edge_documents, no_documents):
    labels = [(i * 3, None if i == 4 else i % 2) for i in range(40)] + [(None, 1), (3, 0), (9999, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = toxicity.toxicity(edge_documents, labels).collect()
    assert len(rows) == edge_documents.count()
    assert all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id is not None and r.doc_id in (33, 36, 39)}) == 1  # no words
    assert toxicity.toxicity(no_documents, labels).collect() == []
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity(edge_documents, none).collect()} == {0}


def test_forward_pass_equals_a_plain_loop():
    """One window, word by word, in both directions, with attention over the words that are there."""
    from math import exp, tanh

    rng = np.random.default_rng(4)
    words = [b"abc", b"hello", b"xyzzyq"]
    grams = toxicity.gram_table(words)
    spots = np.zeros(toxicity.BUCKETS, np.int32)
    used = np.unique(grams)
    spots[used] = np.arange(len(used))
    grams = spots[grams]
    net = toxicity.Network.fresh({w: i + 1 for i, w in enumerate(words)}, spots, rng)
    w = {k: v.astype(np.float64).tolist() for k, v in net.weights.items()}
    sigmoid = lambda x: 1 / (1 + exp(-x))
    times = lambda v, m: [sum(a * row[j] for a, row in zip(v, m, strict=True)) for j in range(len(m[0]))]
    inputs = []
    for i in range(3):
        chars = [tanh(sum(w["gram"][g][j] for g in grams[i])) for j in range(toxicity.CHAR_DIM)]
        inputs.append(w["word"][i + 1] + chars)

    def direction(seq, side):
        n, h, out = toxicity.HIDDEN, [0.0] * toxicity.HIDDEN, []
        for x in seq:
            p = [a + b for a, b in zip(times(x, w[f"in_{side}"]), w[f"bias_{side}"], strict=True)]
            q = times(h, w[f"own_{side}"])
            z = [sigmoid(p[j] + q[j]) for j in range(n)]
            r = [sigmoid(p[n + j] + q[n + j]) for j in range(n)]
            new = [tanh(p[2 * n + j] + r[j] * q[2 * n + j]) for j in range(n)]
            h = [z[j] * h[j] + (1 - z[j]) * new[j] for j in range(n)]
            out.append(h)
        return out

    windows, expected = [], []
    for size in (1, 5, toxicity.WINDOW):
        ids = rng.integers(0, 3, size).tolist()
        seq = [inputs[i] for i in ids]
        both = [a + b for a, b in zip(direction(seq, "ahead"), direction(seq[::-1], "back")[::-1], strict=True)]
        scores = [sum(tanh(s) * q for s, q in zip(times(h, w["attend"]), w["query"], strict=True)) for h in both]
        total = sum(map(exp, scores))
        context = [sum(exp(s) / total * h[j] for s, h in zip(scores, both, strict=True)) for j in range(2 * toxicity.HIDDEN)]
        expected.append(sum(c * o for c, o in zip(context, w["out"], strict=True)) + w["bias"][0])
        windows.append(ids + [-1] * (toxicity.WINDOW - size))
    table = net.projected(net.inputs(np.arange(1, 4), grams))
    assert net.run(table, np.array(windows)) == pytest.approx(expected, abs=1e-4)


def test_the_cache_of_words_changes_no_score(monkeypatch):
    texts = [t.encode() for _, t, _ in made_up(300)]
    labels = [y for _, _, y in made_up(300)]
    net = toxicity.train(texts, labels, turns=1)
    whole = toxicity.Scorer(net).scores(texts)
    monkeypatch.setattr(toxicity, "CACHE", 40)
    scorer = toxicity.Scorer(net)
    parts = np.concatenate([scorer.scores(texts[i : i + 7]) for i in range(0, 300, 7)])
    assert parts == pytest.approx(whole, abs=1e-5)


def test_texts_alone_go_to_the_workers(edge_documents):
    """Rows stay where they are while their texts are scored; only scores come back."""
    vocabulary, spots = {b"al": 1}, np.zeros(toxicity.BUCKETS, dtype=np.int32)
    model = toxicity.Network.fresh(vocabulary, spots, np.random.default_rng(1))
    out = toxicity.score_documents(edge_documents, model)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
    scorer = toxicity.Scorer(model)
    for r in out.select("_d.doc_id", "_d.text", "_score").collect():
        assert abs(r._score - scorer.scores([None if r.text is None else r.text.encode()])[0]) < 1e-6
