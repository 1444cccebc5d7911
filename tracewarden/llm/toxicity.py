"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its own vector, if the training sample had it, next to the sum of the vectors
of its character n-grams. Windows of words overlap; a document scores as its highest window.
Training knows labels of documents only: of a toxic document it takes the window that the
network, at first the evidence of single words, holds for the reason.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.llm.common import lean
from tracewarden.llm.decontaminate import words_of

WINDOW, STRIDE = 24, 16
#: Longer words are read in pieces of this many bytes.
WORD_BYTES = 20
GRAMS = (3, 4, 5)
BUCKETS = 1 << 18
#: Words and n-grams of fewer documents of the sample have no vector of their own.
RARE = 3
#: Documents of average label that are added to the count of each feature.
PRIOR = 8
#: Word and n-gram vectors shrink by this much of the learning rate each step.
DECAY = 0.1
WORD_DIM = CHAR_DIM = HIDDEN = 8
ATTENTION = 4
#: The training sample: at most so many toxic and so many other documents, drawn among the labelled
#: ones of at most so many characters.
SAMPLE, SAMPLE_CHARS = (1000, 3000), 200_000
THRESHOLD = 0.7
#: Windows per training step; steps per turn, at least.
BATCH, STEPS = 256, 40
#: Words that a task keeps with their inputs before it starts anew: some 30 MB.
CACHE = 100_000


def pieces(text: bytes | None) -> list[bytes]:
    """The words of a text, long ones in pieces."""
    words = words_of(text)
    if max(map(len, words), default=0) <= WORD_BYTES:
        return words
    return [w[i : i + WORD_BYTES] for w in words for i in range(0, len(w), WORD_BYTES)]


def gram_table(words: list[bytes]) -> np.ndarray:
    """Buckets of each word's n-grams, with marks for its ends; bucket 0 where there is none."""
    width = WORD_BYTES + 2
    letters = np.array([b"<" + w + b">" for w in words], dtype=f"S{width}")
    letters = letters.view(np.uint8).reshape(len(words), width).astype(np.uint32)
    size = (letters > 0).sum(axis=1)
    out = []
    for n in GRAMS:
        total = np.full((len(words), width - n + 1), n * 77, dtype=np.uint32)
        for i in range(n):
            total = (total ^ letters[:, i : width - n + 1 + i]) * np.uint32(0x01000193)
            total ^= total >> np.uint32(15)
        valid = np.arange(width - n + 1) + n <= size[:, None]
        out.append(np.where(valid, total % np.uint32(BUCKETS - 1) + np.uint32(1), 0))
    return np.concatenate(out, axis=1).astype(np.int32)


def windows(size: int) -> np.ndarray:
    """First words of overlapping windows over ``size`` words; the last one ends at the end."""
    if size <= WINDOW:
        return np.zeros(1, dtype=np.int64)
    return np.append(np.arange(0, size - WINDOW, STRIDE), size - WINDOW)


def window_table(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers per window, -1 beyond a short text, and the document of each window."""
    tables, owner = [], []
    for i, ids in enumerate(docs):
        first = windows(len(ids))
        if len(ids) < WINDOW:
            ids = np.concatenate([ids, np.full(WINDOW - len(ids), -1, dtype=ids.dtype)])
        tables.append(ids[first[:, None] + np.arange(WINDOW)])
        owner.append(np.full(len(first), i))
    return np.concatenate(tables), np.concatenate(owner)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    """Weights by name, and the two directions of computing with them.

    ``vocabulary`` numbers the words with a vector, ``spots`` the buckets of n-grams with one.
    """

    weights: dict[str, np.ndarray]
    vocabulary: dict[bytes, int]
    spots: np.ndarray

    @staticmethod
    def fresh(vocabulary: dict[bytes, int], spots: np.ndarray, rng: np.random.Generator) -> Network:
        inputs, gates = WORD_DIM + CHAR_DIM, 3 * HIDDEN

        def draw(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        weights = {
            "word": draw(len(vocabulary) + 1, WORD_DIM, scale=0.05),
            "gram": draw(int(spots.max()) + 1, CHAR_DIM, scale=0.1),
            "attend": draw(2 * HIDDEN, ATTENTION, scale=0.4),
            "query": draw(ATTENTION, scale=0.5),
            "out": draw(2 * HIDDEN, scale=0.5),
            "bias": np.zeros(1, dtype=np.float32),
        }
        for side in ("ahead", "back"):
            weights[f"in_{side}"] = draw(inputs, gates, scale=0.4)
            weights[f"own_{side}"] = draw(HIDDEN, gates, scale=0.3)
            weights[f"bias_{side}"] = np.zeros(gates, dtype=np.float32)
        weights["word"][0] = 0
        weights["gram"][0] = 0
        return Network(weights, vocabulary, spots)

    def inputs(self, words: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Word vectors beside the squashed sums of n-gram vectors."""
        total = np.zeros((len(grams), CHAR_DIM), dtype=np.float32)
        for column in grams.T:
            total += self.weights["gram"][column]
        return np.concatenate([self.weights["word"][words], np.tanh(total)], axis=1)

    def projected(self, inputs: np.ndarray) -> np.ndarray:
        """What each word adds to the gates, for both directions; a row of zeros for no word."""
        w = self.weights
        both = [inputs @ w[f"in_{s}"] + w[f"bias_{s}"] for s in ("ahead", "back")]
        out = np.concatenate(both, axis=1)
        return np.concatenate([out, np.zeros((1, out.shape[1]), dtype=np.float32)])

    def run(self, table: np.ndarray, index: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of windows. ``index`` has rows of ``table``; -1 is no word. ``keep`` gets the states."""
        w, n = self.weights, HIDDEN
        there = (index >= 0).astype(np.float32)
        full = bool(there.all())
        states = np.empty((WINDOW, len(index), 2 * n), dtype=np.float32)
        for k, side in enumerate(("ahead", "back")):
            own = w[f"own_{side}"]
            h = np.zeros((len(index), n), dtype=np.float32)
            gates = table[:, 3 * n * k : 3 * n * (k + 1)]
            for t in range(WINDOW) if side == "ahead" else range(WINDOW - 1, -1, -1):
                p, q = gates[index[:, t]], h @ own
                zr = _sigmoid(p[:, : 2 * n] + q[:, : 2 * n])
                z, r, qn = zr[:, :n], zr[:, n:], q[:, 2 * n :]
                new = np.tanh(p[:, 2 * n :] + r * qn)
                if keep is not None:
                    keep.append((side, t, h, z, r, qn, new))
                after = new + z * (h - new)
                if not full:
                    m = there[:, t : t + 1]
                    after = m * after + (1 - m) * h
                h = after
                states[t, :, n * k : n * (k + 1)] = h
        seen = np.tanh(states @ w["attend"])
        score = seen @ w["query"] + np.where(there.T > 0, 0, -1e4).astype(np.float32)
        share = np.exp(score - score.max(axis=0))
        share /= share.sum(axis=0)
        context = (share[:, :, None] * states).sum(axis=0)
        if keep is not None:
            keep.append((there, states, seen, share, context))
        return context @ w["out"] + w["bias"][0]

    def gradients(self, words: np.ndarray, grams: np.ndarray, index: np.ndarray, target: np.ndarray, weight: np.ndarray):
        """Gradients of the weighted cross entropy over windows of the given words."""
        w, n = self.weights, HIDDEN
        inputs = self.inputs(words, grams)
        keep: list = []
        logits = self.run(self.projected(inputs), index, keep)
        there, states, seen, share, context = keep.pop()
        off = ((_sigmoid(logits) - target) * weight / weight.sum()).astype(np.float32)
        out = {"out": context.T @ off, "bias": np.array([off.sum()], dtype=np.float32)}
        d_context = off[:, None] * w["out"]
        d_share = (states * d_context).sum(axis=2)
        d_score = share * (d_share - (share * d_share).sum(axis=0))
        out["query"] = np.einsum("tbk,tb->k", seen, d_score)
        d_seen = d_score[:, :, None] * w["query"] * (1 - seen**2)
        out["attend"] = np.einsum("tbi,tbk->ik", states, d_seen)
        d_states = share[:, :, None] * d_context + d_seen @ w["attend"].T
        d_table = np.zeros((len(words) + 1, 6 * n), dtype=np.float32)
        flat, pushed = [], []
        for name in ("own_ahead", "own_back"):
            out[name] = np.zeros_like(w[name])
        carried = {"ahead": 0, "back": 0}
        for side, t, h, z, r, qn, new in reversed(keep):
            k = 0 if side == "ahead" else 1
            m = there[:, t : t + 1]
            total = d_states[t, :, n * k : n * (k + 1)] + carried[side]
            d = total * m
            d_new = d * (1 - z) * (1 - new**2)
            d_z = d * (h - new) * z * (1 - z)
            d_r = d_new * qn * r * (1 - r)
            d_q = np.concatenate([d_z, d_r, d_new * r], axis=1)
            out[f"own_{side}"] += h.T @ d_q
            carried[side] = d * z + total * (1 - m) + d_q @ w[f"own_{side}"].T
            flat.append((k, index[:, t], np.concatenate([d_z, d_r, d_new], axis=1)))
        for k in (0, 1):
            rows = np.concatenate([i for side, i, _ in flat if side == k])
            values = np.concatenate([v for side, _, v in flat if side == k])
            for c in range(3 * n):
                d_table[:, 3 * n * k + c] = np.bincount(rows % (len(words) + 1), values[:, c], len(words) + 1)
        d_table = d_table[:-1]
        d_inputs = 0
        for k, side in enumerate(("ahead", "back")):
            part = d_table[:, 3 * n * k : 3 * n * (k + 1)]
            out[f"in_{side}"], out[f"bias_{side}"] = inputs.T @ part, part.sum(axis=0)
            d_inputs = d_inputs + part @ w[f"in_{side}"].T
        d_char = d_inputs[:, WORD_DIM:] * (1 - inputs[:, WORD_DIM:] ** 2)
        out["word"], out["gram"] = np.zeros_like(w["word"]), np.zeros_like(w["gram"])
        for c in range(WORD_DIM):
            out["word"][:, c] = np.bincount(words, d_inputs[:, c], len(w["word"]))
        spots, width = grams.ravel(), grams.shape[1]
        for c in range(CHAR_DIM):
            out["gram"][:, c] = np.bincount(spots, np.repeat(d_char[:, c], width), len(w["gram"]))
        for name in ("word", "gram"):
            out[name][0] = 0
            out[name][:, 0] = 0
        return out


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.weights, self.rate, self.turn = weights, rate, 0
        self.first = {k: np.zeros_like(v) for k, v in weights.items()}
        self.second = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, gradients: dict[str, np.ndarray]) -> None:
        self.turn += 1
        scale = self.rate * np.sqrt(1 - 0.99**self.turn) / (1 - 0.9**self.turn)
        for k, g in gradients.items():
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.01 * (g * g - self.second[k])
            self.weights[k] -= scale * self.first[k] / (np.sqrt(self.second[k]) + 1e-6)
            if k in ("word", "gram"):
                self.weights[k][:, 1:] *= 1 - self.rate * DECAY


def evidence(counts: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Log odds of toxic documents among those that have a feature, drawn to the average."""
    share = toxic.mean()
    odds = (counts[1] + PRIOR * share) / (counts[0] + PRIOR * (1 - share))
    return np.clip(np.log(odds * (1 - share) / share) / 3, -1.5, 1.5).astype(np.float32)


def train(texts: list[bytes], labels: list[int], seed: int = 10, turns: int = 8) -> Network | float:
    """A network from labelled texts; a constant score if only one label is there."""
    if len(set(labels)) < 2:
        return float(labels[0]) if labels else 0.0
    rng = np.random.default_rng(seed)
    toxic = np.array(labels, dtype=np.float32)
    # Words are numbered as they come; of the texts only the numbers are kept.
    every: dict[bytes, int] = {}
    docs = [np.array([every.setdefault(x, len(every)) for x in pieces(t)], dtype=np.int32) for t in texts]
    met = np.zeros((2, len(every)))
    for label, ids in zip(labels, docs, strict=True):
        met[label, np.unique(ids)] += 1
    words = list(every)
    vocabulary = {word: i + 1 for i, word in enumerate(x for x in words if met[:, every[x]].sum() >= RARE)}
    number = np.array([vocabulary.get(word, 0) for word in words], dtype=np.int32)
    stretches = range(0, len(words), 20_000)
    grams = np.concatenate([gram_table(words[i : i + 20_000]) for i in stretches])
    del every, words
    seen = np.zeros((2, BUCKETS))
    for label, ids in zip(labels, docs, strict=True):
        seen[label, np.unique(grams[np.unique(ids)])] += 1
    common = seen.sum(axis=0) >= RARE
    common[0] = False
    spots = np.where(common, np.cumsum(common), 0).astype(np.int32)
    # The first place of each vector starts from, and keeps to, the evidence of its documents.
    gram_odds, word_odds = evidence(seen, toxic), evidence(met, toxic)
    loud = word_odds * (number > 0)
    for i in stretches:
        part = slice(i, i + 20_000)
        loud[part] += np.where(common[grams[part]], gram_odds[grams[part]], 0).max(axis=1)
        grams[part] = spots[grams[part]]
    network = Network.fresh(vocabulary, spots, rng)
    network.weights["gram"][1:, 0] = gram_odds[common]
    network.weights["word"][number, 0] = np.where(number > 0, word_odds, 0)
    table, owner = window_table(docs)
    del docs
    logits = np.concatenate(
        [np.where(w >= 0, loud[w], -9).max(axis=1) for w in np.array_split(table, 1 + len(table) // 8192)]
    )
    adam = Adam(network.weights, 0.01)

    def fit(chosen: np.ndarray, target: np.ndarray, weight: np.ndarray) -> None:
        for at in range(0, len(chosen), BATCH):
            index = table[chosen[at : at + BATCH]]
            used, place = np.unique(index, return_inverse=True)
            place = place.reshape(index.shape)
            if used[0] < 0:
                used, place = used[1:], place - 1
            part = slice(at, at + BATCH)
            # A word is taken for an unknown one now and then, so that its letters have to do.
            known = np.where(rng.random(len(used)) < 0.3, 0, number[used])
            adam.step(network.gradients(known, grams[used], place, target[part], weight[part]))

    good = np.flatnonzero(toxic[owner] == 0)
    for turn in range(turns):
        if turn and turn % 2 == 0:
            parts = range(0, len(table), 8192)
            logits = np.concatenate([scored(network, number, grams, table[i : i + 8192]) for i in parts])
        order = np.lexsort((-logits, owner))
        rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        best = order[rank < np.where(toxic[owner[order]] > 0, 1, 2)]
        some = rng.choice(good, min(len(good), len(best)), replace=False)
        chosen = np.unique(np.concatenate([best, some]))
        # A small sample is gone through several times, for enough steps.
        chosen = np.concatenate([rng.permutation(chosen) for _ in range(-(-STEPS * BATCH // len(chosen)))])
        adam.rate = 0.01 if turn < turns // 2 else 0.004
        fit(chosen, toxic[owner[chosen]], np.ones(len(chosen), dtype=np.float32))
    return network


def scored(network: Network, number: np.ndarray, grams: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Logits of windows over a numbered vocabulary."""
    used, place = np.unique(index, return_inverse=True)
    place = place.reshape(index.shape)
    if used[0] < 0:
        used, place = used[1:], place - 1
    return network.run(network.projected(network.inputs(number[used], grams[used])), place)


class Scorer:
    """Scores batches of texts; remembers what words add to the gates."""

    def __init__(self, network: Network):
        self.network = network
        # The last row stays zero: it is for no word, whose number is -1.
        self.rows: dict[bytes, int] = {}
        self.table = np.zeros((1024, 6 * HIDDEN), dtype=np.float32)

    def _learn(self, words: set[bytes]) -> None:
        new = sorted(words)
        first = len(self.rows)
        if first + len(new) >= len(self.table):
            wider = np.zeros((2 * (first + len(new)) + 1, 6 * HIDDEN), dtype=np.float32)
            wider[:first] = self.table[:first]
            self.table = wider
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            number = np.array([self.network.vocabulary.get(x, 0) for x in some], dtype=np.int64)
            inputs = self.network.inputs(number, self.network.spots[gram_table(some)])
            self.table[first + at : first + at + len(some)] = self.network.projected(inputs)[:-1]
        self.rows.update({x: first + i for i, x in enumerate(new)})

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        split = [pieces(t) for t in texts]
        if len(self.rows) > CACHE:
            self.rows = {}
            self.table[:] = 0
        missing = set().union(*split) - self.rows.keys()
        if missing:
            self._learn(missing)
        rows = self.rows
        table, owner = window_table([np.array([rows[x] for x in words], dtype=np.int32) for words in split])
        best = np.full(len(texts), -np.inf)
        for at in range(0, len(table), 2048):
            logits = self.network.run(self.table, table[at : at + 2048])
            np.maximum.at(best, owner[at : at + 2048], logits)
        return _sigmoid(best)


def learned(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> Network | float:
    """Trains on at most ``sample`` documents, toxic and others, of rows that are not held out."""
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("_toxic"))
    )
    texts = docs.select("doc_id", "text").filter(F.length("text").between(1, SAMPLE_CHARS))
    known = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    # Ids are drawn by hash among labelled rows.
    drawn = known.filter("_toxic > 0").orderBy(F.xxhash64("doc_id")).limit(sample[0]).union(
        known.filter("_toxic <= 0").orderBy(F.xxhash64("doc_id")).limit(sample[1])
    )
    # One text per id, however often an id is there.
    rows = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "_toxic").agg(F.min("text").alias("text")).toArrow()
    rows = zip(rows["doc_id"].to_pylist(), rows["text"].cast(pa.binary()).to_pylist(), rows["_toxic"].to_pylist(), strict=True)
    _, found, toxic = zip(*sorted(rows), strict=True) if (rows := list(rows)) else ((), (), ())
    return train(list(found), [int(y > 0) for y in toxic])


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def score_documents(docs: DataFrame, model: Network | float) -> DataFrame:
    """_d (a struct of all columns of ``docs``) and _score, from 0 to 1 for every whole text.

    Null and empty texts, and texts without words, are one empty window. Repeated rows score
    alike. No shuffle; texts alone go to the workers and scores come back; a task holds one batch
    of texts and the inputs of ``CACHE`` words.
    """
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_d"))
    if isinstance(model, float):
        return rows.withColumn("_score", F.lit(model))
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.vocabulary, model.spots))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(Network(*shared.value))
        for texts in batches:
            scores = [scorer.scores(texts.slice(at, 128).cast(pa.binary()).to_pylist()) for at in range(0, len(texts), 128)]
            yield pa.array(np.concatenate([np.empty(0), *scores]), pa.float64())

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from lean(run)(batches)

    return rows.withColumn("_score", score("_d.text"))


def toxicity(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scores = score_documents(docs.select("doc_id", "text"), learned(docs, labels, sample))
    return scores.select("_d.doc_id", F.col("_score").alias("score")).select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def civil_documents(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> DataFrame:
    """The documents below the threshold, as they are."""
    return score_documents(docs, learned(docs, labels, sample)).filter(F.col("_score") < THRESHOLD).select("_d.*")
