"""Periodic runs of words: suffix automaton, last ends along its paths, cubes, maximal runs.

A run is a stretch of words with a smallest period that no neighbouring word extends. Words are
appended one by one. Each access of a prefix's state recolours the path from there to the root
with the new end; the segments of the path that had one colour before tell which suffixes ended
where last. An older end at a distance that a segment's longest suffix spans shows a repetition
with that smallest period, which is then extended to both sides.

The tree of suffix links is known before the first access, so its preferred paths are kept per
heavy chain as stacks of coloured segments instead of in splay trees; an access costs the same
recolourings.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has so many words and so many periods at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of the grams by which stretches that may hold a run are found.
GRAM = 8
#: Rounds in which such stretches are narrowed.
ROUNDS = 6

Run = tuple[int, int, int]  # start, length, period


class Automaton:
    """The suffix automaton of a sequence of small integers: lengths, suffix links, prefix states.

    A state's first transition lies in two arrays, as most states have no other one.
    """

    def __init__(self, codes: list[int]):
        width = max(codes, default=0) + 1
        length, link, word, to = [0], [-1], [-1], [0]
        more: dict[int, int] = {}
        others: dict[int, list[int]] = {}
        prefixes = []
        last = 0
        for c in codes:
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            word.append(-1)
            to.append(0)
            p = last
            while p >= 0:
                if word[p] == c or p * width + c in more:
                    break
                if word[p] < 0:
                    word[p], to[p] = c, new
                else:
                    more[p * width + c] = new
                    others.setdefault(p, []).append(c)
                p = link[p]
            if p >= 0:
                q = to[p] if word[p] == c else more[p * width + c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    word.append(word[q])
                    to.append(to[q])
                    if q in others:
                        others[copy] = list(others[q])
                        for x in others[q]:
                            more[copy * width + x] = more[q * width + x]
                    while p >= 0:
                        if word[p] == c:
                            if to[p] != q:
                                break
                            to[p] = copy
                        else:
                            if more.get(p * width + c) != q:
                                break
                            more[p * width + c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            prefixes.append(new)
            last = new
        self.length, self.link, self.prefixes = length, link, prefixes

    def heads(self) -> list[int]:
        """For each state the top of its heavy chain in the tree of suffix links."""
        length, link = self.length, self.link
        order = np.argsort(np.array(length), kind="stable").tolist()
        size = [1] * len(length)
        for v in reversed(order[1:]):
            size[link[v]] += size[v]
        heavy = [0] * len(length)
        largest = [0] * len(length)
        for v in order[1:]:
            if size[v] > largest[link[v]]:
                largest[link[v]], heavy[link[v]] = size[v], v
        head = list(range(len(length)))
        for v in order[1:]:
            if link[v] and heavy[link[v]] == v:
                head[v] = head[link[v]]
        return head


def _runs_of(codes: list[int], least: int, periods: int) -> list[Run]:
    """The runs of one stretch, by the automaton."""
    tree = Automaton(codes)
    length, link, head = tree.length, tree.link, tree.heads()
    chains: dict[int, list[tuple[int, int]]] = {}
    ends: dict[int, int] = {}  # period: end of its last repetition
    found = []
    n, spans = len(codes), periods - 1

    def extended(start: int, end: int, d: int) -> None:
        while start and codes[start - 1] == codes[start - 1 + d]:
            start -= 1
        while end < n and codes[end] == codes[end - d]:
            end += 1
        ends[d] = end
        if end - start >= max(least, periods * d):
            found.append((start, end - start, d))

    for i, v in enumerate(tree.prefixes):
        while v:
            top = head[v]
            reach = length[v]
            segments = chains.get(top)
            if segments is None:
                chains[top] = [(reach, i)]
            else:
                # Segments are (longest suffix, last end), the one nearest to the root on top.
                while segments:
                    longest, end = segments[-1]
                    if longest > reach:
                        longest = reach
                    else:
                        segments.pop()
                    d = i - end
                    if longest >= spans * d and longest + d >= least and ends.get(d, 0) <= i:
                        extended(end - longest + 1, i + 1, d)
                    if longest == reach:
                        break
                segments.append((reach, i))
            v = link[top]
    return found


def stretches(codes: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int]]:
    """Disjoint stretches (start, end) that hold all runs whole; most texts have none.

    Every word of a run is there as often as the run has whole periods, and every gram of up to
    a third of its words twice. So a run never crosses a word that is too rare in its stretch,
    or one that no repeated gram covers; what such words leave is narrowed anew.
    """
    k = min(GRAM, least // 3)
    out, todo = [], [(0, len(codes), 0)]
    with np.errstate(over="ignore"):
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    while todo:
        low, high, rounds = todo.pop()
        if high - low < least:
            continue
        part = codes[low:high]
        names, inverse, counts = np.unique(part, return_inverse=True, return_counts=True)
        good = counts[inverse] >= periods
        grams, span = mixed[low:high], 1
        with np.errstate(over="ignore"):
            while span < k:
                step = min(span, k - span)
                grams = grams[: len(grams) - step] * np.uint64(0xD6E8FEB86659FD93) + grams[step:]
                grams = grams ^ (grams >> np.uint64(32))
                span += step
        order = np.argsort(grams, kind="stable")
        same = grams[order[1:]] == grams[order[:-1]]
        twice = np.zeros(len(grams), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        if not twice.any():
            continue
        edge = np.zeros(len(part) + 1, dtype=np.int64)
        at = np.flatnonzero(twice)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + k, -1)
        good &= np.cumsum(edge[:-1]) > 0
        steps = np.flatnonzero(np.diff(np.concatenate([[0], good.view(np.int8), [0]])))
        for a, b in zip(steps[::2].tolist(), steps[1::2].tolist(), strict=True):
            if b - a == high - low or rounds == ROUNDS:
                out.append((low + a, low + b))
            else:
                todo.append((low + a, low + b, rounds + 1))
    return [s for s in out if s[1] - s[0] >= least]


def runs_of(words: list[bytes], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[Run]:
    """All runs of a sequence of words: (start, length, smallest period), by start, then period.

    A run has ``least`` words and ``periods`` periods at least; ``periods`` is 2 or more, and
    ``least`` is 3 or more.
    """
    if len(words) < least:
        return []
    numbers: dict[bytes, int] = {}
    codes = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    if periods < 3:
        parts = [(0, len(codes))]
    else:
        parts = stretches(codes, least, periods)
    found = []
    for low, high in parts:
        _, own = np.unique(codes[low:high], return_inverse=True)
        found += [(low + s, m, q) for s, m, q in _runs_of(own.tolist(), least, periods)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """Without the words that some run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length / period; ties: smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def looped(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """A tenth of all documents repeat themselves from some word on, as their ids have it."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + j % p] for j in range(n - a))]


def as_is(words: list[bytes], doc_id: int | None) -> list[bytes]:
    return words


def _words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space."""
    return text.split() if text else []


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    for at in range(0, batch.num_rows, 500):
        part = batch.slice(at, 500)
        yield part, part["text"].cast(pa.binary()).to_pylist()


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """One row per run: doc_id, start, length, period (in words, from 0) and its words.

    Rows are read one by one, so nothing is shuffled. Null, empty and short texts have no runs;
    repeated rows give theirs each; a null doc_id stays null; other columns are not read; an
    empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _texts(batch):
                rows = []
                for doc_id, text in zip(part["doc_id"].to_pylist(), texts, strict=True):
                    words = _words(text)
                    for start, length, period in runs_of(words, least, periods):
                        unit = b" ".join(words[start : start + period]).decode()
                        rows.append((doc_id, start, length, period, unit))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                columns = zip(*rows, strict=True) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                    names=["doc_id", "start", "length", "period", "unit"],
                )

    schema = "doc_id long, start long, length long, period long, unit string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def collapsed(docs: DataFrame, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """``docs`` with each run cut to its first period; texts without runs stay byte for byte.

    A text with runs becomes its kept words joined by one space. All other columns stay, whatever
    their names; null and empty texts, repeated rows and an empty table stay as they are.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column(at).cast(pa.binary()).to_pylist():
                words = _words(text)
                runs = runs_of(words, least, periods)
                texts.append(b" ".join(kept_words(words, runs)) if runs else text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return plain.mapInArrow(run, plain.schema).toDF(*names)


def run_digests(
    docs: DataFrame, edit: Callable[[list[bytes], int | None], list[bytes]] = as_is
) -> DataFrame:
    """One row per document: doc_id, n_runs, its strongest run, digests of its runs and kept words.

    ``edit`` may change the words before. Null, empty and short texts have no run: start, length,
    period and exponent_milli are null and the digests those of what there is. Repeated rows
    count each; a null doc_id stays null and is never edited; other columns are not read; an
    empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _texts(batch):
                rows = []
                ids = part["doc_id"]
                for doc_id, text in zip(ids.to_pylist(), texts, strict=True):
                    words = edit(_words(text), doc_id)
                    runs = runs_of(words)
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                    start, length, period = strongest(runs) or (None, None, None)
                    rows.append(
                        (
                            len(runs),
                            start,
                            length,
                            period,
                            1000 * length // period if runs else None,
                            hashlib.sha256(listed.encode()).hexdigest(),
                            hashlib.sha256(b" ".join(kept_words(words, runs))).hexdigest(),
                        )
                    )
                columns = zip(*rows, strict=True) if rows else [()] * 7
                kinds = [pa.int64()] * 5 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                    names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
                )

    schema = (
        "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string"
    )
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
